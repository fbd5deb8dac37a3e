"""URL filter with redirect equivalence, on DataFrame functions only.

Pages point at others by ``<link rel=canonical>``, by ``<meta http-equiv=refresh>`` and by the rows of an
optional redirects table. URLs that these edges connect are aliases. A page that no rule fits takes its
component's decision: allow if any alias is allowed explicitly, else block if any is blocked, else the
default. A page's own rule always wins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulon.llm.common import Scratch
from tabulon.llm.components import connected_components

#: (verdict, host, path) of the rules of the registered query.
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_LINK = r"(?is)<link\b(?=[^>]*\brel\s*=\s*[\"']?canonical\b)[^>]*\bhref\s*=\s*[\"']?([^\"'\s>]+)"
_REFRESH = r"(?is)<meta\b(?=[^>]*\bhttp-equiv\s*=\s*[\"']?refresh\b)[^>]*\bcontent\s*=\s*[\"']?\s*[0-9.]*\s*;\s*url\s*=\s*[\"']?([^\"'\s>]+)"


def host_of(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_index(host: Column, path: Column, rules) -> Column:
    """Number of the longest rule (host plus path, then the host) that fits, null if none does."""
    found = F.lit(None).cast("int")
    for i in sorted(range(len(rules)), key=lambda i: (len(rules[i][1]) + len(rules[i][2]), len(rules[i][1]))):
        _, h, p = rules[i]
        found = F.when(((host == h) | host.endswith("." + h)) & path.startswith(p), F.lit(i)).otherwise(found)
    return found


def node_of(url: Column) -> Column:
    """A URL as a node: scheme and host lower-cased, no fragment, ``/`` for an empty path; null without a host."""
    scheme = F.translate(F.regexp_extract(url, r"(?s)^(.*?)://", 1), _UPPER, _LOWER)
    query = F.regexp_extract(url, r"(?s)^[^?#]*(\?[^#]*)", 1)
    path = path_of(url)
    return F.when(host_of(url) != "", F.concat(scheme, F.lit("://"), host_of(url), F.when(path == "", F.lit("/")).otherwise(path), query))


def resolve(base: Column, link: Column) -> Column:
    """A link of a page made absolute: with a scheme, of the scheme (//), of the host (/) or of the folder."""
    link = F.trim(F.replace(link, F.lit("&amp;"), F.lit("&")))
    scheme, host = F.regexp_extract(base, r"(?s)^(.*?)://", 1), F.regexp_extract(base, r"(?s)^(.*?://[^/?#]*)", 1)
    folder = F.regexp_extract(path_of(base), r"(?s)^(.*/)", 1)
    return (
        F.when((link == "") | link.startswith("#"), F.lit(None))
        .when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), link)
        .when(link.startswith("//"), F.concat(scheme, F.lit(":"), link))
        .when(link.startswith("/"), F.concat(host, link))
        .when(link.startswith("?"), F.concat(host, path_of(base), link))
        .otherwise(F.concat(host, F.when(folder == "", F.lit("/")).otherwise(folder), link))
    )


def link_edges(pages: DataFrame) -> DataFrame:
    """(u, v): a page's node and the node that its canonical link or refresh names."""
    low = F.lower("html")
    links = F.array(
        F.when(low.contains("canonical"), F.regexp_extract("html", _LINK, 1)),
        F.when(low.contains("http-equiv"), F.regexp_extract("html", _REFRESH, 1)),
    )
    out = pages.select("url", F.explode(links).alias("link")).where("link <> ''")
    return out.select(node_of(F.col("url")).alias("u"), node_of(resolve(F.col("url"), F.col("link"))).alias("v")).where("u <> v")


def filter_urls(pages: DataFrame, rules=RULES, redirects: DataFrame | None = None, default: str = "allow") -> DataFrame:
    """(page_id, host, path, rule, verdict) for each row of pages (page_id, url, html).

    redirects: optional (url, target). Null urls and urls without ``://`` have an empty host and path, fit
    no rule and have no aliases. A null html has no links. Repeated rows are judged alike. An empty table
    gives an empty one. Only nodes with a link are grouped: pages meet the labels in a join on the
    node, whose large partitions adaptive execution can split.
    """
    scratch = Scratch(pages.sparkSession, "urls")
    edges = link_edges(pages.select("url", "html"))
    if redirects is not None:
        edges = edges.union(redirects.select(node_of(F.col("url")).alias("u"), node_of(F.col("target")).alias("v")).where("u <> v"))
    labels = connected_components(edges, scratch)
    index = rule_index(F.col("host"), F.col("path"), rules)
    pick = lambda i, k: F.when(i.isNotNull(), F.element_at(F.array(*(F.lit(x) for x in k)), i + 1))
    name = lambda i: pick(i, [r[1] + r[2] for r in rules])
    says = lambda i: pick(i, [r[0] for r in rules])
    own = pages.select("page_id", "url").select("page_id", node_of(F.col("url")).alias("node"), host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")).withColumn("i", index)
    alias = labels.select("node", "comp").withColumn("host", host_of(F.col("node"))).withColumn("path", path_of(F.col("node"))).withColumn("says", says(index))
    group = alias.groupBy("comp").agg(F.bool_or(F.col("says") == "allow").alias("allowed"), F.bool_or(F.col("says") == "block").alias("blocked"))
    group = scratch.write(group, "groups")
    told = scratch.write(labels.join(group, "comp").select("node", F.when(F.col("allowed"), "allow").when(F.col("blocked"), "block").alias("told")), "told")
    own = own.join(told, "node", "left")
    return own.select(
        "page_id", "host", "path", name(F.col("i")).alias("rule"),
        F.coalesce(says(F.col("i")), F.col("told"), F.lit(default)).alias("verdict"),
    )
