"""The dictionary of like fields: every field's card goes to the first group, in order, whose first card it is like.

The rule is sequential: cards come in order; a card joins the earliest group that has a like name, a compatible profile and
no card of the same sheet yet, else the group of its own name, else it leads a new group of that name. Here the rule is a
fixed point of joins over all cards that aren't settled: a card is settled as soon as nothing before it that isn't settled could
change its choice, so cards of different names and sheets settle side by side, and all fields of one name at once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulon.functions import scalar as S
from tabulon.operators.catalog import FIELD, SAME_KIND, SAME_NAME, compatibility
from tabulon.tables import cut, discard

#: What the profile of a card says to ``compatibility``.
PROFILE = ("n", "magnitude", "percent_like", "whole")
_EDITS = int(100 - SAME_NAME)  # letters put in or left out, in percent of both lengths


def similar_names(names: DataFrame) -> DataFrame:
    """(a, b, ratio) of all pairs of different names with a ratio of SAME_NAME or more, a the shorter one (of equal lengths, the smaller).

    names has a column ``name``; nulls go, repeated names count once. Names that are so alike differ by k letters at most, so
    of k + 1 parts of the shorter one a part stands whole in the longer one, shifted by k places at most: names meet by the
    content of such parts, their place and the length, and only those that meet are compared.
    """
    rows = names.select(F.col("name").alias("b"), F.length("name").alias("n")).where("b IS NOT NULL").distinct()
    longest = F.floor(F.col("m") * (100 + _EDITS) / (100 - _EDITS)).cast("int")
    parts = (F.floor((F.col("m") + longest) * _EDITS / 100) + 1).cast("int")
    start = lambda i: F.floor(i * F.col("m") / F.col("parts")).cast("int")
    own = rows.select(F.col("b").alias("a"), F.col("n").alias("m")).withColumn("parts", parts).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    own = own.select("a", "m", "part", F.expr("substring(a, cast(floor(part * m / parts) as int) + 1, cast(floor((part + 1) * m / parts) as int) - cast(floor(part * m / parts) as int))").alias("content"))
    least = F.ceil(F.col("n") * (100 - _EDITS) / (100 + _EDITS)).cast("int")
    far = rows.withColumn("m", F.explode(F.sequence(least, F.col("n")))).withColumn("parts", parts)
    far = far.withColumn("lost", ((F.floor((F.col("m") + F.col("n")) * _EDITS / 100) - (F.col("n") - F.col("m"))) / 2).cast("int"))
    far = far.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).withColumns({"from": start(F.col("part")), "size": start(F.col("part") + 1) - start(F.col("part"))})
    far = far.withColumn("at", F.explode(F.sequence(F.col("from") - F.col("lost"), F.col("from") + F.col("lost") + F.col("n") - F.col("m"))))
    far = far.where("at >= 0 AND at + size <= n").select("b", "n", "m", "part", F.expr("substring(b, at + 1, size)").alias("content"))
    met = own.join(far, ["m", "part", "content"]).where((F.col("m") < F.col("n")) | (F.col("a") < F.col("b"))).select("a", "b").distinct()
    return met.withColumn("ratio", S.indel_ratio(F.col("a"), F.col("b"))).where(F.col("ratio") >= SAME_NAME)


def _kind(profile: Column) -> Column:
    return F.struct(*(profile[c].alias(c) if c != "n" else (F.coalesce(profile[c], F.lit(0)) > 0).alias("known") for c in PROFILE))


def _like(a: Column, b: Column) -> Column:
    """Whether kinds of profiles fit; one without values fits all."""
    return ~a["known"] | ~b["known"] | (F.coalesce(compatibility(a, b), F.lit(0.0)) >= SAME_KIND)


def _settle(left: DataFrame, done: DataFrame, edges: DataFrame) -> DataFrame:
    """left (turn, name, kind, file, sheet) with key, null for cards that have to wait, and leads.

    done: settled cards with key and leads. edges: (name, kind, other, other_kind, fits) of like names, each name with itself.
    """
    leaders = done.where("leads").select(F.col("key").alias("other"), F.col("kind").alias("other_kind"), F.col("turn").alias("since"))
    first = left.join(leaders, left["name"] == leaders["other"], "left_anti").groupBy(F.col("name").alias("other"), F.col("kind").alias("other_kind")).agg(F.min("turn").alias("open"))
    waits = edges.join(first, ["other", "other_kind"]).groupBy("name", "kind").agg(F.min("open").alias("open"))
    groups = edges.join(leaders, ["other", "other_kind"]).select("name", "kind", F.col("other").alias("key"), "since", "fits")
    options = left.join(groups, ["name", "kind"]).where(F.col("since") < F.col("turn"))
    used = done.groupBy("file", "sheet", "key").agg(F.min("turn").alias("used"))
    rival = options.groupBy("file", "sheet", "key").agg(F.min("turn").alias("rival"))
    seats = used.join(rival, ["file", "sheet", "key"], "full")
    free = F.col("fits") & F.coalesce(F.col("used") > F.col("turn"), F.lit(True))
    best = options.join(seats, ["file", "sheet", "key"], "left").groupBy("turn").agg(
        F.min(F.when(free, F.struct("since", "key", (F.col("rival") == F.col("turn")).alias("clear")))).alias("best"),
        F.max(F.when(F.col("key") == F.col("name"), F.col("key"))).alias("own"),
    )
    rows = left.join(best, "turn", "left").join(waits, ["name", "kind"], "left")
    sure = F.col("best.clear") & F.coalesce(F.col("best.since") < F.col("open"), F.lit(True))
    alone = F.col("best").isNull() & F.coalesce(F.col("open") >= F.col("turn"), F.lit(True))
    key = F.when(sure, F.col("best.key")).when(alone, F.coalesce("own", "name"))
    return rows.select(*left.columns, key.alias("key"), (alone & F.col("own").isNull()).alias("leads"))


def field_dictionary(cards: DataFrame, order: tuple[str, ...] = FIELD) -> DataFrame:
    """cards with ``field``, the group that each belongs to; the group's name is the canonical name of its first card in ``order``.

    cards: file, sheet, canonical, profile and the columns of order, as ``catalog.field_cards`` gives them; cards that are equal in
    all of order are taken by a hash of the row, and repeated rows as one. Null names are a group of their own. An empty table gives
    none. Only the number of rounds comes to the driver: at most as many as there are links in the longest chain of cards that wait
    for each other.
    """
    whole = F.xxhash64(*(F.col(f"`{c}`") for c in cards.columns))
    keyed = cards.withColumn("_turn", F.struct(*(F.col(c) for c in order), whole.alias("_hash")))
    rows = cut(keyed.select(F.col("_turn").alias("turn"), F.coalesce(F.concat(F.lit("="), "canonical"), F.lit("")).alias("name"), _kind(F.col("profile")).alias("kind"), F.coalesce("file", F.lit("")).alias("file"), F.coalesce("sheet", F.lit("")).alias("sheet")).distinct())
    kinds = rows.select("name", "kind").distinct()
    pairs = similar_names(kinds.select(F.expr("substring(name, 2)").alias("name")).where("name <> ''")).select(*(F.concat(F.lit("="), x).alias(x) for x in ("a", "b")))
    both = pairs.union(pairs.select("b", "a")).union(kinds.select("name", F.col("name").alias("b")).distinct())
    other = kinds.select(F.col("name").alias("other"), F.col("kind").alias("other_kind"))
    edges = kinds.join(both, F.col("name") == F.col("a")).join(other, F.col("b") == F.col("other")).select("name", "kind", "other", "other_kind", _like(F.col("kind"), F.col("other_kind")).alias("fits"))
    edges = cut(edges.where(F.col("fits") | (F.col("name") == F.col("other"))))
    left, done = rows, cut(rows.where("false").withColumns({"key": F.lit(""), "leads": F.lit(False)}))
    old = []
    while True:
        now = cut(_settle(left, done, edges))
        before, done = done, cut(done.unionByName(now.where("key IS NOT NULL")))
        left = now.where("key IS NULL").select(*rows.columns)
        discard(before, *old)
        old = [now]
        if left.isEmpty():
            break
    discard(edges, now)
    field = F.when(F.col("key") != "", F.expr("substring(key, 2)"))
    found = done.select(F.col("turn").alias("_of"), field.alias("field"))
    return keyed.join(found, F.col("_turn").eqNullSafe(F.col("_of"))).select(*cards.columns, "field")


def like_fields(named: DataFrame) -> DataFrame:
    """(field, files, sheets, cards): groups of ``field_dictionary`` and how far they reach."""
    return named.groupBy("field").agg(F.count_distinct("file").alias("files"), F.count_distinct("file", "sheet").alias("sheets"), F.count(F.lit(1)).alias("cards"))
