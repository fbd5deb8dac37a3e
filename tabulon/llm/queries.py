"""Registered queries of the training-data operators, over whole tables, and the SQL of those that SQL expresses."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulon.llm.decontamination import find_leaks
from tabulon.llm.embedding_dedup import near_vectors
from tabulon.llm.fingerprints import edit_chain
from tabulon.llm.jaccard_join import jaccard_components
from tabulon.llm.language_id import held_out, identify
from tabulon.llm.lexical_search import search
from tabulon.llm.mixing import mix_documents
from tabulon.llm.pii import find_personal_data
from tabulon.llm.resampling import draw_ranks
from tabulon.llm.sharding import shard_documents
from tabulon.llm.token_counts import maintained_counts
from tabulon.llm.url_filter import filter_urls
from tabulon.llm.warc import archive_pages


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    removed = _table(spark, sf_dir, "labels").where("toxic = 1")
    return maintained_counts(_table(spark, sf_dir, "documents"), removed)


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_pages(_table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(_table(spark, sf_dir, "documents"), 8)


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(_table(spark, sf_dir, "documents"), 3, 90, 100)


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_documents(_table(spark, sf_dir, "documents"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    docs = docs.select("doc_id", "text", "lang", held_out(F.col("doc_id")).alias("held_out"))
    out = identify(docs.select("doc_id", "held_out", "text"), docs.where("NOT held_out AND lang IS NOT NULL"))
    return out.select("doc_id", "held_out", "language.lang_pred", "language.score")


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_personal_data(_table(spark, sf_dir, "documents"))


def op9_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(_table(spark, sf_dir, "embeddings"))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(_table(spark, sf_dir, "pages"))


def op11_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return draw_ranks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op12_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edit_chain(_table(spark, sf_dir, "documents"))


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_counts": op1_token_counts,
    "op2_warc": op2_warc,
    "op3_sharding": op3_sharding,
    "op4_jaccard_join": op4_jaccard_join,
    "op5_mixing": op5_mixing,
    "op6_decontamination": op6_decontamination,
    "op7_language_id": op7_language_id,
    "op8_pii": op8_pii,
    "op9_embedding_dedup": op9_embedding_dedup,
    "op10_url_filter": op10_url_filter,
    "op11_resampling": op11_resampling,
    "op12_fingerprints": op12_fingerprints,
    "op13_lexical_search": op13_lexical_search,
}

SQL: dict[str, str] = {
    "op1_token_counts": r"""
        WITH revised AS (SELECT doc_id, source, lang, REGEXP_REPLACE(text, '[0-9]+', '', 'g') AS text FROM documents)
        SELECT source, lang, tokenizer, CAST(COUNT(*) AS BIGINT) AS docs, CAST(SUM(n) AS BIGINT) AS tokens
        FROM (
            SELECT source, lang, 'words-1' AS tokenizer, COALESCE(LEN(REGEXP_EXTRACT_ALL(text, '[^\x20\x09-\x0D]+')), 0) AS n, doc_id FROM revised
            UNION ALL
            SELECT source, lang, 'bytes-1' AS tokenizer, COALESCE(STRLEN(text), 0) AS n, doc_id FROM revised
        )
        WHERE doc_id IS NULL OR doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1 AND doc_id IS NOT NULL)
        GROUP BY source, lang, tokenizer
    """,
    "op2_warc": """
        WITH p AS (SELECT page_id, COALESCE(html, '') AS h FROM pages),
        m AS (SELECT page_id, h, SHA1(h) AS x, MAX(page_id) OVER (PARTITION BY h) AS last FROM p),
        d AS (
            SELECT page_id, h, last, ARRAY_TO_STRING(LIST_TRANSFORM(RANGE(32), lambda i: SUBSTR('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                CAST((CAST('0x' || SUBSTR(x, CAST(i // 4 * 5 + 1 AS INTEGER), 5) AS BIGINT) >> CAST(15 - i % 4 * 5 AS INTEGER)) & 31 AS INTEGER) + 1, 1)), '') AS payload_digest
            FROM m
        )
        SELECT page_id, CAST(STRLEN(h) AS BIGINT) AS payload_bytes, payload_digest, CASE WHEN page_id < last THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id < last THEN last END AS refers_to
        FROM d
    """,
    "op4_jaccard_join": r"""
        WITH RECURSIVE texts AS (
            SELECT doc_id, COALESCE(REGEXP_EXTRACT_ALL(TRANSLATE(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS w FROM documents
        ),
        windows AS (SELECT doc_id, UNNEST(w) AS a, UNNEST(w[2:]) AS b, UNNEST(w[3:]) AS c FROM texts),
        sets AS MATERIALIZED (
            SELECT DISTINCT doc_id, a || ' ' || b || ' ' || c AS shingle FROM windows WHERE c IS NOT NULL
            UNION ALL
            SELECT doc_id, ARRAY_TO_STRING(w, ' ') FROM texts WHERE LEN(w) BETWEEN 1 AND 2
        ),
        sizes AS MATERIALIZED (SELECT doc_id, COUNT(*) AS n FROM sets GROUP BY doc_id),
        pairs AS (SELECT a.doc_id AS u, b.doc_id AS v, COUNT(*) AS shared FROM sets a JOIN sets b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
        links AS MATERIALIZED (
            SELECT u, v FROM pairs JOIN sizes x ON x.doc_id = u JOIN sizes y ON y.doc_id = v WHERE 100 * shared >= 90 * (x.n + y.n - shared)
        ),
        reach AS (SELECT doc_id AS u, doc_id AS v FROM documents UNION SELECT reach.u, links.v FROM reach JOIN links ON reach.v = links.u)
        SELECT doc_id, COALESCE(n, 0) AS n_shingles, component_id
        FROM (SELECT u AS doc_id, MIN(v) AS component_id FROM reach GROUP BY u) LEFT JOIN sizes USING (doc_id)
    """,
    "op9_embedding_dedup": """
        WITH RECURSIVE vectors AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
        sound AS MATERIALIZED (
            SELECT * FROM vectors
            WHERE label IS NOT NULL AND LEN(LIST_FILTER(e, lambda x: x <> 0)) > 0 AND LEN(LIST_FILTER(e, lambda x: x IS NULL OR NOT ISFINITE(x))) = 0
        ),
        links AS MATERIALIZED (
            SELECT a.vec_id AS u, b.vec_id AS v FROM sound a JOIN sound b ON a.label = b.label AND LEN(a.e) = LEN(b.e)
            WHERE a.vec_id <> b.vec_id AND CASE WHEN LEN(a.e) = LEN(b.e) THEN LIST_COSINE_SIMILARITY(a.e, b.e) >= 0.98 END
        ),
        reach AS (SELECT vec_id AS u, vec_id AS v FROM vectors UNION SELECT reach.u, links.v FROM reach JOIN links ON reach.v = links.u)
        SELECT u AS vec_id, COALESCE(n, 0) AS n_links, MIN(v) AS component_id, MIN(v) = u AS kept
        FROM reach LEFT JOIN (SELECT u, COUNT(*) AS n FROM links GROUP BY u) USING (u) GROUP BY u, n
    """,
    "op10_url_filter": r"""
        WITH RECURSIVE rules(says, h, p) AS (
            VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')
        ),
        tags AS (
            SELECT url,
                LIST_FILTER(REGEXP_EXTRACT_ALL(html, '(?is)<link\b[^>]*'), lambda t: REGEXP_MATCHES(t, '(?is)\brel\s*=\s*["'']?canonical\b') AND REGEXP_MATCHES(t, '(?is)\bhref\s*=\s*["'']?[^"''\s>]'))[1] AS canonical,
                LIST_FILTER(REGEXP_EXTRACT_ALL(html, '(?is)<meta\b[^>]*'), lambda t: REGEXP_MATCHES(t, '(?is)\bhttp-equiv\s*=\s*["'']?refresh\b') AND REGEXP_MATCHES(t, '(?is)\bcontent\s*=\s*["'']?\s*[0-9.]*\s*;\s*url\s*=\s*["'']?[^"''\s>]'))[1] AS refresh
            FROM pages
        ),
        named AS (
            SELECT url, TRIM(REPLACE(link, '&amp;', '&'), ' ') AS link,
                REGEXP_EXTRACT(url, '(?s)^(.*?)://', 1) AS scheme, REGEXP_EXTRACT(url, '(?s)^(.*?://[^/?#]*)', 1) AS site, REGEXP_EXTRACT(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path
            FROM (
                SELECT url, REGEXP_EXTRACT(canonical, '(?is)^.*\bhref\s*=\s*["'']?([^"''\s>]+)', 1) AS link FROM tags
                UNION ALL
                SELECT url, REGEXP_EXTRACT(refresh, '(?is)^.*\bcontent\s*=\s*["'']?\s*[0-9.]*\s*;\s*url\s*=\s*["'']?([^"''\s>]+)', 1) FROM tags
            ) WHERE link <> ''
        ),
        targets AS (
            SELECT url, CASE
                WHEN link = '' OR STARTS_WITH(link, '#') THEN NULL
                WHEN REGEXP_MATCHES(link, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN link
                WHEN STARTS_WITH(link, '//') THEN scheme || ':' || link
                WHEN STARTS_WITH(link, '/') THEN site || link
                WHEN STARTS_WITH(link, '?') THEN site || path || link
                ELSE site || COALESCE(NULLIF(REGEXP_EXTRACT(path, '(?s)^(.*/)', 1), ''), '/') || link END AS target
            FROM named
        ),
        urls AS MATERIALIZED (
            SELECT url, COALESCE(TRANSLATE(REGEXP_EXTRACT(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
                COALESCE(REGEXP_EXTRACT(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path,
                CASE WHEN host <> '' THEN TRANSLATE(REGEXP_EXTRACT(url, '(?s)^(.*?)://', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')
                    || '://' || host || COALESCE(NULLIF(path, ''), '/') || REGEXP_EXTRACT(url, '(?s)^[^?#]*(\?[^#]*)', 1) END AS node
            FROM (SELECT url FROM pages UNION SELECT target FROM targets)
        ),
        places AS (SELECT DISTINCT host, path FROM urls UNION SELECT host, '/' FROM urls WHERE host <> ''),
        ruled AS MATERIALIZED (
            SELECT host, path, ARG_MAX(h || p, LENGTH(h || p) * 1000 + LENGTH(h)) AS rule, ARG_MAX(says, LENGTH(h || p) * 1000 + LENGTH(h)) AS says
            FROM places JOIN rules ON (host = h OR ENDS_WITH(host, '.' || h)) AND STARTS_WITH(path, p) GROUP BY host, path
        ),
        edges AS MATERIALIZED (
            SELECT DISTINCT x.node AS u, y.node AS v FROM targets JOIN urls x ON x.url = targets.url JOIN urls y ON y.url = target WHERE x.node <> y.node
        ),
        ways AS (SELECT u, v FROM edges UNION SELECT v, u FROM edges),
        reach AS (SELECT u, v FROM ways UNION SELECT reach.u, ways.v FROM reach JOIN ways ON reach.v = ways.u),
        spots AS (SELECT DISTINCT node, host, COALESCE(NULLIF(path, ''), '/') AS path FROM urls),
        told AS (
            SELECT u, CASE WHEN BOOL_OR(says = 'allow') THEN 'allow' WHEN BOOL_OR(says = 'block') THEN 'block' END AS told
            FROM reach JOIN spots ON node = v LEFT JOIN ruled USING (host, path) GROUP BY u
        )
        SELECT page_id, host, path, rule, COALESCE(says, told, 'allow') AS verdict
        FROM pages p JOIN urls ON urls.url IS NOT DISTINCT FROM p.url LEFT JOIN ruled USING (host, path) LEFT JOIN told ON u = node
    """,
    "op11_resampling": r"""
        WITH table_ AS (
            SELECT LIST_TRANSFORM(RANGE(256), lambda x: LIST_REDUCE(RANGE(8), lambda c, i: CASE WHEN c & 1 = 1 THEN XOR(c >> 1, 3988292384) ELSE c >> 1 END, x)) AS crc
        ),
        words AS (
            SELECT 's' AS side, doc_id, UNNEST(REGEXP_EXTRACT_ALL(TRANSLATE(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word FROM documents
            UNION ALL
            SELECT 't', item_id, UNNEST(REGEXP_EXTRACT_ALL(TRANSLATE(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) FROM benchmark
        ),
        spelt AS (SELECT word, HEX(ENCODE(word)) AS h FROM (SELECT DISTINCT word FROM words)),
        buckets AS (
            SELECT word, XOR(LIST_REDUCE(LIST_TRANSFORM(RANGE(CAST(LENGTH(h) // 2 AS BIGINT)), lambda i: CAST(CAST('0x' || SUBSTR(h, CAST(2 * i + 1 AS INTEGER), 2) AS INTEGER) AS BIGINT)),
                lambda c, b: XOR(c >> 8, crc[CAST(XOR(c, b) & 255 AS INTEGER) + 1]), CAST(4294967295 AS BIGINT)), 4294967295) % 10000 AS bucket
            FROM spelt, table_
        ),
        counts AS (SELECT bucket, COUNT(*) FILTER (side = 's') AS s, COUNT(*) FILTER (side = 't') AS t FROM words JOIN buckets USING (word) GROUP BY bucket),
        totals AS (SELECT CAST(SUM(s) AS DOUBLE) AS s_all, CAST(SUM(t) AS DOUBLE) AS t_all FROM counts),
        gains AS (SELECT bucket, CAST(FLOOR(1000 * LN((t + 1) * (s_all + 10000) / ((s + 1) * (t_all + 10000)))) AS BIGINT) AS gain FROM counts, totals),
        weights AS (
            SELECT doc_id, COUNT(*) AS n_features, SUM(gain) AS total
            FROM words JOIN buckets USING (word) JOIN gains USING (bucket) WHERE side = 's' GROUP BY doc_id
        ),
        scores AS (
            SELECT d.doc_id, COALESCE(n_features, 0) AS n_features, CAST(COALESCE(FLOOR(total / n_features), 0) AS BIGINT) AS weight,
                CAST(FLOOR(-1000 * LN(-LN((CAST('0x' || SUBSTR(SHA256('2024:' || d.doc_id), 1, 8) AS BIGINT) + 0.5) / 4294967296))) AS BIGINT) AS noise
            FROM documents d LEFT JOIN weights w ON d.doc_id = w.doc_id
        ),
        places AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY n_features >= 20 ORDER BY weight + noise DESC, doc_id) AS place, COUNT(*) OVER (PARTITION BY n_features >= 20) AS n FROM scores)
        SELECT doc_id, CAST(n_features AS BIGINT) AS n_features, weight, weight + noise AS score,
            CASE WHEN n_features >= 20 AND place <= 10 * n // 100 THEN place END AS rank
        FROM places
    """,
    "op13_lexical_search": r"""
        WITH words AS (
            SELECT doc_id, UNNEST(REGEXP_EXTRACT_ALL(TRANSLATE(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents
        ),
        wanted AS (
            SELECT DISTINCT item_id, UNNEST(REGEXP_EXTRACT_ALL(TRANSLATE(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark
        ),
        sizes AS (SELECT doc_id, COUNT(*) AS n FROM words GROUP BY doc_id),
        totals AS (SELECT COUNT(*) AS n_all, CAST(SUM(n) AS BIGINT) AS l_all FROM sizes),
        held AS (SELECT doc_id, term, COUNT(*) AS tf FROM words GROUP BY doc_id, term),
        weights AS (SELECT term, CAST(FLOOR(1000 * LN((2 * n_all + 2) / (2 * COUNT(*) + 1))) AS BIGINT) AS w FROM held, totals GROUP BY term, n_all),
        impacts AS (
            SELECT doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * n_all) // l_all))) AS impact
            FROM held JOIN sizes USING (doc_id) JOIN weights USING (term), totals
        ),
        scores AS (SELECT item_id, doc_id, CAST(SUM(impact) AS BIGINT) AS score FROM wanted JOIN impacts USING (term) GROUP BY item_id, doc_id),
        places AS (SELECT *, CAST(ROW_NUMBER() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM scores WHERE score > 0)
        SELECT item_id, rank, doc_id, score FROM places WHERE rank <= 10
    """,
}
