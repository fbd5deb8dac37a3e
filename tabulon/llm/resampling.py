"""Importance resampling of documents towards a target distribution.

Features (runs of words) are hashed to buckets. Counts of the buckets in all documents and in all target
texts give every bucket an integer gain, the logarithm of its ratio; a document's weight is the floored mean
of the gains over its features, looked up in one array. Seeded Gumbel noise turns the best scores into a draw
without replacement. Scores are integers, so their exact histogram has a bounded number of rows: its suffix
sums say how many documents rank before each score and which score is the last one drawn, and only rows of
surviving scores are numbered, each score by itself.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabulon.llm.common import Scratch, fresh, word_lists

#: Rows of one score that a task numbers, about.
SCORE_ROWS = 1_000_000


def bucket_lists(text: bytes, longest: int, buckets: int) -> Iterator[tuple[np.ndarray, int]]:
    """Buckets of the features of a whole text, a stretch of words at a time, and how many words each stretch has."""
    before: list[bytes] = []
    for words in word_lists(text):
        found = list(map(crc32, words))
        line = before + words
        for n in range(2, longest + 1):
            first = max(0, len(before) - n + 1)
            found += [crc32(b" ".join(line[i : i + n])) for i in range(first, len(line) - n + 1)]
        yield np.array(found, np.int64) % buckets, len(words)
        before = line[len(line) - longest + 1 :] if longest > 1 else []


def bucket_counts(texts: DataFrame, longest: int, buckets: int) -> np.ndarray:
    """How often each bucket occurs in a table's column ``text``; ``buckets`` numbers come to the driver, whatever the table's size."""

    def count(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(buckets, np.int64)
        for b in batches:
            for text in b["text"]:
                for found, _ in bucket_lists(text, longest, buckets):
                    total += np.bincount(found, minlength=buckets)
        have = np.flatnonzero(total)
        yield pd.DataFrame({"bucket": have, "n": total[have]})

    rows = texts.where("text IS NOT NULL").select(F.col("text").cast("binary").alias("text"))
    out = np.zeros(buckets, np.int64)
    for r in rows.mapInPandas(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r.bucket] = r.n
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln) of each bucket's smoothed share in the target over that in the source."""
    s, t, k = source.astype(np.float64), target.astype(np.float64), len(source)
    return np.floor(1000 * np.log((t + 1) * (s.sum() + k) / ((s + 1) * (t.sum() + k)))).astype(np.int64)


def _weights(gain: np.ndarray, longest: int):
    @F.pandas_udf("words long, n_features long, weight long")
    def weigh(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for text in b:
                words = n = total = 0
                for found, own in bucket_lists(text or b"", longest, len(gain)):
                    words, n, total = words + own, n + len(found), total + int(gain[found].sum())
                rows.append((words, n, total // n if n else 0))
            yield pd.DataFrame(rows, columns=["words", "n_features", "weight"])

    return weigh


def noise(doc_id: Column, seed: int) -> Column:
    """floor(-1000 ln(-ln u)), u from the first 8 hex digits of sha256 of ``seed:doc_id`` (a null id counts as empty)."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name.cast("binary"), 256), 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0)))).cast("long")


def scored(docs: DataFrame, target: DataFrame, longest: int = 1, buckets: int = 10000, seed: int = 2024, name: str = "draw") -> DataFrame:
    """docs with a column ``name``: words, n_features, weight, score.

    Counts cover all rows of docs and target, repeated rows each. A null or wordless text has no feature and
    weight 0; an empty target or empty docs give gains from the other side alone. A column of docs that is called
    ``name`` is replaced.
    """
    Scratch(docs.sparkSession, "resampling")
    gain = gains(bucket_counts(docs, longest, buckets), bucket_counts(target, longest, buckets))
    got = fresh(docs.columns, "got")
    out = docs.withColumn(got, _weights(gain, longest)(F.col("text").cast("binary")))
    score = F.col(f"{got}.weight") + noise(F.col("doc_id"), seed)
    return out.withColumn(name, F.struct(f"{got}.words", f"{got}.n_features", f"{got}.weight", score.alias("score"))).drop(got)


def ranked(rows: DataFrame, part: int, whole: int, least_words: int = 20, name: str = "draw") -> DataFrame:
    """rows of ``scored`` with rank in the struct: 1, 2, 3... of the floor(part * N / whole) best scores of the N rows with enough words, else null.

    Equal scores go by doc_id, a null id last; repeated rows take a rank each. rows is read twice, so give a written
    table. A score is an integer within some 60 units of 1000 whatever the number of documents, so the histogram that
    the driver holds is bounded. Scores with very many rows are numbered in several ranges of doc_id.
    """
    at = lambda c: F.col(f"{name}.{c}")
    able = at("words") >= least_words
    counts = {r.score: r.n for r in rows.where(able).groupBy(at("score").alias("score")).agg(F.count(F.lit(1)).alias("n")).collect()}
    quota, before, left = sum(counts.values()) * part // whole, {}, 0
    for s in sorted(counts, reverse=True):
        if left >= quota:
            break
        before[s], left = left, left + counts[s]
    bare = rows.withColumn(name, F.struct(at("words"), at("n_features"), at("weight"), at("score"), F.lit(None).cast("long").alias("rank")))
    if not before:
        return bare
    cutoff, names = min(before), list(rows.columns)
    block, start = fresh(names, "block"), fresh(names, "start")
    alive = able & (at("score") >= cutoff)
    splits = -(-max(counts[s] for s in before) // SCORE_ROWS)
    bounds = rows.where(alive).approxQuantile("doc_id", [i / splits for i in range(1, splits)], 0.1 / splits) if splits > 1 else []
    cut = F.lit(len(bounds)) if not bounds else F.when(F.col("doc_id").isNull(), len(bounds)).otherwise(sum((F.col("doc_id") >= F.lit(int(b))).cast("int") for b in bounds))
    live = rows.where(alive).withColumn(block, cut)
    if bounds:  # at most one row for each score and range
        sizes = live.groupBy(at("score").alias("score"), block).agg(F.count(F.lit(1)).alias("n")).collect()
        offsets, run = [], dict(before)
        for s, b, n in sorted((r.score, r[block], r.n) for r in sizes):
            offsets.append((s, b, run[s]))
            run[s] += n
    else:
        offsets = [(s, 0, n) for s, n in before.items()]
    score = fresh([*names, block, start], "own_score")
    table = F.broadcast(rows.sparkSession.createDataFrame(offsets, f"`{score}` long, `{block}` int, `{start}` long"))
    own = Window.partitionBy(score, block).orderBy(F.col("doc_id").asc_nulls_last(), at("weight"), at("n_features"))
    rank = F.col(start) + F.row_number().over(own)
    kept = live.withColumn(score, at("score")).join(table, [score, block])
    kept = kept.withColumn(start, rank).withColumn(name, F.struct(at("words"), at("n_features"), at("weight"), at("score"), F.when(F.col(start) <= quota, F.col(start)).cast("long").alias("rank")))
    return bare.where(~F.coalesce(alive, F.lit(False))).unionByName(kept.select(*bare.columns))


def resampled(docs: DataFrame, target: DataFrame, part: int = 10, whole: int = 100, **how) -> DataFrame:
    """The drawn documents, whole rows, best first within the struct's rank; texts are scored twice rather than written."""
    return ranked(scored(docs, target, **how), part, whole).where("draw.rank IS NOT NULL")


def draw_ranks(docs: DataFrame, target: DataFrame) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of each row of docs; a tenth of those with 20 words is drawn."""
    rows = Scratch(docs.sparkSession, "resampling").write(scored(docs.select("doc_id", "text"), target).select("doc_id", "draw"), "scores")
    return ranked(rows, 10, 100).select("doc_id", "draw.n_features", "draw.weight", "draw.score", "draw.rank")
