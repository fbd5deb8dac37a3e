"""Ranked lexical search as a blocked product of sparse matrices.

The left matrix holds each item's terms, the right one the impact of each term in each document. Documents are
read once to count (documents, terms, and the documents that hold each item term) and to write what they hold
of the items' terms. Then every task walks blocks of documents: a block's impacts, int64, are laid out by
term, and an item's row of the product is the sum of its terms' rows (Gustavson's scheme with a dense
accumulator of the block). Each item keeps its best documents over a task's blocks, and Spark reduces the tasks'
bests in two steps.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F

from tabulon.llm.common import Scratch, word_lists

#: Bytes of item texts searched at a time; documents of a block, and (term, document) entries that end one early.
SLICE, BLOCK, ENTRIES = 16 << 20, 4096, 1 << 21


def terms_of(text: bytes | bytearray | str | None) -> set[bytes]:
    data = text.encode() if isinstance(text, str) else bytes(text or b"")
    return {w for words in word_lists(data) for w in words}


def slices(items: DataFrame, most: int) -> Iterator[list[tuple[int | None, set[bytes]]]]:
    """Items (item_id, terms) in lists of about ``most`` bytes of text; rows with one item_id come together and are one item."""
    whole = items.groupBy("item_id").agg(F.concat_ws(" ", F.collect_set("text")).alias("text")).orderBy(F.col("item_id").asc_nulls_last())
    held, size = [], 0
    for r in whole.toLocalIterator(prefetchPartitions=True):
        found = terms_of(r.text)
        if found:
            held.append((r.item_id, found))
            size += len(r.text)
        if size >= most:
            yield held
            held, size = [], 0
    if held:
        yield held


def _holdings(vocabulary: dict[bytes, int]):
    """doc_id, n (terms with repeats), and the item terms held with their numbers; documents without a term go."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = vocabulary.get
        for b in batches:
            ids, n, terms, times = [], [], [], []
            for i, text in zip(b.column("doc_id").to_pylist(), b.column("text")):
                size, tf = 0, Counter()
                for words in word_lists(text.as_py()):
                    size += len(words)
                    tf.update(map(find, words))
                tf.pop(None, None)
                if size:
                    ids.append(i)
                    n.append(size)
                    terms.append(np.fromiter(tf.keys(), np.int32, len(tf)))
                    times.append(np.fromiter(tf.values(), np.int64, len(tf)))
            yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(n, pa.int64()), pa.array(terms, pa.list_(pa.int32())), pa.array(times, pa.list_(pa.int64()))], names=["doc_id", "n", "terms", "times"])

    return run


def _frequencies(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents of this task that hold each term; term -1 stands for all documents, -2 for all terms."""
    total, docs, size = np.zeros(0, np.int64), 0, 0
    for b in batches:
        docs, size = docs + b.num_rows, size + int(b.column("n").to_numpy().sum())
        own = np.bincount(b.column("terms").flatten().to_numpy(zero_copy_only=False)) if b.num_rows else total[:0]
        if len(own) > len(total):
            total, own = own, total
        total[: len(own)] += own
    have = np.flatnonzero(total)
    yield pa.record_batch([np.r_[have, -1, -2].astype(np.int64), np.r_[total[have], docs, size].astype(np.int64)], names=["term", "n"])


def impacts(tf: np.ndarray, n: np.ndarray, w: np.ndarray, docs: int, terms: int) -> np.ndarray:
    """w * (10**9 tf div (1000 tf + 8 m)), m = 10 + 90 n docs div terms, all in 64-bit integers."""
    if len(n) and int(n.max()) * docs >= (1 << 63) // 90:
        m = np.array([10 + 90 * int(x) * docs // terms for x in n], np.int64)
    else:
        m = 10 + 90 * n * docs // terms
    return w * (1_000_000_000 * tf // (1000 * tf + 8 * m))


def best(scores: np.ndarray, ids: np.ndarray, none: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest positive scores, equal ones by id, a null id last."""
    at = np.flatnonzero(scores > 0)
    if len(at) > k:  # ties with the k-th score stay until ids decide
        at = at[scores[at] >= np.partition(scores[at], len(at) - k)[len(at) - k]]
    return at[np.lexsort((ids[at], none[at], -scores[at]))[:k]]


def _search(starts: np.ndarray, flat: np.ndarray, weight: np.ndarray, docs: int, terms: int, k: int):
    """Each item's k best documents among this task's rows of holdings; items as rows of a sparse matrix (starts, flat)."""

    def blocks(batches: Iterable[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
        held, rows, entries = [], 0, 0
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                ids, lists = part.column("doc_id"), part.column("terms")
                own = lists.value_lengths().to_numpy(zero_copy_only=False)
                held.append([ids.fill_null(0).to_numpy(zero_copy_only=False), ids.is_null().to_numpy(zero_copy_only=False), part.column("n").to_numpy(), own, lists.flatten().to_numpy(zero_copy_only=False), part.column("times").flatten().to_numpy(zero_copy_only=False)])
                rows, entries = rows + part.num_rows, entries + int(own.sum())
                if rows >= BLOCK or entries >= ENTRIES:
                    yield [np.concatenate(x) for x in zip(*held)]
                    held, rows, entries = [], 0, 0
        if held:
            yield [np.concatenate(x) for x in zip(*held)]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = len(starts) - 1
        top: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool))] * items
        for ids, none, n, own, term, tf in blocks(batches):
            doc = np.repeat(np.arange(len(ids)), own)
            by_term = np.argsort(term, kind="stable")
            value = impacts(tf, n[doc], weight[term], docs, terms)[by_term]
            doc, rows = doc[by_term], np.searchsorted(term[by_term], np.arange(len(weight) + 1))
            total = np.zeros(len(ids), np.int64)
            for i in range(items):
                for t in flat[starts[i] : starts[i + 1]]:
                    lo, hi = rows[t], rows[t + 1]
                    total[doc[lo:hi]] += value[lo:hi]
                at = best(total, ids, none, k)
                scores, keys, nulls = (np.concatenate([old, new[at]]) for old, new in zip(top[i], (total, ids, none)))
                at = best(scores, keys, nulls, k)
                top[i] = scores[at], keys[at], nulls[at]
                total[:] = 0
        size = [len(x[0]) for x in top]
        if sum(size):
            scores, keys, nulls = (np.concatenate(x) for x in zip(*top))
            yield pa.record_batch([pa.array(np.repeat(np.arange(items, dtype=np.int32), size)), pa.array(keys, mask=nulls), pa.array(scores)], names=["item", "doc_id", "score"])

    return run


def search(docs: DataFrame, items: DataFrame, k: int = 10, most: int = SLICE) -> DataFrame:
    """(item_id, rank, doc_id, score): each item's k documents of highest positive score, equal scores by doc_id (null last).

    Whole texts are read; null and wordless ones hold no term and don't count as documents. Repeated rows of docs are
    documents each. Rows of items with one item_id are one item with the terms of all of them, a null id
    too; items without a term give no row. Empty tables give none. Other columns aren't read. Items go in slices of
    ``most`` bytes of text, each of which reads the documents once.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "search")
    texts = docs.where("text IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    found: list[DataFrame] = []
    for held in slices(items, most):
        vocabulary = {t: i for i, t in enumerate(sorted(set().union(*(x for _, x in held))))}
        holdings = scratch.write(texts.mapInArrow(_holdings(vocabulary), "doc_id long, n long, terms array<int>, times array<long>"), "holdings")
        counts: dict[int, int] = {r.term: r.n for r in holdings.mapInArrow(_frequencies, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()}
        n, size = counts.get(-1, 0), counts.get(-2, 0)
        df = np.array([counts.get(i, 0) for i in range(len(vocabulary))], np.int64)
        weight = np.floor(1000 * np.log((2 * n + 2) / (2 * df + 1))).astype(np.int64)
        flat = np.array([vocabulary[t] for _, x in held for t in sorted(x)], np.int64)
        starts = np.r_[0, np.cumsum([len(x) for _, x in held])]
        own = holdings.mapInArrow(_search(starts, flat, weight, n, size, k), "item int, doc_id long, score long")
        names = spark.createDataFrame([Row(item=j, item_id=i) for j, (i, _) in enumerate(held)], "item int, item_id long")
        first = F.desc("score"), F.col("doc_id").asc_nulls_last()
        some = own.withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(64)))  # an item's bests of all tasks meet in two steps
        some = some.withColumn("at", F.row_number().over(Window.partitionBy("item", "part").orderBy(*first))).where(F.col("at") <= k)
        last = some.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*first))).where(F.col("rank") <= k)
        found.append(scratch.write(last.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score"), "found"))
        scratch.drop(holdings)
    if not found:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out
