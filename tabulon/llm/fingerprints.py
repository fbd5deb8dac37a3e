"""Document fingerprints from prefix polynomial hashes.

A text's prefix array holds, for every position, the polynomial hash of all code points before it modulo two
primes. The difference of two entries is a span's hash, so any two spans are compared in constant time and the longest
common extension of two places is found by binary search.

A fingerprint is a sample of that array: entries at regular places (a power of two apart) and at places
chosen by content (the hash of the span that starts there ends in enough zero bits), so shifted text is met
again. Likeness of two fingerprints is the share of the longer text that common extensions cover: from the
start, by binary search over the places that both samples hold, then from one place chosen by content to the
next. Only the sample is needed for it.
"""

from __future__ import annotations

import base64
import struct
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from hashlib import sha256

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulon.llm.common import Scratch, fresh, mix64

#: Two primes below 2**31 (products of residues fit 64 bits) and a base for each.
PRIMES = (2147483647, 2147483629)
BASES = (1103515245, 1664525017)
#: Code points of the spans that choose places; most places of each kind; code points hashed at a time.
SPAN, PLACES, REGULAR, PIECE = 16, 32, 16, 1 << 20
#: Bytes of text that a task of the chain gets, about.
TASK_BYTES = 32 << 20

_tables: dict[tuple[int, int], np.ndarray] = {}


def _geometric(which: int, ratio: int, n: int) -> np.ndarray:
    """Powers 0 to n - 1 of a ratio modulo the prime, by doubling."""
    have = _tables.get((which, ratio))
    if have is None or len(have) < n:
        p, have = np.uint64(PRIMES[which]), np.ones(1, np.uint64)
        while len(have) < max(n, 1 << 12):
            have = np.concatenate([have, have * np.uint64(pow(ratio, len(have), PRIMES[which])) % p])
        _tables[which, ratio] = have
    return have[:n]


def powers(which: int, n: int) -> np.ndarray:
    return _geometric(which, BASES[which], n)


def inverses(which: int, n: int) -> np.ndarray:
    return _geometric(which, pow(BASES[which], -1, PRIMES[which]), n)


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def prefixes(points: np.ndarray, which: int, before: int = 0, at: int = 0) -> np.ndarray:
    """Prefix hashes 0 to len(points) of points that stand at place ``at`` after a text with prefix hash ``before``."""
    p = np.uint64(PRIMES[which])
    lift = np.uint64(pow(BASES[which], at, PRIMES[which]))
    terms = (points.astype(np.uint64) + np.uint64(1)) * powers(which, len(points)) % p
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(terms, dtype=np.uint64)]) % p
    return (sums * lift + np.uint64(before)) % p if at else sums


class PrefixHashes:
    """All prefix hashes of a text: 16 bytes a code point."""

    def __init__(self, text: str):
        points = code_points(text)
        self.n = len(points)
        self.sums = [prefixes(points, w) for w in (0, 1)]

    def span(self, i: int, j: int) -> tuple[int, int]:
        """A hash of code points i to j - 1 that doesn't depend on where they stand."""
        return tuple((int(s[j]) - int(s[i])) * pow(BASES[w], -i, PRIMES[w]) % PRIMES[w] for w, s in enumerate(self.sums))

    def same(self, i: int, other: PrefixHashes, j: int, length: int) -> bool:
        """Whether ``length`` code points from i here and from j there are equal; False where either text ends before."""
        return i + length <= self.n and j + length <= other.n and self.span(i, i + length) == other.span(j, j + length)

    def extension(self, i: int, other: PrefixHashes, j: int) -> int:
        """The most code points that are equal from i here and from j there, by binary search."""
        lo, hi = 0, min(self.n - i, other.n - j)
        while lo < hi:
            mid = (lo + hi + 1) // 2
            lo, hi = (mid, hi) if self.same(i, other, j, mid) else (lo, mid - 1)
        return lo


def _zeros(x: np.ndarray) -> np.ndarray:
    """How many zero bits end each value."""
    low = x & (~x + np.uint64(1))
    return np.where(x == 0, 64, np.log2(np.maximum(low, np.uint64(1)).astype(np.float64))).astype(np.int64)


def fingerprint(text: str | None) -> str:
    """The sample of a whole text's prefix array as text; null counts as empty. Equal texts have equal ones.

    The text is hashed in pieces, so memory is bounded by the text itself.
    """
    points = code_points(text or "")
    n, step = len(points), 1
    while n // step > REGULAR:
        step *= 2
    level, before = 0, [0, 0]
    regular: list[np.ndarray] = []
    places = np.zeros((0, 4), np.uint64)  # place, both prefix hashes, the span's mixed hash
    for at in range(0, n, PIECE):
        own = min(PIECE, n - at)
        view = points[at : at + own + SPAN - 1]  # spans may end in the next piece; at the text's end they are shorter
        sums = [prefixes(view, w, before[w], at) for w in (0, 1)]
        ends = np.minimum(np.arange(own) + SPAN, len(view))
        span = np.zeros(own, np.uint64)
        for w in (0, 1):
            p = np.uint64(PRIMES[w])
            shift = inverses(w, own)
            if at:
                shift = shift * np.uint64(pow(BASES[w], -at, PRIMES[w])) % p
            span = span << np.uint64(31) ^ (sums[w][ends] + p - sums[w][:own]) % p * shift % p
        mixed = mix64(span + (ends - np.arange(own)).astype(np.uint64))
        zeros = _zeros(mixed)
        found = np.flatnonzero(zeros >= level)
        while len(places) + len(found) > PLACES:
            level += 1
            found, places = found[zeros[found] >= level], places[_zeros(places[:, 3]) >= level]
        places = np.concatenate([places, np.column_stack([(found + at).astype(np.uint64), sums[0][found], sums[1][found], mixed[found]])])
        first = -at % step
        regular.append(np.column_stack([sums[0][first:own:step], sums[1][first:own:step]]))
        before = [int(s[own]) for s in sums]
    body = struct.pack("<QBBII", n, level, step.bit_length() - 1, *before)
    body += np.concatenate([np.zeros((0, 2), np.uint64), *regular])[1:].astype("<u4").tobytes()
    body += places[:, 0].astype("<u4").tobytes() + places[:, 1:3].astype("<u4").tobytes() + (places[:, 3] >> np.uint64(32)).astype("<u4").tobytes()
    body += np.minimum(_zeros(places[:, 3]), 255).astype(np.uint8).tobytes()
    return base64.b64encode(body).decode()


class Sample:
    """A fingerprint, read."""

    def __init__(self, mark: str):
        body = base64.b64decode(mark)
        self.n, self.level, step, *whole = struct.unpack_from("<QBBII", body)
        self.step, size = 1 << step, struct.calcsize("<QBBII")
        regular = max(0, -(-self.n // self.step) - 1)
        k = (len(body) - size - 8 * regular) // 17
        flat = np.frombuffer(body, "<u4", 2 * regular + 4 * k, size).tolist()
        pairs = list(zip(flat[0 : 2 * regular : 2], flat[1 : 2 * regular : 2]))
        rest = flat[2 * regular :]
        place, sums, spans = rest[:k], list(zip(rest[k : 3 * k : 2], rest[k + 1 : 3 * k : 2])), rest[3 * k :]
        zeros = body[len(body) - k :] if k else b""
        #: Prefix hash by place, and the places chosen by content: (place, span's hash, zero bits).
        self.sums: dict[int, tuple[int, int]] = {0: (0, 0), self.n: tuple(whole)}
        self.sums.update(zip(range(self.step, self.n, self.step), pairs))
        self.sums.update(zip(place, sums))
        self.places = list(zip(place, spans, zeros))

    def span(self, i: int, j: int) -> tuple[int, int]:
        a, b = self.sums[i], self.sums[j]
        return tuple((b[w] - a[w]) * pow(BASES[w], -i, PRIMES[w]) % PRIMES[w] for w in (0, 1))


def likeness(a: str, b: str) -> float:
    """The share (0 to 1) of the longer text that common extensions of two fingerprints cover; 1 for equal texts only."""
    if a == b:
        return 1.0
    x, y = Sample(a), Sample(b)
    both = sorted(x.sums.keys() & y.sums.keys())
    lo, hi = 0, len(both) - 1  # prefix hashes agree up to one of the places, and not beyond it
    while lo < hi:
        mid = (lo + hi + 1) // 2
        lo, hi = (mid, hi) if x.sums[both[mid]] == y.sums[both[mid]] else (lo, mid - 1)
    covered = end_x = end_y = both[lo]
    level = max(x.level, y.level)
    left = [p[:2] for p in x.places if p[2] >= level and p[0] >= end_x]
    right = [p[:2] for p in y.places if p[2] >= level and p[0] >= end_y]
    where: dict[int, list[int]] = {}
    for j, (_, span) in enumerate(right):
        where.setdefault(span, []).append(j)
    i = 0
    while i < len(left):
        here, span = left[i]
        near = [j for j in where.get(span, ()) if right[j][0] >= end_y]
        if here < end_x or not near:
            i += 1
            continue
        j = near[0]
        there = right[j][0]
        lo, hi = 0, min(len(left) - i, len(right) - j) - 1  # later places of a common extension stand alike in both
        while lo < hi:
            mid = (lo + hi + 1) // 2
            p, q = left[i + mid][0], right[j + mid][0]
            lo, hi = (mid, hi) if p - here == q - there and x.span(here, p) == y.span(there, q) and left[i + mid][1] == right[j + mid][1] else (lo, mid - 1)
        last_x, last_y = left[i + lo][0], right[j + lo][0]
        reach = min(SPAN, x.n - last_x, y.n - last_y)  # the last place's own span is equal too
        covered += last_x - here + reach
        end_x, end_y = last_x + reach, last_y + reach
        i = bisect_right(left, (end_x - 1, 1 << 32))
    return min(covered / max(x.n, y.n), 1.0)


def with_fingerprint(docs: DataFrame, name: str = "fingerprint") -> DataFrame:
    """docs with each whole text's fingerprint in a column ``name`` (one of that name is replaced)."""
    Scratch(docs.sparkSession, "fingerprints")
    mark = F.pandas_udf(lambda texts: texts.map(fingerprint), "string")
    return docs.withColumn(name, mark(F.coalesce("text", F.lit(""))))


def edited(text: str, following: str) -> str:
    """The text with its last third (rounded down) replaced by as many first code points of the following one, or all it has."""
    k = len(text) // 3
    return text[: len(text) - k] + following[:k]


def _chain(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows of parts in order, each part's closed by a row that only follows; every other row is told with the one after it."""
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    last = None
    for b in batches:
        rows = []
        for part, closing, null, doc_id, text in zip(b["part"], b["closing"], b["null"], b["id"], b["text"]):
            mark = fingerprint(text)
            if last is not None:
                changed = edited(last[1], text)
                new = fingerprint(changed)
                rows.append((last[0], len(last[1]), sha256(changed.encode("utf-8", "surrogatepass")).hexdigest(), last[2], new, likeness(last[2], new), likeness(last[2], mark)))
            last = None if closing else (None if null else doc_id, text, mark)
        out = pd.DataFrame(rows, columns=names)
        out["doc_id"] = out["doc_id"].astype("Int64")
        yield out


def edit_chain(docs: DataFrame, task_bytes: int = TASK_BYTES) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of each row of docs.

    The next document is the one with the next smaller doc_id, after the smallest the largest; null ids come last, rows
    with one id in the order of a text hash, repeated rows next to each other. A null text is empty, and an empty text
    like an empty one (1), else 0. A single row follows itself, an empty table gives none. Texts move once: rows are dealt
    to ranges of doc_id, ranges of one hot id by text hash, and each range gets the first row of the next one.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "fingerprints")
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("turn"))
    narrow = scratch.write(rows.select("doc_id", "turn", F.octet_length("text").alias("size")), "narrow")
    n, nulls, size = narrow.agg(F.count(F.lit(1)), F.count_if(F.col("doc_id").isNull()), F.coalesce(F.sum("size"), F.lit(0))).first()
    parts = max(1, -(-size // task_bytes))
    bounds = [int(x) for x in narrow.approxQuantile("doc_id", [i / parts for i in range(1, parts)], 0.25 / parts)] if parts > 1 and nulls < n else []
    cuts, times = np.unique(np.array(bounds, np.int64), return_counts=True)
    times = np.where(times > 1, times, 0)  # an id that is several cuts has as many parts of its own
    firsts = np.r_[0, np.cumsum(times[::-1] + 1)]  # part numbers rise as ids descend
    null_parts = max(1, parts * nulls // max(n, 1))

    @F.pandas_udf("int")
    def part_of(null: pd.Series, doc_id: pd.Series, turn: pd.Series) -> pd.Series:
        ids = doc_id.to_numpy(np.int64)
        low, high = np.searchsorted(cuts, ids, "left"), np.searchsorted(cuts, ids, "right")
        share = (turn.to_numpy(np.int64) / 2.0**64 + 0.5).clip(0, 1 - 2**-53)  # rises with the hash
        width = np.where(high > low, np.append(times, 0)[low], 0)
        own = firsts[len(cuts) - high] + np.where(width > 0, 1 + np.floor(share * width).astype(np.int64), 0)
        return pd.Series(np.where(null.to_numpy(bool), firsts[-1] + 1 + np.floor(share * null_parts).astype(np.int64), own)).astype("int32")

    place = lambda df: df.withColumn("part", part_of(F.col("doc_id").isNull(), F.coalesce("doc_id", F.lit(0)), F.col("turn")))
    lead = F.struct(F.col("doc_id"), (-F.col("turn") - 1).alias("turn"))  # the largest is the first: a null id is the smallest
    heads = sorted((r.part, r.head.doc_id, -1 - r.head.turn) for r in place(narrow).groupBy("part").agg(F.max(lead).alias("head")).collect())
    out = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    if not heads:
        return spark.createDataFrame([], out)
    after = [(heads[i - 1][0], *heads[i][1:]) for i in range(len(heads))]  # a row for each part, whose closing row it names
    closers = F.broadcast(spark.createDataFrame(after, "part int, doc_id long, turn long"))
    closing = rows.alias("r").join(closers.alias("c"), F.col("r.doc_id").eqNullSafe(F.col("c.doc_id")) & (F.col("r.turn") == F.col("c.turn")))
    closing = closing.groupBy("c.part").agg(F.first(F.struct("r.doc_id", "r.turn", "r.text")).alias("row")).select("part", "row.*", F.lit(True).alias("closing"))
    whole = place(rows).withColumn("closing", F.lit(False)).unionByName(closing)
    whole = whole.select("part", "closing", F.col("doc_id").isNull().alias("null"), F.coalesce("doc_id", F.lit(0)).alias("id"), "turn", "text")
    dealt = whole.repartitionById(heads[-1][0] + 1, F.col("part")).sortWithinPartitions("part", "closing", "null", F.desc("id"), "turn")
    return dealt.drop("turn").mapInPandas(_chain, out)
