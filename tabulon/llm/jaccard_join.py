"""N-gram Jaccard join by T-occurrence search (DivideSkip) with exact links and components.

A document is the set of its distinct w-word shingles, as 64-bit hashes. Two documents link when
den * |A n B| >= num * |A u B|, so they differ in at most e = (|A| + |B|)(den - num)/(den + num) shingles.

1. Meetings. Of k > e disjoint parts of the hash space at least k - e are equal in linked documents. By
   ordering a document's parts by content, fullest first, linked ones share one of their first e + 1; those
   that share one meet under the smallest of them.
2. Candidates. A document's sketch has one byte for each of about as many parts as it has shingles; linked
   ones differ in at most e bytes, so of K bytes T = K - e are equal. Each meeting runs DivideSkip over
   sketches: no text moves, and what comes out as joined may be linked, what doesn't can't be.
3. Links. Documents that candidates join are dealt together once with their texts, and DivideSkip over
   whole shingle sets finds the links.

Skew. Equal sets are one node. Meetings and joined groups of more than a block first run in blocks, each with
the group's smallest document, at linear cost; only those whose documents then still lie in more than one
component run again, in pairs of blocks that leave out what is already joined. No pair of different texts
that could link stays unchecked unless its component is known to be the same. Very frequent elements, told by a
sample, take their meeting's head from an aggregate instead of a window; the sample only chooses the way.
"""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabulon.llm.common import Scratch, fresh, hash_words, mix64, runs
from tabulon.llm.components import connected_components

#: Documents and shingles of a block.
BLOCK, LOAD = 2048, 1 << 20
MU = 0.0085
#: Postings up to which short lists are merged by a heap; more are merged by counting, with the same result.
HEAP = 256
#: Binary probes at a time.
PROBES = 4096
#: Rows up to which groups are broadcast (some 50 bytes each); more are joined by a shuffle.
FEW = 500_000
#: Frequent elements at most, and one of how many sets is looked at to find them.
HOT, LOOK = 10_000, 64
#: Characters shingled at a time, besides those of a step's last document.
STEP = 1 << 19
#: Bits of a set's identity that joins use; sets that share them but not 64 further bits get new ones.
ID_BITS = 64


_U = np.uint64
#: A byte's value in words, 0 for white space; A-Z count as a-z.
_VALUE = np.array([0 if c in b" \t\n\v\f\r" else c + 33 if 65 <= c <= 90 else c + 1 for c in range(256)], np.uint64)


def shingle_sets(texts: list[str | None], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, end to end, and how many each has.

    Fewer words than ``width`` make one shingle, none make an empty set.
    """
    ids, n = hash_words([(t or "").encode("utf-8", "surrogatepass") for t in texts], _VALUE)
    m = np.where(n > 0, np.maximum(1, n - width + 1), 0)
    cuts = np.r_[0, np.cumsum(m)]
    at = np.arange(cuts[-1]) + np.repeat(np.cumsum(n) - n - cuts[:-1], m)
    h = np.repeat(np.minimum(n, width).astype(_U), m)
    short = np.repeat(n, m) if (n < width).any() else None
    ids = np.r_[ids, np.zeros(width, _U)]
    for i in range(width):
        new = mix64(h * _U(0x9E3779B97F4A7C15) + ids[at + i])
        h = new if short is None else np.where(i < short, new, h)
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        h[a:b].sort()
    first = np.r_[True, h[1:] != h[:-1]] if len(h) else np.empty(0, bool)
    first[cuts[:-1][m > 0]] = True
    upto = np.r_[0, np.cumsum(first)]
    return h[first], upto[cuts[1:]] - upto[cuts[:-1]]


def shingles(text: str | None, width: int) -> np.ndarray:
    return shingle_sets([text], width)[0]


def max_difference(n, num: int, den: int):
    """Most shingles by which a set of n and any set that links with it differ."""
    return (n + n * den // num) * (den - num) // (den + num)


def size_bands(num: int, den: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Top sizes and numbers of parts of bands of set sizes, up to one that holds ``most``."""
    tops = [1]
    while tops[-1] < most:
        tops.append(max(tops[-1] + 1, tops[-1] * 3 // 2))
    e = max_difference(np.array(tops), num, den)
    return np.array(tops), e + 2 + e // 4


def elements(h: np.ndarray, sizes: np.ndarray, num: int, den: int) -> list[np.ndarray]:
    """Each set's first e + 1 parts, fullest first, in its band of sizes and in the one below if linked sets reach into it.

    An element is a count, inverted, and 56 bits of content, part and band. Empty parts come last and
    count only where a set has too few others. Sets that can link with no other have none.
    """
    tops, parts = size_bands(num, den, int(sizes.max(initial=1)))
    band, need = np.searchsorted(tops, sizes), max_difference(sizes, num, den) + 1
    out: list[list[np.ndarray]] = [[] for _ in sizes]
    for below in (0, 1):
        b = band - below
        use = (need > 1) & (b >= 0)
        if below:
            use &= tops[np.maximum(b, 0)] * den // num >= sizes
        if not use.any():
            continue
        own = np.repeat(use, sizes)
        x, d = h[own], np.repeat(np.arange(len(sizes)), sizes)[own]
        p = ((x >> _U(32)) * parts[b[d]].astype(_U)) >> _U(32)
        first = np.flatnonzero(np.r_[True, (p[1:] != p[:-1]) | (d[1:] != d[:-1])])
        of, part = d[first], p[first]
        name = lambda part, of: mix64(part * _U(1_000_003) + (b[of] + 1).astype(_U))
        content = mix64(np.add.reduceat(mix64(x + _U(77)), first) ^ name(part, of)) >> _U(8)
        key = content | (_U(255) - np.minimum(np.diff(np.r_[first, len(x)]), 255).astype(_U)) << _U(56)
        cuts = np.searchsorted(of, np.arange(len(sizes) + 1))
        for i in np.flatnonzero(use).tolist():
            mine = np.sort(key[cuts[i] : cuts[i + 1]])
            if len(mine) < need[i]:
                empty = np.setdiff1d(np.arange(parts[b[i]], dtype=_U), part[cuts[i] : cuts[i + 1]])
                mine = np.r_[mine, np.sort(mix64(name(empty, np.full(len(empty), i))) >> _U(8) | _U(255 << 56))]
            out[i].append(mine[: need[i]].view(np.int64))
    return [np.concatenate(x) if x else np.empty(0, np.int64) for x in out]


def level(sizes: np.ndarray) -> np.ndarray:
    """Logarithm of the number of bytes in the sketch of a set."""
    return np.maximum(3, np.ceil(np.log2(np.maximum(sizes, 1) * 0.7))).astype(np.int64)


def sketches(h: np.ndarray, sizes: np.ndarray) -> list[bytes]:
    """A byte for each part: a sum over its shingles, so that two neighbours' sum is that of the part they halve."""
    lv = level(sizes)
    base = np.cumsum(1 << lv) - (1 << lv)
    d = np.repeat(np.arange(len(sizes)), sizes)
    at = base[d] + (h >> (_U(64) - lv[d].astype(_U))).astype(np.int64)
    out = np.bincount(at, (mix64(h + _U(91)) >> _U(56)).astype(np.float64), int((1 << lv).sum())).astype(np.int64).astype(np.uint8)
    return [out[a : a + (1 << k)].tobytes() for a, k in zip(base.tolist(), lv.tolist())]


class Lists:
    """The inverted lists of a block's documents, for T-occurrence search by DivideSkip."""

    def __init__(self, tokens: np.ndarray, sizes: np.ndarray):
        self.m, self.cuts = len(sizes), np.r_[0, np.cumsum(sizes)]
        values, self.token = np.unique(tokens, return_inverse=True)
        order = np.argsort(self.token, kind="stable")
        self.docs = np.repeat(np.arange(self.m), sizes)[order]
        self.places = self.token[order] * self.m + self.docs
        self.ends = np.r_[0, np.cumsum(np.bincount(self.token, minlength=len(values)))]

    def search(self, i: int, t: int, among: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Documents ``among`` (a mask) that share at least t tokens with document i, and how many they share."""
        mine = self.token[self.cuts[i] : self.cuts[i + 1]]
        size = self.ends[mine + 1] - self.ends[mine]
        order = np.argsort(size, kind="stable")
        mine, size = mine[order], size[order]
        long = max(0, min(t - 1, int(t / (MU * np.log2(max(2, size[-1])) + 1)))) if len(mine) else 0
        short = size[: len(mine) - long] > 1  # a list of one document holds i itself
        start, length = self.ends[mine[: len(short)]][short], size[: len(short)][short]
        total = int(length.sum())
        if total <= HEAP:
            merged = Counter(heapq.merge(*(self.docs[a : a + k].tolist() for a, k in zip(start.tolist(), length.tolist()))))
            counts = np.zeros(self.m, np.int64)
            counts[list(merged.keys())] = list(merged.values())
        else:
            at = np.arange(total) + np.repeat(start - (np.cumsum(length) - length), length)
            counts = np.bincount(self.docs[at], minlength=self.m)
        found = np.flatnonzero((counts >= t - long) & among)
        seen, probes = counts[found], mine[len(mine) - long :]
        while len(probes) and len(found):  # binary probes of as many long lists at once as fit
            n = max(1, PROBES // len(found))
            want = probes[:n, None] * self.m + found
            seen = seen + (self.places[np.minimum(np.searchsorted(self.places, want), len(self.places) - 1)] == want).sum(0)
            probes = probes[n:]
            keep = seen + len(probes) >= t
            found, seen = found[keep], seen[keep]
        return found, seen


def join_block(lists: Lists, comp: np.ndarray, least, accept, apart=None) -> list[tuple[int, int]]:
    """Index pairs that ``accept``(i, found, shared) takes and that connect what all such pairs would; comp is updated.

    ``least``(i) is the smallest overlap accepted for i; pairs of one component are left out, and so are
    those of one value of an array in ``apart``. The largest component's documents are found by the others' searches.
    """
    out, main = [], None
    start = int(np.argmax(np.bincount(comp)[comp])) if len(comp) else 0
    for i in [start, *range(len(comp))]:
        if main is not None and comp[i] == main:
            continue
        among = comp != comp[i]
        for a in apart or ():
            among &= a != a[i]
        if among.any():
            found, shared = lists.search(i, least(i), among)
            if len(found):
                found = found[accept(i, found, shared)]
            for j in found.tolist():
                if comp[j] != comp[i]:
                    out.append((i, j))
                    old, new = (comp[i], comp[j]) if comp[j] == main else (comp[j], comp[i])
                    comp[comp == old] = new
        if main is None:
            main = comp[i]
    return out


def _numbers(comp) -> np.ndarray:
    return np.unique(np.asarray(comp), return_inverse=True)[1]


def join_sets(sets: list[np.ndarray], comp, num: int, den: int, side=None) -> list[tuple[int, int]]:
    """Index pairs of linked shingle sets that connect what all links would, and what ``comp`` connects already."""
    n = np.array([len(s) for s in sets], np.int64)
    accept = lambda i, j, both: den * both >= num * (n[i] + n[j] - both)
    return join_block(Lists(np.concatenate(sets), n), _numbers(comp), lambda i: int(-(-n[i] * num // den)), accept, None if side is None else [side])


def join_sketches(rows: list[bytes], n: np.ndarray, comp, num: int, den: int, side=None) -> list[tuple[int, int]]:
    """Index pairs that join all documents whose sketches allow a link: those of one length, and of the double folded to it."""
    lv, comp, out = level(n), _numbers(comp), []
    for k in np.unique(lv).tolist():
        low = lv == k
        at = np.flatnonzero(low | (lv == k + 1) & (n * num <= n[low].max() * den))
        if len(at) < 2 or (comp[at] == comp[at[0]]).all():
            continue
        raw = np.stack([np.frombuffer(rows[i], np.uint8).reshape(1 << k, -1).sum(1, dtype=np.uint8) for i in at.tolist()])
        tokens = (raw.astype(np.int64) | np.arange(1 << k) << 8).ravel()
        own, size, half = comp[at], n[at], low[at]
        sides = [np.where(half, -1 - np.arange(len(at)), 0)] + ([] if side is None else [side[at]])

        def accept(i, j, both, size=size, k=k):
            return ((1 << k) - both <= (size[i] + size[j]) * (den - num) // (den + num)) & (np.minimum(size[i], size[j]) * den >= np.maximum(size[i], size[j]) * num)

        found = join_block(Lists(tokens, np.full(len(at), 1 << k)), own, lambda i, size=size, k=k: int((1 << k) - max_difference(size[i], num, den)), accept, sides)
        for i, j in found:
            a, b = comp[at[i]], comp[at[j]]
            comp[comp == b] = a
            out.append((int(at[i]), int(at[j])))
    return out


def identity(h: np.ndarray, sizes: np.ndarray, bits: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit hashes of each set, the first cut to ``bits``."""
    some = np.flatnonzero(sizes)
    starts, out = (np.cumsum(sizes) - sizes)[some], []
    for salt in (13, 29):
        x = np.zeros(len(sizes), _U)
        if len(some):
            x[some] = np.add.reduceat(mix64(h + _U(salt)), starts)
        out.append(mix64(x + sizes.astype(_U) * _U(0xC2B2AE3D27D4EB4F) + _U(salt)))
    return (out[0] >> _U(64 - bits)).view(np.int64), out[1].view(np.int64)


def _steps(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Parts of batches whose texts have about STEP characters."""
    for b in batches:
        sizes = np.cumsum([len(t) if t else 0 for t in b["text"]])
        lo = 0
        while lo < len(b):
            hi = max(lo + 1, int(np.searchsorted(sizes, (sizes[lo - 1] if lo else 0) + STEP)))
            yield b.iloc[lo:hi]
            lo = hi


PROFILE = "doc_id long, text_hash long, n long, sid long, check long, parts array<long>, sketch binary"


def _profiles(width: int, num: int, den: int, bits: int):
    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        told: set[tuple[int, int]] = set()
        for b in _steps(batches):
            h, sizes = shingle_sets(b["text"].tolist(), width)
            sid, check = identity(h, sizes, bits)
            new = np.zeros(len(b), bool)
            for i, key in enumerate(zip(sid.tolist(), check.tolist())):
                if sizes[i] and key not in told:
                    told.add(key)
                    new[i] = True
            kept = np.flatnonzero(new)
            x, m = h[np.repeat(new, sizes)], sizes[new]
            parts, sketch = np.full(len(b), None, object), np.full(len(b), None, object)
            for i, p, s in zip(kept.tolist(), elements(x, m, num, den), sketches(x, m)):
                parts[i], sketch[i] = p, s
            none = sizes == 0
            yield pd.DataFrame({
                "doc_id": b["doc_id"].array, "text_hash": b["text_hash"].array, "n": sizes, "sid": pd.arrays.IntegerArray(sid, none),
                "check": pd.arrays.IntegerArray(check, none), "parts": parts, "sketch": sketch,
            })

    return run


def _candidates(num: int, den: int):
    """Pairs (u, v) of sids that join the documents of each (g, x, y) whose sketches allow a link."""

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for g in runs(batches, ["g", "x", "y"]):
            g = g.drop_duplicates("sid")
            side = None if g["x"].iloc[0] == g["y"].iloc[0] else g["b"].to_numpy()
            found = join_sketches(g["sketch"].tolist(), g["n"].to_numpy(np.int64), g["comp"].to_numpy(), num, den, side)
            if found:
                sid = g["sid"].to_numpy()
                yield pd.DataFrame({"u": sid[[i for i, _ in found]], "v": sid[[j for _, j in found]]})

    return run


def _links(width: int, num: int, den: int):
    """Pairs (u, v) of sids that join the linked documents of each (g, x, y)."""

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for g in runs(batches, ["g", "x", "y"]):
            g = g.drop_duplicates(["sid", "text"])
            h, sizes = shingle_sets(g["text"].tolist(), width)
            own = identity(h, sizes)[1] == g["check"].to_numpy(np.int64)  # a repeated doc_id may stand for other texts too
            sets = [s for s, ok in zip(np.split(h, np.cumsum(sizes)[:-1]), own) if ok]
            g, first = g[own], ~g[own].duplicated("sid").to_numpy()
            g, sets = g[first], [s for s, ok in zip(sets, first) if ok]
            if len(g) < 2:
                continue
            side = None if g["x"].iloc[0] == g["y"].iloc[0] else g["b"].to_numpy()
            found = join_sets(sets, g["comp"].to_numpy(), num, den, side)
            if found:
                sid = g["sid"].to_numpy()
                yield pd.DataFrame({"u": sid[[i for i, _ in found]], "v": sid[[j for _, j in found]]})

    return run


def _dealt(rows: DataFrame) -> DataFrame:
    return rows.repartition(F.col("g"), F.col("x"), F.col("y")).sortWithinPartitions("g", "x", "y")


def _small(rows: DataFrame) -> DataFrame:
    return F.broadcast(rows) if rows.count() <= FEW else rows


def _blocks(members: DataFrame) -> DataFrame:
    """(g, k): how many blocks a group of members (g, sid, n) fills."""
    fill = F.greatest(F.count(F.lit(1)) / BLOCK, F.sum("n") / LOAD)
    return members.groupBy("g").agg(F.greatest(F.ceil(fill), F.lit(1)).cast("int").alias("k"))


def _first_round(members: DataFrame, blocks: DataFrame) -> DataFrame:
    """Rows (g, x, y, b, sid, comp): every member in one block, the group's smallest one in each."""
    rows = members.join(blocks, "g")
    inner = rows.select("g", F.when(F.col("k") == 1, 0).otherwise(F.pmod(F.xxhash64("sid"), F.col("k"))).cast("long").alias("x"), "sid")
    heads = rows.where("k > 1").groupBy("g", "k").agg(F.min("sid").alias("sid")).select("g", F.explode(F.sequence(F.lit(0).cast("long"), F.col("k").cast("long") - 1)).alias("x"), "sid")
    return inner.union(heads).select("g", "x", F.col("x").alias("y"), F.lit(0).alias("b"), "sid", F.col("sid").alias("comp"))


def _second_round(members: DataFrame, blocks: DataFrame, labels: DataFrame, scratch: Scratch) -> DataFrame | None:
    """Rows (g, x, y, b, sid, comp) for groups of several blocks whose members still lie in more than one component.

    Members of a group's largest component are blocked apart from the others and not paired among themselves.
    """
    open_ = members.join(blocks.where("k > 1").select("g"), "g").join(labels, "sid", "left").select("g", "sid", "n", F.coalesce("comp", "sid").alias("comp"))
    open_ = scratch.write(open_, "open")
    by = open_.groupBy("g", "comp").agg(F.count(F.lit(1)).alias("c"), F.sum("n").alias("n"))
    fill = lambda c, n: F.ceil(F.greatest(c / BLOCK, n / LOAD)).cast("int")
    main = by.groupBy("g").agg(
        F.max_by("comp", F.struct("c", "comp")).alias("main"), F.max_by("c", F.struct("c", "comp")).alias("c"), F.max_by("n", F.struct("c", "comp")).alias("n"),
        F.sum("c").alias("ca"), F.sum("n").alias("na"),
    ).where("ca > c")
    main = main.select("g", "main", F.greatest(fill(F.col("c"), F.col("n")), F.lit(1)).alias("ka"), F.greatest(fill(F.col("ca") - F.col("c"), F.col("na") - F.col("n")), F.lit(1)).alias("kb"))
    main = scratch.write(main, "main")
    if main.isEmpty():
        return None
    h = F.xxhash64("sid")
    rows = open_.join(main, "g").withColumn("b", F.when(F.col("comp") == F.col("main"), F.pmod(h, F.col("ka")) + F.col("kb")).otherwise(F.pmod(h, F.col("kb"))).cast("int"))
    other = F.when(F.col("b") < F.col("kb"), F.sequence(F.lit(0), F.col("ka") + F.col("kb") - 1)).otherwise(F.sequence(F.lit(0), F.col("kb") - 1))
    rows = rows.select("g", "sid", "comp", "b", F.explode(other).alias("o"))
    return rows.select("g", F.least("b", "o").cast("long").alias("x"), F.greatest("b", "o").cast("long").alias("y"), "b", "sid", "comp")


def _joined(members: DataFrame, search, scratch: Scratch) -> DataFrame:
    """Components (node, comp) of what ``search``(rows) finds within the groups of members (g, sid, n)."""
    members = scratch.write(members, "members")
    blocks = scratch.write(_blocks(members), "blocks")
    found = scratch.write(search(_first_round(members, blocks)), "found")
    labels = connected_components(found, scratch)
    if not blocks.where("k > 1").isEmpty():
        rows = _second_round(members, blocks, labels.withColumnRenamed("node", "sid"), scratch)
        if rows is not None:
            found = scratch.write(labels.select(F.col("node").alias("u"), F.col("comp").alias("v")).union(search(rows)), "more")
            labels = connected_components(found, scratch)
    return labels


def _meetings(prof: DataFrame, scratch: Scratch) -> DataFrame:
    """(g, sid): sets that share an element, under the smallest of them, itself included."""
    sig = prof.select("sid", F.explode("parts").alias("sig"))
    often = sig.where(F.pmod(F.xxhash64("sid"), F.lit(LOOK)) == 0).groupBy("sig").count().where("count >= 32").orderBy(F.desc("count"), "sig").limit(HOT)
    often = scratch.write(often.select(F.col("sig").alias("often")), "often")
    heads = lambda rows: rows.where("g <> sid").select("g", "sid")
    if often.isEmpty():
        found = heads(sig.select("sid", F.min("sid").over(Window.partitionBy("sig")).alias("g")))
    else:
        often, same = F.broadcast(often), F.col("sig") == F.col("often")
        rare = sig.join(often, same, "left_anti")
        hot = sig.join(often, same, "left_semi")
        lead = scratch.write(hot.groupBy("sig").agg(F.min("sid").alias("g")), "lead")
        found = heads(rare.select("sid", F.min("sid").over(Window.partitionBy("sig")).alias("g"))).union(heads(hot.join(F.broadcast(lead), "sig")))
    edges = scratch.write(found.distinct(), "edges")
    return edges.union(edges.select("g", F.col("g").alias("sid")).distinct())


def _components(docs: DataFrame, width: int, num: int, den: int, scratch: Scratch) -> DataFrame:
    """(doc_id, text_hash, n, sid, comp, component_id) for each row of docs; sid, comp and component_id null without shingles."""
    docs = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    prof = scratch.write(docs.mapInPandas(_profiles(width, num, den, ID_BITS), PROFILE), "profiles")
    while True:
        lows = prof.where("sid IS NOT NULL").groupBy("sid").agg(F.min("doc_id").alias("lo"), F.min("check").alias("check"), F.max("check").alias("other"), F.min("n").alias("n"))
        lows = scratch.write(lows, "lows")
        twins = lows.where("check <> other").select(F.col("sid").alias("twin"))  # some n * n / 2**65 of n sets
        if twins.isEmpty():
            break
        prof = prof.join(_small(scratch.write(twins, "twins")), F.col("sid") == F.col("twin"), "left")
        prof = scratch.write(prof.withColumn("sid", F.when(F.col("twin").isNull(), F.col("sid")).otherwise(F.xxhash64("sid", "check"))).drop("twin"), "profiles")
    lows = lows.drop("other")

    size = lows.select("sid", "n")
    sketch = prof.where("sketch IS NOT NULL").select("sid", "n", "sketch")
    pairs = "u long, v long"

    def by_sketch(rows: DataFrame) -> DataFrame:
        rows = sketch.join(_small(scratch.write(rows, "groups")), "sid").select("g", "x", "y", "b", "sid", "comp", "n", "sketch")
        return _dealt(rows).mapInPandas(_candidates(num, den), pairs)

    def by_text(rows: DataFrame) -> DataFrame:
        rows = rows.join(lows.select("sid", "lo", "check"), "sid")
        rows = docs.join(_small(scratch.write(rows, "groups")), F.col("doc_id").eqNullSafe(F.col("lo"))).select("g", "x", "y", "b", "sid", "comp", "check", "text")
        return _dealt(rows).mapInPandas(_links(width, num, den), pairs)

    joined = _joined(_meetings(prof, scratch).join(size, "sid").select("g", "sid", "n"), by_sketch, scratch)
    scratch.tidy()
    labels = _joined(joined.select(F.col("comp").alias("g"), F.col("node").alias("sid")).join(size, "sid").select("g", "sid", "n"), by_text, scratch)
    whole = lows.join(labels.withColumnRenamed("node", "sid"), "sid", "left").select("sid", "lo", F.coalesce("comp", "sid").alias("comp"))
    whole = scratch.write(whole, "whole")
    lowest = scratch.write(whole.groupBy("comp").agg(F.min("lo").alias("component_id")), "lowest")
    ids = scratch.write(whole.join(lowest, "comp").select("sid", "comp", "component_id"), "ids")
    scratch.tidy()
    return prof.select("doc_id", "text_hash", "n", "sid").join(ids, "sid", "left").select("doc_id", "text_hash", "n", "sid", "comp", "component_id")


def jaccard_components(docs: DataFrame, width: int = 5, num: int = 8, den: int = 10) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row of docs (doc_id, text; further columns are ignored).

    Null and empty texts and texts of separators only have no shingles and link with nothing. Repeated
    rows and equal texts share a component. component_id is the component's smallest doc_id (null only
    if all of them are null). An empty table gives an empty one.
    """
    found = _components(docs, width, num, den, Scratch(docs.sparkSession, "jaccard"))
    own = F.when(F.col("sid").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return found.select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"))


def one_of_each(docs: DataFrame, width: int = 5, num: int = 8, den: int = 10) -> DataFrame:
    """The rows of docs (doc_id, text and any others) that stand for their component.

    That is the row of the smallest doc_id (a null one is the largest; of one doc_id's texts that with the smallest
    hash). Rows without shingles stand for themselves. Rows that repeat a doc_id with its text stay once.
    """
    scratch = Scratch(docs.sparkSession, "unique")
    found = scratch.write(_components(docs, width, num, den, scratch).select("doc_id", "text_hash", "sid", "comp"), "found")
    key = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")
    heads = scratch.write(found.where("comp IS NOT NULL").groupBy("comp").agg(F.min(key).alias("head")), "heads")
    gone = found.join(heads, "comp").where(~key.eqNullSafe(F.col("head"))).select("doc_id", "text_hash").distinct()
    again = found.groupBy("doc_id", "text_hash").count().where("count > 1").select("doc_id", "text_hash")

    def named(keys: DataFrame, what: str) -> tuple[DataFrame, object]:
        """The keys under names that no column of docs has, and the condition that a row of docs has such a key."""
        a, b = fresh(docs.columns, "id"), fresh(docs.columns, "hash")
        keys = scratch.write(keys.select(F.col("doc_id").alias(a), F.col("text_hash").alias(b)), what)
        return keys, F.col("doc_id").eqNullSafe(F.col(a)) & F.xxhash64("text").eqNullSafe(F.col(b))

    gone, same = named(gone, "gone")
    again, _ = named(again, "again")
    rows = docs.join(_small(gone), same, "left_anti")
    if again.isEmpty():
        return rows
    again = _small(again)
    return rows.join(again, same, "left_anti").unionByName(rows.join(again, same, "left_semi").dropDuplicates(["doc_id", "text"]))

