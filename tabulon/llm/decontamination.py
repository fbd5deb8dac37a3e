"""Benchmark decontamination by latent semantic retrieval.

Words are runs of ASCII letters and digits and of any other characters beyond ASCII, lower-cased. They
are hashed to ``COUNTED`` terms with document counts over all documents; terms in more than ``COMMON`` of
the documents are stop words; others fold into ``TERMS`` terms of the space. Texts without them are cut into overlapping passages of ``SPAN`` words,
weighted by tf-idf and projected on singular vectors that a distributed randomised SVD finds: tasks sum
A'(A W) for a random W over passages of all documents and items that together hold every word, the
driver orthonormalises the sum and scales it by singular values. The benchmark's passages are put into cells of that
space by spherical k-means; every passage of every document opens the cells whose centre is near and is compared by
cosine with what is in them, block by block. Candidates are checked on the whole words: the longest common
subsequence with the item must cover ``COPY`` of it, or ``LOOSE`` of it together with the item's answer
(its own column, else its last five words). Items with too few other words than stop words for a passage
are searched by their ``RARE`` rarest words instead.

Cosines miss copies with many words replaced, so candidates also come from runs: every place where a document
has ``run_length`` consecutive words of an item, or the first words of an answer that the item doesn't hold as
such a run. A copy of COPY of the words with others left out or replaced always keeps a run, and one by LOOSE
keeps the answer's, so these are all found; with words put in between, a run of the item has to stay whole.

Without an answer of its own an item's last five words stand for it: that is a rule of thumb, not an answer.
The benchmark is the broadcast side and is taken in slices of about ``SLICE`` items, so its size is bounded.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulon.llm.common import Scratch, fresh, hash_words, mix64

#: Terms whose documents are counted to tell stop words, and those of the latent space, of which each holds many of the former.
COUNT_BITS, BITS = 22, 16
COUNTED, TERMS = 1 << COUNT_BITS, 1 << BITS
#: Counted terms that are summed together.
SECTION = 1 << 12
RANK = 48
SPAN, STRIDE, ITEM_STRIDE = 8, 4, 2
#: Items with fewer words besides stop words are searched by so many of their rarest words.
SHORT, RARE = 6, 3
COMMON = 0.02
LEAST = 0.7
COPY, LOOSE = 0.8, 0.5
#: Words of a run, for items with fewer than MEDIUM words and others: what a fifth of the words, lost, leave whole somewhere.
RUNS, MEDIUM = (3, 4), 16
#: Terms of the latent space whose sums make a row.
ROW_TERMS = 16
#: Items and bytes of a slice of the benchmark, about; each slice is a pass over the documents.
SLICE, SLICE_BYTES = 10_000, 8 << 20
#: Passages and item passages that are compared at a time; item passages from which cells are made, most cells, and the cosine to a cell's centre that opens it.
ROWS, COLUMNS, DIRECT, MOST_CELLS, OPEN = 8192, 4096, 512, 1024, 0.2
#: Characters that a step holds at most, besides those of its last document; splitting it into words takes some 50 bytes a character.
STEP = 1 << 18

_PRIME = 0x9E3779B97F4A7C15
_VALUE = np.array([c + 1 if chr(c).isalnum() or c > 127 else 0 for c in range(256)], np.uint64)


def split_words(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit ids of all words of the texts in order, and how many each text has."""
    return hash_words([(t or "").lower().encode("utf-8", "surrogatepass") for t in texts], _VALUE)


def terms(ids: np.ndarray) -> np.ndarray:
    """Counted terms of words."""
    return (ids >> np.uint64(64 - COUNT_BITS)).astype(np.int64)


def coarse(t: np.ndarray) -> np.ndarray:
    """Terms of the latent space of counted terms."""
    return t >> (COUNT_BITS - BITS)


def steps(batches: Iterable[pd.DataFrame], *names: str) -> Iterator[tuple[np.ndarray, np.ndarray, list[tuple]]]:
    """Word ids and word counts of consecutive documents and their other columns, about STEP characters at a time."""
    texts, rest, n = [], [], 0
    for b in batches:
        for row in b[["text", *names]].itertuples(index=False):
            texts.append(row[0])
            rest.append(row[1:])
            n += len(row[0] or "")
            if n >= STEP:
                yield *split_words(texts), rest
                texts, rest, n = [], [], 0
    if texts:
        yield *split_words(texts), rest


def _document_counts(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Documents of each term, as places and counts of the sections of terms; section -1 counts all documents."""
    total, n = np.zeros(COUNTED, np.int32), 0
    for ids, sizes, _ in steps(batches):
        doc = np.repeat(np.arange(len(sizes)), sizes)
        t, found = np.unique(np.unique(doc << COUNT_BITS | terms(ids)) & (COUNTED - 1), return_counts=True)
        total[t] += found.astype(np.int32)
        n += len(sizes)
    rows = [(-1, b"", np.array([n], np.int32).tobytes())]
    for k, part in enumerate(total.reshape(-1, SECTION)):
        if len(at := np.flatnonzero(part)):
            rows.append((k, at.astype(np.uint16).tobytes(), part[at].tobytes()))
    yield pd.DataFrame(rows, columns=["section", "at", "n"])


def _summed_counts(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(term, n) of rows sorted by section: counted terms of two documents or more, -1 all documents, and -2 - c the sum for term c of the space."""

    def done(k: int, sums: np.ndarray) -> pd.DataFrame:
        at = np.flatnonzero(sums > 1)
        space = sums.reshape(-1, 1 << (COUNT_BITS - BITS)).sum(1)
        names = -2 - (k * len(space) + np.arange(len(space)))
        return pd.DataFrame({"term": np.r_[k * SECTION + at, names], "n": np.r_[sums[at], space]})

    now, sums, docs = None, np.zeros(SECTION, np.int64), 0
    for b in batches:
        for k, at, n in b[["section", "at", "n"]].itertuples(index=False):
            if k < 0:
                docs += int(np.frombuffer(n, np.int32)[0])
                continue
            if k != now:
                if now is not None:
                    yield done(now, sums)
                now, sums = k, np.zeros(SECTION, np.int64)
            sums[np.frombuffer(at, np.uint16)] += np.frombuffer(n, np.int32)
    if now is not None:
        yield done(now, sums)
    if docs:
        yield pd.DataFrame({"term": [-1], "n": [docs]})


def passages(sizes: np.ndarray, stride: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text number, start and end (in the concatenated words) of passages; a last one is flush with its text's end."""
    sizes = np.asarray(sizes)
    base = np.r_[0, np.cumsum(sizes)[:-1]].astype(np.int64) if len(sizes) else np.empty(0, np.int64)
    over = np.maximum(sizes - SPAN, 0)
    count = np.where(sizes > 0, over // stride + 1 + (over % stride > 0), 0)
    doc = np.repeat(np.arange(len(sizes)), count)
    nth = np.arange(len(doc)) - np.repeat(np.r_[0, np.cumsum(count)[:-1]] if len(count) else count, count)
    start = np.minimum(nth * stride, over[doc])
    return doc, start + base[doc], np.minimum(start + SPAN, sizes[doc]) + base[doc]


def project(t: np.ndarray, weighted: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Sums of weighted[t] over passages of SPAN words or fewer; weighted (TERMS, rank)."""
    out, short = np.zeros((len(start), weighted.shape[1]), np.float32), (end - start < SPAN).any()
    for k in range(SPAN if len(start) else 0):
        own = weighted[t[np.minimum(start + k, end - 1)]]
        if short:
            own[start + k >= end] = 0
        out += own
    return out


def runs(ids: np.ndarray, sizes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of n consecutive words of a text each, and where they start in the concatenated words."""
    m = max(0, len(ids) - n + 1)
    h = np.zeros(m, np.uint64)
    for k in range(n):
        h = h * np.uint64(_PRIME) + ids[k : m + k]
    at = np.flatnonzero(np.repeat(np.cumsum(sizes), sizes)[:m] >= np.arange(m) + n)
    return mix64(h[at]), at


def _content(ids: np.ndarray, sizes: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions and space terms of the words that aren't stop words, and how many of them each text has."""
    t = terms(ids)
    keep = ~stop[t]
    left = np.r_[0, np.cumsum(keep)]
    ends = np.cumsum(sizes)
    return np.flatnonzero(keep), coarse(t[keep]), left[ends] - left[ends - sizes]


def _gram(idf: np.ndarray, stop: np.ndarray, rank: int, seed: int):
    """A task's part of A'(A W) over passages without overlap (but a text's last), as rows of ROW_TERMS terms; those without any word are left out."""

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        random = np.random.default_rng(seed).standard_normal((TERMS, rank), np.float32) * idf[:, None]
        total = np.zeros((rank, TERMS))
        for ids, sizes, _ in steps(batches):
            _, t, sizes = _content(ids, sizes, stop)
            _, start, end = passages(sizes, SPAN)
            if not len(start):
                continue
            square = np.r_[0.0, np.cumsum(idf[t] ** 2)]
            y = project(t, random, start, end) / np.maximum(square[end] - square[start], 1e-9)[:, None]
            size = end - start
            words = np.repeat(start - np.r_[0, np.cumsum(size)[:-1]], size) + np.arange(size.sum())
            own, place = np.unique(t[words], return_inverse=True)
            for k, column in enumerate(y.T):
                total[k, own] += np.bincount(place, np.repeat(column, size), len(own))
        del random
        for lo in range(0, TERMS, 512 * ROW_TERMS):
            part = slice(lo, lo + 512 * ROW_TERMS)
            z = (total[:, part] * idf[part]).T.astype(np.float32, order="C").reshape(-1, ROW_TERMS * rank)
            if len(at := np.flatnonzero(z.any(1))):
                yield pd.DataFrame({"place": lo // ROW_TERMS + at, "z": [row.tobytes() for row in z[at]]})

    return run


def _summed_rows(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sums of the rows of each place, of rows sorted by place; a place that two batches share gives two."""
    for b in batches:
        if len(b):
            place = b["place"].to_numpy(np.int64)
            first = np.flatnonzero(np.r_[True, np.diff(place) != 0])
            z = np.add.reduceat(np.frombuffer(b"".join(b["z"]), np.float32).reshape(len(b), -1), first, axis=0, dtype=np.float64)
            yield pd.DataFrame({"place": place[first], "z": [row.tobytes() for row in z.astype(np.float32)]})


def lcs(places: dict[int, list[int]], m: int, words: list[int]) -> int:
    """Length of the longest common subsequence, by bit-parallel rows; places: positions of each of the item's m words.

    Rows of bits for words with many places are kept for the call, others made when they are met, so memory stays linear.
    """
    full = (1 << m) - 1
    row, kept = full, {}
    for w in words:
        if (at := places.get(w)) is None:
            continue
        if (bits := kept.get(w)) is None:
            bits = 0
            for k in at:
                bits |= 1 << k
            if m <= 4096 or len(at) > 64:
                kept[w] = bits
        if u := row & bits:
            row = ((row + u) | (row - u)) & full
    return m - row.bit_count()


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


def cells(target: np.ndarray, rounds: int = 4, seed: int = 9) -> tuple[np.ndarray, np.ndarray]:
    """Centres and each row's cell by spherical k-means on a sample of the rows; DIRECT rows or fewer are one cell."""
    n = len(target)
    if n <= DIRECT:
        return np.zeros((min(n, 1), target.shape[1]), np.float32), np.zeros(n, np.int64)
    k = min(MOST_CELLS, int(1.2 * n**0.5))
    random = np.random.default_rng(seed)
    sample = target[random.permutation(n)[: 32 * k]]
    centres = sample[:k].copy()
    for _ in range(rounds):
        own = (sample @ centres.T).argmax(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, sample)
        centres = np.where((np.bincount(own, minlength=k) > 0)[:, None], unit(sums), centres).astype(np.float32)
    return centres, np.concatenate([(target[lo : lo + ROWS] @ centres.T).argmax(1) for lo in range(0, n, ROWS)])


class Benchmark:
    """A slice of the benchmark made ready for search."""

    def __init__(self, items: list[tuple], space: np.ndarray, stop: np.ndarray, idf: np.ndarray):
        ids, sizes = split_words([x[1] for x in items])
        answers, lengths = split_words([x[2] for x in items])
        self.names = [x[0] for x in items]
        self.words = np.split(ids, np.cumsum(sizes)[:-1]) if items else []
        given = np.split(answers, np.cumsum(lengths)[:-1]) if items else []
        self.answers = [(a if len(a) else w[-5:]).tolist() for a, w in zip(given, self.words)]
        self.places: list[dict[int, list[int]]] = []
        for w in self.words:
            m: dict[int, list[int]] = {}
            for k, x in enumerate(w.tolist()):
                m.setdefault(x, []).append(k)
            self.places.append(m)
        #: An item's different words, and how often the most frequent one stands in it.
        self.known = [(frozenset(m), max(map(len, m.values()), default=0)) for m in self.places]
        pos, t, content = _content(ids, sizes, stop)
        base = np.cumsum(sizes) - sizes
        self.of, start, end = passages(content, ITEM_STRIDE)
        keep = content[self.of] >= SHORT
        self.of, start, end = self.of[keep], start[keep], end[keep]
        self.offset = pos[start] - base[self.of] if len(start) else start
        target = unit(project(t, space, start, end))
        self.centres, cell = cells(target)
        order = np.argsort(cell, kind="stable")
        self.of, self.offset = self.of[order], self.offset[order]
        self.target = target[order].T.copy()
        self.bounds = np.searchsorted(cell[order], np.arange(len(self.centres) + 1))
        self.rare: dict[int, list[tuple[int, int]]] = {}  # rarest words of a short item: the item and the word's place
        for j, w in enumerate(self.words):
            if len(w) and content[j] < SHORT:
                first = np.sort(np.unique(w, return_index=True)[1])
                for k in first[np.argsort(-idf[coarse(terms(w[first]))], kind="stable")[:RARE]].tolist():
                    self.rare.setdefault(int(w[k]), []).append((j, k))

        self.runs: dict[int, tuple[np.ndarray, list[list[tuple[int, int]]]]] = {}  # by length: sorted hashes; items and places of each
        found: dict[int, dict[int, list[tuple[int, int]]]] = {}

        def add(words: np.ndarray, n: int, j: int, shift: int | None) -> None:
            hashes, places = runs(words, np.array([len(words)]), n)
            for h, k in zip(hashes.tolist(), places.tolist()):
                found.setdefault(n, {}).setdefault(h, []).append((j, k if shift is None else shift))

        for j, (w, a) in enumerate(zip(self.words, self.answers)):
            n, own = len(w), RUNS[len(w) >= MEDIUM]
            add(w, own, j, None)
            if not a or n < 2 * len(a):
                continue
            places = [k for k in range(n - len(a) + 1) if w[k : k + len(a)].tolist() == a]
            if not places:  # the answer stands before, amid or after the rest
                places = [n + self.pad(j) - len(a), (n - len(a)) // 2, -self.pad(j)]
            elif len(a) >= own:
                continue
            head = np.array(a[:own], np.uint64)
            for k in places:
                add(head, len(head), j, k)
        for n, table in found.items():
            keys = sorted(table)
            self.runs[n] = np.array(keys, np.uint64), [table[h] for h in keys]

    def near(self, p: np.ndarray, least: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Rows of p, item passages and cosines of at least ``least``, from the cells that each row opens."""
        for lo in range(0, len(p) if self.target.shape[1] else 0, ROWS):
            part = p[lo : lo + ROWS]
            opened = part @ self.centres.T >= OPEN if len(self.centres) > 1 else np.ones((len(part), len(self.centres)), bool)
            for c in np.flatnonzero(opened.any(0)).tolist():
                rows = np.flatnonzero(opened[:, c])
                own = part[rows] if len(rows) < len(part) else part
                for first in range(self.bounds[c], self.bounds[c + 1], COLUMNS):
                    s = own @ self.target[:, first : min(first + COLUMNS, self.bounds[c + 1])]
                    if s.size and s.max() >= least:
                        i, j = np.nonzero(s >= least)
                        yield lo + rows[i], first + j, s[i, j]

    def pad(self, j: int) -> int:
        """Words that a copy of item j may stand off its expected place."""
        return 4 + len(self.words[j]) // 4

    def check(self, j: int, doc: np.ndarray, at: int) -> float:
        """Coverage of item j's words near position at of a document; 0 if it isn't a copy."""
        n = len(self.words[j])
        pad = self.pad(j)
        own = doc[max(0, at - pad) : max(0, at) + n + pad].tolist()
        known, most = self.known[j]
        if len(known.intersection(own)) * most < LOOSE * n:  # no subsequence of these words can be long enough
            return 0.0
        part = lcs(self.places[j], n, own) / n
        if part >= COPY:
            return part
        a = self.answers[j]
        if part >= LOOSE and n >= 2 * len(a) and any(own[k : k + len(a)] == a for k in range(len(own) - len(a) + 1)):
            return part
        return 0.0


def _find(items: list[tuple], space: np.ndarray, stop: np.ndarray, idf: np.ndarray, least: float):
    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = Benchmark(items, space, stop, idf)
        rare = np.array(sorted(known.rare), np.uint64)
        for ids, sizes, rest in steps(batches, "doc_id", "text_hash"):
            pos, t, content = _content(ids, sizes, stop)
            base = np.cumsum(sizes) - sizes
            best: dict[tuple[int, int], tuple[float, float]] = {}
            seen: set[tuple[int, int, int]] = set()

            def look(d: int, j: int, at: int, cosine: float) -> None:
                if (key := (d, j, at // 4)) not in seen:
                    seen.add(key)
                    part = known.check(j, ids[base[d] : base[d] + sizes[d]], at)
                    if part > 0:
                        old = best.get((d, j), (0.0, 0.0))
                        best[d, j] = max(part, old[0]), max(min(1.0, cosine), old[1])

            doc, start, end = passages(content, STRIDE)
            if len(doc):
                for rows, columns, cosines in known.near(unit(project(t, space, start, end)), least):
                    of = doc[rows]
                    at = pos[start[rows]] - base[of] - known.offset[columns]
                    for d, j, k, cosine in zip(of.tolist(), known.of[columns].tolist(), at.tolist(), cosines.tolist()):
                        look(d, j, k, cosine)
            if len(rare):
                hit = np.flatnonzero(np.isin(ids, rare))
                of = np.searchsorted(base, hit, side="right") - 1
                for d, at, w in zip(of.tolist(), (hit - base[of]).tolist(), ids[hit].tolist()):
                    for j, k in known.rare[w]:
                        look(d, j, at - k, 0.0)
            for n, (keys, places) in known.runs.items():
                hashes, at = runs(ids, sizes, n)
                slot = np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)
                hit = np.flatnonzero(keys[slot] == hashes)
                of = np.searchsorted(base + sizes, at[hit], side="right")
                for i, d, x in zip(at[hit].tolist(), of.tolist(), slot[hit].tolist()):
                    for j, k in places[x]:
                        look(d, j, i - int(base[d]) - k, 0.0)
            if best:
                rows = [(*rest[d], known.names[j], *v) for (d, j), v in best.items()]
                yield pd.DataFrame(rows, columns=["doc_id", "text_hash", "item_id", "coverage", "cosine"]).astype({"doc_id": "Int64", "item_id": "Int64"})

    return run


def learn_space(docs: DataFrame, items: DataFrame, rank: int = RANK, seed: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Projection (TERMS, rank), stop words (COUNTED, a mask) and weights (TERMS); counts are over all documents, the basis is fitted on all of them and all items.

    The driver gets the stop words, which are at most a document's mean number of different
    words over COMMON, one sum for each term of the space (the documents of its words, stop words taken off) and one vector of it.
    """
    scratch = Scratch(docs.sparkSession, "terms")
    parts = docs.mapInPandas(_document_counts, "section int, at binary, n binary").repartition("section").sortWithinPartitions("section")
    counts = scratch.write(parts.mapInPandas(_summed_counts, "term int, n long"), "counts")
    n = int(counts.where("term = -1").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])
    frequent = counts.where("term >= 0").where(F.col("n") > max(1.0, COMMON * n)).toPandas()
    sums = counts.where("term < -1").toPandas()
    scratch.drop(counts)
    stop, df = np.zeros(COUNTED, bool), np.zeros(TERMS)
    df[-2 - sums["term"].to_numpy(np.int64)] = sums["n"]
    at = frequent["term"].to_numpy(np.int64)
    stop[at] = True
    np.subtract.at(df, coarse(at), frequent["n"].to_numpy(np.float64))
    idf = (np.maximum(np.log((n + 1) / (df + 1)), 0) + 0.1).astype(np.float32)
    z = docs.select("text").union(items.select("text")).mapInPandas(_gram(idf, stop, rank, seed), "place int, z binary")
    z = z.repartition("place").sortWithinPartitions("place").mapInPandas(_summed_rows, "place int, z binary").toPandas()
    gram = np.zeros((TERMS // ROW_TERMS, ROW_TERMS * rank))
    if len(z):
        np.add.at(gram, z["place"].to_numpy(np.int64), np.frombuffer(b"".join(z["z"]), np.float32).reshape(len(z), -1))
    gram = gram.reshape(TERMS, rank)
    q, r = np.linalg.qr(gram)
    u, s, _ = np.linalg.svd(r)
    return (q @ (u / np.sqrt(np.maximum(s, 1e-9 * max(s[0], 1e-9)))) * idf[:, None]).astype(np.float32), stop, idf


def find_leaks(docs: DataFrame, benchmark: DataFrame, least: float = LEAST) -> DataFrame:
    """(doc_id, item_id, coverage, cosine): documents of docs (doc_id, text) that hold items of benchmark (item_id, text[, answer]).

    One row for each document row and item found, with the best coverage of the item's words and the best
    cosine by which it was found (0: by rare words or runs only). Null and
    empty texts and texts without words hold and are nothing. Repeated rows are reported each; equal
    items are found each. Empty tables give an empty one.
    """
    return _leaks(docs, benchmark, least).drop("text_hash")


def _leaks(docs: DataFrame, benchmark: DataFrame, least: float = LEAST) -> DataFrame:
    """``find_leaks``' rows with the text's xxhash64."""
    scratch = Scratch(docs.sparkSession, "leaks")
    docs = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    answer = F.col("answer").cast("string") if "answer" in benchmark.columns else F.lit(None).cast("string")
    items = scratch.write(benchmark.where("text IS NOT NULL").select("item_id", "text", answer.alias("answer")), "items")
    count, size = items.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    slices = max(1, -(-count // SLICE), -(-size // SLICE_BYTES))
    space, stop, idf = learn_space(docs, items)
    out = None
    for k in range(slices):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(slices)) == k).collect()
        found = docs.mapInPandas(_find([tuple(r) for r in rows], space, stop, idf, least), "doc_id long, text_hash long, item_id long, coverage double, cosine double")
        out = found if out is None else out.union(found)
    return out


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs whose text holds no item; rows are told by doc_id and text, so namesakes and null ids are judged by their own texts."""
    scratch = Scratch(docs.sparkSession, "clean")
    bad = scratch.write(_leaks(docs, benchmark).select("doc_id", "text_hash").distinct(), "bad")
    id_, hash_ = fresh(docs.columns, "id"), fresh(docs.columns, "hash")
    bad = bad.select(F.col("doc_id").alias(id_), F.col("text_hash").alias(hash_))
    return docs.join(bad, F.col("doc_id").eqNullSafe(F.col(id_)) & (F.xxhash64("text") == F.col(hash_)), "left_anti")
