"""Mixing sources to target weights by Sainte-Lague apportionment of equal-token blocks.

Every source's documents, in seeded order, form one sequence of words cut into blocks of ``BLOCK``
words. Blocks are seats: highest quotients target/(2 seats + 1) give each source an integer quota, and
since the method is house monotone, the first k/shards of the seats are shard k's quota. Which blocks a
source gives is a seeded permutation of its block numbers, passed up to ``most`` times. Prefix sums of
sizes run in hash buckets, as many as the number of rows asks for, so a source with a third of all rows is spread over them.

Whole documents are mixed by the same order: all of them as often as the target holds the source, and once
more the first ones up to the rest of the target. The document on that cut is in if more than half of it is,
and what this leaves over or short is made up by its neighbours, until the one on the cut isn't larger than
the source's mean. Words miss the target by half of that one then.

The driver plans over one row for each source, up to ``MOST_SOURCES``. More of them stay a table: shares come
from sums over it, and the quotient of the last seat is searched by counts of the seats above.
"""

from __future__ import annotations

import heapq
import math
import struct
from bisect import bisect_right
from collections.abc import Callable, Iterable, Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabulon.llm.common import Scratch, fresh

BLOCK = 16
#: Rows of one hash bucket of a source, about, if it held all rows; buckets at least.
BUCKET_ROWS, BUCKETS = 100_000, 256
#: Sources that the driver plans for; beyond, points at which a search counts at once.
MOST_SOURCES, POINTS = 100_000, 16
#: Documents larger than their source's mean are looked at within so many means of the cut at once, about twice as many at most.
REACH = 32
WORD = r"[^\x20\x09-\x0D]+"


def targets(sizes: list[int], weights: list[int], most: int = 3) -> list[Fraction]:
    """Shares of sum(sizes) by weight, none above ``most`` times its size, the excess reshared by weight."""
    out, left, open_ = [Fraction(0)] * len(sizes), Fraction(sum(sizes)), sorted(range(len(sizes)), key=lambda i: Fraction(sizes[i], weights[i]))
    w = sum(weights)
    for i in open_:  # a source that is capped at this level stays so when others' excess is reshared
        out[i] = min(Fraction(most * sizes[i]), left * weights[i] / w)
        left -= out[i]
        w -= weights[i]
    return out


def sainte_lague(want: list[Fraction], seats: int, caps: list[int]) -> list[int]:
    """Seats by highest quotients want/(2s + 1), none above its cap; starts near the divisor's solution and steps by quotients."""
    total = sum(want)
    if not total:
        return [0] * len(want)
    low = seats - len(want)
    got = [min(c, max(0, math.floor(w * low / total))) if low > 0 else 0 for w, c in zip(want, caps)]
    heap = [(-w / (2 * g + 1), i) for i, (w, g, c) in enumerate(zip(want, got, caps)) if w and g < c]
    heapq.heapify(heap)
    for _ in range(seats - sum(got)):
        if not heap:
            break
        _, i = heap[0]
        got[i] += 1
        if got[i] < caps[i]:
            heapq.heapreplace(heap, (-want[i] / (2 * got[i] + 1), i))
        else:
            heapq.heappop(heap)
    return got


def _step(n: int, seed: str) -> tuple[int, int]:
    """Multiplier and shift of a seeded permutation of 0..n-1."""
    h = xxhash.xxh3_64_intdigest(seed.encode())
    a = h % (1 << 20) | 1  # so that block * a stays within 63 bits for up to 2**43 blocks
    while math.gcd(a, n) != 1:
        a += 2
    return a, (h >> 20) % n


def plan(sizes: dict, weights: tuple[int, ...] = (1, 2, 3), most: int = 3, shards: int = 8, seed: int = 7) -> list[tuple]:
    """Rows (source, source_size, target, blocks, quotas by shard, multiplier, shift) for sources in code-point order, null last."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    size = [sizes[s] for s in names]
    want = targets(size, [weights[i % len(weights)] for i in range(len(names))], most)
    seats, caps = round(Fraction(sum(size), BLOCK)), [most * -(-n // BLOCK) for n in size]
    ends = [sainte_lague(want, seats * (k + 1) // shards, caps) for k in range(shards)]
    out = []
    for i, s in enumerate(names):
        n = -(-size[i] // BLOCK)
        a, c = _step(max(n, 1), f"{seed}:{s!r}")
        quotas = np.diff([0, *(e[i] for e in ends)]).tolist()
        out.append((s, size[i], float(want[i]), n, quotas, a, c))
    return out


def _first(table: DataFrame, size: Callable, goals: list[int], upto: int, value: Callable[[int], float]) -> list[int]:
    """For each goal the least whole number from 0 to ``upto`` at which the table's sum of ``size`` of its value (k: the goal's place) reaches the goal.

    Sums don't fall as the number grows; ``upto`` stands if no smaller one reaches the goal.
    """
    low, high = [0] * len(goals), [upto] * len(goals)
    while any(a < b for a, b in zip(low, high)):
        points = sorted({(k, a + (b - a) * j // POINTS) for k, (a, b) in enumerate(zip(low, high)) if a < b for j in range(POINTS)})
        at = table.sparkSession.createDataFrame([(k, x, value(x)) for k, x in points], "k int, x long, v double")
        for r in table.crossJoin(F.broadcast(at)).groupBy("k", "x").agg(F.sum(size(F.col("v"), F.col("k"))).alias("got")).collect():
            if r["got"] >= goals[r["k"]]:
                high[r["k"]] = min(high[r["k"]], r["x"])
            else:
                low[r["k"]] = max(low[r["k"]], r["x"] + 1)
    return low


def plan_table(sources: DataFrame, scratch: Scratch, weights: tuple[int, ...] = (1, 2, 3), most: int = 3, shards: int = 8, seed: int = 7) -> DataFrame:
    """What ``plan`` gives, of sources (src, n, source_rows) of any number, and source_rows; quotients are doubles, equal ones go to the source earlier in the order."""
    order = sources.select("src", "n", "source_rows").orderBy(F.col("src").asc_nulls_last()).rdd.zipWithIndex().map(lambda x: (x[1], *x[0]))
    weight = F.array(*map(F.lit, weights))[F.pmod("i", F.lit(len(weights))).cast("int")]
    table = scratch.write(sources.sparkSession.createDataFrame(order, "i long, of string, source_size long, source_rows long").withColumn("weight", weight), "sources")
    of_weight = lambda f: F.coalesce(*(F.when(F.col("weight") == w, F.lit(f(w))) for w in sorted(set(weights))))
    total, heavy, count = table.agg(F.sum("source_size"), F.sum("weight"), F.count(F.lit(1))).first()
    level, capped = Fraction(total, heavy), None
    while True:  # the excess over capped sources raises the level of all others, which may cap more of them
        capped = F.col("source_size") <= of_weight(lambda w: math.floor(level * w / most))  # noqa: B023
        given, heavy = table.agg(F.coalesce(F.sum(F.when(capped, F.col("source_size"))), F.lit(0)), F.coalesce(F.sum(F.when(~capped, F.col("weight"))), F.lit(0))).first()
        if not heavy or level == (level := Fraction(total - most * given, heavy)):
            break
    target = F.when(capped, (most * F.col("source_size")).cast("double")).otherwise(of_weight(lambda w: float(level * w)))
    want = F.when(capped, most * F.col("source_size") * level.denominator).otherwise(of_weight(lambda w: level.numerator * w))  # whole, so that equal quotients are equal doubles
    table = scratch.write(table.withColumns({"target": target, "want": want.cast("double"), "blocks": F.ceil(F.col("source_size") / BLOCK)}), "targets")
    cap = most * F.col("blocks")

    def seats(t):
        """A source's quotients of t at least."""
        n = F.floor((F.col("want") / t + 1) / 2)
        n = n + F.when(F.col("want") / (2 * n + 1) >= t, 1).otherwise(0) - F.when((n > 0) & (F.col("want") / (2 * n - 1) < t), 1).otherwise(0)
        return F.least(cap, n)

    held = table.where("want > 0")
    last, largest, room = held.agg(F.min(F.col("want") / (2 * cap + 1)), F.max("want"), F.sum(cap)).first()
    if last is None:
        return table.withColumns({"quotas": F.array_repeat(F.lit(0).cast("long"), shards), "a": F.lit(1).cast("long"), "c": F.lit(0).cast("long")}).drop("i", "weight", "want")
    number = lambda x: struct.unpack("<q", struct.pack("<d", x))[0]  # noqa: E731  positive doubles stand in the order of their bits
    double = lambda n: struct.unpack("<d", struct.pack("<q", n))[0]
    top = number(largest) + 1
    goals = [min(room, round(Fraction(total, BLOCK)) * (k + 1) // shards) for k in range(shards)]
    at = [top - x for x in _first(held, lambda t, k: seats(t), goals, top - number(last), lambda x: double(top - x))]
    bounds = [F.array(*(F.lit(double(x + more)) for x in at)) for more in (0, 1)]
    above = held.agg(*(F.sum(seats(F.lit(double(x + 1)))) for x in at)).first()
    tied = lambda k: seats(bounds[0][k]) - seats(bounds[1][k])
    until = _first(held, lambda i, k: F.when(F.col("i") < i, tied(k)).otherwise(0), [g - a for g, a in zip(goals, above)], count, float)
    ends = [F.lit(0), *(seats(F.lit(double(x + 1))) + F.when(F.col("i") < n, seats(F.lit(double(x))) - seats(F.lit(double(x + 1)))).otherwise(0) for x, n in zip(at, until))]
    ends = [F.when(F.col("want") > 0, e).otherwise(0).cast("long") for e in ends]
    table = table.withColumn("quotas", F.array(*(b - a for a, b in zip(ends, ends[1:]))))

    def steps(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [_step(max(int(n), 1), f"{seed}:{None if pd.isna(s) else s!r}") for s, n in zip(b["of"], b["blocks"])]
            yield b.assign(a=[x[0] for x in found], c=[x[1] for x in found])

    table = table.drop("i", "weight", "want")
    schema = ", ".join(f"{n} {t}" for n, t in table.dtypes)
    return scratch.write(table.mapInPandas(steps, f"{schema}, a long, c long"), "planned")


class Cut:
    """Where the last pass over a source's whole documents ends, rest words from the first; settled ones are apart from the order."""

    def __init__(self, rest: float, settled: dict[int, tuple[int, bool]]):
        self.rest, self.settled = rest, settled

    def place(self) -> float:
        """The cut in words of the whole order: what settled ones give is taken off, and those before it are passed over."""
        at = self.rest - sum(size for size, given in self.settled.values() if given)
        for start in sorted(self.settled):
            if at >= start:
                at += self.settled[start][0]
        return at

    def settle(self, low: float, high: float, starts: list[int], ends: list[int]) -> bool:
        """Settles one document on the cut after another, of the larger ones that meet low to high, in order; True if the cut leaves that stretch first."""
        while low <= (at := self.place()) <= high:
            i = bisect_right(ends, at)
            if i == len(ends) or starts[i] >= at:
                return False
            self.settled[starts[i]] = ends[i] - starts[i], (starts[i] + ends[i]) / 2 < at
        return True


def _settle(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        out = []
        for r in b.itertuples(index=False):
            cut = Cut(r.rest, dict(zip(map(int, r.settled), zip(map(int, r.sizes), map(bool, r.given)))))
            starts, ends = ([] if x is None else [int(y) for y in x] for x in (r.starts, r.ends))
            more = cut.settle(r.cut - REACH * r.mean, r.cut + REACH * r.mean, starts, ends)
            held = sorted(cut.settled.items())
            out.append((r.of, r.full, r.rest, r.mean, cut.place(), [k for k, _ in held], [x[0] for _, x in held], [x[1] for _, x in held], more))
        yield pd.DataFrame(out, columns=["of", "full", "rest", "mean", "cut", "settled", "sizes", "given", "open"])


def _cut_whole(at: DataFrame, planned: DataFrame, near: Callable[[DataFrame], DataFrame], scratch: Scratch) -> DataFrame:
    """(of, full, cut, given, kept_out): passes over all documents of a source, the cut of the last one, starts of settled ones.

    Each round looks at a stretch around the cuts that aren't settled; it settles a document of each at least.
    """
    state = "of string, full int, rest double, mean double, cut double, settled array<long>, sizes array<long>, given array<boolean>, open boolean"
    large = scratch.write(at.where(F.col("to") - F.col("from") > F.col("source_size") / F.col("source_rows")).select("src", "from", "to").distinct(), "large")
    size = F.col("source_size")
    full = F.when(size > 0, F.floor(F.col("target") / size)).otherwise(0).cast("int")
    left = planned.select("of", full.alias("full"), (F.col("target") - full * size).alias("rest"), (size / F.col("source_rows")).alias("mean"))
    none = F.array().cast("array<long>")
    left = left.withColumns({"cut": F.col("rest"), "settled": none, "sizes": none, "given": F.array().cast("array<boolean>"), "open": F.lit(True)})
    done = []
    while True:
        reach = left.select("of", (F.col("cut") - REACH * F.col("mean")).alias("low"), (F.col("cut") + REACH * F.col("mean")).alias("high"))
        here = large.join(near(reach), F.col("src").eqNullSafe(F.col("of"))).where((F.col("to") > F.col("low")) & (F.col("from") < F.col("high")))
        here = here.groupBy(F.col("src").alias("s")).agg(F.sort_array(F.collect_list("from")).alias("starts"), F.sort_array(F.collect_list("to")).alias("ends"))
        now = scratch.write(left.join(here, F.col("of").eqNullSafe(F.col("s")), "left").drop("s").mapInPandas(_settle, state), "cuts")
        done.append(now.where("NOT open"))
        left = now.where("open")
        if left.isEmpty():
            break
    whole = done[0]
    for x in done[1:]:
        whole = whole.union(x)
    side = lambda given: F.transform(F.filter(F.arrays_zip("settled", "given"), lambda x: x["given"] == F.lit(given)), lambda x: x["settled"])
    return whole.select("of", "full", "cut", side(True).alias("in_"), side(False).alias("kept_out")).withColumnRenamed("in_", "given")


def _mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3, shards: int = 8, seed: int = 7, by_shard: bool = False) -> DataFrame:
    """The columns of ``mix_documents`` and src."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "mixing")
    rows = docs.select(
        "doc_id", F.xxhash64("text").alias("text_hash"), F.col("source").cast("string").alias("src"),
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
    ).withColumn("h", F.xxhash64(F.lit(seed), "doc_id", "text_hash"))
    rows = scratch.write(rows, "rows")
    rows = rows.withColumn("b", F.pmod("h", F.lit(max(BUCKETS, -(-rows.count() // BUCKET_ROWS)))).cast("int"))
    parts = scratch.write(rows.groupBy("src", "b").agg(F.sum("size").alias("n"), F.count(F.lit(1)).alias("rows")), "parts")
    sources = parts.groupBy("src").agg(F.sum("n").alias("n"), F.sum("rows").alias("source_rows"))
    found = sources.limit(MOST_SOURCES + 1).collect()
    many = len(found) > MOST_SOURCES
    if many:
        planned = plan_table(sources, scratch, weights, most, shards, seed)
    else:
        rows_of = {r["src"]: r["source_rows"] for r in found}
        planned = spark.createDataFrame(
            [(*r, rows_of[r[0]]) for r in plan({r["src"]: r["n"] for r in found}, weights, most, shards, seed)],
            "of string, source_size long, target double, blocks long, quotas array<long>, a long, c long, source_rows long",
        )
    near = (lambda df: df) if many else F.broadcast
    up = Window.partitionBy("src").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("src", "b", F.coalesce(F.sum("n").over(up), F.lit(0)).alias("base"))
    parts = parts.join(near(planned), F.col("src").eqNullSafe(F.col("of"))).drop("of")
    parts = scratch.write(parts, "starts").select(F.col("src").alias("s"), F.col("b").alias("k"), "base", "source_size", "source_rows", "target", "blocks", "quotas", "a", "c")
    inner = Window.partitionBy("src", "b").orderBy("h", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    equal = Window.partitionBy("src", "b").orderBy("h", "doc_id")
    at = rows.withColumns({
        "before": F.coalesce(F.sum("size").over(inner), F.lit(0)),
        "upto": F.sum("size").over(equal.rangeBetween(Window.unboundedPreceding, Window.currentRow)),
        "alike": F.sum("size").over(equal.rangeBetween(Window.currentRow, Window.currentRow)),
    })
    at = at.join(parts, F.col("src").eqNullSafe(F.col("s")) & (F.col("b") == F.col("k")))
    at = at.withColumn("start", F.col("base") + F.col("before")).withColumn("end", F.col("start") + F.col("size"))
    at = at.withColumn("to", F.col("base") + F.col("upto")).withColumn("from", F.col("to") - F.col("alike"))  # of equal rows together
    at = scratch.write(at.drop("s", "k", "before", "upto", "alike", "base"), "at")
    cuts = _cut_whole(at, planned, near, scratch)
    at = at.join(near(cuts), F.col("src").eqNullSafe(F.col("of"))).drop("of")
    quota = F.aggregate("quotas", F.lit(0).cast("long"), lambda x, y: x + y)
    at = at.withColumn("quota", quota)

    def held(block):
        """Words of the document in a block, times the passes that give this block."""
        inside = F.least(F.col("end"), (block + 1) * BLOCK) - F.greatest(F.col("start"), block * BLOCK)
        turn = F.pmod(block * F.col("a") + F.col("c"), F.col("blocks"))
        return F.struct(inside.alias("words"), turn.alias("turn"))

    spans = F.when(F.col("size") > 0, F.transform(F.sequence(F.floor(F.col("start") / BLOCK), F.floor((F.col("end") - 1) / BLOCK)), held)).otherwise(F.array())
    at = at.withColumn("spans", spans)
    given = lambda s, q: s["words"] * (F.floor(q / F.col("blocks")) + F.when(s["turn"] < F.pmod(q, F.col("blocks")), 1).otherwise(0))
    upto = lambda q: F.aggregate("spans", F.lit(0).cast("long"), lambda x, s: x + given(s, q))
    taken = F.when(F.col("size") > 0, upto(F.col("quota"))).otherwise(F.lit(0)).cast("long")
    inside = (F.col("from") + F.col("to")) / 2 < F.col("cut")
    again = F.when(F.array_contains("given", F.col("from")), 1).when(F.array_contains("kept_out", F.col("from")), 0).otherwise(inside.cast("int"))
    copies = F.when(F.col("size") > 0, F.col("full") + again).otherwise(0).cast("int")
    out = at.select("src", "doc_id", "text_hash", "size", "source_size", "target", taken.alias("taken"), copies.alias("copies"), *(["spans", "quotas", "blocks"] if by_shard else []))
    if not by_shard:
        return out
    first = lambda k: F.aggregate(F.slice("quotas", 1, k), F.lit(0).cast("long"), lambda x, y: x + y)
    words = F.array(*(upto(first(F.lit(k + 1))) - upto(first(F.lit(k))) for k in range(shards)))
    return out.withColumn("shard_words", F.when(F.col("size") > 0, words)).drop("spans", "quotas", "blocks")


def mix_documents(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, text_hash, size, source_size, target, taken, copies) for each row of docs (doc_id, text, source).

    size counts the words of the text (null: 0). A null source is a source, the last. taken counts the
    words of the document that the mix holds, repeats included, at most ``most`` times its size;
    Equal quotients go to the source earlier in the order. copies says how often the document is in a mix of whole ones, whose words by source meet the target
    up to a part of a document; ``by_shard`` adds shard_words, taken by shard. Rows without words take
    nothing. text_hash is the text's xxhash64. Equal rows stand next to each other in their source's
    order, take what falls on them, and have equal copies. Reruns agree. No rows give none.
    """
    return _mix(docs, **options).drop("src")


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs as often as the mixture holds them whole (``copies``); those it doesn't hold go."""
    scratch = Scratch(docs.sparkSession, "mixed")
    source, id_, hash_, copies, nth = (fresh(docs.columns, x) for x in ("_source", "_id", "_hash", "_copies", "_nth"))
    key = [F.col("src").alias(source), F.col("doc_id").alias(id_), F.col("text_hash").alias(hash_)]
    plan_ = _mix(docs, **options).where("copies > 0").select(*key, F.col("copies").alias(copies))
    plan_ = scratch.write(plan_.dropDuplicates([source, id_, hash_]), "plan")
    same = F.col("doc_id").eqNullSafe(F.col(id_)) & (F.xxhash64("text") == F.col(hash_)) & F.col("source").cast("string").eqNullSafe(F.col(source))
    return docs.join(plan_, same).withColumn(nth, F.explode(F.sequence(F.lit(1), F.col(copies)))).select(*docs.columns)
