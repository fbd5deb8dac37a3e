"""Delimited files as cells, any size: a file is read by many tasks, each from a block of whole lines.

Whether a block starts inside a quoted field isn't known where it is read. So each block first says what it makes of
both cases: how it ends, and how many records end in it. These are functions of two states; windows over a file's
blocks compose them and sum the records, which gives every block its start and its first row number. The
encoding is the first one that all blocks of a file are well-formed in. Then blocks are parsed; a record that
spans blocks is put together from its fragments. A record has to fit a task, a file needn't.

Lines are split at the byte of a line feed, which isn't part of any character in the encodings read here; other line ends
are found while parsing.
"""

from __future__ import annotations

import csv
import io
import re
from bisect import bisect_left
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabulon.sources.sheets import DELIMITED, ENCODINGS, GRID, coerce
from tabulon.tables import cut, ship

#: Bytes that a step parses, about; blocks up to which what is known of them is broadcast.
PIECE, FEW = 4 << 20, 100_000

# A field as csv.reader takes it: quotes count at its start only, and what follows a closing quote belongs to it.
_FIELD = rb'(?:"(?:[^"]++|"")*+"[^,\r\n]*+|(?!")[^,\r\n]*+)'
_END = rb"(?:\r\n|[\r\n])"
_RECORD = re.compile(_FIELD + rb"(?:," + _FIELD + rb")*+" + _END)
_REST = re.compile(rb'(?:[^"]++|"")*+"[^,\r\n]*+(?:,' + _FIELD + rb")*+" + _END)


def record_ends(data: bytes, at: int = 0) -> list[int]:
    """Where records end that start one after the other from ``at``; the last one may be short of the data's end, its quotes being open."""
    if data.find(b'"', at) < 0:
        return [m.end() for m in re.compile(_END).finditer(data, at)]
    out, scan = [], _RECORD.scanner(data, at).match
    while m := scan():
        out.append(m.end())
    return out


def both_ways(data: bytes) -> tuple[tuple[bool, int], tuple[bool, int]]:
    """For whole lines that start outside, and inside, of quotes: whether they end inside, and how many records end in them."""
    if b'"' not in data:
        return (False, data.count(b"\n") + data.count(b"\r") - data.count(b"\r\n")), (True, 0)
    ends = record_ends(data)
    outside = (ends[-1] if ends else 0) < len(data), len(ends)
    m = _REST.match(data)
    if not m:
        return outside, (True, 0)
    k = bisect_left(ends, m.end())
    if k < len(ends) and ends[k] == m.end():  # from here on both ways are one
        return outside, (outside[0], len(ends) - k)
    ends = record_ends(data, m.end())
    return outside, ((ends[-1] if ends else m.end()) < len(data), 1 + len(ends))


def fitting(data: bytes) -> int:
    """A bit for each of ENCODINGS that the data is well-formed in."""
    if data.isascii():
        return (1 << len(ENCODINGS)) - 1
    out = 0
    for i, name in enumerate(ENCODINGS):
        try:
            data.decode(name)
            out |= 1 << i
        except UnicodeDecodeError:
            pass
    return out


def _pieces(batches: Iterable[pa.RecordBatch], more: tuple[str, ...] = ()) -> Iterator[tuple[tuple, bytes]]:
    """(path, start, further columns) and about PIECE bytes of whole lines of one block at a time, in order."""
    held, size, now = [], 0, None
    for b in batches:
        if not b.num_rows:
            continue
        keys = list(zip(*(b.column(c).to_pylist() for c in ("path", "start", *more))))
        length = pc.binary_length(b.column("value")).to_numpy(zero_copy_only=False)
        lines, lo = b.column("value").to_pylist(), 0
        change = [i for i in range(1, len(keys)) if keys[i] != keys[i - 1]] + [len(keys)]
        for hi in change:
            if held and keys[lo] != now:
                yield now, b"\n".join(held) + b"\n"
                held, size = [], 0
            now = keys[lo]
            while lo < hi:
                sums = size + np.cumsum(length[lo:hi] + 1)
                k = min(int(np.searchsorted(sums, PIECE)) + 1, hi - lo)
                held += lines[lo : lo + k]
                size, lo = int(sums[k - 1]), lo + k
                if size >= PIECE:
                    yield now, b"\n".join(held) + b"\n"
                    held, size = [], 0
    if held:
        yield now, b"\n".join(held) + b"\n"


def _survey(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(path, start, out_inside, out_records, in_inside, in_records, fits) of each block."""
    found: dict[tuple, list] = {}
    for key, data in _pieces(batches):
        state = found.setdefault(key, [False, 0, True, 0, (1 << len(ENCODINGS)) - 1])
        ways = both_ways(data)
        for k in (0, 2):
            inside, n = ways[state[k]]
            state[k], state[k + 1] = inside, state[k + 1] + n
        state[4] &= fitting(data)
    names = ["path", "start", "out_inside", "out_records", "in_inside", "in_records", "fits"]
    types = [pa.string(), pa.int64(), pa.bool_(), pa.int64(), pa.bool_(), pa.int64(), pa.int32()]
    columns = zip(*((*k, *v) for k, v in found.items())) if found else [[]] * len(names)
    yield pa.record_batch([pa.array(list(c), t) for c, t in zip(columns, types)], names=names)


def _lines(spark: SparkSession, folder: str) -> DataFrame:
    """(path, start, value): lines by block, in order within each."""
    known = ",".join("".join(f"[{c}{c.upper()}]" for c in s) for s in DELIMITED)
    text = spark.read.option("lineSep", "\n").option("pathGlobFilter", f"*.{{{known}}}").text(folder)
    rows = text.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"), F.col("value").cast("binary").alias("value"))
    return rows.where(~F.col("path").rlike(r"/(~|%7E)(\$|%24)[^/]*$"))


def _blocks(survey: DataFrame) -> DataFrame:
    """(path, start, inside, before, opens, encoding) of each block: its state and the records that ended before it, whether it ends inside.

    A block that ends alike either way settles the state; others keep it or turn it round, so the state is the last
    settled one, turned as often as blocks since turned it.
    """
    own = Window.partitionBy("path").orderBy("start")
    prior = own.rowsBetween(Window.unboundedPreceding, -1)
    turned = F.sum((F.col("out_inside") & ~F.col("in_inside")).cast("long"))
    out = survey.withColumn("turns", F.coalesce(turned.over(own.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0)))
    settled = F.when(F.col("out_inside") == F.col("in_inside"), F.struct(F.col("out_inside").alias("to"), "turns"))
    out = out.withColumns({"last": F.last(settled, ignorenulls=True).over(prior), "so_far": F.coalesce(F.lag("turns").over(own), F.lit(0))})
    odd = F.pmod(F.col("so_far") - F.coalesce("last.turns", F.lit(0)), F.lit(2)) == 1
    out = out.withColumn("inside", F.coalesce("last.to", F.lit(False)) != odd)
    own_records = F.when(F.col("inside"), F.col("in_records")).otherwise(F.col("out_records"))
    fits = F.bit_and("fits").over(Window.partitionBy("path"))
    first = F.lit(None).cast("string")
    for i in reversed(range(len(ENCODINGS))):
        first = F.when(fits.bitwiseAND(1 << i) != 0, ENCODINGS[i]).otherwise(first)
    return out.select(
        "path", "start", "inside", F.coalesce(F.sum(own_records).over(prior), F.lit(0)).alias("before"),
        F.when(F.col("inside"), F.col("in_inside")).otherwise(F.col("out_inside")).alias("opens"), first.alias("encoding"),
    )


def _parsed(data: bytes, encoding: str, row: int) -> list[tuple]:
    csv.field_size_limit(1 << 30)
    out, text = [], data.decode(encoding.removesuffix("-sig"))
    for r, line in enumerate(csv.reader(io.StringIO(text, newline="")), row + 1):
        for c, value in enumerate(line, 1):
            if (found := coerce(value)) is not None:
                out.append((r, c, *found))
    return out


_CELLS = "path string, row long, col int, text string, number double"
_SCHEMA = pa.schema([("path", pa.string()), ("row", pa.int64()), ("col", pa.int32()), ("text", pa.string()), ("number", pa.float64())])
_FRAGMENT = pa.schema([("path", pa.string()), ("row", pa.int64()), ("encoding", pa.string()), ("start", pa.int64()), ("nth", pa.int64()), ("data", pa.binary())])


def _frame(path: str, rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=["row", "col", "text", "number"])
    out.insert(0, "path", path)
    return out.astype({"row": "int64", "col": "int32", "number": "Float64"})


def _open_parts(key: tuple, data: bytes, state: dict) -> Iterator[tuple[int, bytes, bool]]:
    """(records before, bytes, whole) of stretches: whole records at a time, and fragments of those that a block starts or ends inside of.

    state: of the block so far: inside, row, and the bytes held of a record that began in this block (None for one that began before).
    """
    at = 0
    if state["inside"]:
        m = _REST.match(data)
        at = m.end() if m else len(data)
        if state["held"] is None:
            yield state["row"], data[:at], False
        else:
            state["held"].append(data[:at])
        if not m:
            return
        if state["held"] is not None:
            yield state["row"], b"".join(state["held"]), True
        state["row"] += 1
    ends = record_ends(data, at)
    end = ends[-1] if ends else at
    if ends:
        yield state["row"], data[at:end], True
        state["row"] += len(ends)
    state["inside"], state["held"] = end < len(data), [data[end:]]


def _stretches(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[tuple, int, bytes, bool]]:
    names, now, state = ("inside", "before", "encoding"), None, {}
    for key, data in _pieces(batches, names):
        if key != now:
            if state.get("inside") and state["held"]:
                yield now, state["row"], b"".join(state["held"]), False
            now, state = key, {"inside": key[2], "row": key[3], "held": None}
            data = data.removeprefix(b"\xef\xbb\xbf") if key[1] == 0 and key[4].startswith("utf-8") else data
        for row, part, whole in _open_parts(key, data, state):
            yield key, row, part, whole
    if state.get("inside") and state["held"]:
        yield now, state["row"], b"".join(state["held"]), False


def _whole(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for key, row, data, whole in _stretches(batches):
        if whole:
            frame = _frame(key[0], _parsed(data, key[4], row))
            yield from pa.Table.from_pandas(frame, _SCHEMA, preserve_index=False).to_batches()


def _fragments(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for nth, (key, row, data, whole) in enumerate(_stretches(batches)):
        if not whole:
            yield pa.record_batch([[x] for x in (key[0], row, key[4], key[1], nth, data)], schema=_FRAGMENT)


def _mended(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        for path, row, encoding, parts in zip(b["path"], b["row"], b["encoding"], b["parts"]):
            yield _frame(path, _parsed(b"".join(bytes(p) for p in parts), encoding, row))


def name_of(path: Column) -> Column:
    return F.url_decode(F.replace(F.element_at(F.split(path, "/"), -1), F.lit("+"), F.lit("%2B")))


def read_delimited(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of GRID for the delimited files in a folder, without a header; the cells of a file are those of reading it whole.

    A file that none of ENCODINGS fits gives a row with a warning. Files are listed and split by Spark, so
    spark.sql.files.maxPartitionBytes is the size of a block. What is known of the blocks is broadcast for FEW of them, else the lines are
    shuffled by block. Empty files give no rows.
    """
    ship(spark)
    survey = _lines(spark, folder).mapInArrow(_survey, "path string, start long, out_inside boolean, out_records long, in_inside boolean, in_records long, fits int")
    blocks = cut(_blocks(survey))
    good = blocks.where("encoding IS NOT NULL")

    def known(of: DataFrame) -> DataFrame:
        lines = _lines(spark, folder)
        if of.count() <= FEW:
            out = lines.join(F.broadcast(of), ["path", "start"])
        else:
            out = lines.withColumn("at", F.monotonically_increasing_id()).join(of, ["path", "start"]).repartition("path", "start").sortWithinPartitions("path", "start", "at")
        return out.select("path", "start", "inside", "before", "encoding", "value")

    cells = known(good).mapInArrow(_whole, _CELLS)
    edges = known(good.where("inside OR opens")).mapInArrow(_fragments, "path string, row long, encoding string, start long, nth long, data binary")
    parts = F.transform(F.sort_array(F.collect_list(F.struct("start", "nth", "data"))), lambda x: x["data"])
    mended = edges.groupBy("path", "row", "encoding").agg(parts.alias("parts")).mapInPandas(_mended, _CELLS)
    name = name_of(F.col("path"))
    out = cells.unionByName(mended).select(name.alias("file"), F.regexp_replace(name, r"\.[^.]*$", "").alias("sheet"), F.col("row").cast("int").alias("row"), "col", "text", "number", F.lit(None).cast("string").alias("warning"))
    nothing = {c.split()[0]: F.lit(None).cast(c.split()[1]) for c in GRID.split(", ")}
    bad = blocks.where("encoding IS NULL").select("path").distinct()
    told = bad.select(*({**nothing, "file": name, "warning": F.lit(f"can't be opened: none of {', '.join(ENCODINGS)} fits")}[c].alias(c) for c in nothing))
    return out.unionByName(told)
