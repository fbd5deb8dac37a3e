"""What the training-data operators share: scratch tables, shipping of modules, small vector helpers."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

ROOT = str(Path(__file__).resolve().parents[2])
#: Bytes of an Arrow batch for Python workers, besides those of its last row.
BATCH_BYTES = 4 << 20


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package wherever the driver was started."""
    env = spark.sparkContext.environment
    if ROOT not in env.get("PYTHONPATH", "").split(":"):
        env["PYTHONPATH"] = ":".join(x for x in (env.get("PYTHONPATH", ""), ROOT) if x)


def bound_batches(spark: SparkSession) -> None:
    """From now on Arrow batches of this session end at BATCH_BYTES, if its own bound isn't lower.

    A batch lies in the JVM, as Arrow and as pandas in the worker, for each of an executor's tasks; by Spark's bounds it ends at 10,000 rows or 64 MB.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(key)) > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; where it is unset, a temporary one if all run on this machine."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(found or f"file://{tempfile.gettempdir()}/checkpoints")
    whole = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toString()
    return re.sub(r"^file:/(?!/)", "file:///", whole).rstrip("/")


class Scratch:
    """Tables written to the shared folder to cut lineage; a lost executor costs only the tasks it ran.

    Tables that a result reads lazily stay until the driver ends; ``drop`` removes those no longer needed.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.base = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.n = 0
        ship(spark)
        atexit.register(self.drop, self.base)

    def path(self, name: str = "t") -> str:
        self.n += 1
        return f"{self.base}/{self.n}-{name}"

    def write(self, df: DataFrame, name: str = "t") -> DataFrame:
        p = self.path(name)
        df.write.parquet(p)
        out = self.spark.read.schema(df.schema).parquet(p)
        out._scratch_path = p
        return out

    def tidy(self) -> None:
        """Let Spark's cleaner remove the shuffle files behind finished tables, which wait for the driver's garbage collection."""
        self.spark.sparkContext._jvm.System.gc()

    def drop(self, *tables) -> None:
        try:
            jvm, jsc = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc
            for t in tables:
                p = jvm.org.apache.hadoop.fs.Path(t if isinstance(t, str) else t._scratch_path)
                p.getFileSystem(jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # at the driver's end the JVM may be gone already
            pass


def fresh(taken: list[str], name: str) -> str:
    """The name, with underscores after it until no column in ``taken`` has it."""
    low = {c.lower() for c in taken}
    while name.lower() in low:
        name += "_"
    return name


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective mixer of 64-bit values."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_PRIME = 0x9E3779B97F4A7C15
_powers: list[tuple[np.ndarray, np.ndarray]] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number modulo 2**64 and their inverses, n at least."""
    if not _powers or len(_powers[0][0]) < n:
        size = max(n, 1 << 20)
        up, down = np.full(size, _PRIME, np.uint64), np.full(size, pow(_PRIME, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        _powers[:] = [(np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64))]
    return _powers[0]


def hash_words(parts: list[bytes], values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit ids of all words of the parts in order, and how many each part has; a polynomial hash by prefix sums.

    values: a number for each byte, 0 for those between words, the blank among them.
    """
    data = np.frombuffer(b" ".join([*parts, b""]), np.uint8)
    value = values[data]
    edge = np.diff(np.concatenate([np.zeros(1, np.int8), (value != 0).view(np.int8)]))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    up, down = powers(len(data) + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(value * up[: len(data)], dtype=np.uint64)])
    ids = mix64((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64))
    ends = np.cumsum([len(p) + 1 for p in parts])
    return ids, np.bincount(np.searchsorted(ends, start, side="right"), minlength=len(parts))[: len(parts)]


def runs(batches: Iterable[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """Groups of consecutive rows with equal keys, of a partition sorted by them; holds one group at a time."""
    held: list[pd.DataFrame] = []
    for b in batches:
        if not len(b):
            continue
        k = b[keys].to_numpy()
        cuts = [0, *(np.flatnonzero((k[1:] != k[:-1]).any(axis=1)) + 1).tolist(), len(b)]
        if held and not (held[-1][keys].iloc[-1].to_numpy() == k[0]).all():
            yield pd.concat(held, ignore_index=True) if len(held) > 1 else held[0]
            held = []
        for lo, hi in zip(cuts[:-1], cuts[1:]):
            part = b.iloc[lo:hi]
            if lo:
                yield pd.concat(held, ignore_index=True) if len(held) > 1 else held[0]
                held = []
            held.append(part)
    if held:
        yield pd.concat(held, ignore_index=True) if len(held) > 1 else held[0]


#: A-Z to a-z; what isn't a digit, a letter or beyond ASCII to a blank.
_WORD_BYTES = bytes(ord(" ") if i < 0x30 or 0x3A <= i < 0x41 or 0x5B <= i < 0x61 or 0x7B <= i < 0x80 else i + 32 if 0x41 <= i < 0x5B else i for i in range(256))


def word_lists(text: bytes, step: int = 1 << 20) -> Iterator[list[bytes]]:
    """The words of a whole UTF-8 text in order, A-Z lower-cased, in lists from about ``step`` bytes each, so a long text needs no list of all."""
    low, at = text.translate(_WORD_BYTES), 0
    while at < len(low):
        end = low.find(b" ", at + step)
        end = len(low) if end < 0 else end
        yield low[at:end].split()
        at = end
