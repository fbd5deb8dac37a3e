"""Tables that cut lineage between the steps of an iteration, and the folder that they and derived files go to."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROOT = str(Path(__file__).resolve().parents[1])


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package wherever the driver was started."""
    env = spark.sparkContext.environment
    if ROOT not in env.get("PYTHONPATH", "").split(":"):
        env["PYTHONPATH"] = ":".join(x for x in (env.get("PYTHONPATH", ""), ROOT) if x)


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder (spark.checkpoint.dir or one set before); where there is none, a temporary one if all runs on this machine.

    Elsewhere that is an error, since executors have to share the folder.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        found = sc.getConf().get("spark.checkpoint.dir")
        if not found and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(found or f"file://{tempfile.mkdtemp(prefix='spark-')}")
    return sc.getCheckpointDir()


def fresh_folder(spark: SparkSession, name: str) -> str:
    """A path for derived files that nothing has been written to."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """The rows, written to the shared folder and read again, so that later steps and lost executors don't compute them again.

    Unlike a checkpoint's, the table's size is known from its files, however long the iteration. It stays until ``discard`` or the driver's end.
    """
    path = fresh_folder(df.sparkSession, "cut")
    atexit.register(_delete, df.sparkSession, path)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Remove tables of ``cut`` that nothing reads any more."""
    for t in tables:
        _delete(t.sparkSession, t._path)


def _delete(spark: SparkSession, path: str) -> None:
    try:
        jvm, jsc = spark.sparkContext._jvm, spark.sparkContext._jsc
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # at the driver's end the JVM may be gone already
        pass


def meet(a: DataFrame, b: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Equi-join on keys of which nulls equal each other, with the keys once; b's other columns must have other names than a's."""
    right = b.select(*(F.col(c).alias(f"__{c}" if c in keys else c) for c in b.columns))
    cond = F.lit(True)
    for k in keys:
        cond &= F.col(k).eqNullSafe(F.col(f"__{k}"))
    out = a.join(right, cond, how)
    if how in ("outer", "full"):
        out = out.withColumns({k: F.coalesce(k, f"__{k}") for k in keys})
    return out.drop(*(f"__{k}" for k in keys))
