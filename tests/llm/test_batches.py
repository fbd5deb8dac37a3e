"""Arrow batches that the pipeline's stages give to Python workers."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

FOLDER = "/root/testdata/sf0.001"
KEY = "spark.sql.execution.arrow.maxBytesPerBatch"


def most_in_a_batch(docs) -> int:
    """Bytes of text in the largest batch."""

    def run(batches):
        yield pd.DataFrame({"n": [max((int(b["text"].str.len().sum()) for b in batches), default=0)]})

    return docs.select("text").mapInPandas(run, "n long").agg(F.max("n")).first()[0]


@pytest.mark.parametrize("stage", ["language", "near_duplicates", "decontamination"])
def test_batches_of_long_texts_are_bounded(spark, stage):
    pipeline = pytest.importorskip("corpus_pipeline")
    few = spark.read.parquet(f"{FOLDER}/documents.parquet").limit(20)
    long = spark.range(600).coalesce(1).select(F.repeat(F.lit("word "), 8000).alias("text"))
    try:
        spark.conf.set(KEY, "64m")
        assert most_in_a_batch(long) == 600 * 40_000
        out = dict(pipeline.STAGES)[stage](spark, few, FOLDER)
        assert most_in_a_batch(long) <= (4 << 20) + 40_000
        assert 0 < out.count() <= 20
        spark.conf.set(KEY, "1m")  # a lower bound of the session's own stays
        dict(pipeline.STAGES)[stage](spark, few, FOLDER)
        assert most_in_a_batch(long) <= (1 << 20) + 40_000
    finally:
        spark.conf.unset(KEY)
