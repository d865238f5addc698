"""Each stage of the pipeline bounds the bytes of rows that are sent to Python together."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline

SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def _sizes(frame):
    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows]), pa.array([batch.nbytes])], ["rows", "bytes"])

    return [tuple(r) for r in frame.mapInArrow(run, "rows long, bytes long").collect()]


@pytest.fixture(autouse=True)
def setting(spark):
    spark.conf.unset(SETTING)
    yield
    spark.conf.unset(SETTING)


def _texts(spark, rows, chars):
    return spark.range(0, rows, 1, 1).select(F.col("id").alias("doc_id"), F.expr(f"repeat('ab ', {chars // 3})").alias("text"), F.lit("en").alias("lang"), F.lit("s").alias("source"), F.lit(chars).cast("long").alias("n_chars"))


@pytest.mark.parametrize("name", [name for name, _ in corpus_pipeline.STAGES])
def test_stages_bound_their_batches(spark, tmp_path, name):
    spark.createDataFrame([(0, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    dict(corpus_pipeline.STAGES)[name](spark, _texts(spark, 4, 30), str(tmp_path))
    sizes = _sizes(_texts(spark, 40, 600_000))
    assert sum(rows for rows, _ in sizes) == 40
    assert max(size for _, size in sizes) < 5 << 20
    # a row of more bytes is a batch
    assert [rows for rows, _ in _sizes(_texts(spark, 3, 9_000_000))] == [1, 1, 1]


def test_a_lower_bound_of_the_caller_stays(spark):
    spark.conf.set(SETTING, "1m")
    corpus_pipeline.mix(spark, _texts(spark, 4, 30), "")
    assert spark.conf.get(SETTING) == "1m"
