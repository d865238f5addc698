"""Incremental search and indexing: files that arrive are parsed once, in micro-batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from thicket.operators import index, search
from thicket.sources import scan

_BINARY = "path string, modificationTime timestamp, length long, content binary"


def watch(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of schema.FILES rows of files that appear below a folder; binary and unknown ones are left out."""
    raw = spark.readStream.format("binaryFile").schema(_BINARY).option("recursiveFileLookup", "true").load(folder)
    named = raw.withColumn("language", scan.language_of(F.col("path"))).filter(F.col("language").isNotNull() & ~scan.is_binary(F.col("content")) & (F.col("length") > 0))
    return named.select(F.xxhash64("path").alias("file_id"), "path", "language", "content", F.col("length").alias("file_size_bytes"), F.unix_timestamp("modificationTime").alias("mtime_secs"))


def search_stream(files: DataFrame, queries: list[str], sink: str, checkpoint: str, lang: str = "auto") -> StreamingQuery:
    """Append the matches of each batch of files to a Parquet folder; a batch that is run again replaces its own rows."""

    def batch(frame: DataFrame, number: int) -> None:
        search.search(frame, queries, lang).write.mode("overwrite").parquet(f"{sink}/batch={number}")

    return files.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).start()


def index_stream(files: DataFrame, sink: str, checkpoint: str) -> StreamingQuery:
    """Append index entries of arriving files; the latest entry of a path holds (``latest``)."""

    def batch(frame: DataFrame, number: int) -> None:
        index.entries(frame).write.mode("overwrite").parquet(f"{sink}/batch={number}")

    return files.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).start()


def latest(entries: DataFrame) -> DataFrame:
    """The newest entry of each path, of a table that ``index_stream`` has written."""
    columns = [c for c in entries.columns if c not in ("path", "batch")]
    return entries.groupBy("path").agg(F.max_by(F.struct(*columns), F.struct("mtime_secs", "batch")).alias("e")).select("path", "e.*")
