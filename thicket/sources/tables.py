"""File views of tables: each row is a file with an id, a path, a language and content."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def as_files(frame: DataFrame, file_id, path, language, text) -> DataFrame:
    """The schema.FILES columns from expressions; mtime is 0 for rows of a table."""
    content = text.cast("binary")
    return frame.select(file_id.cast("long").alias("file_id"), path.cast("string").alias("path"), language.alias("language"), content.alias("content"), F.octet_length(text).cast("long").alias("file_size_bytes"), F.lit(0).cast("long").alias("mtime_secs"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return as_files(d, F.col("doc_id"), F.concat(F.coalesce("source", F.lit("")), F.lit("/"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("."), F.coalesce("lang", F.lit(""))), F.lit("text"), F.col("text"))


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return as_files(d, F.col("page_id"), F.col("url"), F.lit("html"), F.col("html"))


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return as_files(d, F.col("conv_id") * 1000 + F.col("turn"), F.concat(F.col("conv_id").cast("string"), F.lit("/"), F.col("turn").cast("string"), F.lit("."), "role"), F.lit("text"), F.col("text"))
