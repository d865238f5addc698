"""The file index: one filter a file, kept up to date by file time and size."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from thicket.functions import sieve, trigram
from thicket.schema import IndexVersionMismatch

VERSION = 1


def entries(files: DataFrame) -> DataFrame:
    """(path, mtime_secs, file_size_bytes, bits, language) of files."""
    return trigram.with_bits(files.select("path", "mtime_secs", "file_size_bytes", "content", "language")).select("path", "mtime_secs", "file_size_bytes", "bits", "language")


def status(files: DataFrame, index: DataFrame) -> DataFrame:
    """All columns of files, with the entry's bits and ``status``: not_indexed, stale or fresh."""
    known = index.select(F.col("path").alias("__path"), F.col("mtime_secs").alias("__mtime"), F.col("file_size_bytes").alias("__size"), "bits")
    same = (F.col("__mtime") == F.col("mtime_secs")) & F.col("__size").eqNullSafe(F.col("file_size_bytes")) & F.col("bits").isNotNull()
    named = F.when(F.col("__path").isNull(), "not_indexed").when(same, "fresh").otherwise("stale")
    return files.join(known, F.col("path") == F.col("__path"), "left").withColumn("status", named).drop("__path", "__mtime", "__size")


def candidates(files: DataFrame, index: DataFrame, queries: list[str], compat: bool = False) -> DataFrame:
    """Files that have to be parsed: all but those that are fresh in the index and whose filter rules every query out."""
    seen = status(files, index)
    return seen.filter((F.col("status") != "fresh") | sieve.accepts(F.col("bits"), queries, compat)).select(*files.columns)


def removed(index: DataFrame, files: DataFrame) -> DataFrame:
    """Entries of files that are gone."""
    return index.join(files.select("path"), "path", "left_anti")


def kept(index: DataFrame, files: DataFrame) -> DataFrame:
    return index.join(files.select("path"), "path", "left_semi")


def refresh(index: DataFrame, files: DataFrame) -> DataFrame:
    """The index after a walk: fresh entries as they are, new ones for the rest, none for files that are gone."""
    seen = status(files, index)
    old = seen.filter("status = 'fresh'").select("path", "mtime_secs", "file_size_bytes", "bits", "language")
    new = entries(seen.filter("status <> 'fresh'").select(*files.columns))
    return old.unionByName(new)


def save(index: DataFrame, path: str) -> None:
    """Write an index, with its version, beside what is there, and then put it in its place. ``index`` may have been read from there."""
    put_in_place(index.withColumn("version", F.lit(VERSION)), path)


def put_in_place(frame: DataFrame, path: str) -> None:
    """Write a table to a folder beside ``path`` and rename it; a job that dies before leaves the old one, and one that dies between the renames leaves both beside it."""
    context = frame.sparkSession.sparkContext
    hadoop = context._jvm.org.apache.hadoop.fs.Path
    new, old = f"{path.rstrip('/')}.{uuid.uuid4().hex}.new", f"{path.rstrip('/')}.{uuid.uuid4().hex}.old"
    frame.write.parquet(new)
    store = hadoop(path).getFileSystem(context._jsc.hadoopConfiguration())
    if store.exists(hadoop(path)) and not store.rename(hadoop(path), hadoop(old)):
        raise OSError(f"{path} can't be moved")
    if not store.rename(hadoop(new), hadoop(path)):
        raise OSError(f"{new} can't be moved to {path}")
    store.delete(hadoop(old), True)


def load(spark: SparkSession, path: str) -> DataFrame:
    found = spark.read.parquet(path)
    other = found.filter(F.col("version") != VERSION).limit(1).collect()
    if other:
        raise IndexVersionMismatch(f"index version {other[0]['version']}, expected {VERSION}")
    return found.drop("version")
