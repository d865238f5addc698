"""A corpus pipeline: five stages over documents, each written as Parquet and read again as the next one's input.

The rows that a stage returns are all that later stages see. All stages but the
last return the columns of documents; ``n_chars`` follows changed texts.

Spark sends rows to Python in batches of 10000 rows or 64 MB, and holds each in
the executor's heap, outside of it and in the Python worker at the same time. The
stages lower the session's bound to ``BATCH`` bytes. It stays so after they
return, as that is when their rows are made; a row of more bytes is a batch.
"""

from __future__ import annotations

import functools

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from thicket.llm import bpe, crf, line_dedup, mixing, near_copies
from thicket.llm.queries import RANKS, REPEATS
from thicket.llm.lineage import shared_folder

#: Scores from which on a document is rejected.
TOXIC = 0.7
#: Bytes of rows sent to Python together, and the setting that bounds them.
BATCH, BOUND = 1 << 22, "spark.sql.execution.arrow.maxBytesPerBatch"


def _bounded(stage):
    """The stage, with the session's batches of ``BATCH`` bytes at most."""

    @functools.wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        now = spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(BOUND))
        if now > BATCH:
            spark.conf.set(BOUND, BATCH)
        return stage(spark, docs, sf_dir)

    return run


@_bounded
def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored as toxic go."""
    model = crf.fit_from(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), F.crc32(F.col("doc_id").cast("string")) % 3 != 1)
    return crf.score_texts(docs, model, score="__score", spans="__spans").filter(F.col("__score") < TOXIC).drop("__score", "__spans")


@_bounded
def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated runs of lines go, however short, but for runs of blank lines alone; all documents stay."""
    kept = line_dedup.dedupe(docs, min_words=1, n_lines="__lines", n_removed="__removed")
    changed = F.when(F.col("__removed") > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))
    return kept.withColumn("n_chars", changed).drop("__lines", "__removed")


@_bounded
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: five-word shingles with a similarity of 0.8 or more."""
    return near_copies.one_of_each(docs, words=5)


@_bounded
def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Small sources are repeated, twice at most; every document stays."""
    return mixing.realise(docs, max_repeats=REPEATS)


@_bounded
def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of whole texts, and digests of ids and of the decoded bytes."""
    return bpe.round_trip(docs, public_tokenizers.path(RANKS), public_tokenizers.PATTERN, keep_ids=True).drop("text")


STAGES = [
    ("toxicity", toxicity),
    ("line_dedup", lines),
    ("simhash_near_dedup", near_duplicates),
    ("mixing", mix),
    ("byte_bpe", encode),
]

#: Trained and iterative stages can't be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``, by way of Parquet in the shared folder."""
    docs, folder = spark.read.parquet(f"{sf_dir}/documents.parquet"), shared_folder(spark)
    for name, stage in STAGES[:-1]:
        path = f"{folder}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
