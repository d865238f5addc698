"""Cutting lineage in the shared checkpoint folder, and fitting bounded samples away from the driver."""

from __future__ import annotations

import gc
import pickle
import tempfile
import time
import uuid
from collections.abc import Callable, Iterable
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Seconds between two releases of what past rounds left on disk.
REST = 2.0
_released = [0.0]


def _release(spark: SparkSession) -> None:
    """Let go of shuffle files and checkpoints that no frame needs any more.

    Spark deletes them once the driver's garbage collector finds their owners
    gone, by default every half hour; until then the rounds of an iterative job
    pile up on the executors' disks, however small the last round is.
    """
    if time.monotonic() - _released[0] >= REST:
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        _released[0] = time.monotonic()


def _ready(spark: SparkSession) -> str:
    context = spark.sparkContext
    if not context.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not context.master.startswith("local[") and context.master != "local":
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="checkpoints-")
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def cut(frame: DataFrame) -> DataFrame:
    """Write the rows to the folder that the cluster names in spark.checkpoint.dir and go on from there.

    Where that setting is empty, a folder of our own is made only if driver and
    executors are one process on one machine, as in tests; a cluster is refused.
    """
    spark = frame.sparkSession
    _ready(spark)
    kept = frame.checkpoint(eager=True)
    del frame
    _release(spark)
    return kept


def shared_folder(spark: SparkSession) -> str:
    """A new folder below the shared one, for tables."""
    return f"{_ready(spark)}/{uuid.uuid4().hex}"


def in_one_task(rows: DataFrame, make: Callable[[Iterable[pa.RecordBatch]], Any]) -> Any:
    """What ``make`` returns for the Arrow batches of ``rows``, which the caller has bounded, in their order. It runs in a task; only its result comes to the driver."""

    def run(batches):
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(make(batches))], pa.binary())], ["made"])

    return pickle.loads(rows.coalesce(1).mapInArrow(run, "made binary").first()["made"])
