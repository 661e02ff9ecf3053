"""Helpers that several operators of this package share."""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetloom.session import durable_copy, let_workers_import

#: Rows handed to a Python worker at once. Texts can be long, so a batch is kept far below Spark's 10,000 rows.
BATCH_ROWS = "500"


def ready_workers(spark: SparkSession) -> None:
    """Let workers import this package; lower the rows of an Arrow batch, unless the session has chosen a number of its own."""
    let_workers_import(spark)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, BATCH_ROWS)


def map_arrow(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``mapInArrow`` over batches small enough for long texts."""
    ready_workers(df.sparkSession)
    return df.mapInArrow(fn, schema)


def id_and_text(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``doc_id`` (long) and ``text`` (null becomes empty); no other column of ``docs`` is read.

    Ids are numbers, or text that states one; another text ends the job.
    """
    text = F.coalesce(docs[text_column], F.lit(""))
    return docs.select(docs[id_column].cast("long").alias("doc_id"), text.alias("text"))


def release_shuffles(spark: SparkSession) -> None:
    """Let the shuffle files of finished jobs go.

    Spark deletes them when nothing refers to a shuffle any more, which it learns from a collection
    of the driver's garbage. Asking for one bounds the disk by the dearest step, not the sum of all.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def kept_on_disk(df: DataFrame, label: str) -> DataFrame:
    """``durable_copy``, after which the shuffle files that made it may go."""
    stored = durable_copy(df, label)
    del df
    release_shuffles(stored.sparkSession)
    return stored
