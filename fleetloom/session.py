"""Session settings and the shared scratch folder."""

from __future__ import annotations

import os
import re
import uuid

from pyspark.sql import SparkSession

#: Settings that may change after the session has started; results and plans of the operators count on them.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # samples of one wait are merged in the task that read them, before the shuffle
    "spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition": "true",
}


def build_session(app_name: str = "fleetloom", master: str | None = None, **conf: str) -> SparkSession:
    """A session with ``SETTINGS``.

    Cluster-level settings (executors, memory, ``spark.checkpoint.dir``) come from
    ``spark-submit``; only ``master`` and explicit ``conf`` entries are set here.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in (SETTINGS | {k.replace("__", "."): v for k, v in conf.items()}).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def let_workers_import(spark: SparkSession) -> None:
    """Put the folder of this package on the path of Python workers that are started from now on.

    Harmless where the package is installed or shipped; needed where it only lies beside the driver's script.
    """
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    given = spark.sparkContext.environment.get("PYTHONPATH", "").split(os.pathsep)
    if root not in given:
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join([root, *[p for p in given if p]])


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach: ``spark.checkpoint.dir``; in local mode, where that is unset, one below the warehouse.

    On a cluster the warehouse may be a folder of the driver alone, so there the setting is required.
    No setting of the session is changed.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured and not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return configured.rstrip("/") if configured else f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_scratch"


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def tasks_for(df, rows: int) -> int:
    """Tasks of at most about ``rows`` rows each. For rows of few bytes and much work: adaptive execution, which goes by bytes, would give them all to a few tasks."""
    return max(1, -(-df.count() // rows))


def durable_copy(df, label: str):
    """Write ``df`` to the shared folder and read it back.

    Cuts lineage in a way that survives lost executors and gives every later reader the
    same rows, which matters where a column depends on how the input was split.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.mode("errorifexists").parquet(path)
    return df.sparkSession.read.parquet(path)
