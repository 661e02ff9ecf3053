"""Sinks: reports and accumulated benchmark results."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_report(df: DataFrame, path: str, fmt: str = "json", order: str | Sequence[str] | None = None) -> None:
    """Write report rows as JSON Lines or Parquet; ordering belongs to the report only."""
    if fmt not in ("json", "parquet"):
        raise ValueError(f"unknown report format: {fmt!r}")
    ordered_report(df, order).write.mode("errorifexists").format(fmt).save(path)


def ordered_report(df: DataFrame, order: str | Sequence[str] | None) -> DataFrame:
    """Rows in report order (range-partitioned sort)."""
    if order is None:
        return df
    return df.orderBy(*([order] if isinstance(order, str) else order))


#: Builds of one batch up to which the store is pruned to them by name.
NAMED_BUILDS = 1000


def append_results(df: DataFrame, path: str, by: Sequence[str] = ("cluster", "serial"), run: str = "run_id") -> None:
    """Append run metrics under ``cluster=/serial=``; earlier builds are never overwritten.

    Runs (``run`` within a build) that are there already are left out, so a repeated write adds nothing, and one
    that was cut short is completed. Only folders of builds in this batch are looked at: their names
    prune the store where they are at most ``NAMED_BUILDS``, else a join with them does.
    The rebalance hint lets adaptive execution gather each build into few files and split
    one that is large, instead of one file per task and build or one task per build.
    """
    there = stored_runs(df, path, by, run)
    if there is not None:
        df = df.join(there, [*by, run], "left_anti")
    df.hint("rebalance", *by).write.mode("append").partitionBy(*by).parquet(path)


def stored_runs(df: DataFrame, path: str, by: Sequence[str] = ("cluster", "serial"), run: str = "run_id") -> DataFrame | None:
    """Keys of the runs that the store at ``path`` has of the builds in ``df``; None without a store.

    Folder names are read in the types of ``df``, so a serial ``007`` stays text.
    """
    keys = [*by, run]
    kinds = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)
    try:
        there = df.sparkSession.read.schema(kinds).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    builds = df.select(*by).distinct()
    named = builds.limit(NAMED_BUILDS + 1).collect()
    if len(named) > NAMED_BUILDS:
        return there.join(builds, list(by), "left_semi").distinct()
    for column in by:
        names = {r[column] for r in named}
        there = there.where(F.col(column).isin(*(n for n in names if n is not None)) | (F.col(column).isNull() if None in names else F.lit(False)))
    return there.distinct()
