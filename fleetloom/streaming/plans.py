"""Stateless and windowed stream operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetloom.functions import fixed_values as fixed
from fleetloom.functions.text import as_col
from fleetloom.operators.health import with_line_counts
from fleetloom.streaming.trackers import LATENESS


def action_plan(status: str | Column, action: str | Column) -> Column:
    """``abort``, ``done``, ``wait`` or ``request`` for a fleet status and a wanted action."""
    state, wanted = as_col(status), as_col(action)
    done, pending = F.lit(False), F.lit(False)
    for name in fixed.FLEET_DONE:
        done = done | ((wanted == name) & state.isin(*fixed.FLEET_DONE[name]))
        pending = pending | ((wanted == name) & state.isin(*fixed.FLEET_PENDING[name]))
    no = F.lit(False)
    return (
        F.when(~F.coalesce(wanted.isin(*fixed.FLEET_DONE), no), "error")
        .when(F.coalesce(state == fixed.FLEET_ABORT, no), "abort")
        .when(F.coalesce(done, no), "done")
        .when(F.coalesce(pending, no), "wait")
        .otherwise("request")
    )


def plan_actions(stream: DataFrame, *, status: str = "status", action: str = "action") -> DataFrame:
    """Rows with their ``plan``; works on streams and tables, keeps no state."""
    return stream.withColumn("plan", action_plan(status, action))


def node_state_stream(
    stream: DataFrame, *, key: str | Sequence[str] = (), ts: str, line: str = "line", window: str = "1 hour", lateness: str = LATENESS, count_lines: bool = False
) -> DataFrame:
    """Usable and unusable nodes per key and tumbling window, final when the window closes.

    Lines of a window that has closed are dropped; with ``count_lines`` each window tells how many
    ``lines`` it holds, from which ``late_rows`` works out how many were dropped.
    """
    keys = [key] if isinstance(key, str) else list(key)
    counted = with_line_counts(stream.select(*keys, ts, line), line).withWatermark(ts, lateness)
    sums = [F.sum("line_usable").alias("usable"), F.sum("line_unusable").alias("unusable")] + [F.count(F.lit(1)).alias("lines")] * count_lines
    totals = counted.groupBy(*keys, F.window(ts, window).alias("w")).agg(*sums)
    return totals.select(*keys, F.col("w.start").alias("window_start"), "usable", "unusable", *["lines"] * count_lines)


INPUT = "input"


def observed_input(stream: DataFrame) -> DataFrame:
    """The stream with its rows counted as they are read."""
    return stream.observe(INPUT, F.count(F.lit(1)).alias("rows"))


def run_to_files(stream: DataFrame, path: str, checkpoint: str, *, fmt: str = "parquet") -> DataFrame:
    """Run a stream over all data available now into files and return them as a table."""
    return run_and_count(stream, path, checkpoint, fmt=fmt)[0]


def run_and_count(stream: DataFrame, path: str, checkpoint: str, *, fmt: str = "parquet") -> tuple[DataFrame, int]:
    """``run_to_files``, and how many rows of an ``observed_input`` this run has read."""
    query = (
        stream.writeStream.format(fmt)
        .outputMode("append")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    read: dict[int, int] = {}
    running = True
    while running:  # only the latest batches are remembered by the query
        running = not query.awaitTermination(5)
        read |= {p.batchId: p.observedMetrics[INPUT]["rows"] for p in query.recentProgress if INPUT in p.observedMetrics}
    return stream.sparkSession.read.schema(stream.schema).format(fmt).load(path), sum(read.values())


def late_rows(rows_read: int, closed: DataFrame, checkpoint: str, *, lines: str = "lines") -> DataFrame:
    """What became of all rows that a stream with ``count_lines`` has read: ``read, closed, open, late``.

    Rows are in windows that were put out, in windows that the state store still holds, or were dropped
    because their window had closed. Spark's own counter is of groups of rows, not of rows.
    """
    spark = closed.sparkSession
    held = spark.read.format("statestore").load(checkpoint).agg(F.coalesce(F.sum("value.count"), F.lit(0)).alias("open"))
    out = closed.agg(F.coalesce(F.sum(lines), F.lit(0)).alias("closed"))
    return out.select(F.lit(rows_read).cast("long").alias("read"), "closed", held.scalar().alias("open")).withColumn("late", F.expr("read - closed - open"))
