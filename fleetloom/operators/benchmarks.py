"""Benchmark output: latest run, metrics from tool text, run facts, expected bands."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetloom.functions import fixed_values as fixed
from fleetloom.functions.text import field, fields, leading_number
from fleetloom.operators.kernels import range_match


def latest_run(runs: DataFrame, *, key: str | Sequence[str], run_id: str = "run_id") -> DataFrame:
    """Greatest run id in text order per directory, among ids that start with a digit."""
    keys = [key] if isinstance(key, str) else list(key)
    return runs.where(F.col(run_id).rlike("^[0-9]")).groupBy(*keys).agg(F.max(run_id).alias(run_id))


def peak(lines: DataFrame, *, key: str | Sequence[str], pos: str = "line_no", line: str = "line") -> DataFrame:
    """Two-field row with the greatest positive second field; the first one wins a tie.

    Rows are told apart inside the aggregate, so each line is split once.
    """
    keys = [key] if isinstance(key, str) else list(key)
    parsed = _parsed(lines, [*keys, pos], line)
    row = (F.col("_nf") == 2) & (F.col("_number") > 0)
    best = F.max_by(
        F.when(row, F.struct(F.col("_first").alias("size"), F.col("_second").alias("peak_text"), F.col("_number").alias("peak"))),
        F.when(row, F.struct(F.col("_number"), -F.col(pos))),
    )
    return parsed.groupBy(*keys).agg(best.alias("b")).where(F.col("b").isNotNull()).select(*keys, "b.*")


def _parsed(lines: DataFrame, keep: Sequence[str], line: str) -> DataFrame:
    """Lines with their field count, first two fields and the second one's value."""
    split = lines.select(*keep, F.col(line).alias("_line"), fields(line, TOOL_BLANKS).alias("_parts"))
    picked = split.select(
        *keep, "_line", F.size("_parts").alias("_nf"), field(F.col("_parts"), 1).alias("_first"), field(F.col("_parts"), 2).alias("_second")
    )
    return picked.withColumn("_number", leading_number("_second"))


def first_match(lines: DataFrame, matches: Column, *, key: str | Sequence[str], value: Column, pos: str | Sequence[str] = "line_no") -> DataFrame:
    """Value of the first row per key for which ``matches`` holds."""
    keys = [key] if isinstance(key, str) else list(key)
    orders = [pos] if isinstance(pos, str) else list(pos)
    return lines.where(matches).groupBy(*keys).agg(F.min_by(value, F.struct(*orders)).alias("value"))


def latency_row(line: str = "line", size: str = "8") -> Column:
    parts = fields(line, TOOL_BLANKS)
    return (F.size(parts) == 2) & (field(parts, 1) == size)


# Fixed value: what separates the fields of tool output.
TOOL_BLANKS = " \t\n"

# Result files of a run below its own folder.
STREAM_FILE, IOR_FILE, COMMAND_FILE = "stream.txt", "ior.txt", "cmd.txt"
LATENCY_FILE, BANDWIDTH_FILE = "osu/latency.txt", "osu/bandwidth.txt"
LATENCY_GPU_FILE, BANDWIDTH_GPU_FILE = "osu/latency_cuda.txt", "osu/bandwidth_cuda.txt"
HPCG_FILE_PATTERN = r"^hpcg/HPCG-Benchmark_[^/]*\.txt$"
#: All that state a metric of the report, for a scan that opens no others.
METRIC_FILES = (STREAM_FILE, IOR_FILE, COMMAND_FILE, LATENCY_FILE, BANDWIDTH_FILE, LATENCY_GPU_FILE, BANDWIDTH_GPU_FILE, "hpcg/HPCG-Benchmark_*.txt")
STREAM_KERNELS = ("Copy", "Scale", "Add", "Triad")


def benchmark_summary(
    lines: DataFrame, *, key: Sequence[str] = ("cluster", "serial", "run_id"), relpath: str = "relpath", pos: str = "line_no", line: str = "line"
) -> DataFrame:
    """One row per run with every metric of the report; absent tests are NULL.

    Each line is told once which metric it states, if any, and keeps only that value; all
    metrics are then conditional aggregates of one pass, reduced to a row per run and task
    before the shuffle.
    """
    parsed, path, text = _parsed(lines, [*key, relpath, pos], line), F.col(relpath), F.col("_line")
    pair = F.col("_nf") == 2
    eight, positive = pair & (F.col("_first") == "8"), pair & (F.col("_number") > 0)
    kind = F
    for kernel in STREAM_KERNELS:
        kind = kind.when((path == STREAM_FILE) & F.startswith(text, F.lit(f"{kernel}:")), f"stream_{kernel.lower()}_mbs")
    for operation in ("write", "read"):
        kind = kind.when((path == IOR_FILE) & F.startswith(text, F.lit(operation)), f"ior_{operation}_mibs")
    kind = (
        kind.when((path == LATENCY_FILE) & eight, "latency_us")
        .when((path == LATENCY_GPU_FILE) & eight, "latency_gpu_us")
        .when((path == BANDWIDTH_FILE) & positive, "bandwidth")
        .when((path == BANDWIDTH_GPU_FILE) & positive, "bandwidth_gpu")
        .when(path == COMMAND_FILE, "command")
        .when(path.rlike(HPCG_FILE_PATTERN), F.when(F.contains(text, F.lit("GFLOP/s rating")), "hpcg_rating").otherwise("hpcg_other"))
    )
    told = parsed.withColumn("_kind", kind)
    rating = F.try_element_at(F.split(text, "="), F.lit(2))
    narrow = told.select(
        *key,
        pos,
        "_kind",
        F.when(F.startswith("_kind", F.lit("hpcg")), path).alias("_file"),
        F.when(F.col("_kind") == "hpcg_rating", rating)
        .when(F.col("_kind") == "hpcg_other", None)
        .when(F.col("_kind") == "command", text)
        .when(F.startswith("_kind", F.lit("bandwidth")), F.col("_first"))
        .when(F.col("_kind").isNotNull(), F.col("_second"))
        .alias("_text"),
        F.when(F.startswith("_kind", F.lit("bandwidth")), F.col("_number")).alias("_number"),
    )

    def earliest(name: str) -> Column:
        return F.min_by("_text", F.when(F.col("_kind") == name, F.col(pos)))

    # the first file by name decides, and in it the first rating; a first file without one states nothing
    is_hpcg = F.startswith("_kind", F.lit("hpcg"))
    in_first_file = F.struct("_file", F.col("_kind") != "hpcg_rating", pos)
    hpcg = F.min_by(F.struct("_text"), F.when(is_hpcg, in_first_file))["_text"]

    def peak_of(name: str) -> list[Column]:
        row = F.col("_kind") == name
        best = F.max_by(F.struct("_number", "_text"), F.when(row, F.struct(F.col("_number"), -F.col(pos))))
        return [best["_number"].alias(f"{name}_mbs"), best["_text"].alias(f"{name}_size")]

    def measured(name: str) -> Column:
        return earliest(name).try_cast("double").alias(name)

    return narrow.groupBy(*key).agg(
        *[measured(f"stream_{kernel.lower()}_mbs") for kernel in STREAM_KERNELS],
        measured("latency_us"),
        *peak_of("bandwidth"),
        measured("latency_gpu_us"),
        *peak_of("bandwidth_gpu"),
        measured("ior_write_mibs"),
        measured("ior_read_mibs"),
        hpcg.alias("hpcg_rating"),
        earliest("command").alias("command"),
    )


def run_facts(commands: DataFrame, command: str = "command") -> DataFrame:
    """Options of a recorded run command and what follows from them."""

    def option(name: str) -> Column:
        return F.nullif(F.regexp_extract(command, rf"--{name} (\S+)", 1), F.lit(""))

    nodes, ppn, seconds = (option(n).try_cast("bigint") for n in ("nodes", "ppn", "hpcg-time"))
    ranks = nodes * ppn
    return commands.withColumns(
        {
            "tests": option("tests"),
            "nodes": nodes,
            "ppn": ppn,
            "hpcg_seconds": seconds,
            "total_ranks": ranks,
            "hpcg_valid": seconds >= fixed.HPCG_VALID_SECONDS,
            "osu_possible": ranks >= 2,
        }
    )


def documented_bands(spark: SparkSession) -> DataFrame:
    """The documented latency and bandwidth bands as a table."""
    rows = [
        F.struct(
            F.lit(metric).alias("metric"), F.lit(band).alias("band"), F.lit(low).alias("low"), F.lit(high).cast("double").alias("high")
        )
        for metric, band, low, high in fixed.BENCHMARK_BANDS
    ]
    return spark.range(1).select(F.inline(F.array(*rows)))


def expected_band(metrics: DataFrame, bands: DataFrame | None = None, *, metric: str = "metric", value: str = "value") -> DataFrame:
    """Measurements with the band they fall into; out-of-band rows do not appear.

    The documented bands are a handful of literals, which each row tests itself; a table of
    ``bands`` is matched by a join.
    """
    if bands is not None:
        return range_match(metrics, bands, key=metric, value=value)
    within = lambda low, high: (F.col(value) >= low) & (F.lit(True) if high is None else F.col(value) < high)
    tested = [
        F.when((F.col(metric) == name) & within(low, high), F.struct(F.lit(band).alias("band"), F.lit(low).alias("low"), F.lit(high).cast("double").alias("high")))
        for name, band, low, high in fixed.BENCHMARK_BANDS
    ]
    return metrics.withColumn("_b", F.explode(F.filter(F.array(*tested), lambda b: b.isNotNull()))).select(*metrics.columns, "_b.*")
