"""The reports a fleet operator asks for, each one plan over tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetloom.functions import fixed_values as fixed
from fleetloom.functions.values import age_label, epoch_ms_text
from fleetloom.operators import benchmarks, cost, health, inventory, logs, pricing, quality, queues
from fleetloom.operators.kernels import latest_per_key
from fleetloom.sources.readers import normalize_records


def cost_overview(
    names: DataFrame,
    raw_records: DataFrame,
    lines: DataFrame,
    *,
    tag: str | Column,
    amount: str,
    ts: str,
    days: int,
    as_of: str,
    errors: DataFrame | None = None,
    owner: str | None = None,
) -> DataFrame:
    """Spend of every active cluster in the window, with owner, region and printed cost."""
    active = inventory.valid_keys(names, "cluster")
    records = normalize_records(raw_records).select(
        F.col("cluster_name").alias("cluster"), F.col("cluster_owner").alias("owner"), "region"
    )
    totals = cost.cost_by_tag(lines, key=tag, amount=amount, ts=ts, days=days, as_of=as_of)
    report = cost.cost_report(active, records, totals, errors, owner=owner)
    return report.withColumns(
        {"period": cost.period_label(days, as_of), "cost_usd": cost.cost_label("total", "error")}
    )


def fleet_list(
    names: DataFrame,
    raw_records: DataFrame,
    *,
    as_of: str,
    snapshots: DataFrame | None = None,
    tiebreak: tuple[str, ...] = (),
    region: str | None = None,
    owner: str | None = None,
) -> DataFrame:
    """Inventory of active clusters with age and live status; ``tiebreak`` is required with ``snapshots``."""
    active = inventory.valid_keys(names, "cluster_name").select("cluster_name")
    records = normalize_records(raw_records).join(active, "cluster_name", "left_semi")
    filtered = inventory.equality_filters(records, region=region, owner=owner)
    aged = filtered.withColumn("age", age_label("deployment_date", as_of))
    return inventory.with_live_status(aged, snapshots, tiebreak=tiebreak)


def cluster_health(results: DataFrame, node_lines: DataFrame, describes: DataFrame | None = None, *, key: str = "cluster") -> DataFrame:
    """Check roll-up whose scheduler check comes from the node lines, its stack and address checks from ``describes`` where given."""
    counts = health.node_state_counts(node_lines, key=key, rc="rc")
    verdicts = health.slurm_verdict(counts).select(key, F.lit("slurm").alias("check"), (F.col("verdict") == "PASS").alias("ok"))
    flags = results.groupBy(key).agg(F.bool_or("monitoring").alias("monitoring"))
    judged = verdicts.join(flags, key).select(key, "check", "ok", "monitoring")
    derived = ["slurm"]
    if describes is not None:
        derived += ["stack", "head_ip"]
        stack = health.stack_checks(health.stack_verdict(describes, key=key), key=key)
        judged = judged.unionByName(stack.join(flags, key).select(key, "check", "ok", "monitoring"))
    others = results.where(~F.col("check").isin(derived)).select(key, "check", "ok", "monitoring")
    return health.check_rollup(others.unionByName(judged), key=key, monitoring="monitoring")


def recent_log_lines(
    groups: DataFrame, streams: DataFrame, events: DataFrame, *, prefix: str, tokens: Sequence[str], n: int
) -> DataFrame:
    """Last events of each wanted stream in each cluster's newest log group."""
    newest = logs.latest_log_group(groups, prefix=prefix)
    current = streams.join(newest.select("cluster", F.col("log_group").alias("group")), "group")
    wanted = logs.match_streams(current, tokens, key=["cluster", "group"]).select("cluster", "group", "token", "stream")
    tail = logs.log_tail(
        events.join(wanted, ["group", "stream"]), key=["cluster", "token"], ts="ts_ms", n=n, tiebreak="seq"
    )
    text = F.concat(epoch_ms_text("ts_ms"), F.lit("  "), F.rtrim("message"))
    return tail.select("cluster", "token", "stream", "rank", text.alias("line"))


def benchmark_report(lines: DataFrame, *, latest_only: bool = True) -> DataFrame:
    """Metrics of every run, or of the newest run per cluster and build.

    Lines are reduced to one row per run first; the newest run is picked among those.
    """
    summary = benchmarks.benchmark_summary(lines)
    if latest_only:
        build = ["cluster", "serial"]
        rest = [c for c in summary.columns if c not in build]
        summary = latest_per_key(summary.where(F.col("run_id").rlike("^[0-9]")), key=build, order="run_id", value=rest)
    return benchmarks.run_facts(summary)


def build_estimate(
    records: DataFrame,
    catalog: DataFrame,
    spot_history: DataFrame,
    *,
    tiebreak: str | Sequence[str],
    zone: str | None = None,
    product: str | None = fixed.SPOT_PRODUCT_BUILD,
) -> DataFrame:
    """Hourly cost per role of every configuration from the price catalog and spot history.

    A history without a ``region`` takes it from the availability zone.
    """
    pairs = records.select(
        "region",
        F.explode(F.concat(F.array("headnode_instance_type"), "cpu_instance_types", "gpu_instance_types")).alias("instance_type"),
    ).distinct()
    ondemand = pricing.ondemand_price(pairs, catalog).select("instance_type", "region", "od_price")
    if "region" not in spot_history.columns:
        spot_history = spot_history.withColumn("region", pricing.region_of_zone("availability_zone"))
    spot = pricing.latest_spot_price(spot_history, product=product, zone=zone, key=["instance_type", "region"], tiebreak=tiebreak)
    return pricing.fleet_hourly_cost(records, ondemand, spot.withColumn("spot_price", F.col("spot_price").try_cast("decimal(20,10)")))


def configuration_findings(configs: DataFrame, rules: dict[str, Column], *, key: str) -> DataFrame:
    """Broken rules and broken volume limits of each configuration in one list and one pass."""
    findings = F.concat(quality.broken_rules(rules), quality.broken_volumes())
    return configs.select(key, F.explode(findings).alias("rule"))


def queue_overview(configs: DataFrame, types: DataFrame) -> DataFrame:
    """Queue summary with the ranks each node of a queue can hold."""
    summary = queues.queue_summary(configs)
    ranks = queues.ranks_per_queue(summary, types, key=["cluster", "pos"], type_list="types", count="vcpus")
    return summary.join(ranks, ["cluster", "pos"])
