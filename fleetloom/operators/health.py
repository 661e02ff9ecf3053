"""Node states, check roll-ups, job failures, clean-up outcomes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetloom.functions import fixed_values as fixed
from fleetloom.functions.text import field, fields, is_blank, usable_state
from fleetloom.operators.cost import lookback_hours
from fleetloom.operators.kernels import first_per_key


def job_failures(
    jobs: DataFrame,
    *,
    hours: int,
    as_of: str,
    states: Sequence[str] = fixed.FAILED_JOB_STATES,
    start: str = "start",
    state: str = "state",
    job_id: str = "job_id",
    columns: Sequence[str] = ("job_id", "job_name", "state", "exit_code", "node_list", "start", "end"),
) -> DataFrame:
    """Failed allocations (no job steps) that started within the window."""
    recent = lookback_hours(jobs, start, hours, as_of)
    failed = recent.where(F.col(state).isin(*states) & ~F.contains(F.col(job_id).cast("string"), F.lit(".")))
    return failed.select(*columns)


def with_line_counts(lines: DataFrame, line: str = "line") -> DataFrame:
    """Add ``line_usable`` and ``line_unusable``: the nodes named by one ``<count> <state>`` line.

    A line that cannot be read counts as one unusable node; a blank line counts nothing.
    """
    parts, zero, one = F.col("_parts"), F.lit(0).cast("bigint"), F.lit(1).cast("bigint")
    split = lines.withColumn("_parts", fields(line))
    picked = split.withColumns(
        {"_nf": F.size(parts), "_count": field(parts, 1).try_cast("bigint"), "_ok": usable_state(field(parts, 2))}
    )
    readable = (F.col("_nf") >= 2) & F.col("_count").isNotNull()
    good = F.when(readable & F.col("_ok"), F.col("_count")).otherwise(zero)
    bad = (
        F.when(F.col("_nf") == 0, zero).when(~readable, one).when(F.col("_ok"), zero).otherwise(F.col("_count"))
    )
    return picked.withColumns({"line_usable": good, "line_unusable": bad}).drop("_parts", "_nf", "_count", "_ok")


def node_state_counts(lines: DataFrame, *, key: str | Sequence[str], line: str = "line", rc: str | None = None) -> DataFrame:
    """Usable and unusable node totals per snapshot, with what the verdict needs."""
    keys = [key] if isinstance(key, str) else list(key)
    kept = lines.select(*keys, line, (F.col(rc) if rc else F.lit(0)).alias("rc"), (~is_blank(line)).alias("_written"))
    return with_line_counts(kept, line).groupBy(*keys).agg(
        F.max("rc").alias("rc"),
        F.coalesce(F.bool_or("_written"), F.lit(False)).alias("has_output"),
        F.coalesce(F.sum("line_usable"), F.lit(0)).alias("usable"),
        F.coalesce(F.sum("line_unusable"), F.lit(0)).alias("unusable"),
    )


def slurm_verdict(counts: DataFrame) -> DataFrame:
    """PASS or FAIL per snapshot with the reason or the degradation note."""
    none_text, some_text = fixed.TEXT_NONE_USABLE, fixed.TEXT_SOME_USABLE
    n_bad = F.col("unusable").cast("string")
    n_ok = F.col("usable").cast("string")
    failed_call = F.col("rc") != 0
    silent = ~F.col("has_output")
    none_usable = F.col("usable") == 0
    return counts.withColumns(
        {
            "verdict": F.when(failed_call | silent | none_usable, "FAIL").otherwise("PASS"),
            "detail": F.when(failed_call, F.concat(F.lit(fixed.TEXT_CALL_FAILED), F.col("rc").cast("string")))
            .when(silent, F.lit(fixed.TEXT_NO_PARTITIONS))
            .when(none_usable, F.concat(F.lit(none_text[0]), n_bad, F.lit(none_text[1])))
            .when(F.col("unusable") > 0, F.concat(n_ok, F.lit(some_text[0]), n_bad, F.lit(some_text[1]))),
        }
    )


def annotate_nodes(lines: DataFrame, *, key: str | Sequence[str], line: str = "line", pos: str = "line_no") -> DataFrame:
    """Lines of a node table with ``marked`` where the STATE field is not usable.

    The column is found by its header name. The header and whatever precedes it stay
    unmarked, as do rows with fewer fields.
    """
    keys = [key] if isinstance(key, str) else list(key)
    header = F.array_position(F.transform("_parts", F.upper), "STATE")
    headers = (
        lines.where(F.contains(F.upper(line), F.lit("STATE")))
        .select(*keys, F.col(pos).alias("_header_pos"), fields(line).alias("_parts"))
        .select(*keys, "_header_pos", header.alias("_state_field"))
        .where("_state_field > 0")
    )
    columns = first_per_key(headers, key=keys, order="_header_pos", value=["_header_pos", "_state_field"])
    # lines are split after the join: what is shuffled, if it is, are the lines as they stand
    joined = lines.join(columns, keys, "left")
    state = field(fields(line), F.col("_state_field").cast("int"))
    below = F.col(pos) > F.col("_header_pos")
    marked = F.coalesce(below & ~usable_state(state), F.lit(False))
    return joined.withColumn("marked", marked).drop("_header_pos", "_state_field")


# What a finished stack reports.
STACK_OK = ("CREATE_COMPLETE",)
TEXT_DESCRIBE_FAILED, TEXT_DESCRIBE_BROKEN = "describe call failed (rc=", "unexpected describe response"

DESCRIBED = "struct<clusterStatus:string,cloudFormationStackStatus:string,headNode:struct<publicIpAddress:string,privateIpAddress:string>>"


def stack_verdict(snapshots: DataFrame, *, key: str, rc: str = "rc", text: str = "text", ok_statuses: Sequence[str] = STACK_OK) -> DataFrame:
    """``ok``, ``detail`` and ``head_ip`` of each cluster's describe answer (one row per cluster).

    A failed call and an answer that is no JSON object are not ok and leave the address unknown
    (NULL). Otherwise the address is the public one, else the private one, else empty; the cluster
    is ok when its status is among ``ok_statuses``. An absent status reads ``UNKNOWN``.
    """
    failed = F.coalesce(F.col(rc), F.lit(1)) != 0
    doc = F.from_json(text, DESCRIBED, {"mode": "PERMISSIVE"})
    broken = F.coalesce(F.try_variant_get(F.try_parse_json(text), "$", "map<string,variant>").isNull(), F.lit(True))
    status = F.coalesce(doc["clusterStatus"], F.lit("UNKNOWN"))
    stack = F.coalesce(doc["cloudFormationStackStatus"], F.lit("UNKNOWN"))
    given = lambda c: F.nullif(c, F.lit(""))
    address = F.coalesce(given(doc["headNode"]["publicIpAddress"]), given(doc["headNode"]["privateIpAddress"]), F.lit(""))
    known, ok = ~failed & ~broken, status.isin(*ok_statuses)
    detail = (
        F.when(failed, F.concat(F.lit(TEXT_DESCRIBE_FAILED), F.coalesce(F.col(rc).cast("string"), F.lit("none")), F.lit(")")))
        .when(broken, F.lit(TEXT_DESCRIBE_BROKEN))
        .when(ok, F.concat(F.lit("clusterStatus="), status))
        .otherwise(F.concat(F.lit("clusterStatus="), status, F.lit(" cloudFormationStackStatus="), stack))
    )
    return snapshots.select(key, (known & ok).alias("ok"), detail.alias("detail"), F.when(known, address).alias("head_ip"))


def stack_checks(verdicts: DataFrame, *, key: str) -> DataFrame:
    """The ``stack`` and ``head_ip`` rows of ``check_rollup`` from ``stack_verdict``: ``(key, check, ok)``."""
    rows = F.array(
        F.struct(F.lit("stack").alias("check"), F.col("ok").alias("ok")),
        F.struct(F.lit("head_ip").alias("check"), (F.col("head_ip") != "").alias("ok")),
    )
    return verdicts.select(key, F.explode(rows).alias("c")).select(key, "c.*")


# Checks in report order.
CHECKS = ("record", "stack", "head_ip", "ssh", "slurm", "postinstall", "grafana", "storage")


def check_rollup(results: DataFrame, *, key: str, monitoring: str, checks: Sequence[str] = CHECKS) -> DataFrame:
    """One row per cluster: the status of each check after gating, failures and health.

    ``results`` is long: ``(key, check, ok, monitoring)``. Without a record nothing else is
    reported; a head address nobody could ask for and ssh without one are skipped; without ssh the checks on the node are;
    grafana is looked at only with monitoring; storage always is. SKIP is never a failure.
    """
    raw = results.groupBy(key).agg(
        F.bool_or(monitoring).alias("_monitoring"),
        *[F.bool_and(F.when(F.col("check") == c, F.col("ok"))).alias(c) for c in checks],
    )

    def status(ok: Column) -> Column:
        return F.when(F.coalesce(ok, F.lit(False)), "PASS").otherwise("FAIL")

    has_record = F.coalesce(F.col("record"), F.lit(False))
    has_ip = F.coalesce(F.col("head_ip"), F.lit(False))
    ssh_ok = has_ip & F.coalesce(F.col("ssh"), F.lit(False))
    skip = F.lit("SKIP")
    gated = {
        "record": status(F.col("record")),
        "stack": status(F.col("stack")),
        "head_ip": F.when(F.col("head_ip").isNotNull(), status(F.col("head_ip"))).otherwise(skip),
        "ssh": F.when(has_ip, status(F.col("ssh"))).otherwise(skip),
        "slurm": F.when(ssh_ok, status(F.col("slurm"))).otherwise(skip),
        "postinstall": F.when(ssh_ok, status(F.col("postinstall"))).otherwise(skip),
        "grafana": F.when(F.coalesce(F.col("_monitoring"), F.lit(False)), F.when(ssh_ok, status(F.col("grafana"))).otherwise(skip)),
        "storage": status(F.col("storage")),
    }
    shown = [
        (gated[c] if c == "record" else F.when(has_record, gated[c])).alias(c) for c in checks
    ]
    wide = raw.select(key, *shown)
    failures = F.lit(0)
    for c in checks:
        failures = failures + F.when(F.col(c) == "FAIL", 1).otherwise(0)
    return wide.withColumn("failures", failures.cast("bigint")).withColumn("healthy", F.col("failures") == 0)


def deletion_outcome(text: Column) -> Column:
    """``confirmed``, ``delete_failed`` or ``unconfirmed`` from the last describe answer."""
    gone = F.contains(text, F.lit(fixed.DELETE_DONE))
    for phrase in fixed.DELETE_GONE:
        gone = gone | F.contains(text, F.lit(phrase))
    known = F.coalesce(text, F.lit(""))
    failed = F.contains(known, F.lit(fixed.DELETE_FAILED))
    return F.when(F.coalesce(gone, F.lit(False)), "confirmed").when(failed, "delete_failed").otherwise("unconfirmed")


def cleanup_report(steps: DataFrame, stack: DataFrame, *, key: str, label: str = "resource") -> DataFrame:
    """What a teardown left: orphans (failed steps), retained resources, headline, exit status.

    The headline follows the stack alone and the orphan list the steps alone. Labels are
    kept once per cluster and sorted.
    """
    per_key = steps.groupBy(key).agg(
        F.array_sort(F.collect_set(F.when(F.col("failed"), F.col(label)))).alias("orphaned"),
        F.array_sort(F.collect_set(F.when(F.col("retained") & ~F.col("failed"), F.col(label)))).alias("retained"),
    )
    final = stack.select(key, deletion_outcome(F.col("text")).alias("outcome"))
    joined = final.join(per_key, key, "left")
    empty = F.array().cast("array<string>")
    headline = (
        F.when(F.col("outcome") == "confirmed", "deleted")
        .when(F.col("outcome") == "delete_failed", "DELETE_FAILED")
        .otherwise("not confirmed")
    )
    return joined.select(
        key,
        F.coalesce("orphaned", empty).alias("orphaned"),
        F.coalesce("retained", empty).alias("retained"),
        headline.alias("headline"),
        ((F.size(F.coalesce("orphaned", empty)) > 0) | (F.col("outcome") != "confirmed")).alias("exit_failing"),
    )


def cleanup_items(steps: DataFrame, *, key: str, label: str = "resource") -> DataFrame:
    """What a teardown left, a row for each resource: ``kind`` is ``orphaned`` or ``retained``. For teardowns of any length."""
    kind = F.when(F.col("failed"), "orphaned").when(F.col("retained"), "retained")
    return steps.select(key, F.col(label), kind.alias("kind")).where(F.col("kind").isNotNull()).distinct()


def archive_progress(actions: DataFrame, *, key: str | Sequence[str], action: str = "action", word: str = "ARCHIVE") -> DataFrame:
    """Outstanding archive actions per filesystem."""
    keys = [key] if isinstance(key, str) else list(key)
    return actions.groupBy(*keys).agg(F.count_if(F.contains(F.col(action), F.lit(word))).alias("outstanding"))
