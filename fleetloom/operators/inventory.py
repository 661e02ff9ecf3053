"""Fleet inventory: name and equality filters, missing records, live status, tags, derived fields."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetloom.functions import fixed_values as fixed
from fleetloom.functions.text import as_col, has_prefix, sanitize
from fleetloom.operators.kernels import latest_per_key


def valid_key(c: str | Column, pattern: str = fixed.CLUSTER_NAME_PATTERN, forbid: str = "--") -> Column:
    return as_col(c).rlike(pattern) & ~F.contains(as_col(c), F.lit(forbid))


def valid_keys(df: DataFrame, col: str, pattern: str = fixed.CLUSTER_NAME_PATTERN, forbid: str = "--") -> DataFrame:
    """Rows whose name is a legal cluster name; the rest is not a cluster."""
    return df.where(valid_key(col, pattern, forbid))


def equality_filters(df: DataFrame, *, region: str | None = None, owner: str | None = None, owner_col: str = "cluster_owner") -> DataFrame:
    """Optional region and owner filters; the owner is compared after cleaning."""
    if region is not None:
        df = df.where(F.col("region") == region)
    if owner is not None:
        df = df.where(sanitize(owner_col) == owner)
    return df


def missing_records(names: DataFrame, records: DataFrame, *, key: str = "cluster_name") -> DataFrame:
    """Active names without a readable record."""
    return names.join(records.select(key), key, "left_anti")


def with_live_status(
    inventory: DataFrame, snapshots: DataFrame | None, *, key: str = "cluster_name", ts: str = "ts", tiebreak: tuple[str, ...] = ()
) -> DataFrame:
    """``status`` from the latest describe snapshot of each cluster.

    ``<cluster> / <stack>`` with ``?`` for an absent field, ``ERR`` when the call failed or
    never answered, ``LOCAL`` when nobody asked (``snapshots`` is None).
    """
    if snapshots is not None and not tiebreak:
        raise ValueError("snapshots of equal time need a tiebreak")
    if snapshots is None:
        return inventory.withColumn("status", F.lit(fixed.TEXT_STATUS_LOCAL))
    latest = latest_per_key(snapshots, key=key, order=[ts, *tiebreak], value=["rc", "cluster_status", "stack_status"])
    joined = inventory.join(latest, key, "left")
    text = F.concat(
        F.coalesce("cluster_status", F.lit(fixed.TEXT_STATUS_UNKNOWN)), F.lit(" / "), F.coalesce("stack_status", F.lit(fixed.TEXT_STATUS_UNKNOWN))
    )
    status = F.when(F.coalesce(F.col("rc"), F.lit(1)) != 0, F.lit(fixed.TEXT_STATUS_ERROR)).otherwise(text)
    return joined.withColumn("status", status).drop("rc", "cluster_status", "stack_status")


def family_flags(df: DataFrame, type_col: str, archs: str | None = None) -> DataFrame:
    """``arch``, ``is_gpu`` and ``needs_gdr`` of an instance type.

    A list of supported architectures, where present, decides the architecture; the
    family prefixes are the fallback.
    """
    by_family = F.when(has_prefix(type_col, fixed.ARM_PREFIXES), "arm64").otherwise("x86_64")
    arch = by_family
    if archs is not None:
        listed = F.when(F.array_contains(archs, "arm64"), "arm64").otherwise("x86_64")
        arch = F.when(F.col(archs).isNotNull(), listed).otherwise(by_family)
    return df.withColumns(
        {
            "arch": arch,
            "is_gpu": has_prefix(type_col, fixed.GPU_PREFIXES),
            "needs_gdr": has_prefix(type_col, fixed.GPU_RDMA_PREFIXES),
        }
    )


# Tag names and the record field each one carries.
RECORD_TAGS = {
    "ClusterID": "cluster_name",
    "ClusterOSType": "base_os",
    "ClusterScheduler": "scheduler",
    "ClusterSerialNumber": "cluster_serial_number",
    "ClusterOwner": "cluster_owner",
    "ClusterOwnerEmail": "cluster_owner_email",
    "ClusterOwnerDepartment": "cluster_owner_department",
    "ProjectID": "project_id",
    "ProdLevel": "prod_level",
    "DEPLOYMENT_DATE": "DEPLOYMENT_DATE",
}
STACK_TYPE_TAG = "ClusterStackType"


def record_tags(df: DataFrame, *, key: str, stack_type: str, tags: Mapping[str, str] = RECORD_TAGS) -> DataFrame:
    """Tag rows ``(key, tag_key, tag_value)`` of each record; the project only when defined."""
    pairs = [F.lit(STACK_TYPE_TAG), F.lit(stack_type)]
    for tag, column in tags.items():
        pairs += [F.lit(tag), F.col(column).cast("string")]
    kept = F.map_filter(F.create_map(*pairs), lambda k, v: (k != "ProjectID") | (v != fixed.TEXT_UNDEFINED))
    return df.select(key, F.explode(kept).alias("tag_key", "tag_value"))


def derived_columns(df: DataFrame, *, results_prefix: str) -> DataFrame:
    """Fields a build derives from its configuration, added in one projection.

    Flags are booleans; ``account`` and ``region`` name the long-lived results bucket.
    """
    mounts = F.filter(
        F.array(
            F.col("shared_dir"),
            F.when(F.col("enable_efs"), F.lit("/efs")),
            F.when(F.col("enable_fsx"), F.lit("/fsx")),
            F.when(F.col("enable_external_nfs"), F.lit("/nfs")),
        ),
        lambda x: x.isNotNull(),
    )
    # Option labels in report order.
    options = (
        ("EFA", "enable_efa"),
        ("EFS", "enable_efs"),
        ("FSx/Lustre", "enable_fsx"),
        ("External NFS", "enable_external_nfs"),
        ("GPU queue", "enable_gpu_queue"),
        ("HPC Benchmarks", "enable_hpc_benchmarks"),
        ("Monitoring", "enable_monitoring"),
    )
    chosen = F.filter(F.array(*[F.when(F.col(c), F.lit(label)) for label, c in options]), lambda x: x.isNotNull())
    wait = F.col("bootstrap_timeout")
    allowance = F.greatest(
        F.when(F.col("enable_fsx"), fixed.BOOTSTRAP_LUSTRE).otherwise(0),
        F.when(F.col("enable_efs"), fixed.BOOTSTRAP_EFS).otherwise(0),
    )
    bootstrap = F.when(wait == fixed.BOOTSTRAP_DEFAULT, fixed.BOOTSTRAP_DEFAULT + allowance).otherwise(
        F.least(F.greatest(wait, F.lit(1)), F.lit(fixed.BOOTSTRAP_MAX))
    )
    all_types = F.concat("cpu_instance_types", "gpu_instance_types")
    pinned_cpu = F.col("enable_cpu_queue") & F.col("maintain_cpu_size")
    pinned_gpu = F.col("enable_gpu_queue") & F.col("maintain_gpu_size")
    return df.withColumns(
        {
            "pkg_dir": F.when(F.col("enable_fsx"), "/fsx/pkg")
            .when(F.col("enable_efs"), "/efs/pkg")
            .when(F.col("enable_external_nfs"), "/nfs/pkg")
            .otherwise(F.concat("shared_dir", F.lit("/pkg"))),
            "mounts": mounts,
            "options": chosen,
            "bootstrap_seconds": bootstrap.cast("bigint"),
            "efa_gdr": F.col("enable_efa") & F.exists(all_types, lambda t: has_prefix(t, fixed.GPU_RDMA_PREFIXES)),
            "min_count_pinned": pinned_cpu | pinned_gpu,
            "cpu_min_count": F.when(F.col("maintain_cpu_size"), F.col("initial_cpu_queue_size")).otherwise(0).cast("bigint"),
            "gpu_min_count": F.when(F.col("maintain_gpu_size"), F.col("initial_gpu_queue_size")).otherwise(0).cast("bigint"),
            "compose_staged": F.col("enable_monitoring") & F.contains("base_os", F.lit("alinux")),
            "compose_arch": F.when(F.col("base_os").isin(*fixed.ARM_OSES), "aarch64").otherwise("x86_64"),
            "results_bucket": F.concat_ws("-", F.lit(results_prefix), "account", "region"),
        }
    )
