"""Data-quality rules over configurations, volume bounds, bucket pairs, layered settings."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetloom.functions import fixed_values as fixed
from fleetloom.functions.text import as_col, has_prefix
from fleetloom.operators.inventory import valid_key


def broken_rules(rules: Mapping[str, Column]) -> Column:
    """Names of the rules a row breaks. A rule is the condition that must hold.

    A rule that cannot be evaluated (NULL) is broken, because an absent value is not
    evidence that it is legal.
    """
    broken = F.array(*[F.when(~F.coalesce(holds, F.lit(False)), F.lit(name)) for name, holds in rules.items()])
    return F.filter(broken, lambda r: r.isNotNull())


def rule_violations(df: DataFrame, rules: Mapping[str, Column], *, key: str | Sequence[str]) -> DataFrame:
    """One row per entity and rule it breaks; all rules are evaluated in one projection."""
    keys = [key] if isinstance(key, str) else list(key)
    return df.select(*keys, F.explode(broken_rules(rules)).alias("rule"))


# --- single rules: each returns the condition that must hold ---------------------------


def cluster_name_ok(c: str | Column) -> Column:
    return valid_key(c)


def owner_ok(c: str | Column) -> Column:
    value = as_col(c)
    return value.rlike(fixed.OWNER_PATTERN) & ~F.endswith(value, F.lit("-")) & ~F.contains(value, F.lit("--"))


def zone_ok(c: str | Column) -> Column:
    return as_col(c).rlike(fixed.ZONE_PATTERN)


def region_ok(c: str | Column) -> Column:
    return as_col(c).rlike(fixed.REGION_PATTERN)


def base_os_ok(c: str | Column) -> Column:
    return as_col(c).isin(*fixed.OS_LOGIN_USERS)


def login_user(c: str | Column) -> Column:
    """Login user of a base OS, NULL for an unknown one."""
    pairs = [F.lit(x) for item in fixed.OS_LOGIN_USERS.items() for x in item]
    return F.try_element_at(F.create_map(*pairs), as_col(c))


def queue_name_ok(c: str | Column) -> Column:
    value = as_col(c)
    return (
        (F.length(value) <= fixed.QUEUE_NAME_MAX)
        & value.rlike(fixed.QUEUE_NAME_PATTERN)
        & ~F.contains(value, F.lit("--"))
        & (value != fixed.QUEUE_NAME_RESERVED)
    )


def instance_type_ok(c: str | Column) -> Column:
    return as_col(c).rlike(fixed.INSTANCE_TYPE_PATTERN)


def shared_dir_ok(c: str | Column) -> Column:
    return as_col(c).rlike(fixed.SHARED_DIR_PATTERN)


def queue_sizes_ok(initial: str | Column, largest: str | Column, idle: str | Column, *, added: bool = False) -> Column:
    """Idle time, initial and largest size of a queue; an added queue must be able to grow."""
    first, most = as_col(initial), as_col(largest)
    ok = (as_col(idle) >= 1) & (first >= 0) & (first <= most)
    return ok & (most >= 1) if added else ok


def fsx_size_ok(size: str | Column, enabled: str | Column) -> Column:
    value = as_col(size)
    legal = (value > 0) & ((value == fixed.LUSTRE_SMALL) | (value % fixed.LUSTRE_STEP == 0))
    return ~as_col(enabled) | legal


def fsx_chunk_ok(chunk: str | Column, hydrated: str | Column) -> Column:
    low, high = fixed.LUSTRE_CHUNK
    return ~as_col(hydrated) | as_col(chunk).between(low, high)


def email_ok(c: str | Column) -> Column:
    return as_col(c).rlike(fixed.EMAIL_PATTERN)


def checksum_ok(c: str | Column) -> Column:
    return as_col(c).rlike(fixed.CHECKSUM_PATTERN)


def version_ok(c: str | Column, *, three_parts: bool = False) -> Column:
    return as_col(c).rlike(fixed.VERSION3_PATTERN if three_parts else fixed.VERSION_PATTERN)


def ranks_ok(c: str | Column) -> Column:
    return as_col(c).cast("string").rlike(fixed.RANK_PATTERN)


def bucket_name_ok(c: str | Column) -> Column:
    return F.length(as_col(c)) <= fixed.BUCKET_NAME_MAX


def os_arch_ok(base_os: str | Column, instance_type: str | Column) -> Column:
    """No ARM type on an x86 OS and no x86 type on an ARM OS."""
    arm, system = has_prefix(instance_type, fixed.ARM_PREFIXES), as_col(base_os)
    return ~((arm & system.isin(*fixed.X86_OSES)) | (~arm & system.isin(*fixed.ARM_OSES)))


def queue_kind_ok(types: str | Column, wants_gpu: str | Column) -> Column:
    """All types of a queue match its kind and share one architecture."""
    listed, gpu = as_col(types), as_col(wants_gpu)
    kind = F.forall(listed, lambda t: has_prefix(t, fixed.GPU_PREFIXES) == gpu)
    arm = F.exists(listed, lambda t: has_prefix(t, fixed.ARM_PREFIXES))
    x86 = F.exists(listed, lambda t: ~has_prefix(t, fixed.ARM_PREFIXES))
    return kind & ~(arm & x86)


# --- volumes ---------------------------------------------------------------------------

VOLUMES = ("headnode", "compute", "gpu", "shared")


def _limit(kind: Column, table: Mapping[str, object], pick, default=None) -> Column:
    chain = F
    for name, limit in table.items():
        chain = chain.when(kind == name, F.lit(pick(limit)))
    return chain.otherwise(F.lit(default))


def volume_violation(size: Column, kind: Column, iops: Column, throughput: Column) -> Column:
    """First broken limit of a volume in fixed order, NULL for a legal one."""
    per_gib = _limit(kind, fixed.VOLUME_IOPS_PER_GIB, lambda r: r)
    has_iops = kind.isin(*fixed.VOLUME_IOPS)
    is_gp3 = kind == "gp3"
    low_tp, high_tp = fixed.GP3_THROUGHPUT
    return (
        F.when(size < _limit(kind, fixed.VOLUME_SIZE, lambda b: b[0], fixed.VOLUME_SIZE_DEFAULT[0]), "size_min")
        .when(size > _limit(kind, fixed.VOLUME_SIZE, lambda b: b[1], fixed.VOLUME_SIZE_DEFAULT[1]), "size_max")
        .when(
            has_iops
            & ~iops.between(
                _limit(kind, fixed.VOLUME_IOPS, lambda b: b[0]), _limit(kind, fixed.VOLUME_IOPS, lambda b: b[1])
            ),
            "iops_range",
        )
        .when(has_iops & (iops > size * per_gib), "iops_per_gib")
        .when(is_gp3 & ~throughput.between(low_tp, high_tp), "throughput_range")
        .when(is_gp3 & (throughput > iops * F.lit(fixed.THROUGHPUT_PER_IOPS)), "throughput_per_iops")
    )


def volume_entries() -> Column:
    """The four volumes of a configuration as an array; a queue's volume only when it is enabled."""
    enabled = {"compute": F.col("enable_cpu_queue"), "gpu": F.col("enable_gpu_queue")}
    entries = [
        F.when(
            enabled.get(v, F.lit(True)),
            F.struct(
                F.lit(v).alias("volume"),
                F.col(f"{v}_type").alias("type"),
                *[F.col(f"{v}_{m}").cast("bigint").alias(m) for m in ("size", "iops", "throughput")],
            ),
        )
        for v in VOLUMES
    ]
    return F.filter(F.array(*entries), lambda e: e.isNotNull())


def volume_bounds(configs: DataFrame, *, key: str) -> DataFrame:
    """Volumes that break a limit, with the first limit they break."""
    rows = configs.select(key, F.explode(volume_entries()).alias("_v")).select(key, "_v.*")
    first = volume_violation(F.col("size"), F.col("type"), F.col("iops"), F.col("throughput"))
    return rows.withColumn("violation", first).where(F.col("violation").isNotNull())


def broken_volumes() -> Column:
    """``volume_<name>_<limit>`` for every volume of a row that breaks a limit."""
    labels = F.transform(
        volume_entries(),
        lambda v: F.concat(
            F.lit("volume_"), v["volume"], F.lit("_"), volume_violation(v["size"], v["type"], v["iops"], v["throughput"])
        ),
    )
    return F.filter(labels, lambda label: label.isNotNull())


# --- bucket pairs and layers -------------------------------------------------------------


def bucket_pair_status(df: DataFrame) -> DataFrame:
    """Import/export bucket pairs with a status and the export place that takes effect.

    Expects ``import_bucket, export_bucket, import_path, export_path``; ``UNDEFINED`` marks
    an absent bucket.
    """
    no_import = F.col("import_bucket") == fixed.TEXT_UNDEFINED
    no_export = F.col("export_bucket") == fixed.TEXT_UNDEFINED
    differ = F.col("import_bucket") != F.col("export_bucket")
    same_path = F.col("import_path") == F.col("export_path")
    status = (
        F.when(no_import, "error_no_import")
        .when(no_export, "warn_export_defaults_to_import")
        .when(differ, "error_buckets_differ")
        .when(same_path, "warn_same_path")
        .otherwise("ok")
    )
    failed = no_import | (~no_export & differ)
    return df.withColumns(
        {
            "status": status,
            "effective_bucket": F.when(~failed, F.when(no_export, F.col("import_bucket")).otherwise(F.col("export_bucket"))),
            "effective_path": F.when(~failed, F.when(no_export, F.col("import_path")).otherwise(F.col("export_path"))),
        }
    )


def layered_resolve(
    layers: DataFrame,
    *,
    key: str | Sequence[str],
    layer: str = "layer",
    value: str = "value",
    order: Sequence[str] = ("cli", "file", "hard"),
    cast: str | None = None,
) -> DataFrame:
    """Value per key from the first layer that has it.

    A NULL in the first layer is absent, in a later one it is a value and wins. Layers that
    ``order`` does not name count for nothing. With ``cast`` a value from a later layer that
    does not convert sets ``invalid``.
    """
    keys = [key] if isinstance(key, str) else list(key)
    rank = F.array_position(F.array(*[F.lit(name) for name in order]), F.col(layer))
    present = layers.where((rank > 0) & ((F.col(layer) != order[0]) | F.col(value).isNotNull()))
    first = present.groupBy(*keys).agg(F.min_by(F.struct(F.col(layer), F.col(value)), rank).alias("r"))
    chosen = first.select(*keys, F.col("r")[layer].alias(layer), F.col("r")[value].alias(value))
    if cast is None:
        return chosen
    converted = F.col(value).try_cast(cast)
    return chosen.withColumns(
        {
            "typed": converted,
            "invalid": (F.col(layer) != order[0]) & F.col(value).isNotNull() & converted.isNull(),
        }
    )
