"""Rules over configurations, volume bounds, bucket pairs, layered settings."""

from __future__ import annotations

from pyspark.sql import functions as F

from bindings.inventory_queries import ARM_SQL, FAMILY_SQL, GPU_SQL, instance_type
from bindings.registry import Tables, query
from fleetloom.operators import quality
from fleetloom.plans import reports


def configs(t: Tables):
    """One configuration per part; each field is legal for some parts and broken for others."""
    size, kind = F.col("p_size"), F.col("p_type")
    slug = F.replace(F.col("p_name"), F.lit(" "), F.lit("-"))
    number = F.col("p_partkey").cast("string")
    brand = F.substring("p_brand", 7, 9)
    return t.part.select(
        "p_partkey",
        F.when(kind == "PROMO", F.upper(slug)).otherwise(F.concat(slug, F.lit("-"), number)).alias("name"),
        F.when(kind == "SMALL", F.concat(slug, F.lit("-"))).otherwise(F.concat(brand, F.lit("-"), slug)).alias("owner"),
        F.concat(F.lit("us-east-"), brand, F.when(size > 10, "a").otherwise("")).alias("zone"),
        F.concat(F.lit("us-gov-west-"), F.when(size > 5, brand).otherwise("")).alias("region"),
        F.when(size > 40, "rhel8").when(size > 30, "rhel9arm").otherwise("ubuntu2404").alias("os"),
        F.when(size == 7, "default").otherwise(F.concat(slug, F.lit("-"), F.col("p_size").cast("string"))).alias("queue"),
        F.when(kind == "LARGE", F.lit("c5")).otherwise(instance_type()).alias("it"),
        F.concat(F.when(kind == "MEDIUM", "").otherwise("/"), F.lit("shared"), F.when(size == 3, "$HOME").otherwise("")).alias("dir"),
        (size - 10).alias("initial"),
        brand.cast("int").alias("largest"),
        F.when(size == 1, 0).otherwise(10).alias("idle"),
        (size * 400).alias("fsx_size"),
        (kind != "ECONOMY").alias("fsx"),
        (size * 20000).alias("chunk"),
        (kind == "PROMO").alias("hydrated"),
        F.concat(slug, F.when(size > 2, "@example.org").otherwise("@example")).alias("email"),
        F.concat(F.lit("sha256:"), F.when(size > 45, F.md5("p_name")).otherwise(F.sha2("p_name", 256))).alias("checksum"),
        F.concat(F.lit("v"), brand, F.lit("."), size.cast("string"), F.when(kind == "SMALL", ".1").otherwise("")).alias("version"),
        F.concat(F.when(kind == "STANDARD", "0").otherwise(""), size.cast("string")).alias("ranks"),
        F.concat(F.lit("a-bucket-name-that-is-long-"), F.repeat(slug, 3), number).alias("bucket"),
        (size > 25).alias("wants_gpu"),
    )


def rules():
    return {
        "cluster_name": quality.cluster_name_ok("name"),
        "cluster_owner": quality.owner_ok("owner"),
        "zone": quality.zone_ok("zone"),
        "region": quality.region_ok("region"),
        "base_os": quality.base_os_ok("os"),
        "queue_name": quality.queue_name_ok("queue"),
        "instance_type": quality.instance_type_ok("it"),
        "shared_dir": quality.shared_dir_ok("dir"),
        "queue_sizes": quality.queue_sizes_ok("initial", "largest", "idle"),
        "added_queue_sizes": quality.queue_sizes_ok("initial", "largest", "idle", added=True),
        "fsx_size": quality.fsx_size_ok("fsx_size", "fsx"),
        "fsx_chunk": quality.fsx_chunk_ok("chunk", "hydrated"),
        "email": quality.email_ok("email"),
        "checksum": quality.checksum_ok("checksum"),
        "version": quality.version_ok("version"),
        "compose_version": quality.version_ok("version", three_parts=True),
        "ranks": quality.ranks_ok("ranks"),
        "bucket_name": quality.bucket_name_ok("bucket"),
        "os_arch": quality.os_arch_ok("os", "it"),
        "queue_kind": quality.queue_kind_ok(F.array("it"), "wants_gpu"),
    }


CONFIGS = rf"""
SELECT p_partkey, slug, CASE WHEN p_type = 'PROMO' THEN upper(slug) ELSE concat(slug, '-', p_partkey) END AS name,
  CASE WHEN p_type = 'SMALL' THEN concat(slug, '-') ELSE concat(brand, '-', slug) END AS owner,
  concat('us-east-', brand, CASE WHEN p_size > 10 THEN 'a' ELSE '' END) AS zone,
  concat('us-gov-west-', CASE WHEN p_size > 5 THEN brand ELSE '' END) AS region,
  CASE WHEN p_size > 40 THEN 'rhel8' WHEN p_size > 30 THEN 'rhel9arm' ELSE 'ubuntu2404' END AS os,
  CASE WHEN p_size = 7 THEN 'default' ELSE concat(slug, '-', p_size) END AS queue,
  CASE WHEN p_type = 'LARGE' THEN 'c5' ELSE concat({FAMILY_SQL}, '.', p_size, 'xlarge') END AS it,
  concat(CASE WHEN p_type = 'MEDIUM' THEN '' ELSE '/' END, 'shared', CASE WHEN p_size = 3 THEN '$HOME' ELSE '' END) AS dir,
  p_size - 10 AS initial, CAST(brand AS INT) AS largest, CASE WHEN p_size = 1 THEN 0 ELSE 10 END AS idle,
  p_size * 400 AS fsx_size, p_type <> 'ECONOMY' AS fsx, p_size * 20000 AS chunk, p_type = 'PROMO' AS hydrated,
  concat(slug, CASE WHEN p_size > 2 THEN '@example.org' ELSE '@example' END) AS email,
  concat('sha256:', CASE WHEN p_size > 45 THEN md5(p_name) ELSE sha256(p_name) END) AS checksum,
  concat('v', brand, '.', p_size, CASE WHEN p_type = 'SMALL' THEN '.1' ELSE '' END) AS version,
  concat(CASE WHEN p_type = 'STANDARD' THEN '0' ELSE '' END, p_size) AS ranks,
  concat('a-bucket-name-that-is-long-', repeat(slug, 3), p_partkey) AS bucket, p_size > 25 AS wants_gpu
FROM (SELECT *, replace(p_name, ' ', '-') AS slug, substr(p_brand, 7) AS brand FROM part)
"""

# The same rules as conditions that must hold.
RULES_SQL = {
    "cluster_name": "regexp_matches(name, '^[a-z]([a-z0-9\\-]{0,25}[a-z0-9])?$') AND NOT contains(name, '--')",
    "cluster_owner": "regexp_matches(owner, '^[a-z0-9][a-z0-9\\-]{0,62}$') AND NOT ends_with(owner, '-') AND NOT contains(owner, '--')",
    "zone": "regexp_matches(zone, '^[a-z]{2}(-[a-z]+)+-[0-9]+[a-z]$')",
    "region": "regexp_matches(region, '^[a-z]{2}(-[a-z]+)+-[0-9]+$')",
    "base_os": "os IN ('ubuntu2404', 'rhel9arm')",
    "queue_name": "length(queue) <= 16 AND regexp_matches(queue, '^[a-z][a-z0-9-]*[a-z0-9]$') AND NOT contains(queue, '--') AND queue <> 'default'",
    "instance_type": "it LIKE '%.%'",
    "shared_dir": "starts_with(dir, '/') AND NOT contains(dir, '$')",
    "queue_sizes": "idle >= 1 AND initial >= 0 AND initial <= largest",
    "added_queue_sizes": "idle >= 1 AND initial >= 0 AND initial <= largest AND largest >= 1",
    "fsx_size": "NOT fsx OR fsx_size = 1200 OR fsx_size % 2400 = 0",
    "fsx_chunk": "NOT hydrated OR chunk BETWEEN 1024 AND 512000",
    "email": "email LIKE '%.org'",
    "checksum": "length(checksum) = 71",
    "version": "regexp_matches(version, '^v[0-9]+\\.[0-9]+(\\.[0-9]+)?$')",
    "compose_version": "regexp_matches(version, '^v[0-9]+\\.[0-9]+\\.[0-9]+$')",
    "ranks": "NOT starts_with(ranks, '0')",
    "bucket_name": "length(bucket) <= 63",
    "os_arch": f"NOT (({ARM_SQL} AND os = 'ubuntu2404') OR (NOT {ARM_SQL} AND os = 'rhel9arm'))",
    "queue_kind": f"{GPU_SQL} = wants_gpu",
}
VIOLATIONS = " UNION ALL ".join(f"SELECT p_partkey, '{name}' AS rule FROM c WHERE NOT ({ok})" for name, ok in RULES_SQL.items())


@query("rule_violations", f"WITH c AS ({CONFIGS}) {VIOLATIONS}")
def rule_violations(t: Tables):
    return quality.rule_violations(configs(t), rules(), key="p_partkey")


@query(
    "login_user",
    "SELECT p_partkey, CASE WHEN p_size > 40 THEN NULL WHEN p_size > 30 THEN 'ec2-user' ELSE 'ubuntu' END AS login FROM part",
)
def login_user(t: Tables):
    return configs(t).select("p_partkey", quality.login_user("os").alias("login"))


VOLUME_SQL = """
v AS (
  SELECT p_partkey, 'headnode' AS volume, CASE WHEN p_type = 'PROMO' THEN 'gp3' ELSE 'standard' END AS type, p_size * 30 AS size, p_size * 100 AS iops, p_size * 10 AS throughput FROM part
  UNION ALL SELECT p_partkey, 'compute', 'io1', p_size, p_size * 60, 0 FROM part WHERE p_type <> 'SMALL'
  UNION ALL SELECT p_partkey, 'gpu', 'gp3', p_size, 3000 + p_size * 10, p_size * 30 FROM part WHERE p_size > 10
  UNION ALL SELECT p_partkey, 'shared', CASE WHEN p_type = 'LARGE' THEN 'io2' WHEN p_type = 'SMALL' THEN 'st1' ELSE 'xx9' END, p_size * 2000 - 5000, p_size * 10000, 1 FROM part),
b(type, lo, hi) AS (VALUES ('standard', 1, 1024), ('io1', 4, 16384), ('io2', 4, 65536), ('gp2', 1, 16384), ('gp3', 1, 16384), ('st1', 500, 16384), ('sc1', 500, 16384)),
i(type, ilo, ihi, ratio) AS (VALUES ('io1', 100, 64000, 50), ('io2', 100, 256000, 1000), ('gp3', 3000, 16000, 500)),
j AS (SELECT v.*, coalesce(lo, 1) AS lo, coalesce(hi, 16384) AS hi, ilo, ihi, ratio FROM v LEFT JOIN b USING (type) LEFT JOIN i USING (type)),
f AS (SELECT p_partkey, volume, type, CAST(size AS BIGINT) AS size, CAST(iops AS BIGINT) AS iops, CAST(throughput AS BIGINT) AS throughput,
  CASE WHEN size < lo THEN 'size_min' WHEN size > hi THEN 'size_max' WHEN ilo IS NULL THEN NULL
    WHEN iops < ilo OR iops > ihi THEN 'iops_range' WHEN iops > size * ratio THEN 'iops_per_gib' WHEN type <> 'gp3' THEN NULL
    WHEN throughput < 125 OR throughput > 1000 THEN 'throughput_range' WHEN throughput > iops * 0.25 THEN 'throughput_per_iops' END AS violation FROM j)
"""


def volumes(t: Tables):
    size, kind = F.col("p_size"), F.col("p_type")
    return t.part.select(
        "p_partkey",
        (kind != "SMALL").alias("enable_cpu_queue"),
        (size > 10).alias("enable_gpu_queue"),
        F.when(kind == "PROMO", "gp3").otherwise("standard").alias("headnode_type"),
        (size * 30).alias("headnode_size"), (size * 100).alias("headnode_iops"), (size * 10).alias("headnode_throughput"),
        F.lit("io1").alias("compute_type"),
        size.alias("compute_size"), (size * 60).alias("compute_iops"), F.lit(0).alias("compute_throughput"),
        F.lit("gp3").alias("gpu_type"),
        size.alias("gpu_size"), (3000 + size * 10).alias("gpu_iops"), (size * 30).alias("gpu_throughput"),
        F.when(kind == "LARGE", "io2").when(kind == "SMALL", "st1").otherwise("xx9").alias("shared_type"),
        (size * 2000 - 5000).alias("shared_size"), (size * 10000).alias("shared_iops"), F.lit(1).alias("shared_throughput"),
    )


@query("volume_bounds", f"WITH {VOLUME_SQL} SELECT * FROM f WHERE violation IS NOT NULL")
def volume_bounds(t: Tables):
    return quality.volume_bounds(volumes(t), key="p_partkey")


@query(
    "configuration_findings",
    f"""
WITH c AS ({CONFIGS}), {VOLUME_SQL}
{VIOLATIONS} UNION ALL SELECT p_partkey, concat('volume_', volume, '_', violation) FROM f WHERE violation IS NOT NULL
""",
)
def configuration_findings(t: Tables):
    return reports.configuration_findings(configs(t).join(volumes(t), "p_partkey"), rules(), key="p_partkey")


@query(
    "bucket_pair_status",
    """
WITH x AS (SELECT p_partkey, CASE WHEN p_size > 45 THEN 'UNDEFINED' ELSE p_type END AS ib,
  CASE WHEN p_size < 10 THEN 'UNDEFINED' WHEN p_size < 20 THEN p_brand ELSE p_type END AS eb, p_name AS ip,
  CASE WHEN p_size > 40 THEN p_name ELSE concat(p_name, '/out') END AS ep FROM part)
SELECT p_partkey, CASE WHEN ib = 'UNDEFINED' THEN 'error_no_import' WHEN eb = 'UNDEFINED' THEN 'warn_export_defaults_to_import'
  WHEN ib <> eb THEN 'error_buckets_differ' WHEN ip = ep THEN 'warn_same_path' ELSE 'ok' END AS status,
  CASE WHEN ib = 'UNDEFINED' THEN NULL WHEN eb = 'UNDEFINED' THEN ib WHEN ib = eb THEN eb END AS effective_bucket,
  CASE WHEN ib = 'UNDEFINED' THEN NULL WHEN eb = 'UNDEFINED' THEN ip WHEN ib = eb THEN ep END AS effective_path
FROM x
""",
)
def bucket_pair_status(t: Tables):
    size = F.col("p_size")
    pairs = t.part.select(
        "p_partkey",
        F.when(size > 45, "UNDEFINED").otherwise(F.col("p_type")).alias("import_bucket"),
        F.when(size < 10, "UNDEFINED").when(size < 20, F.col("p_brand")).otherwise(F.col("p_type")).alias("export_bucket"),
        F.col("p_name").alias("import_path"),
        F.when(size > 40, F.col("p_name")).otherwise(F.concat("p_name", F.lit("/out"))).alias("export_path"),
    )
    return quality.bucket_pair_status(pairs).select("p_partkey", "status", "effective_bucket", "effective_path")


@query(
    "layered_resolve",
    """
WITH l AS (SELECT o_custkey, CASE o_orderpriority WHEN '1-URGENT' THEN 'cli' WHEN '2-HIGH' THEN 'file' WHEN '4-NOT SPECIFIED' THEN 'elsewhere' ELSE 'hard' END AS layer,
  max(CASE WHEN o_orderstatus = 'F' THEN CASE WHEN o_totalprice > 490000 THEN 'n/a' ELSE CAST(CAST(floor(o_totalprice) AS BIGINT) AS VARCHAR) END END) AS value
  FROM orders GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY CASE layer WHEN 'cli' THEN 1 WHEN 'file' THEN 2 ELSE 3 END) AS rn
  FROM l WHERE layer <> 'elsewhere' AND (layer <> 'cli' OR value IS NOT NULL))
SELECT o_custkey, layer, value, TRY_CAST(value AS BIGINT) AS typed,
  layer <> 'cli' AND value IS NOT NULL AND TRY_CAST(value AS BIGINT) IS NULL AS invalid FROM r WHERE rn = 1
""",
)
def layered_resolve(t: Tables):
    priority = F.col("o_orderpriority")
    layer = F.when(priority == "1-URGENT", "cli").when(priority == "2-HIGH", "file").when(priority == "4-NOT SPECIFIED", "elsewhere").otherwise("hard")
    written = F.when(F.col("o_totalprice") > 490000, "n/a").otherwise(F.floor("o_totalprice").cast("string"))
    layers = (
        t.orders.groupBy("o_custkey", layer.alias("layer"))
        .agg(F.max(F.when(F.col("o_orderstatus") == "F", written)).alias("value"))
    )
    return quality.layered_resolve(layers, key="o_custkey", cast="bigint")
