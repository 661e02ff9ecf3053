"""Records, name filters, live status, tags, derived fields, and value expressions."""

from __future__ import annotations

from pyspark.sql import functions as F

from bindings.registry import Tables, query
from fleetloom.functions import text, values
from fleetloom.operators import inventory
from fleetloom.plans import reports
from fleetloom.sources.readers import normalize_records

NAMES = """
SELECT p_partkey, CASE p_type
  WHEN 'PROMO' THEN replace(p_name, ' ', '--') WHEN 'SMALL' THEN upper(replace(p_name, ' ', '-'))
  WHEN 'LARGE' THEN concat(replace(p_name, ' ', '-'), '-', p_partkey, '-') WHEN 'MEDIUM' THEN concat(p_size, '-', replace(p_name, ' ', '-'))
  WHEN 'ECONOMY' THEN concat(replace(p_name, ' ', '-'), '-of-a-very-long-', p_partkey)
  ELSE concat(replace(p_name, ' ', '-'), '-', p_partkey) END AS name FROM part
"""


def names(t: Tables):
    slug, number = F.replace(F.col("p_name"), F.lit(" "), F.lit("-")), F.col("p_partkey").cast("string")
    kind = F.col("p_type")
    name = (
        F.when(kind == "PROMO", F.replace(F.col("p_name"), F.lit(" "), F.lit("--")))
        .when(kind == "SMALL", F.upper(slug))
        .when(kind == "LARGE", F.concat(slug, F.lit("-"), number, F.lit("-")))
        .when(kind == "MEDIUM", F.concat(F.col("p_size").cast("string"), F.lit("-"), slug))
        .when(kind == "ECONOMY", F.concat(slug, F.lit("-of-a-very-long-"), number))
        .otherwise(F.concat(slug, F.lit("-"), number))
    )
    return t.part.select("p_partkey", name.alias("name"))


@query(
    "valid_keys",
    f"""
SELECT * FROM ({NAMES}) WHERE regexp_matches(name, '^[a-z]([a-z0-9\\-]{{0,25}}[a-z0-9])?$') AND NOT contains(name, '--')
""",
)
def valid_keys(t: Tables):
    return inventory.valid_keys(names(t), "name")


RAW = """
SELECT CASE WHEN c_nationkey = 3 THEN NULL ELSE concat('cl-', c_custkey) END AS cluster_name, concat('dir-', c_custkey) AS dir,
  concat(lower(c_mktsegment), chr(27), '[31m') AS cluster_owner, concat('s-', c_custkey) AS serial,
  CASE WHEN c_nationkey = 7 THEN NULL ELSE concat('nation-', c_nationkey) END AS region,
  concat(' a.large, ,', c_mktsegment, '.xlarge, a.large,') AS cpu,
  CASE c_mktsegment WHEN 'BUILDING' THEN 'abc' WHEN 'MACHINERY' THEN NULL WHEN 'FURNITURE' THEN '1.5' ELSE concat(' ', c_nationkey) END AS big
FROM customer
"""


def raw_records(t: Tables):
    number, segment = F.col("c_custkey").cast("string"), F.col("c_mktsegment")
    nation = F.col("c_nationkey").cast("string")
    size = (
        F.when(segment == "BUILDING", "abc")
        .when(segment == "FURNITURE", "1.5")
        .when(segment != "MACHINERY", F.concat(F.lit(" "), nation))
    )
    return t.customer.select(
        F.when(F.col("c_nationkey") != 3, F.concat(F.lit("cl-"), number)).alias("cluster_name"),
        F.concat(F.lit("dir-"), number).alias("dir"),
        F.concat(F.lower(segment), F.lit("\x1b[31m")).alias("cluster_owner"),
        F.concat(F.lit("s-"), number).alias("cluster_serial_number"),
        F.when(F.col("c_nationkey") != 7, F.concat(F.lit("nation-"), nation)).alias("region"),
        F.concat(F.lit(" a.large, ,"), segment, F.lit(".xlarge, a.large,")).alias("cpu_instance_types"),
        size.alias("max_cpu_queue_size"),
    )


RECORDS = f"""
SELECT coalesce(cluster_name, dir) AS cluster_name, replace(cluster_owner, chr(27), '') AS cluster_owner, serial,
  coalesce(region, '') AS region, array_to_string([trim(x) for x in string_split(cpu, ',') if trim(x) <> ''], '|') AS cpu_instance_types,
  '' AS gpu_instance_types, CASE WHEN regexp_matches(big, '^ *[0-9]+$') THEN CAST(trim(big) AS BIGINT) ELSE 0 END AS max_cpu_queue_size,
  CAST(0 AS BIGINT) AS max_gpu_queue_size, CAST(0 AS BIGINT) AS initial_cpu_queue_size, CAST(0 AS BIGINT) AS initial_gpu_queue_size,
  '' AS headnode_instance_type, 'false' AS enable_cpu_queue, 'false' AS enable_gpu_queue, 'ondemand' AS cluster_type,
  '' AS deployment_date, '' AS ssh_keypair, 'ubuntu' AS ec2_user, '' AS s3_bucketname, 'false' AS enable_monitoring
FROM ({RAW})
"""


def flat(records):
    lists = {c: F.array_join(c, "|") for c in ("cpu_instance_types", "gpu_instance_types")}
    return records.withColumns(lists)


@query("normalize_records", RECORDS)
def normalize(t: Tables):
    return flat(normalize_records(raw_records(t), directory="dir"))


@query(
    "equality_filters",
    f"SELECT cluster_name, region FROM ({RECORDS}) WHERE region = 'nation-5' AND cluster_owner = 'building[31m'",
)
def equality_filters(t: Tables):
    raw = raw_records(t)
    return inventory.equality_filters(raw, region="nation-5", owner="building[31m").select(
        F.coalesce("cluster_name", "dir").alias("cluster_name"), "region"
    )


SNAPSHOTS = """
SELECT o_custkey, o_orderdate, o_orderkey, CASE WHEN o_orderpriority = '1-URGENT' THEN 1 ELSE 0 END AS rc,
  CASE WHEN o_orderstatus <> 'P' THEN o_orderstatus END AS cs, CASE WHEN o_orderpriority <> '5-LOW' THEN o_orderpriority END AS ss
FROM orders
"""


def snapshots(t: Tables):
    return t.orders.select(
        F.col("o_custkey").alias("cluster_name"),
        F.col("o_orderdate").alias("ts"),
        "o_orderkey",
        F.when(F.col("o_orderpriority") == "1-URGENT", 1).otherwise(0).alias("rc"),
        F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")).alias("cluster_status"),
        F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_orderpriority")).alias("stack_status"),
    )


@query(
    "with_live_status",
    f"""
WITH s AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM ({SNAPSHOTS}))
SELECT c_custkey AS cluster_name, c_mktsegment AS owner,
  CASE WHEN coalesce(rc, 1) <> 0 THEN 'ERR' ELSE concat(coalesce(cs, '?'), ' / ', coalesce(ss, '?')) END AS status
FROM customer LEFT JOIN s ON o_custkey = c_custkey AND rn = 1
""",
)
def with_live_status(t: Tables):
    fleet = t.customer.select(F.col("c_custkey").alias("cluster_name"), F.col("c_mktsegment").alias("owner"))
    return inventory.with_live_status(fleet, snapshots(t), tiebreak=("o_orderkey",))


@query(
    "fleet_list",
    """
SELECT concat('c', c_custkey) AS cluster_name, lower(c_mktsegment) AS cluster_owner,
  CASE WHEN first_order > TIMESTAMP '2001-08-01 00:30:00' THEN '?' ELSE
    CASE WHEN date_diff('minute', first_order, TIMESTAMP '2001-08-01 00:30:00') < 60 THEN concat(date_diff('minute', first_order, TIMESTAMP '2001-08-01 00:30:00'), 'm')
         WHEN date_diff('minute', first_order, TIMESTAMP '2001-08-01 00:30:00') // 60 < 48 THEN concat(date_diff('minute', first_order, TIMESTAMP '2001-08-01 00:30:00') // 60, 'h')
         ELSE concat(date_diff('minute', first_order, TIMESTAMP '2001-08-01 00:30:00') // 60 // 24, 'd') END END AS age,
  'LOCAL' AS status
FROM customer JOIN (SELECT o_custkey, min(o_orderdate) AS first_order FROM orders GROUP BY 1) ON o_custkey = c_custkey
WHERE c_nationkey = 4
""",
)
def fleet_list(t: Tables):
    named = lambda c: F.concat(F.lit("c"), F.col(c).cast("string"))
    first = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.min("o_orderdate").alias("born"))
    raw = t.customer.join(first, "c_custkey").select(
        named("c_custkey").alias("cluster_name"),
        F.lower("c_mktsegment").alias("cluster_owner"),
        F.concat(F.lit("nation-"), F.col("c_nationkey").cast("string")).alias("region"),
        F.date_format("born", "d-MMMM-yyyy").alias("DEPLOYMENT_DATE"),
    )
    listed = reports.fleet_list(
        t.customer.select(named("c_custkey").alias("cluster_name")), raw, as_of="2001-08-01 00:30:00", region="nation-4"
    )
    return listed.select("cluster_name", "cluster_owner", "age", "status")


# One instance family per brand number 1..25.
FAMILIES = (
    "a1", "c6g", "c6gn", "c7i", "m5", "p4d", "p4de", "p5", "g5", "g5g", "g6", "t4g", "x2gd",
    "hpc7g", "hpc7a", "im4gn", "is4gen", "i4g", "inf2", "trn1", "r6g", "r5", "p3", "g4dn", "g4ad",
)
FAMILY_SQL = f"{list(FAMILIES)!r}[CAST(substr(p_brand, 7) AS INT)]"


def instance_type():
    family = F.element_at(F.array(*[F.lit(f) for f in FAMILIES]), F.substring("p_brand", 7, 9).cast("int"))
    return F.concat(family, F.lit("."), F.col("p_size").cast("string"), F.lit("xlarge"))


ARM_SQL = r"regexp_matches(it, '^(a1\.|c6g|c7g|c8g|m6g|m7g|r6g|r7g|hpc7g|g5g|im4gn|is4gen|i4g|t4g|x2g)')"
GPU_SQL = r"regexp_matches(it, '^(g4dn\.|g4ad\.|g5\.|g5g\.|g6\.|p3\.|p3dn\.|p4d\.|p4de\.|p5\.)')"


@query(
    "family_flags",
    rf"""
WITH x AS (SELECT p_partkey, p_type, concat({FAMILY_SQL}, '.', p_size, 'xlarge') AS it FROM part)
SELECT p_partkey, it AS instance_type,
  CASE p_type WHEN 'LARGE' THEN 'arm64' WHEN 'SMALL' THEN 'x86_64' ELSE CASE WHEN {ARM_SQL} THEN 'arm64' ELSE 'x86_64' END END AS arch,
  {GPU_SQL} AS is_gpu, regexp_matches(it, '^(p4d\.|p4de\.|p5\.)') AS needs_gdr
FROM x
""",
)
def family_flags(t: Tables):
    listed = F.when(F.col("p_type") == "LARGE", F.array(F.lit("x86_64"), F.lit("arm64"))).when(
        F.col("p_type") == "SMALL", F.array(F.lit("i386"), F.lit("x86_64"))
    )
    rows = t.part.select("p_partkey", instance_type().alias("instance_type"), listed.alias("archs"))
    return inventory.family_flags(rows, "instance_type", "archs").drop("archs")


@query(
    "record_tags",
    """
WITH r AS (SELECT c_custkey, unnest([
  {'k': 'ClusterStackType', 'v': 'fleet'}, {'k': 'ClusterID', 'v': c_name}, {'k': 'ClusterOSType', 'v': 'rhel9'},
  {'k': 'ClusterScheduler', 'v': 'slurm'}, {'k': 'ClusterSerialNumber', 'v': concat('s', c_custkey)},
  {'k': 'ClusterOwner', 'v': c_mktsegment}, {'k': 'ClusterOwnerEmail', 'v': concat(c_mktsegment, '@example.org')},
  {'k': 'ClusterOwnerDepartment', 'v': NULL}, {'k': 'ProjectID', 'v': CASE WHEN c_nationkey > 12 THEN concat('p', c_nationkey) ELSE 'UNDEFINED' END},
  {'k': 'ProdLevel', 'v': 'dev'}, {'k': 'DEPLOYMENT_DATE', 'v': '4-July-2026'}]) AS e FROM customer)
SELECT c_custkey, e.k AS tag_key, e.v AS tag_value FROM r WHERE NOT (e.k = 'ProjectID' AND e.v = 'UNDEFINED')
""",
)
def record_tags(t: Tables):
    rows = t.customer.select(
        "c_custkey",
        F.col("c_name").alias("cluster_name"),
        F.lit("rhel9").alias("base_os"),
        F.lit("slurm").alias("scheduler"),
        F.concat(F.lit("s"), F.col("c_custkey").cast("string")).alias("cluster_serial_number"),
        F.col("c_mktsegment").alias("cluster_owner"),
        F.concat("c_mktsegment", F.lit("@example.org")).alias("cluster_owner_email"),
        F.lit(None).cast("string").alias("cluster_owner_department"),
        F.when(F.col("c_nationkey") > 12, F.concat(F.lit("p"), F.col("c_nationkey").cast("string"))).otherwise("UNDEFINED").alias("project_id"),
        F.lit("dev").alias("prod_level"),
        F.lit("4-July-2026").alias("DEPLOYMENT_DATE"),
    )
    return inventory.record_tags(rows, key="c_custkey", stack_type="fleet")


@query(
    "derived_columns",
    rf"""
WITH x AS (SELECT p_partkey, p_size, concat('/', replace(p_name, ' ', '_')) AS dir, p_type IN ('PROMO', 'LARGE') AS fsx,
  p_size > 20 AS efs, p_type = 'SMALL' AS nfs, p_size > 10 AS efa, concat({FAMILY_SQL}, '.', p_size, 'xlarge') AS it,
  p_type <> 'ECONOMY' AS cpu_on, p_size > 40 AS gpu_on, p_size > 30 AS bench, p_type IN ('MEDIUM', 'SMALL') AS mon,
  CASE WHEN p_size < 25 THEN 2100 ELSE p_size * 1000 END AS wait, p_size < 15 AS keep_cpu, p_size > 35 AS keep_gpu,
  CASE p_type WHEN 'PROMO' THEN 'alinux2023arm' WHEN 'SMALL' THEN 'alinux2023' WHEN 'LARGE' THEN 'rhel9arm' ELSE 'ubuntu2404' END AS os,
  p_brand FROM part)
SELECT p_partkey,
  CASE WHEN fsx THEN '/fsx/pkg' WHEN efs THEN '/efs/pkg' WHEN nfs THEN '/nfs/pkg' ELSE concat(dir, '/pkg') END AS pkg_dir,
  concat_ws(',', dir, CASE WHEN efs THEN '/efs' END, CASE WHEN fsx THEN '/fsx' END, CASE WHEN nfs THEN '/nfs' END) AS mounts,
  concat_ws(',', CASE WHEN efa THEN 'EFA' END, CASE WHEN efs THEN 'EFS' END, CASE WHEN fsx THEN 'FSx/Lustre' END, CASE WHEN nfs THEN 'External NFS' END,
    CASE WHEN gpu_on THEN 'GPU queue' END, CASE WHEN bench THEN 'HPC Benchmarks' END, CASE WHEN mon THEN 'Monitoring' END) AS options,
  CAST(CASE WHEN wait = 2100 THEN 2100 + CASE WHEN fsx THEN 1800 WHEN efs THEN 600 ELSE 0 END ELSE least(greatest(wait, 1), 43200) END AS BIGINT) AS bootstrap_seconds,
  efa AND regexp_matches(it, '^(p4d\.|p4de\.|p5\.)') AS efa_gdr,
  (cpu_on AND keep_cpu) OR (gpu_on AND keep_gpu) AS min_count_pinned,
  CAST(CASE WHEN keep_cpu THEN p_size ELSE 0 END AS BIGINT) AS cpu_min_count, CAST(CASE WHEN keep_gpu THEN p_size + 1 ELSE 0 END AS BIGINT) AS gpu_min_count,
  mon AND os LIKE '%alinux%' AS compose_staged, CASE WHEN os LIKE '%arm' THEN 'aarch64' ELSE 'x86_64' END AS compose_arch,
  concat('results-123-', p_brand) AS results_bucket
FROM x
""",
)
def derived_columns(t: Tables):
    size, kind = F.col("p_size"), F.col("p_type")
    rows = t.part.select(
        "p_partkey",
        F.concat(F.lit("/"), F.replace(F.col("p_name"), F.lit(" "), F.lit("_"))).alias("shared_dir"),
        kind.isin("PROMO", "LARGE").alias("enable_fsx"),
        (size > 20).alias("enable_efs"),
        (kind == "SMALL").alias("enable_external_nfs"),
        (size > 10).alias("enable_efa"),
        F.array(instance_type()).alias("cpu_instance_types"),
        F.array().cast("array<string>").alias("gpu_instance_types"),
        (kind != "ECONOMY").alias("enable_cpu_queue"),
        (size > 40).alias("enable_gpu_queue"),
        (size > 30).alias("enable_hpc_benchmarks"),
        kind.isin("MEDIUM", "SMALL").alias("enable_monitoring"),
        F.when(size < 25, 2100).otherwise(size * 1000).alias("bootstrap_timeout"),
        (size < 15).alias("maintain_cpu_size"),
        (size > 35).alias("maintain_gpu_size"),
        size.alias("initial_cpu_queue_size"),
        (size + 1).alias("initial_gpu_queue_size"),
        F.when(kind == "PROMO", "alinux2023arm").when(kind == "SMALL", "alinux2023").when(kind == "LARGE", "rhel9arm").otherwise("ubuntu2404").alias("base_os"),
        F.lit("123").alias("account"),
        F.col("p_brand").alias("region"),
    )
    derived = inventory.derived_columns(rows, results_prefix="results")
    return derived.select(
        "p_partkey", "pkg_dir", F.array_join("mounts", ",").alias("mounts"), F.array_join("options", ",").alias("options"),
        "bootstrap_seconds", "efa_gdr", "min_count_pinned", "cpu_min_count", "gpu_min_count", "compose_staged", "compose_arch", "results_bucket",
    )


@query(
    "age_label",
    """
WITH m AS (SELECT o_orderkey, CASE WHEN o_orderpriority = '5-LOW' THEN NULL ELSE
  date_diff('minute', o_orderdate, TIMESTAMP '2001-08-01 00:30:00') END AS m FROM orders)
SELECT o_orderkey, CASE WHEN m IS NULL THEN '?' WHEN m < 60 THEN concat(m, 'm') WHEN m // 60 < 48 THEN concat(m // 60, 'h')
  ELSE concat(m // 60 // 24, 'd') END AS age FROM m
""",
)
def age_label(t: Tables):
    written = F.when(F.col("o_orderpriority") == "5-LOW", F.date_format("o_orderdate", "yyyy-MM-dd")).otherwise(
        F.date_format("o_orderdate", "d-MMMM-yyyy")
    )
    return t.orders.select("o_orderkey", values.age_label(written, "2001-08-01 00:30:00").alias("age"))


@query(
    "parse_keys",
    """
SELECT o_orderkey, concat('c-', o_custkey) AS cluster, strftime(o_orderdate, '%Y-%m-%d 07:08:09') AS built_at,
  strftime(o_orderdate, '%Y-%m-%d 10:15:00') AS started_at, o_orderkey AS pid, o_orderpriority AS p_cluster,
  concat('s', o_custkey) AS p_serial, strftime(o_orderdate, '%Y%m%d_101500') AS p_run, 'osu/latency.txt' AS p_file
FROM orders
""",
)
def parse_keys(t: Tables):
    day = F.col("o_orderdate")
    number, owner = F.col("o_orderkey").cast("string"), F.col("o_custkey").cast("string")
    serial = F.concat(F.lit("c-"), owner, F.lit("-090807"), F.date_format(day, "ddMMyyyy"))
    run = F.concat(F.date_format(day, "yyyyMMdd"), F.lit("_101500_"), number)
    path = F.concat(
        F.lit("store:/x/results/"), F.col("o_orderpriority"), F.lit("/s"), owner, F.lit("/"), F.date_format(day, "yyyyMMdd"),
        F.lit("_101500/osu/latency.txt"),
    )
    keys = t.orders.select(
        "o_orderkey",
        text.parse_serial(serial).alias("s"),
        text.parse_run_id(run).alias("r"),
        text.parse_results_path(path, "results").alias("p"),
    )
    stamp = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    return keys.select(
        "o_orderkey", F.col("s.cluster").alias("cluster"), stamp("s.built_at").alias("built_at"), stamp("r.started_at").alias("started_at"),
        F.col("r.pid").alias("pid"), F.col("p.cluster").alias("p_cluster"), F.col("p.serial").alias("p_serial"),
        F.col("p.run_id").alias("p_run"), F.col("p.relpath").alias("p_file"),
    )


@query(
    "sanitize",
    r"""
SELECT doc_id, md5(s) AS digest, length(s) AS kept FROM (SELECT doc_id, regexp_replace(text, '[^\x20-\x7e]', '', 'g') AS s FROM documents)
""",
)
def sanitize(t: Tables):
    clean = text.sanitize("text")
    return t.documents.select("doc_id", F.md5(clean).alias("digest"), F.length(clean).cast("bigint").alias("kept"))


BLANKS = "chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(28) || chr(29) || chr(30) || chr(31) || ' ' || chr(133) || chr(160) || chr(5760) || " + " || ".join(
    f"chr({n})" for n in (*range(8192, 8203), 8232, 8233, 8239, 8287, 12288)
)


@query(
    "parse_type_list",
    f"""
WITH parts AS (SELECT doc_id, pos, trim(part, {BLANKS}) AS part FROM (
  SELECT doc_id, unnest(string_split(text, ',')) AS part, generate_subscripts(string_split(text, ','), 1) AS pos FROM documents)),
firsts AS (SELECT doc_id, part, min(pos) AS pos FROM parts WHERE part <> '' GROUP BY 1, 2),
lists AS (SELECT doc_id, count(*) AS n, md5(string_agg(part, '|' ORDER BY pos)) AS digest FROM firsts GROUP BY 1)
SELECT doc_id, coalesce(n, 0) AS n, coalesce(digest, md5('')) AS digest FROM documents LEFT JOIN lists USING (doc_id)
""",
)
def parse_type_list(t: Tables):
    parsed = text.parse_type_list("text")
    return t.documents.select("doc_id", F.size(parsed).cast("bigint").alias("n"), F.md5(F.array_join(parsed, "|")).alias("digest"))


@query("epoch_ms_text", "SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS at FROM events")
def epoch_ms_text(t: Tables):
    ms = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000)
    return t.events.select("event_id", values.epoch_ms_text(ms).alias("at"))


@query(
    "coerce_values",
    """
SELECT event_id, CASE WHEN event_type IN ('error', 'view') THEN -1 ELSE CAST(floor(value) AS BIGINT) END AS as_int,
  CASE event_type WHEN 'purchase' THEN NULL ELSE event_type = 'click' END AS as_bool, value > 1 AS int_bool,
  CASE event_type WHEN 'signup' THEN '' ELSE concat('a|', event_type, '|a') END AS as_list,
  CASE event_type WHEN 'signup' THEN 'none' ELSE event_type END AS as_text
FROM events
""",
)
def coerce_values(t: Tables):
    kind = F.col("event_type")
    number = F.when(kind == "error", "1.5x").when(kind != "view", F.concat(F.lit(" "), F.floor("value").cast("string"), F.lit(" ")))
    flag = F.when(kind == "click", "TRUE").when(kind != "purchase", "yes")
    listing = F.when(kind == "signup", " ,, ").otherwise(F.concat(F.lit("a, "), kind, F.lit(",,a")))
    return t.events.select(
        "event_id",
        values.to_int(number, -1).alias("as_int"),
        values.to_bool(flag).alias("as_bool"),
        values.to_bool(F.when(F.col("value") > 1, F.ceil("value")).otherwise(0), "int").alias("int_bool"),
        F.array_join(values.to_list(listing), "|").alias("as_list"),
        values.to_text(F.when(kind != "signup", F.concat(kind, F.lit("\x07"))), "none").alias("as_text"),
    )


@query(
    "clamp",
    """
SELECT event_id, least(greatest(CAST(floor(value) AS BIGINT), 5), 100) AS value, floor(value) NOT BETWEEN 5 AND 100 AS adjusted FROM events
""",
)
def clamp(t: Tables):
    return t.events.select("event_id", values.clamp(F.floor("value"), 5, 100).alias("c")).select("event_id", "c.*")


@query(
    "nvidia_gpu_count",
    """
SELECT p_partkey, CAST(CASE p_type WHEN 'PROMO' THEN p_size WHEN 'SMALL' THEN p_size + 4 WHEN 'LARGE' THEN 0 ELSE 0 END AS BIGINT) AS gpus FROM part
""",
)
def nvidia_gpu_count(t: Tables):
    device = lambda maker, n: F.struct(F.lit(maker).alias("manufacturer"), n.cast("int").alias("count"))
    size = F.col("p_size")
    gpus = (
        F.when(F.col("p_type") == "PROMO", F.array(device("Nvidia", size), device("AMD", F.lit(2))))
        .when(F.col("p_type") == "SMALL", F.array(device("NVIDIA", size), device("nvidia", F.lit(4)), device("NVIDIA", F.lit(None))))
        .when(F.col("p_type") == "LARGE", F.array(device("AMD", size)))
    )
    return t.part.select("p_partkey", values.nvidia_gpu_count(gpus).alias("gpus"))


@query(
    "usable_vcpus",
    """
SELECT p_partkey, CAST(CASE WHEN p_type = 'PROMO' THEN 0 WHEN p_brand = 'Brand#3' THEN p_size
  WHEN p_type = 'SMALL' THEN p_size // 2 ELSE p_size END AS BIGINT) AS vcpus FROM part
""",
)
def usable_vcpus(t: Tables):
    total = F.when(F.col("p_type") != "PROMO", F.col("p_size"))
    threads = F.when(F.col("p_type") == "SMALL", 2).when(F.col("p_type") == "LARGE", 0)
    return t.part.select("p_partkey", values.usable_vcpus(total, threads, F.col("p_brand") == "Brand#3").alias("vcpus"))


@query(
    "glob_to_regex",
    r"""
WITH x AS (SELECT page_id, url, CASE WHEN url LIKE 'https%' THEN concat('https://*', regexp_extract(url, '^https?://([^/?#]*)', 1), '/??/*') ELSE '*.example.com/*[0-9]' END AS p FROM pages),
r AS (SELECT *, concat('^(?s:', replace(replace(regexp_replace(p, '([\\^$.|+()\[\]{}])', '\\\1', 'g'), '*', '.*'), '?', '.'), ')$') AS regex FROM x)
SELECT page_id, regex, regexp_matches(url, regex) AS hit FROM r
""",
)
def glob_to_regex(t: Tables):
    host = F.regexp_extract("url", "^https?://([^/?#]*)", 1)
    pattern = F.when(F.startswith("url", F.lit("https")), F.concat(F.lit("https://*"), host, F.lit("/??/*"))).otherwise("*.example.com/*[0-9]")
    rows = t.pages.select("page_id", "url", text.glob_to_regex(pattern).alias("regex"))
    return rows.select("page_id", "regex", F.rlike("url", F.col("regex")).alias("hit"))
