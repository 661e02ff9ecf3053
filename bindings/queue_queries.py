"""Catalog, queues, ranks, architecture, capability, subnets, inheritance, changes."""

from __future__ import annotations

from pyspark.sql import functions as F

from bindings.inventory_queries import FAMILY_SQL, GPU_SQL, instance_type
from bindings.registry import Tables, query
from fleetloom.operators import queues
from fleetloom.plans import reports

CATEGORIES = ("STANDARD", "SMALL", "MEDIUM", "LARGE", "ECONOMY", "PROMO")


@query(
    "instance_catalog",
    "SELECT p_partkey AS instance_type, lower(p_type) AS category FROM part WHERE p_type IN ('STANDARD','SMALL','MEDIUM','LARGE','ECONOMY','PROMO')",
)
def instance_catalog(t: Tables):
    types = t.part.select(F.col("p_partkey").alias("instance_type"), "p_type")
    return queues.instance_catalog({c.lower(): types.where(F.col("p_type") == c) for c in CATEGORIES})


def queue_configs(t: Tables):
    """A queue per part: two resources, or one without instances for the smallest parts."""
    resource = "struct<min:int,max:int,instances:array<string>>"
    first = F.struct(F.lit(None).cast("int").alias("min"), F.col("p_size").alias("max"), F.array(instance_type(), F.lit("m5.large")).alias("instances"))
    second = F.struct(F.lit(1).alias("min"), F.lit(10).alias("max"), F.array(F.lit("m5.large")).alias("instances"))
    bare = F.struct(F.lit(2).alias("min"), F.lit(4).alias("max"), F.lit(None).cast("array<string>").alias("instances"))
    resources = (
        F.when(F.col("p_size") > 5, F.array(first, second))
        .when(F.col("p_size") > 2, F.array(bare))
        .otherwise(F.lit(None).cast(f"array<{resource}>"))
    )
    capacity = F.when(F.col("p_type") == "PROMO", "SPOT").otherwise("ONDEMAND")
    return t.part.select(
        F.col("p_brand").alias("cluster"),
        F.col("p_partkey").alias("pos"),
        F.struct(F.col("p_name").alias("name"), capacity.alias("capacity_type"), resources.alias("resources")).alias("queue"),
    )


SUMMARY = f"""
SELECT p_brand AS cluster, p_partkey AS pos, p_name AS name, CASE WHEN p_size > 5 AND {GPU_SQL} THEN 'gpu' ELSE 'compute' END AS kind,
  CASE WHEN p_type = 'PROMO' THEN 'SPOT' ELSE 'ONDEMAND' END AS capacity_type,
  CAST(CASE WHEN p_size > 5 THEN 1 WHEN p_size > 2 THEN 2 ELSE 0 END AS BIGINT) AS min_count,
  CAST(CASE WHEN p_size > 5 THEN p_size + 10 WHEN p_size > 2 THEN 4 ELSE 0 END AS BIGINT) AS max_count,
  CASE WHEN p_size > 5 THEN concat(it, '|m5.large|m5.large') ELSE '' END AS types
FROM (SELECT *, concat({FAMILY_SQL}, '.', p_size, 'xlarge') AS it FROM part)
"""


@query("queue_summary", SUMMARY)
def queue_summary(t: Tables):
    return queues.queue_summary(queue_configs(t)).withColumn("types", F.array_join("types", "|"))


def type_sizes(t: Tables):
    """Smallest size per type, for the types of the larger parts only; the rest is unknown."""
    large = t.part.where(F.col("p_size") > 8).select(instance_type().alias("instance_type"), (F.col("p_size") - 9).alias("vcpus"))
    fixed = t.part.select(F.lit("m5.large").alias("instance_type"), F.col("p_size").alias("vcpus"))
    return large.unionByName(fixed).groupBy("instance_type").agg(F.max("vcpus").alias("vcpus"))


RANKS = f"""
WITH p AS (SELECT *, concat({FAMILY_SQL}, '.', p_size, 'xlarge') AS it FROM part),
types AS (SELECT it, max(p_size - 9) AS vcpus FROM p WHERE p_size > 8 GROUP BY 1 UNION ALL SELECT 'm5.large', max(p_size) FROM p),
m AS (SELECT p_brand AS cluster, p_partkey AS pos, p_size, least(coalesce(a.vcpus, 0), b.vcpus) AS v FROM p LEFT JOIN types a ON a.it = p.it CROSS JOIN (SELECT vcpus FROM types WHERE it = 'm5.large') b)
"""


@query("ranks_per_queue", f"{RANKS} SELECT cluster, pos, CAST(CASE WHEN p_size > 5 THEN greatest(v, 1) ELSE 0 END AS BIGINT) AS ranks FROM m")
def ranks_per_queue(t: Tables):
    rows = queues.queue_summary(queue_configs(t))
    return queues.ranks_per_queue(rows, type_sizes(t), key=["cluster", "pos"], type_list="types", count="vcpus")


@query("device_ranks_per_queue", f"{RANKS} SELECT cluster, pos, CAST(CASE WHEN p_size > 5 THEN v ELSE 0 END AS BIGINT) AS ranks FROM m")
def device_ranks_per_queue(t: Tables):
    rows = queues.queue_summary(queue_configs(t))
    return queues.ranks_per_queue(rows, type_sizes(t), key=["cluster", "pos"], type_list="types", count="vcpus", floor=None)


@query(
    "queue_overview",
    f"""
WITH s AS ({SUMMARY}), r AS ({RANKS} SELECT cluster, pos, CAST(CASE WHEN p_size > 5 THEN greatest(v, 1) ELSE 0 END AS BIGINT) AS ranks FROM m)
SELECT * FROM s JOIN r USING (cluster, pos)
""",
)
def queue_overview(t: Tables):
    return reports.queue_overview(queue_configs(t), type_sizes(t)).withColumn("types", F.array_join("types", "|"))


@query(
    "arch_consistency",
    """
WITH x AS (SELECT concat(p_brand, '/', p_size) AS cluster, CASE WHEN p_type <> 'ECONOMY' THEN p_name END AS it,
  CASE WHEN p_name LIKE 'red%' OR p_name LIKE 'blue%' THEN 'arm64' ELSE 'x86_64' END AS arch FROM part),
g AS (SELECT cluster, min(arch) FILTER (WHERE it IS NOT NULL) AS lo, max(arch) FILTER (WHERE it IS NOT NULL) AS hi,
  string_agg(DISTINCT concat(it, '=', arch), ', ' ORDER BY concat(it, '=', arch)) FILTER (WHERE it IS NOT NULL) AS detail FROM x GROUP BY 1)
SELECT cluster, CASE WHEN lo = hi THEN lo END AS arch, coalesce(lo <> hi, false) AS mixed, CASE WHEN lo <> hi THEN detail END AS detail FROM g
""",
)
def arch_consistency(t: Tables):
    arm = F.col("p_name").rlike("^(red|blue)")
    types = t.part.select(
        F.concat("p_brand", F.lit("/"), F.col("p_size").cast("string")).alias("cluster"),
        F.when(F.col("p_type") != "ECONOMY", F.col("p_name")).alias("instance_type"),
        F.when(arm, "arm64").otherwise("x86_64").alias("arch"),
    )
    return queues.arch_consistency(types, key="cluster")


def wanted_types(t: Tables):
    return t.part.select("p_partkey", F.col("p_name").alias("instance_type"))


@query(
    "not_capable_live",
    """
SELECT p_partkey, p_name AS instance_type FROM part
WHERE p_name NOT IN (SELECT p_name FROM part WHERE p_brand = 'Brand#5' AND p_size > 30)
""",
)
def not_capable_live(t: Tables):
    live = t.part.where((F.col("p_brand") == "Brand#5") & (F.col("p_size") > 30)).select(F.col("p_name").alias("instance_type"))
    fallback = t.part.where(F.col("p_type") == "PROMO").select(F.col("p_name").alias("instance_type"))
    return queues.not_capable(wanted_types(t), live, fallback)


@query(
    "not_capable_fallback",
    """
SELECT p_partkey, p_name AS instance_type FROM part WHERE p_name NOT IN (SELECT p_name FROM part WHERE p_type = 'PROMO' AND p_size = 12)
""",
)
def not_capable_fallback(t: Tables):
    live = t.part.where(F.col("p_size") > 1000).select(F.col("p_name").alias("instance_type"))
    fallback = t.part.where((F.col("p_type") == "PROMO") & (F.col("p_size") == 12)).select(F.col("p_name").alias("instance_type"))
    return queues.not_capable(wanted_types(t), live, fallback)


def subnets(t: Tables):
    return t.supplier.select(
        F.when(F.col("s_nationkey") < 12, "vpc-a").otherwise("vpc-b").alias("vpc"),
        F.concat(F.lit("z"), F.col("s_nationkey").cast("string")).alias("zone"),
        F.col("s_name").alias("subnet_id"),
        (F.col("s_acctbal") > 3000).alias("private"),
    )


SUBNETS = """
SELECT CASE WHEN s_nationkey < 12 THEN 'vpc-a' ELSE 'vpc-b' END AS vpc, concat('z', s_nationkey) AS zone, s_name AS subnet_id, s_acctbal > 3000 AS private FROM supplier
"""


@query(
    "first_per_group",
    f"SELECT vpc, zone, min(subnet_id) AS subnet_id, count(*) AS members, count(*) > 1 AS ambiguous FROM ({SUBNETS}) WHERE private GROUP BY 1, 2",
)
def first_per_group(t: Tables):
    return queues.first_per_group(subnets(t), key=["vpc", "zone"], order="subnet_id", private="private")


@query(
    "gpu_subnets",
    f"""
WITH picks AS (SELECT vpc, zone, min(subnet_id) AS a, min(subnet_id) FILTER (WHERE private) AS p FROM ({SUBNETS}) GROUP BY 1, 2),
r AS (SELECT c_custkey AS cluster, CASE WHEN c_nationkey < 12 THEN 'vpc-a' ELSE 'vpc-b' END AS vpc, concat('z', c_nationkey) AS zone,
  c_mktsegment IN ('BUILDING', 'MACHINERY') AS pc, c_acctbal > 4000 AS pg, c_mktsegment = 'FURNITURE' AS hand, c_acctbal > 8000 AS gz FROM customer),
x AS (SELECT r.*, a, p, NOT gz AND NOT (pg AND NOT (pc AND NOT hand)) AS reuse FROM r LEFT JOIN picks USING (vpc, zone))
SELECT cluster, 'compute' AS role, CASE WHEN hand THEN 'given-1' WHEN pc THEN p ELSE a END AS subnet_id FROM x
UNION ALL
SELECT cluster, 'gpu', CASE WHEN reuse THEN CASE WHEN hand THEN 'given-1' WHEN pc THEN p ELSE a END WHEN pg THEN p ELSE a END FROM x
""",
)
def gpu_subnets(t: Tables):
    zone, none = F.concat(F.lit("z"), F.col("c_nationkey").cast("string")), F.array().cast("array<string>")
    requests = t.customer.select(
        F.col("c_custkey").alias("cluster"),
        F.when(F.col("c_nationkey") < 12, "vpc-a").otherwise("vpc-b").alias("vpc"),
        F.array(zone).alias("compute_zones"),
        F.when(F.col("c_acctbal") > 8000, F.array(zone)).otherwise(none).alias("gpu_zones"),
        F.col("c_mktsegment").isin("BUILDING", "MACHINERY").alias("private_compute"),
        (F.col("c_acctbal") > 4000).alias("private_gpu"),
        F.when(F.col("c_mktsegment") == "FURNITURE", F.array(F.lit("given-1"), F.lit("given-2"))).otherwise(none).alias("compute_override"),
    )
    return queues.first_subnets(requests, subnets(t))


@query(
    "inherit_first",
    """
SELECT o_custkey AS cluster, arg_min(o_orderpriority, o_orderkey) FILTER (WHERE o_orderstatus <> 'P') AS plain,
  coalesce(coalesce(arg_min(o_orderpriority, o_orderkey) FILTER (WHERE o_orderstatus <> 'P' AND o_totalprice > 400000),
    arg_min(o_orderpriority, o_orderkey) FILTER (WHERE o_orderstatus <> 'P')), 'none') AS preferred
FROM orders GROUP BY 1
""",
)
def inherit_first(t: Tables):
    rows = t.orders.select(F.col("o_custkey").alias("cluster"), F.col("o_orderkey").alias("pos"), "o_orderpriority", "o_orderstatus", "o_totalprice")
    value = F.when(F.col("o_orderstatus") != "P", F.col("o_orderpriority"))
    plain = queues.inherit_first(rows, value, key="cluster", name="plain")
    gpu_first = queues.inherit_first(rows, value, key="cluster", prefer=F.col("o_totalprice") > 400000, default=F.lit("none"), name="preferred")
    return plain.join(gpu_first, "cluster")


# Changes in order: each customer asks for four, among them removals of every queue there is and an add that is taken back.
CHANGES = """
changes AS (SELECT cluster, unnest([
    {position: 1, queue: q, action: a}, {position: 2, queue: '5-LOW', action: 'remove'}, {position: 3, queue: 'brand-new', action: 'add'},
    {position: 4, queue: CASE WHEN a = 'add' THEN 'brand-new' ELSE '1-URGENT' END, action: 'remove'}]) AS c
  FROM (SELECT c_custkey AS cluster, CASE c_mktsegment WHEN 'BUILDING' THEN '1-URGENT' WHEN 'MACHINERY' THEN '2-HIGH' WHEN 'FURNITURE' THEN '4-NOT SPECIFIED' ELSE '3-MEDIUM' END AS q,
    CASE WHEN c_acctbal > 4500 THEN 'add' ELSE 'remove' END AS a FROM customer)),
ordered AS (SELECT cluster, c.position AS position, c.queue AS queue, c.action AS action FROM changes),
have AS (SELECT o_custkey AS cluster, list(DISTINCT o_orderpriority) AS qs FROM orders GROUP BY 1),
start AS (SELECT c_custkey AS cluster, coalesce(qs, CAST([] AS VARCHAR[])) AS qs FROM customer LEFT JOIN have ON have.cluster = c_custkey),
fold AS (WITH RECURSIVE f(cluster, position, qs, queue, action, reason) AS (
  SELECT cluster, 0, qs, CAST(NULL AS VARCHAR), CAST(NULL AS VARCHAR), CAST(NULL AS VARCHAR) FROM start
  UNION ALL SELECT cluster, position, CASE WHEN reason IS NOT NULL THEN qs WHEN action = 'add' THEN list_append(qs, queue) ELSE list_filter(qs, lambda x: x <> queue) END, queue, action, reason
  FROM (SELECT o.cluster, o.position, f.qs, o.queue, o.action,
      CASE WHEN o.action = 'add' AND list_contains(f.qs, o.queue) THEN 'already exists' WHEN o.action = 'remove' AND NOT list_contains(f.qs, o.queue) THEN 'not found'
        WHEN o.action = 'remove' AND len(f.qs) = 1 THEN 'last queue' END AS reason
    FROM f JOIN ordered o ON o.cluster = f.cluster AND o.position = f.position + 1)) SELECT * FROM f)
"""


def queue_changes(t: Tables):
    segment = F.col("c_mktsegment")
    queue = F.when(segment == "BUILDING", "1-URGENT").when(segment == "MACHINERY", "2-HIGH").when(segment == "FURNITURE", "4-NOT SPECIFIED").otherwise("3-MEDIUM")
    action = F.when(F.col("c_acctbal") > 4500, "add").otherwise("remove")
    back = F.when(action == "add", "brand-new").otherwise("1-URGENT")
    change = lambda at, name, what: F.struct(F.lit(at).alias("position"), name.alias("queue"), what.alias("action"))
    listed = F.array(
        change(1, queue, action), change(2, F.lit("5-LOW"), F.lit("remove")), change(3, F.lit("brand-new"), F.lit("add")), change(4, back, F.lit("remove"))
    )
    changes = t.customer.select(F.col("c_custkey").alias("cluster"), F.explode(listed).alias("c")).select("cluster", "c.*")
    existing = t.orders.select(F.col("o_custkey").alias("cluster"), F.col("o_orderpriority").alias("queue")).distinct()
    return queues.queue_apply(existing, changes)


@query("queue_apply", f"WITH {CHANGES} SELECT cluster, unnest(qs) AS queue FROM fold WHERE position = 4")
def queue_apply(t: Tables):
    return queue_changes(t)[0]


@query("queue_apply_rejected", f"WITH {CHANGES} SELECT cluster, position, queue, action, reason FROM fold WHERE reason IS NOT NULL")
def queue_apply_rejected(t: Tables):
    return queue_changes(t)[1]
