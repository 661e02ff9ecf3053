"""Look-back windows, cost by tag, cost report."""

from __future__ import annotations

from pyspark.sql import functions as F

from bindings.registry import Tables, query
from fleetloom.operators import cost, inventory
from fleetloom.plans import reports

AS_OF = "2001-08-01"


@query(
    "lookback_days",
    """
SELECT o_orderkey, o_totalprice FROM orders
WHERE o_orderdate >= TIMESTAMP '2001-08-01' - INTERVAL 30 DAY AND o_orderdate < TIMESTAMP '2001-08-01'
""",
)
def lookback_days(t: Tables):
    return cost.lookback_days(t.orders, "o_orderdate", 30, AS_OF).select("o_orderkey", "o_totalprice")


@query(
    "lookback_hours",
    "SELECT event_id, user_id FROM events WHERE ts >= TIMESTAMP '2024-01-30' - INTERVAL 72 HOUR",
)
def lookback_hours(t: Tables):
    return cost.lookback_hours(t.events, "ts", 72, "2024-01-30").select("event_id", "user_id")


@query(
    "cost_by_tag",
    """
SELECT l_suppkey AS cluster, round(sum(l_extendedprice), 2) AS total FROM lineitem
WHERE l_shipdate >= TIMESTAMP '2000-08-01' AND l_shipdate < TIMESTAMP '2001-08-01' GROUP BY 1
""",
)
def cost_by_tag(t: Tables):
    totals = cost.cost_by_tag(t.lineitem, key="l_suppkey", amount="l_extendedprice", ts="l_shipdate", days=365, as_of=AS_OF)
    return totals.select("cluster", F.round("total", 2).alias("total"))


TEXT_LINES = """
SELECT l_suppkey, l_shipdate,
  CASE WHEN l_returnflag = 'R' AND l_linestatus = 'O' THEN 'not-a-number'
       WHEN l_discount = 0 THEN NULL ELSE printf('%.2f', l_extendedprice) END AS amount
FROM lineitem
"""


def text_lines(t: Tables):
    broken = (F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "O")
    amount = F.when(broken, "not-a-number").when(
        F.col("l_discount") != 0, F.format_string("%.2f", F.col("l_extendedprice"))
    )
    return t.lineitem.select("l_suppkey", "l_shipdate", amount.alias("amount"))


@query(
    "cost_by_tag_text",
    f"""
WITH lines AS ({TEXT_LINES})
SELECT l_suppkey AS cluster, CAST(coalesce(sum(TRY_CAST(amount AS DECIMAL(20,10))), 0) AS DOUBLE) AS total
FROM lines WHERE l_shipdate >= TIMESTAMP '2000-08-01' AND l_shipdate < TIMESTAMP '2001-08-01' GROUP BY 1
""",
)
def cost_by_tag_text(t: Tables):
    totals = cost.cost_by_tag(text_lines(t), key="l_suppkey", amount="amount", ts="l_shipdate", days=365, as_of=AS_OF)
    return totals.select("cluster", F.col("total").cast("double").alias("total"))


@query(
    "cost_by_tag_month",
    f"""
WITH lines AS ({TEXT_LINES})
SELECT l_suppkey AS cluster, CAST(CAST(date_trunc('month', l_shipdate) AS DATE) AS VARCHAR) AS month,
  CAST(coalesce(sum(TRY_CAST(amount AS DECIMAL(20,10))), 0) AS DOUBLE) AS total
FROM lines WHERE l_shipdate >= TIMESTAMP '2000-08-20' - INTERVAL 200 DAY AND l_shipdate < TIMESTAMP '2000-08-20'
GROUP BY 1, 2
""",
)
def cost_by_tag_month(t: Tables):
    totals = cost.cost_by_tag_month(
        text_lines(t), key="l_suppkey", amount="amount", ts="l_shipdate", days=200, as_of="2000-08-20"
    )
    return totals.select("cluster", F.col("month").cast("string").alias("month"), F.col("total").cast("double").alias("total"))


@query(
    "tag_active",
    """
WITH tags AS (
  SELECT concat('nation-', c_nationkey) AS k, bool_or(c_acctbal > 9900) AS active FROM customer GROUP BY 1)
SELECT s_suppkey AS probe, concat('nation-', s_nationkey) AS tag_key,
  CASE WHEN s_acctbal > 0 THEN coalesce(active, false) END AS active
FROM supplier LEFT JOIN tags ON k = concat('nation-', s_nationkey)
""",
)
def tag_active(t: Tables):
    nation = lambda c: F.concat(F.lit("nation-"), F.col(c).cast("string"))
    probes = t.supplier.select(
        F.col("s_suppkey").alias("probe"), nation("s_nationkey").alias("tag_key"), (F.col("s_acctbal") > 0).alias("readable")
    )
    status = F.when(F.col("c_acctbal") > 9900, "Active").otherwise("Inactive")
    tags = t.customer.select(nation("c_nationkey").alias("tag"), status.alias("status"))
    return cost.tag_active(probes, tags, probe="probe", tag_key="tag_key", key_column="tag", status="status")


def report_inputs(t: Tables):
    names = t.customer.select(F.col("c_custkey").alias("cluster"))
    records = t.customer.where(F.col("c_mktsegment") != "MACHINERY").select(
        F.col("c_custkey").alias("cluster"),
        F.col("c_mktsegment").alias("owner"),
        F.concat(F.lit("nation-"), F.col("c_nationkey").cast("string")).alias("region"),
    )
    errors = t.customer.where(F.col("c_acctbal") < -500).select(
        F.col("c_custkey").alias("cluster"), F.lit("AccessDenied").alias("error")
    )
    return names, records, errors


@query(
    "cost_report",
    """
WITH spend AS (
  SELECT o_custkey, sum(o_totalprice) AS total FROM orders
  WHERE o_orderdate >= TIMESTAMP '2000-08-01' AND o_orderdate < TIMESTAMP '2001-08-01' GROUP BY 1)
SELECT c_custkey AS cluster,
  CASE WHEN c_mktsegment <> 'MACHINERY' THEN c_mktsegment ELSE 'unknown' END AS owner,
  CASE WHEN c_mktsegment <> 'MACHINERY' THEN concat('nation-', c_nationkey) ELSE 'unknown' END AS region,
  CASE WHEN c_acctbal < -500 THEN NULL ELSE round(coalesce(total, 0), 2) END AS total,
  CASE WHEN c_acctbal < -500 THEN 'unavailable' WHEN coalesce(total, 0) = 0 THEN 'zero' ELSE 'value' END AS status,
  CASE WHEN c_acctbal < -500 THEN 'AccessDenied' END AS error
FROM customer LEFT JOIN spend ON o_custkey = c_custkey
""",
)
def cost_report(t: Tables):
    names, records, errors = report_inputs(t)
    spend = cost.cost_by_tag(t.orders, key="o_custkey", amount="o_totalprice", ts="o_orderdate", days=365, as_of=AS_OF)
    return cost.cost_report(names, records, spend, errors).withColumn("total", F.round("total", 2))


@query(
    "cost_overview",
    """
WITH spend AS (
  SELECT o_custkey, sum(o_totalprice) AS total FROM orders
  WHERE o_orderdate >= TIMESTAMP '2001-07-02' AND o_orderdate < TIMESTAMP '2001-08-01' GROUP BY 1)
SELECT concat('c', c_custkey) AS cluster, lower(c_mktsegment) AS owner, concat('nation-', c_nationkey) AS region,
  round(coalesce(total, 0), 2) AS total, CASE WHEN coalesce(total, 0) = 0 THEN 'zero' ELSE 'value' END AS status,
  CAST(NULL AS VARCHAR) AS error, '2001-07-02 – 2001-08-01' AS period,
  CASE WHEN coalesce(total, 0) = 0 THEN '$0.00 *' ELSE printf('$%.2f', round(total, 2)) END AS cost_usd
FROM customer LEFT JOIN spend ON o_custkey = c_custkey WHERE c_mktsegment <> 'HOUSEHOLD'
""",
)
def cost_overview(t: Tables):
    named = F.concat(F.lit("c"), F.col("c_custkey").cast("string"))
    names = t.customer.select(F.when(F.col("c_mktsegment") == "HOUSEHOLD", F.initcap(named)).otherwise(named).alias("cluster"))
    raw = t.customer.select(
        named.alias("cluster_name"),
        F.lower("c_mktsegment").alias("cluster_owner"),
        F.concat(F.lit("nation-"), F.col("c_nationkey").cast("string")).alias("region"),
    )
    lines = t.orders.withColumn("tag", F.concat(F.lit("c"), F.col("o_custkey").cast("string")))
    report = reports.cost_overview(
        names, raw, lines, tag="tag", amount="o_totalprice", ts="o_orderdate", days=30, as_of=AS_OF
    )
    return report.withColumn("total", F.round("total", 2))


@query("missing_records", "SELECT c_custkey AS cluster FROM customer WHERE c_mktsegment = 'MACHINERY'")
def missing_records(t: Tables):
    names, records, _ = report_inputs(t)
    return inventory.missing_records(names, records, key="cluster")
