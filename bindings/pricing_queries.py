"""Spot and on-demand prices, price ranges, hourly fleet cost."""

from __future__ import annotations

from pyspark.sql import functions as F

from bindings.registry import Tables, query
from fleetloom.functions import values
from fleetloom.functions.fixed_values import REGION_LOCATIONS
from fleetloom.operators import pricing
from fleetloom.plans import reports

HISTORY = """
SELECT l_partkey AS instance_type, l_shipdate AS ts, l_returnflag AS product, l_linestatus AS availability_zone,
  l_extendedprice AS spot_price, l_orderkey, l_linenumber, l_suppkey, l_quantity FROM lineitem
"""
TIES = ("l_orderkey", "l_linenumber", "l_suppkey", "l_quantity", "spot_price")


def history(t: Tables):
    return t.lineitem.select(
        F.col("l_partkey").alias("instance_type"),
        F.col("l_shipdate").alias("ts"),
        F.col("l_returnflag").alias("product"),
        F.col("l_linestatus").alias("availability_zone"),
        F.col("l_extendedprice").alias("spot_price"),
        "l_orderkey",
        "l_linenumber",
        "l_suppkey",
        "l_quantity",
    )


def latest_sql(where: str) -> str:
    return f"""
SELECT instance_type, spot_price FROM (
  SELECT *, row_number() OVER (PARTITION BY instance_type
    ORDER BY ts DESC, l_orderkey DESC, l_linenumber DESC, l_suppkey DESC, l_quantity DESC, spot_price DESC) AS rn
  FROM ({HISTORY}) WHERE {where}) WHERE rn = 1
"""


@query("latest_spot_price", latest_sql("true"))
def latest_spot_price(t: Tables):
    return pricing.latest_spot_price(history(t), product=None, tiebreak=TIES)


@query("latest_spot_price_zone", latest_sql("product = 'R' AND availability_zone = 'O'"))
def latest_spot_price_zone(t: Tables):
    return pricing.latest_spot_price(history(t), product="R", zone="O", tiebreak=TIES)


@query(
    "unavailable_types",
    """
SELECT p_partkey AS instance_type FROM part WHERE p_partkey NOT IN
  (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' AND l_linestatus = 'O')
""",
)
def unavailable_types(t: Tables):
    prices = pricing.latest_spot_price(history(t), product="R", zone="O", tiebreak=TIES)
    return pricing.unavailable_types(t.part.select(F.col("p_partkey").alias("instance_type")), prices)


# Sites of the twenty brands that are on the price list; five have no location.
SITES = {f"Brand#{n}": f"Site {n}" for n in range(1, 21)}

CATALOG = """
SELECT p_name AS instance_type, printf('%09d', p_partkey) AS sku, concat('Site ', substr(p_brand, 7)) AS location,
  CASE WHEN p_size = 50 THEN concat('{"terms": {"OnDemand": {"t', p_partkey)
       WHEN p_size = 49 THEN '{"terms": {"OnDemand": {}}}'
       ELSE concat('{"terms": {"OnDemand": {"t', p_partkey, '": {"priceDimensions": {"d', p_size,
                   '": {"pricePerUnit": {"USD": "', printf('%.4f', p_retailprice), '"}}}}}}}') END AS doc
FROM part WHERE p_type NOT IN ('PROMO', 'ECONOMY', 'SMALL', 'MEDIUM')
"""


def catalog(t: Tables, instance_type=None, location=None):
    doc = (
        F.when(F.col("p_size") == 50, F.concat(F.lit('{"terms": {"OnDemand": {"t'), F.col("p_partkey").cast("string")))
        .when(F.col("p_size") == 49, '{"terms": {"OnDemand": {}}}')
        .otherwise(
            F.format_string(
                '{"terms": {"OnDemand": {"t%d": {"priceDimensions": {"d%d": {"pricePerUnit": {"USD": "%.4f"}}}}}}}',
                F.col("p_partkey"), F.col("p_size"), F.col("p_retailprice"),
            )
        )
    )
    return t.part.select(
        (F.col("p_name") if instance_type is None else instance_type).alias("instance_type"),
        F.lpad(F.col("p_partkey").cast("string"), 9, "0").alias("sku"),
        (F.concat(F.lit("Site "), F.substring("p_brand", 7, 9)) if location is None else location).alias("location"),
        F.when(F.col("p_type") == "PROMO", "Windows").otherwise("Linux").alias("operating_system"),
        F.when(F.col("p_type") == "ECONOMY", "SQL").otherwise("NA").alias("preinstalled_sw"),
        F.when(F.col("p_type") == "SMALL", "Dedicated").otherwise("Shared").alias("tenancy"),
        F.when(F.col("p_type") == "MEDIUM", "AllocatedCapacityReservation").otherwise("Used").alias("capacity_status"),
        doc.alias("doc"),
    )


@query(
    "ondemand_price",
    f"""
WITH catalog AS ({CATALOG}),
offers AS (SELECT instance_type, location, arg_min(doc, sku) AS doc FROM catalog GROUP BY 1, 2),
priced AS (SELECT instance_type, location,
  CASE WHEN json_valid(doc) THEN TRY_CAST(json_extract_string(doc, '$.terms.OnDemand.*.priceDimensions.*.pricePerUnit.USD')[1]
       AS DECIMAL(20,10)) END AS price FROM offers),
wanted AS (SELECT p_partkey, p_name, p_brand,
  CASE WHEN CAST(substr(p_brand, 7) AS INT) <= 20 THEN concat('Site ', substr(p_brand, 7)) END AS location FROM part)
SELECT p_partkey, p_name AS instance_type, p_brand AS region, CAST(price AS DOUBLE) AS od_price,
  CASE WHEN w.location IS NULL THEN 'region not in location map'
       WHEN p.instance_type IS NULL THEN 'not found in price catalog'
       WHEN price IS NULL THEN 'unexpected price document' END AS reason
FROM wanted w LEFT JOIN priced p ON p.instance_type = p_name AND p.location = w.location
""",
)
def ondemand_price(t: Tables):
    types = t.part.select("p_partkey", F.col("p_name").alias("instance_type"), F.col("p_brand").alias("region"))
    priced = pricing.ondemand_price(types, catalog(t), locations=SITES)
    return priced.withColumn("od_price", F.col("od_price").cast("double"))


PARTS = """
SELECT p_partkey, p_type, p_size, p_retailprice, p_type AS region,
  [concat('brand:', p_brand), concat('type:', p_type), concat('size:', p_size), concat('name:', p_name)] AS types
FROM part
"""


def typed_parts(t: Tables):
    label = lambda tag, c: F.concat(F.lit(f"{tag}:"), F.col(c).cast("string"))
    return t.part.select(
        "p_partkey",
        "p_type",
        "p_size",
        "p_retailprice",
        F.col("p_type").alias("region"),
        F.array(label("brand", "p_brand"), label("type", "p_type"), label("size", "p_size"), label("name", "p_name")).alias("types"),
    )


def prices_of(parts, *keys: str):
    """On-demand prices of all types but the largest sizes, spot prices of brands and types, both for each of ``keys``."""
    exploded = parts.select(*keys, "p_size", "p_retailprice", F.explode("types").alias("instance_type"))
    cheapest = exploded.groupBy(*keys, "instance_type").agg(F.min("p_retailprice").alias("od_price"))
    ondemand = cheapest.where(~F.col("instance_type").rlike("^size:(4[0-9]|50)$"))
    spot = exploded.where(F.col("instance_type").rlike("^(brand|type):")).groupBy(*keys, "instance_type").agg(
        (F.max("p_retailprice") / 4).alias("spot_price")
    )
    return ondemand, spot


PRICE_CTES = f"""
parts AS ({PARTS}),
exploded AS (SELECT region, p_size, p_retailprice, unnest(types) AS instance_type FROM parts),
spot AS (SELECT instance_type, max(p_retailprice) / 4 AS spot_price FROM exploded
         WHERE regexp_matches(instance_type, '^(brand|type):') GROUP BY 1)
"""


@query(
    "queue_price_range",
    f"""
WITH {PRICE_CTES},
od AS (SELECT instance_type, min(p_retailprice) AS od_price FROM exploded
       WHERE NOT regexp_matches(instance_type, '^size:(4[0-9]|50)$') GROUP BY 1),
queues AS (SELECT p_partkey AS queue, p_type IN ('PROMO', 'LARGE') AS is_spot,
           CASE WHEN p_size = 50 THEN [types[3]] ELSE types END AS types FROM parts),
q AS (SELECT queue, is_spot, unnest(types) AS instance_type FROM queues),
agg AS (SELECT queue, min(od_price) AS od_min, max(od_price) AS od_max,
  min(CASE WHEN is_spot AND od_price IS NOT NULL THEN spot_price END) AS spot_min,
  max(CASE WHEN is_spot AND od_price IS NOT NULL THEN spot_price END) AS spot_max,
  count(od_price) AS types_found, count(*) - count(od_price) AS types_failed
  FROM q LEFT JOIN od USING (instance_type) LEFT JOIN spot USING (instance_type) GROUP BY 1)
SELECT *, CASE WHEN types_found > 0 AND types_failed > 0 THEN concat(types_failed, ' type(s) unavailable') END AS note FROM agg
""",
)
def queue_price_range(t: Tables):
    parts = typed_parts(t)
    ondemand, spot = prices_of(parts)
    queues = parts.select(
        F.col("p_partkey").alias("queue"),
        F.col("p_type").isin("PROMO", "LARGE").alias("is_spot"),
        F.when(F.col("p_size") == 50, F.array(F.col("types")[2])).otherwise(F.col("types")).alias("types"),
    )
    return pricing.queue_price_range(queues, ondemand, spot, keys=["queue"], types="types", is_spot="is_spot")


FLEET = """
SELECT p_partkey AS cluster_name, region, types[1] AS head, types[2:4] AS cpu, CASE WHEN p_size > 25 THEN [types[3]] ELSE [] END AS gpu,
  p_type <> 'SMALL' AS cpu_on, true AS gpu_on, p_size - 1 AS max_cpu, p_size AS max_gpu, p_type IN ('PROMO', 'LARGE') AS spot FROM parts
"""


def fleet_records(t: Tables):
    return typed_parts(t).select(
        F.col("p_partkey").alias("cluster_name"),
        "region",
        F.when(F.col("p_type").isin("PROMO", "LARGE"), "spot").otherwise("ondemand").alias("cluster_type"),
        F.col("types")[0].alias("headnode_instance_type"),
        F.slice("types", 2, 3).alias("cpu_instance_types"),
        F.when(F.col("p_size") > 25, F.array(F.col("types")[2])).otherwise(F.array().cast("array<string>")).alias("gpu_instance_types"),
        F.when(F.col("p_type") == "SMALL", "false").otherwise("true").alias("enable_cpu_queue"),
        F.lit("true").alias("enable_gpu_queue"),
        (F.col("p_size") - 1).alias("max_cpu_queue_size"),
        F.col("p_size").alias("max_gpu_queue_size"),
    )


@query(
    "fleet_hourly_cost",
    f"""
WITH {PRICE_CTES},
local_spot AS (SELECT instance_type, region, max(p_retailprice) / 4 AS spot_price FROM exploded WHERE regexp_matches(instance_type, '^(brand|type):') GROUP BY 1, 2),
od AS (SELECT instance_type, region, min(p_retailprice) AS od_price FROM exploded
       WHERE NOT regexp_matches(instance_type, '^size:(4[0-9]|50)$') GROUP BY 1, 2),
fleet AS ({FLEET}),
roles AS (
  SELECT cluster_name, region, 'head' AS role, [head] AS types, 1 AS n, false AS spot FROM fleet
  UNION ALL SELECT cluster_name, region, 'cpu', cpu, max_cpu, spot FROM fleet WHERE cpu_on AND max_cpu > 0
  UNION ALL SELECT cluster_name, region, 'gpu', gpu, max_gpu, spot FROM fleet WHERE gpu_on AND len(gpu) > 0 AND max_gpu > 0),
r AS (SELECT cluster_name, region, role, n, spot, unnest(types) AS instance_type FROM roles),
agg AS (SELECT cluster_name, role, n, min(od_price) * n AS od_low, max(od_price) * n AS od_high,
  min(CASE WHEN spot AND od_price IS NOT NULL THEN spot_price END) * n AS spot_low,
  max(CASE WHEN spot AND od_price IS NOT NULL THEN spot_price END) * n AS spot_high,
  count(od_price) AS found, count(*) - count(od_price) AS failed
  FROM r LEFT JOIN od USING (instance_type, region) LEFT JOIN local_spot USING (instance_type, region) GROUP BY 1, 2, 3)
SELECT cluster_name, role, CAST(n AS BIGINT) AS count, od_low, CASE WHEN abs(od_high - od_low) < 0.001 THEN od_low ELSE od_high END AS od_high,
  spot_low, CASE WHEN abs(spot_high - spot_low) < 0.001 THEN spot_low ELSE spot_high END AS spot_high,
  CASE WHEN found > 0 AND failed > 0 THEN concat(failed, ' type(s) unavailable') END AS note FROM agg
""",
)
def fleet_hourly_cost(t: Tables):
    parts = typed_parts(t)
    ondemand, spot = prices_of(parts, "region")
    return pricing.fleet_hourly_cost(fleet_records(t), ondemand, spot)


# Parts are types; a number of 25 is the region, of which the last five are not on the price list.
ESTIMATE_SQL = f"""
WITH h AS (SELECT *, CAST(instance_type AS BIGINT) + CASE WHEN availability_zone = 'F' THEN 1 ELSE 0 END AS shifted FROM ({HISTORY}) WHERE product = 'R'),
hist AS (SELECT instance_type, region, spot_price FROM (SELECT *, shifted % 25 AS region, row_number() OVER (PARTITION BY instance_type, shifted % 25
  ORDER BY ts DESC, l_orderkey DESC, l_linenumber DESC, l_suppkey DESC, l_quantity DESC, spot_price DESC) AS rn FROM h) WHERE rn = 1),
offers AS (SELECT p_partkey AS instance_type, p_partkey % 25 AS region, TRY_CAST(CASE WHEN p_size < 49 THEN printf('%.4f', p_retailprice) END AS DECIMAL(20,10)) AS price
  FROM part WHERE p_type NOT IN ('PROMO', 'ECONOMY', 'SMALL', 'MEDIUM') AND p_partkey % 25 < 20),
roles AS (SELECT p_partkey AS cluster_name, p_partkey % 25 AS region, 'head' AS role, 1 AS n, false AS spot, unnest([p_partkey]) AS instance_type FROM part
  UNION ALL SELECT p_partkey, p_partkey % 25, 'cpu', p_size, p_partkey % 2 = 0, unnest([p_partkey, p_partkey + 1, p_partkey + 25]) FROM part),
agg AS (SELECT cluster_name, role, n, min(price) * n AS od_low, max(price) * n AS od_high,
  min(CASE WHEN spot AND price IS NOT NULL THEN CAST(spot_price AS DECIMAL(20,10)) END) * n AS spot_low,
  max(CASE WHEN spot AND price IS NOT NULL THEN CAST(spot_price AS DECIMAL(20,10)) END) * n AS spot_high, count(price) AS found, count(*) - count(price) AS failed
  FROM roles LEFT JOIN offers USING (instance_type, region) LEFT JOIN hist USING (instance_type, region) GROUP BY 1, 2, 3)
SELECT cluster_name, role, CAST(n AS BIGINT) AS count, round(CAST(od_low AS DOUBLE), 4) AS od_low, round(CAST(od_high AS DOUBLE), 4) AS od_high,
  round(CAST(spot_low AS DOUBLE), 4) AS spot_low, round(CAST(spot_high AS DOUBLE), 4) AS spot_high,
  CASE WHEN found > 0 AND failed > 0 THEN concat(failed, ' type(s) unavailable') END AS note FROM agg
"""


@query("build_estimate", ESTIMATE_SQL)
def build_estimate(t: Tables):
    text = lambda c: c.cast("string")
    part = F.col("p_partkey")
    records = t.part.select(
        part.alias("cluster_name"),
        region_of(part).alias("region"),
        F.when(part % 2 == 0, "spot").otherwise("ondemand").alias("cluster_type"),
        text(part).alias("headnode_instance_type"),
        F.array(text(part), text(part + 1), text(part + 25)).alias("cpu_instance_types"),
        F.array().cast("array<string>").alias("gpu_instance_types"),
        F.lit("true").alias("enable_cpu_queue"),
        F.lit("false").alias("enable_gpu_queue"),
        F.col("p_size").alias("max_cpu_queue_size"),
        F.lit(0).alias("max_gpu_queue_size"),
    )
    located = catalog(t, text(part), F.try_element_at(F.lit(list(REGION_LOCATIONS.values())[:20]), (part % 25 + 1).cast("int")))
    shifted = F.col("instance_type") + (F.col("availability_zone") == "F").cast("int")
    spot = history(t).withColumn("region", region_of(shifted)).withColumn("instance_type", text(F.col("instance_type")))
    estimate = reports.build_estimate(records, located, spot, product="R", tiebreak=TIES)
    money = ("od_low", "od_high", "spot_low", "spot_high")
    return estimate.withColumns({c: F.round(F.col(c).cast("double"), 4) for c in money})


def region_of(number):
    """The first twenty regions of the price list, then unknown ones."""
    return F.element_at(F.lit([*list(REGION_LOCATIONS)[:20], *(f"nowhere-{n}" for n in range(5))]), (number % 25 + 1).cast("int"))


@query(
    "price_range_label",
    """
WITH r AS (SELECT p_name, p_size, min(p_retailprice) AS lo, CASE WHEN p_size > 40 THEN min(p_retailprice) ELSE max(p_retailprice) END AS hi
           FROM part GROUP BY 1, 2)
SELECT p_name, p_size,
  CASE WHEN abs(hi - lo) < 0.001 THEN printf('$%.3f/hr', lo) ELSE printf('$%.3f–$%.3f/hr', lo, hi) END AS label,
  CASE WHEN abs(hi - lo) < 0.001 THEN printf('~$%.3f/hr spot', lo) ELSE printf('~$%.3f–$%.3f/hr spot', lo, hi) END AS spot_label
FROM r
""",
)
def price_range_label(t: Tables):
    low, high = F.min("p_retailprice"), F.max("p_retailprice")
    ranges = t.part.groupBy("p_name", "p_size").agg(low.alias("lo"), F.when(F.col("p_size") > 40, low).otherwise(high).alias("hi"))
    return ranges.select(
        "p_name",
        "p_size",
        values.price_range_label("lo", "hi").alias("label"),
        values.price_range_label("lo", "hi", spot=True).alias("spot_label"),
    )


@query(
    "run_cost",
    """
SELECT l_orderkey, round(sum(l_extendedprice * l_quantity * (l_linenumber * 15) / 60), 4) AS cost FROM lineitem GROUP BY 1
""",
)
def run_cost(t: Tables):
    each = values.run_cost("l_extendedprice", "l_quantity", F.col("l_linenumber") * 15)
    return t.lineitem.groupBy("l_orderkey").agg(F.round(F.sum(each), 4).alias("cost"))
