"""Grants, scopes, sizes, drift, coverage, prefixes."""

from __future__ import annotations

from pyspark.sql import functions as F

from bindings.registry import Tables, query
from fleetloom.operators import policy

BANNED = ("logs:DeleteLogGroup", "part:PROMO7", "part:x")


@query(
    "action_grants",
    f"""
WITH p AS (SELECT p_partkey AS doc, p_brand AS sid, unnest([
    CASE WHEN p_size > 45 THEN 'logs:*' WHEN p_size > 40 THEN 'logs:Delete*' WHEN p_size > 35 THEN 'logs:Create*' ELSE 'logs.DeleteLogGroup' END,
    CASE WHEN p_size > 25 THEN concat('part:', p_type, '?') ELSE concat('part:', p_type, p_size) END]) AS pattern FROM part)
SELECT doc, sid, pattern, action FROM (SELECT *, unnest({list(BANNED)!r}) AS action FROM p)
WHERE regexp_full_match(action, replace(replace(replace(pattern, '.', '\\.'), '*', '.*'), '?', '.'))
""",
)
def action_grants(t: Tables):
    size, kind = F.col("p_size"), F.col("p_type")
    logs = F.when(size > 45, "logs:*").when(size > 40, "logs:Delete*").when(size > 35, "logs:Create*").otherwise("logs.DeleteLogGroup")
    part = F.when(size > 25, F.concat(F.lit("part:"), kind, F.lit("?"))).otherwise(F.concat(F.lit("part:"), kind, size.cast("string")))
    docs = t.part.select(F.col("p_partkey").alias("doc"), F.col("p_brand").alias("sid"), F.array(logs, part).alias("actions"))
    return policy.action_grants(docs, BANNED)


@query(
    "arn_scope",
    """
WITH s AS (SELECT n_nationkey, CASE WHEN n_regionkey < 3 THEN concat('^arn:Customer#0*[0-9]*', n_nationkey, '$') ELSE '^arn:Customer#00000.[0-9]{3}$' END AS regex FROM nation)
SELECT c_custkey, concat('arn:', c_name) AS arn, c_nationkey AS doc, regexp_matches(concat('arn:', c_name), regex) AS allowed FROM customer JOIN s ON n_nationkey = c_nationkey
""",
)
def arn_scope(t: Tables):
    number = F.col("n_nationkey").cast("string")
    patterns = F.when(F.col("n_regionkey") < 3, F.array(F.lit("nothing-*"), F.concat(F.lit("arn:Customer#*"), number))).otherwise(
        F.array(F.lit("arn:Customer#00000????"))
    )
    docs = t.nation.select(F.col("n_nationkey").alias("doc"), F.lit("Attach").alias("sid"), patterns.alias("condition_patterns"))
    other = t.nation.select(F.col("n_nationkey").alias("doc"), F.lit("Other").alias("sid"), F.array(F.lit("*")).alias("condition_patterns"))
    candidates = t.customer.select("c_custkey", F.concat(F.lit("arn:"), F.col("c_name")).alias("arn"), F.col("c_nationkey").alias("doc"))
    return policy.arn_scope(docs.unionByName(other), candidates, sid="Attach")


# Each placeholder with its value in SQL and as a column; some customers' date stamp is not known yet.
FILLED = {
    "<AWS_ACCOUNT_ID>": "CAST(c_custkey AS VARCHAR)",
    "<AWS_REGION>": "'us-east-1'",
    "<VPC_ID>": "concat('vpc-', c_nationkey)",
    "<PROD_LEVEL>": "'dev'",
    "<CLUSTER_SERIAL_NUMBER>": "concat(c_name, '-1')",
    "<CLUSTER_NAME>": "c_name",
    "<CLUSTER_OWNER>": "c_mktsegment",
    "<CLUSTER_SERIAL_DATESTAMP>": "CASE WHEN c_mktsegment = 'BUILDING' THEN '<CLUSTER_SERIAL_DATESTAMP>' ELSE '20260701' END",
}
RESOURCE = "arn:" + "/".join([*FILLED, "<CLUSTER_NAME>"])
RENDERED = "text"
for _name, _value in FILLED.items():
    RENDERED = f"replace({RENDERED}, '{_name}', {_value})"


@query(
    "policy_size",
    f"""
WITH tpl AS (SELECT n_name AS template, concat('{{"Statement": [ {{"Sid" : "', n_name, '", "Resource": "{RESOURCE}"',
  ', "pad": "', repeat('y', n_nationkey * 400), '"}} ]', CASE WHEN n_nationkey = 20 THEN '' ELSE '}}' END) AS text FROM nation),
a AS (SELECT *, concat('NATION_', c_nationkey) AS template FROM customer),
r AS (SELECT c_custkey, template, {RENDERED} AS t FROM a JOIN tpl USING (template)),
s AS (SELECT c_custkey, template, contains(t, '<CLUSTER_SERIAL_DATESTAMP>') AS unfilled, CASE WHEN json_valid(t) THEN octet_length(encode(CAST(json(t) AS VARCHAR))) END AS bytes FROM r)
SELECT c_custkey, template, CAST(bytes AS BIGINT) AS bytes, coalesce(bytes <= 6144, false) AS fits, unfilled FROM s
""",
)
def policy_size(t: Tables):
    text = F.concat(
        F.lit('{"Statement": [ {"Sid" : "'), F.col("n_name"), F.lit(f'", "Resource": "{RESOURCE}"'),
        F.lit(', "pad": "'), F.repeat(F.lit("y"), F.col("n_nationkey") * 400), F.lit('"} ]'),
        F.when(F.col("n_nationkey") == 20, "").otherwise("}"),
    )
    templates = t.nation.select(F.col("n_name").alias("template"), text.alias("text"))
    attachments = t.customer.withColumn("template", F.concat(F.lit("NATION_"), F.col("c_nationkey").cast("string")))
    values = {name: F.expr(value.replace("VARCHAR", "STRING")) for name, value in FILLED.items()}
    sized = policy.policy_size(attachments, templates, values)
    return sized.select("c_custkey", "template", "bytes", "fits", "unfilled")


SIDES = """
e AS (SELECT DISTINCT o_custkey AS cluster, o_orderpriority AS policy FROM orders WHERE o_orderstatus = 'F'),
a AS (SELECT DISTINCT o_custkey AS cluster, o_orderpriority AS policy FROM orders WHERE o_orderstatus = 'O'),
k AS (SELECT DISTINCT o_custkey AS cluster, o_orderpriority AS policy FROM orders WHERE o_totalprice > 150000 OR o_orderstatus = 'P')
"""


@query(
    "drift",
    f"""
WITH {SIDES}
SELECT cluster, policy, 'stale' AS drift FROM ((SELECT * FROM a INTERSECT SELECT * FROM k) EXCEPT SELECT * FROM e)
UNION ALL SELECT cluster, policy, 'missing' FROM (SELECT * FROM e EXCEPT SELECT * FROM a)
""",
)
def drift(t: Tables):
    rows = t.orders.select(F.col("o_custkey").alias("cluster"), F.col("o_orderpriority").alias("policy"), "o_orderstatus", "o_totalprice")
    return policy.drift(
        rows.where(F.col("o_orderstatus") == "F"), rows.where(F.col("o_orderstatus") == "O"), rows.where((F.col("o_totalprice") > 150000) | (F.col("o_orderstatus") == "P")),
        keys=["cluster", "policy"],
    )


@query(
    "coverage_diff",
    """
WITH a AS (SELECT DISTINCT o_custkey FROM orders WHERE o_orderdate >= TIMESTAMP '1998-07-01'),
b AS (SELECT DISTINCT o_custkey FROM orders WHERE o_orderdate < TIMESTAMP '1998-07-01')
SELECT o_custkey, 'left_only' AS side FROM (SELECT * FROM a EXCEPT SELECT * FROM b)
UNION ALL SELECT o_custkey, 'right_only' FROM (SELECT * FROM b EXCEPT SELECT * FROM a)
""",
)
def coverage_diff(t: Tables):
    recent = t.orders.where(F.col("o_orderdate") >= F.lit("1998-07-01").cast("timestamp_ntz"))
    early = t.orders.where(F.col("o_orderdate") < F.lit("1998-07-01").cast("timestamp_ntz"))
    return policy.coverage_diff(recent, early, keys=["o_custkey"])


@query(
    "prefix_status",
    """
WITH l AS (SELECT regexp_extract(url, '^https?://([^/?#]*)', 1) AS bucket, regexp_extract(url, '^https?://[^/?#]*/(.*)$', 1) AS key FROM pages),
p AS (SELECT DISTINCT bucket, unnest(['en/', 'fr/', 'de/', 'en/6', 'export/']) AS prefix FROM l)
SELECT bucket, prefix, prefix <> 'export/' AS required, CASE WHEN bucket LIKE 'www.%' THEN 'access_denied' WHEN bucket LIKE 'm.%' THEN 'bucket_not_found' WHEN prefix = 'export/' THEN 'exempt'
  WHEN EXISTS (SELECT 1 FROM l WHERE l.bucket = p.bucket AND starts_with(l.key, p.prefix)) THEN 'nonempty' ELSE 'empty' END AS status FROM p
""",
)
def prefix_status(t: Tables):
    listing = t.pages.select(
        F.regexp_extract("url", "^https?://([^/?#]*)", 1).alias("bucket"), F.regexp_extract("url", "^https?://[^/?#]*/(.*)$", 1).alias("key")
    )
    wanted = F.array(*[F.lit(p) for p in ("en/", "fr/", "de/", "en/6", "export/")])
    prefixes = listing.select("bucket").distinct().select("bucket", F.explode(wanted).alias("prefix"))
    prefixes = prefixes.withColumn("required", F.col("prefix") != "export/")
    code = F.when(F.startswith("bucket", F.lit("www.")), "403").when(F.startswith("bucket", F.lit("m.")), "404")
    answers = listing.select("bucket").distinct().select("bucket", code.alias("code"))
    return policy.prefix_status(prefixes, listing, answers)
