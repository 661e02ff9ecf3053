"""Sources and sinks: tool text, snapshots, pages, manifests, reports, appended results."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from bindings.log_queries import LINES, lines
from bindings.registry import Tables, query
from fleetloom.operators import cost
from fleetloom.session import scratch_path, tasks_for
from fleetloom.sources import readers, sinks


@query(
    "scan_tool_text",
    f"""
SELECT source AS cluster, lang AS serial, doc_id, count(*) AS lines, true AS in_order,
  CAST(sum(line_no * (CAST('0x' || substr(md5(line), 1, 8) AS BIGINT) % 1000003)) AS BIGINT) AS digest, CAST(sum(length(line)) AS BIGINT) AS characters
FROM (SELECT l.*, source, lang FROM ({LINES}) l JOIN documents USING (doc_id)) GROUP BY 1, 2, 3
""",
)
def scan_tool_text(t: Tables):
    """Documents written once as text files below ``results/<cluster>/<serial>/<run>/``, then scanned."""
    root = scratch_path(t.spark, "tooltext")
    tagged = lines(t, "source", "lang").select(
        F.format_string("%d\t%d\t%s", F.col("doc_id"), F.col("line_no"), F.col("line")).alias("value"),
        F.col("source").alias("cluster"), F.col("lang").alias("serial"), F.lit("20260701_101500_7").alias("run_id"), "doc_id", "line_no",
    )
    keys = ("cluster", "serial", "run_id")
    placed = tagged.hint("rebalance", *keys).sortWithinPartitions(*keys, "doc_id", "line_no").select("value", *keys)
    placed.write.partitionBy(*keys).text(f"{root}/results")
    numbered = readers.number_lines(readers.scan_tool_text(t.spark, f"{root}/results", root="results"))
    parts = F.split("line", "\t", 3)
    rows = numbered.select(
        F.substring_index("cluster", "=", -1).alias("cluster"),
        F.substring_index("serial", "=", -1).alias("serial"),
        parts[0].cast("bigint").alias("doc_id"), parts[1].cast("int").alias("n"), parts[2].alias("text"), "line_no",
    )
    shift = F.col("line_no") - F.col("n")
    of_line = F.conv(F.substring(F.md5("text"), 1, 8), 16, 10).cast("bigint") % 1_000_003
    return rows.groupBy("cluster", "serial", "doc_id").agg(
        F.count("*").alias("lines"),
        (F.min(shift) == F.max(shift)).alias("in_order"),
        F.sum(F.col("n") * of_line).alias("digest"),
        F.sum(F.length("text")).alias("characters"),
    )


@query(
    "parse_snapshot",
    """
WITH s AS (SELECT event_id, CASE WHEN event_type = 'error' THEN substr(props, 1, length(props) - 1) WHEN event_type = 'view' THEN '{"other": {"name": "x"}}' ELSE props END AS doc FROM events)
SELECT event_id, CASE WHEN json_valid(doc) THEN CAST(json_extract(doc, '$.k') AS BIGINT) END AS k,
  CASE WHEN json_valid(doc) THEN json_extract_string(doc, '$.other.name') END AS name FROM s
""",
)
def parse_snapshot(t: Tables):
    doc = (
        F.when(F.col("event_type") == "error", F.left("props", F.length("props") - 1))
        .when(F.col("event_type") == "view", '{"other": {"name": "x"}}')
        .otherwise(F.col("props"))
    )
    parsed = readers.parse_snapshot(t.events.select("event_id", doc.alias("json")), "json", "struct<k:bigint,other:struct<name:string>>")
    return parsed.select("event_id", F.col("doc.k").alias("k"), F.col("doc.other.name").alias("name"))


@query(
    "paged_union",
    """
SELECT user_id, count(*) AS n, round(coalesce(sum(value) FILTER (WHERE event_type <> 'error'), 0), 2) AS total,
  count(props) FILTER (WHERE event_type = 'view') AS with_props FROM events GROUP BY 1
""",
)
def paged_union(t: Tables):
    of = lambda kind: t.events.where(F.col("event_type") == kind)
    pages = [of("view").select("user_id", "value", "props"), of("error").select("user_id")]
    pages += [of(kind).select("value", "user_id") for kind in ("click", "purchase", "signup")]
    joined = readers.paged_union(*pages)
    return joined.groupBy("user_id").agg(
        F.count("*").alias("n"), F.round(F.coalesce(F.sum("value"), F.lit(0.0)), 2).alias("total"), F.count("props").alias("with_props")
    )


FILES_A_TASK = 200  # files that one task writes


def record_files(t: Tables) -> str:
    """One file for each supplier, some of them broken; every thirteenth has none."""
    key, number = F.col("s_suppkey"), F.col("s_suppkey").cast("string")
    fields = {
        "cluster_name": F.when(key % 5 != 0, F.col("s_name")), "cluster_owner": F.concat(F.lit("nation-"), F.col("s_nationkey").cast("string")), "region": F.lit("us-east-1"),
        "max_cpu_queue_size": F.when(key % 4 == 0, "many").otherwise(number),
        "cpu_instance_types": F.when(key % 2 == 0, F.array(F.lit("a.large"), F.concat(F.lit("b."), number))),
    }
    whole = F.to_json(F.struct(*[v.alias(k) for k, v in fields.items()]))
    text = (
        F.when(key % 7 == 3, F.left(whole, F.length(whole) - 3)).when(key % 11 == 5, F.concat(F.lit("["), whole, F.lit("]"))).when(key % 17 == 4, F.lit(" "))
        .when(key % 19 == 6, F.lit('"text"')).otherwise(whole)
    )
    path = scratch_path(t.spark, "records")
    rows = t.supplier.where(key % 13 != 2).select(text.alias("value"), F.concat(F.lit("s"), number).alias("cluster"))
    rows.repartition(tasks_for(rows, FILES_A_TASK), "cluster").write.partitionBy("cluster").text(path)
    return path


RECORDS = """
SELECT s_suppkey AS k, CASE WHEN s_suppkey % 13 = 2 THEN 'missing' WHEN s_suppkey % 7 = 3 OR s_suppkey % 11 = 5 OR s_suppkey % 17 = 4 OR s_suppkey % 19 = 6 THEN 'unreadable' END AS problem, * FROM supplier
"""


@query(
    "scan_inventory",
    f"""
SELECT concat('s', k) AS cluster, problem, CASE WHEN problem IS NULL AND k % 5 <> 0 THEN s_name ELSE concat('s', k) END AS cluster_name,
  CASE WHEN problem IS NULL THEN concat('nation-', s_nationkey) ELSE '' END AS cluster_owner, CASE WHEN problem IS NULL THEN 'us-east-1' ELSE '' END AS region,
  'ubuntu' AS ec2_user, CAST(CASE WHEN problem IS NULL AND k % 4 <> 0 THEN k ELSE 0 END AS BIGINT) AS max_cpu_queue_size,
  CASE WHEN problem IS NULL AND k % 2 = 0 THEN concat('a.large,b.', k) ELSE '' END AS cpu_types FROM ({RECORDS})
""",
)
def scan_inventory(t: Tables):
    """Records and broken or absent files of all suppliers, from one read."""
    names = t.supplier.select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("cluster_name"))
    scan = readers.scan_inventory(t.spark, record_files(t), names, stem=r"cluster=([^/]+)/[^/]+$")
    kept = ("cluster", "problem", "cluster_name", "cluster_owner", "region", "ec2_user", "max_cpu_queue_size")
    return scan.select(*kept, F.array_join("cpu_instance_types", ",").alias("cpu_types"))


def event_pages(t: Tables):
    """Every event is a page of its user's chain and names the next one by time; chains are damaged by user."""
    by_time = Window.partitionBy("user_id").orderBy("ts", "event_id")
    n = F.row_number().over(by_time)
    pages = t.events.select("user_id", "event_id", n.alias("n"), F.lead("event_id").over(by_time).alias("after"), F.first("event_id").over(by_time).alias("first"))
    kind = F.col("user_id") % 6
    last = F.col("after").isNull()
    follows = F.when((kind == 1) & last, F.col("event_id")).when((kind == 2) & last, F.col("first") * -1).otherwise(F.col("after"))
    pages = pages.where(~((kind == 3) & (F.col("n") % 20 == 7)))
    named = pages.select(
        "user_id", "event_id", F.when((F.col("n") > 1) | (kind == 4), F.col("event_id").cast("string")).alias("token"),
        F.when(follows < 0, "").otherwise(follows.cast("string")).alias("next_token"),
    )
    again = named.where((F.col("user_id") % 6 == 5) & (F.col("event_id") % 4 == 1))
    return named.unionByName(again)


PAGES = """
o AS (SELECT user_id, event_id, row_number() OVER w AS n, lead(event_id) OVER w AS after FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
p AS (SELECT user_id, event_id, CASE WHEN n > 1 OR user_id % 6 = 4 THEN CAST(event_id AS VARCHAR) ELSE '' END AS token,
  coalesce(CASE WHEN after IS NULL AND user_id % 6 = 1 THEN CAST(event_id AS VARCHAR) ELSE CAST(after AS VARCHAR) END, '') AS next
  FROM o WHERE NOT (user_id % 6 = 3 AND n % 20 = 7)),
walk AS (SELECT user_id, token, next, 1 AS page_no FROM p WHERE token = ''
  UNION ALL SELECT p.user_id, p.token, p.next, page_no + 1 FROM walk JOIN p ON p.user_id = walk.user_id AND p.token = walk.next AND walk.next <> '' AND walk.next <> walk.token)
"""


@query(
    "order_pages",
    f"""
WITH RECURSIVE {PAGES}
SELECT p.user_id, p.event_id, CAST(page_no AS BIGINT) AS page_no, CASE WHEN page_no IS NULL THEN 'unreached' END AS defect FROM p LEFT JOIN walk USING (user_id, token)
UNION ALL SELECT user_id, event_id, NULL, 'repeated' FROM p WHERE user_id % 6 = 5 AND event_id % 4 = 1
""",
)
def order_pages(t: Tables):
    return readers.order_pages(event_pages(t), chain="user_id").select("user_id", "event_id", "page_no", "defect")


@query(
    "page_walks",
    f"""
WITH RECURSIVE {PAGES},
e AS (SELECT user_id, count(*) AS n, arg_max(next, page_no) AS next, arg_max(token, page_no) AS token FROM walk GROUP BY 1),
a AS (SELECT user_id, count(*) AS n, count(*) FILTER (WHERE user_id % 6 = 5 AND event_id % 4 = 1) AS again FROM p GROUP BY 1)
SELECT user_id, CAST(coalesce(e.n, 0) AS BIGINT) AS pages, CASE WHEN e.n IS NULL THEN 'no_start' WHEN next = '' THEN 'complete' WHEN next = token THEN 'cyclic' ELSE 'missing' END AS ending,
  CASE WHEN next <> '' THEN next END AS stopped, CAST(again AS BIGINT) AS repeated, CAST(a.n - coalesce(e.n, 0) AS BIGINT) AS unreached FROM a LEFT JOIN e USING (user_id)
""",
)
def page_walks(t: Tables):
    return readers.page_walks(readers.order_pages(event_pages(t), chain="user_id"), chain="user_id")


@query(
    "verify_manifest",
    """
SELECT doc_id AS key, CASE WHEN lang = 'de' THEN 'no_expected' WHEN doc_id % 7 = 3 THEN 'missing' WHEN source = (SELECT min(source) FROM documents) THEN 'empty'
  WHEN doc_id % 5 = 2 THEN 'mismatch' ELSE 'ok' END AS status FROM documents
""",
)
def verify_manifest(t: Tables):
    """All documents are objects; some lie under a key that no entry has, some entries expect another text."""
    first = t.documents.agg(F.min("source").alias("s"))
    marked = t.documents.withColumn("blank", F.col("source") == first.scalar())
    objects = marked.select(
        F.when(F.col("doc_id") % 7 == 3, -F.col("doc_id")).otherwise(F.col("doc_id")).alias("key"), F.when(F.col("blank"), "").otherwise(F.col("text")).cast("binary").alias("content")
    )
    digest = F.when(F.col("doc_id") % 5 == 2, F.sha2(F.concat("text", F.lit("x")), 256)).otherwise(F.sha2("text", 256))
    manifest = t.documents.select(F.col("doc_id").alias("key"), F.when(F.col("lang") != "de", digest).alias("expected"))
    return readers.verify_manifest(manifest, objects).drop("expected")


@query(
    "write_report",
    """
SELECT l_suppkey AS cluster, round(sum(l_extendedprice), 2) AS total FROM lineitem
WHERE l_shipdate >= TIMESTAMP '2001-07-02' AND l_shipdate < TIMESTAMP '2001-08-01' GROUP BY 1
""",
)
def write_report(t: Tables):
    totals = cost.cost_by_tag(t.lineitem, key="l_suppkey", amount="l_extendedprice", ts="l_shipdate", days=30, as_of="2001-08-01")
    path = scratch_path(t.spark, "report")
    sinks.write_report(totals.withColumn("total", F.round("total", 2)), path, "json", order="cluster")
    return readers.read_pages(t.spark, path, schema="cluster bigint, total double")


@query("ordered_report", "SELECT c_name, c_acctbal FROM customer ORDER BY c_name")
def ordered_report(t: Tables):
    return sinks.ordered_report(t.customer.select("c_name", "c_acctbal"), "c_name")


@query(
    "append_results",
    "SELECT o_orderstatus AS cluster, o_orderpriority AS serial, count(*) AS runs, CAST(sum(o_orderkey) AS BIGINT) AS keys FROM orders GROUP BY 1, 2",
)
def append_results(t: Tables):
    path = scratch_path(t.spark, "results")
    rows = t.orders.select(F.col("o_orderstatus").alias("cluster"), F.col("o_orderpriority").alias("serial"), F.col("o_orderkey").alias("run_id"), "o_orderdate")
    cut = F.lit("1998-01-01").cast("timestamp_ntz")
    sinks.append_results(rows.where(F.col("o_orderdate") < cut), path)
    sinks.append_results(rows, path)  # the earlier half is there and stays as it is
    stored = t.spark.read.parquet(path)
    return stored.groupBy("cluster", "serial").agg(F.count("*").alias("runs"), F.sum("run_id").alias("keys"))
