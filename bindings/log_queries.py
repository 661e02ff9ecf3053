"""Log groups, streams, tails, marker lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from bindings.inventory_queries import BLANKS
from bindings.registry import Tables, query
from fleetloom.operators import logs
from fleetloom.plans import reports

LINES = """
SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM documents
"""


def lines(t: Tables, *keep: str):
    return t.documents.select("doc_id", *keep, F.posexplode(F.split("text", "\n")).alias("pos", "line")).select(
        "doc_id", *keep, "line", (F.col("pos") + 1).alias("line_no")
    )


@query(
    "log_tail",
    """
SELECT user_id, event_id, CAST(rn AS INT) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn <= 5
""",
)
def log_tail(t: Tables):
    kept = logs.log_tail(t.events.select("user_id", "ts", "event_id"), key="user_id", ts="ts", n=5, tiebreak="event_id")
    return kept.drop("ts")


@query(
    "tail_nonblank",
    f"""
SELECT doc_id, CAST(line_no AS INT) AS line_no, CAST(rn AS INT) AS rank, md5(line) AS digest FROM (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line_no DESC) AS rn FROM ({LINES}) WHERE trim(line, {BLANKS}) <> '') WHERE rn <= 3
""",
)
def tail_nonblank(t: Tables):
    kept = logs.tail_nonblank(lines(t), key="doc_id", n=3)
    return kept.select("doc_id", "line_no", "rank", F.md5("line").alias("digest"))


@query(
    "latest_log_group",
    """
WITH g AS (SELECT concat('c', o_custkey, CASE WHEN o_orderstatus = 'P' THEN '-test' ELSE '' END) AS cluster,
  concat('/fleet/logs/c', o_custkey, CASE WHEN o_orderstatus = 'P' THEN '-test' ELSE '' END, '-', strftime(o_orderdate, '%Y%m%d0930')) AS log_group
  FROM orders WHERE o_orderpriority NOT IN ('1-URGENT', '2-HIGH'))
SELECT cluster, max(log_group) AS log_group FROM g GROUP BY 1
""",
)
def latest_log_group(t: Tables):
    stamp = F.concat(F.date_format("o_orderdate", "yyyyMMdd"), F.lit("0930"))
    suffix = F.when(F.col("o_orderpriority") == "1-URGENT", F.concat(stamp, F.lit("1"))).when(
        F.col("o_orderpriority") == "2-HIGH", F.concat(F.lit("x"), F.substring(stamp, 2, 11))
    ).otherwise(stamp)
    kind = F.when(F.col("o_orderstatus") == "P", "-test").otherwise("")
    groups = t.orders.select(
        F.concat(F.lit("/fleet/logs/c"), F.col("o_custkey").cast("string"), kind, F.lit("-"), suffix).alias("name")
    )
    return logs.latest_log_group(groups, prefix="/fleet/logs/")


TOKENS = ("/en/", "/fr/", "page=2", "#top", "https", "absent-token")


@query(
    "match_streams",
    f"""
WITH s AS (SELECT regexp_extract(url, '\\.example\\.([a-z]+)', 1) AS tld, url, page_id, unnest({list(TOKENS)!r}) AS token FROM pages)
SELECT tld, token, url AS stream, page_id AS last_event FROM (
  SELECT *, row_number() OVER (PARTITION BY tld, token ORDER BY page_id DESC, url DESC) AS rn FROM s WHERE contains(url, token)) WHERE rn = 1
""",
)
def match_streams(t: Tables):
    streams = t.pages.select(
        F.regexp_extract("url", r"\.example\.([a-z]+)", 1).alias("tld"), F.col("url").alias("stream"), F.col("page_id").alias("last_event")
    )
    return logs.match_streams(streams, TOKENS, key="tld")


@query(
    "last_matching_line",
    f"""
SELECT doc_id, md5(rtrim(arg_max(line, line_no) FILTER (WHERE contains(line, ' the ') OR starts_with(line, './') OR starts_with(line, '/')))) AS digest
FROM ({LINES}) GROUP BY 1
""",
)
def last_matching_line(t: Tables):
    last = logs.last_matching_line(lines(t), logs.rebuild_line("line", " the "), key="doc_id")
    return last.select("doc_id", F.md5("last_line").alias("digest"))


@query("first_line", f"SELECT doc_id, md5(line) AS digest FROM ({LINES}) WHERE line_no = 1")
def first_line(t: Tables):
    return logs.first_line(lines(t), key="doc_id").select("doc_id", F.md5("line").alias("digest"))


@query(
    "recent_log_lines",
    """
WITH groups AS (SELECT o_custkey, max(o_orderdate) AS newest FROM orders GROUP BY 1),
streams AS (SELECT o_custkey, o_orderdate, o_orderpriority, max(o_orderkey) AS last_event FROM orders GROUP BY 1, 2, 3),
wanted AS (SELECT o_custkey, o_orderdate, o_orderpriority, token, row_number() OVER (PARTITION BY o_custkey, token ORDER BY last_event DESC, o_orderpriority DESC) AS rn
  FROM (SELECT *, unnest(['1-URGENT', 'LOW', 'HIGH']) AS token FROM streams JOIN groups USING (o_custkey) WHERE o_orderdate = newest)
  WHERE contains(o_orderpriority, token)),
ev AS (SELECT w.o_custkey, token, w.o_orderpriority, o_orderkey, o_totalprice, w.o_orderdate,
  row_number() OVER (PARTITION BY w.o_custkey, token ORDER BY o_orderkey DESC) AS rank
  FROM orders o JOIN wanted w ON rn = 1 AND o.o_custkey = w.o_custkey AND o.o_orderdate = w.o_orderdate AND o.o_orderpriority = w.o_orderpriority)
SELECT concat('c', o_custkey) AS cluster, token, o_orderpriority AS stream, CAST(rank AS INT) AS rank,
  concat(strftime(o_orderdate, '%Y-%m-%d 00:00:00'), '  order ', o_orderkey) AS line FROM ev WHERE rank <= 2
""",
)
def recent_log_lines(t: Tables):
    group = F.concat(
        F.lit("/fleet/logs/c"), F.col("o_custkey").cast("string"), F.lit("-"), F.date_format("o_orderdate", "yyyyMMdd"), F.lit("0000")
    )
    events = t.orders.select(
        group.alias("group"),
        F.col("o_orderpriority").alias("stream"),
        (F.unix_micros(F.col("o_orderdate").cast("timestamp")) / 1000).cast("bigint").alias("ts_ms"),
        F.col("o_orderkey").alias("seq"),
        F.concat(F.lit("order "), F.col("o_orderkey").cast("string"), F.lit("  ")).alias("message"),
    )
    groups = events.select(F.col("group").alias("name")).distinct()
    streams = events.groupBy("group", "stream").agg(F.max("seq").alias("last_event"))
    return reports.recent_log_lines(groups, streams, events, prefix="/fleet/logs/", tokens=("1-URGENT", "LOW", "HIGH"), n=2)
