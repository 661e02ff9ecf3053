"""Benchmark runs: latest run, peaks, first matches, summaries, run facts, expected bands."""

from __future__ import annotations

from pyspark.sql import functions as F

from bindings.inventory_queries import BLANKS
from bindings.log_queries import LINES, lines
from bindings.registry import Tables, query
from fleetloom.functions.text import field, fields
from fleetloom.operators import benchmarks, kernels
from fleetloom.plans import reports


@query(
    "latest_run",
    """
SELECT o_custkey AS results_dir, max(strftime(o_orderdate, '%Y%m%d_101500_') || o_orderkey) AS run_id FROM orders
WHERE o_orderstatus <> 'P' GROUP BY 1
""",
)
def latest_run(t: Tables):
    stamp = F.concat(F.date_format("o_orderdate", "yyyyMMdd"), F.lit("_101500_"), F.col("o_orderkey").cast("string"))
    runs = t.orders.select(
        F.col("o_custkey").alias("results_dir"),
        F.when(F.col("o_orderstatus") == "P", F.concat(F.lit("tmp"), stamp)).otherwise(stamp).alias("run_id"),
    )
    return benchmarks.latest_run(runs, key="results_dir")


# Within an order, a line's place: part before line number, as one increasing number.
POSITION = "l_partkey * 10 + l_linenumber"


def bandwidth_lines(t: Tables):
    header = (F.col("l_linestatus") == "O") & (F.col("l_discount") == 0)
    row = F.format_string("  %d   %.2f ", F.col("l_linenumber"), F.col("l_extendedprice"))
    return t.lineitem.select(
        "l_orderkey", F.expr(POSITION).alias("line_no"), F.when(header, "# Size  Bandwidth (MB/s)").otherwise(row).alias("line")
    )


@query(
    "peak_bandwidth",
    f"""
SELECT l_orderkey, CAST(l_linenumber AS VARCHAR) AS size, printf('%.2f', l_extendedprice) AS peak_text, l_extendedprice AS peak FROM (
  SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, {POSITION}) AS rn FROM lineitem
  WHERE NOT (l_linestatus = 'O' AND l_discount = 0)) WHERE rn = 1
""",
)
def peak_bandwidth(t: Tables):
    return benchmarks.peak(bandwidth_lines(t), key="l_orderkey")


@query(
    "first_match",
    f"""
SELECT l_orderkey, printf('%.2f', arg_min(l_extendedprice, {POSITION})) AS value FROM lineitem
WHERE l_linenumber = 3 AND NOT (l_linestatus = 'O' AND l_discount = 0) GROUP BY 1
""",
)
def first_match(t: Tables):
    rows = bandwidth_lines(t)
    return benchmarks.first_match(rows, benchmarks.latency_row("line", "3"), key="l_orderkey", value=field(fields("line"), 2))


def tool_lines(t: Tables):
    """Every order is a run; each of its lines is one line of one tool's output."""
    kind, device = F.col("l_linenumber"), F.col("l_discount") >= 0.05
    price, quantity = F.format_string("%.2f", F.col("l_extendedprice")), F.format_string("%.1f", F.col("l_quantity"))
    file = lambda name: F.when(device, f"osu/{name}_cuda.txt").otherwise(f"osu/{name}.txt")
    relpath = (
        F.when(kind <= 2, "stream.txt").when(kind == 3, file("latency")).when(kind == 4, file("bandwidth"))
        .when(kind == 5, "ior.txt").when(kind == 6, F.format_string("hpcg/HPCG-Benchmark_%05d.txt", F.col("l_suppkey"))).otherwise("cmd.txt")
    )
    line = (
        F.when(kind == 1, F.concat(F.when(device, "Add:     ").otherwise("Copy:    "), price, F.lit("  0.1 0.1 0.1")))
        .when(kind == 2, F.concat(F.when(device, "Scale:   ").otherwise("Triad:   "), price, F.lit("  0.1 0.1 0.1")))
        .when(kind == 3, F.concat(F.when(F.col("l_returnflag") == "N", F.lit("16 ")).otherwise(F.lit("8   ")), quantity))
        .when(kind == 4, F.concat(quantity, F.lit("  "), price))
        .when(kind == 5, F.concat(F.when(F.col("l_returnflag") == "N", F.lit("write ")).otherwise(F.lit("read  ")), price, F.lit(" MiB")))
        .when((kind == 6) & device, F.concat(F.lit("Setup time="), price))  # a file that states no rating
        .when(kind == 6, F.concat(F.lit("Final: VALID with a GFLOP/s rating of="), price, F.lit("=x")))
        .otherwise(
            F.format_string(
                "./bench.sh run --tests stream,osu --nodes %d --ppn %d --hpcg-time %d --ior-size 1g",
                F.col("l_suppkey"), F.col("l_quantity").cast("int"), (F.col("l_quantity") * 60).cast("int"),
            )
        )
    )
    return t.lineitem.select(
        F.col("l_orderkey").alias("cluster"), F.col("l_returnflag").alias("serial"), F.col("l_linestatus").alias("run_id"),
        relpath.alias("relpath"), line.alias("line"), F.expr(f"{POSITION} + cast(l_suppkey as bigint) * 1000000").alias("line_no"),
    )


RUN_LINES = f"""
SELECT l_orderkey AS cluster, l_returnflag AS serial, l_linestatus AS run_id, l_linenumber AS kind, l_extendedprice AS price, l_quantity AS quantity,
  l_suppkey, l_discount >= 0.05 AS device, {POSITION} + l_suppkey * 1000000 AS pos FROM lineitem
"""


def summary_sql(where: str = "true", keys: str = "cluster, serial, run_id") -> str:
    first = lambda kind, value="price": f"arg_min({value}, pos) FILTER (WHERE {kind})"
    return f"""
SELECT {keys}, {first('kind = 1 AND NOT device')} AS stream_copy_mbs, {first('kind = 1 AND device')} AS stream_add_mbs,
  {first('kind = 2 AND NOT device')} AS stream_triad_mbs, {first('kind = 2 AND device')} AS stream_scale_mbs,
  {first("kind = 3 AND serial <> 'N' AND NOT device", 'quantity')} AS latency_us, {first("kind = 3 AND serial <> 'N' AND device", 'quantity')} AS latency_gpu_us,
  max(price) FILTER (WHERE kind = 4 AND NOT device) AS bandwidth_mbs, max(price) FILTER (WHERE kind = 4 AND device) AS bandwidth_gpu_mbs,
  printf('%.1f', arg_max(quantity, (price, -pos)) FILTER (WHERE kind = 4 AND NOT device)) AS bandwidth_size,
  printf('%.1f', arg_max(quantity, (price, -pos)) FILTER (WHERE kind = 4 AND device)) AS bandwidth_gpu_size,
  {first("kind = 5 AND serial = 'N'")} AS ior_write_mibs, {first("kind = 5 AND serial <> 'N'")} AS ior_read_mibs,
  (arg_min([CASE WHEN NOT device THEN printf('%.2f', price) END], (l_suppkey, device, pos)) FILTER (WHERE kind = 6))[1] AS hpcg_rating,
  arg_min((l_suppkey, quantity), pos) FILTER (WHERE kind = 7) AS cmd
FROM ({RUN_LINES}) WHERE {where} GROUP BY {keys}
"""


@query("benchmark_summary", f"SELECT * EXCLUDE (cmd), cmd IS NOT NULL AS has_command FROM ({summary_sql()})")
def benchmark_summary(t: Tables):
    summary = benchmarks.benchmark_summary(tool_lines(t))
    return summary.withColumn("has_command", F.col("command").isNotNull()).drop("command")


@query(
    "run_facts",
    """
SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_returnflag = 'N' THEN 'hpcg' ELSE 'stream,osu' END AS tests,
  l_linenumber AS nodes, CAST(l_quantity AS BIGINT) AS ppn, CAST(l_quantity * 60 AS BIGINT) AS hpcg_seconds,
  CAST(l_linenumber * l_quantity AS BIGINT) AS total_ranks, l_quantity * 60 >= 1800 AS hpcg_valid, l_linenumber * l_quantity >= 2 AS osu_possible
FROM (SELECT * REPLACE (CAST(l_linenumber AS BIGINT) AS l_linenumber) FROM lineitem)
""",
)
def run_facts(t: Tables):
    command = F.format_string(
        "./bench.sh run --tests %s --nodes %d --ppn %d --hpcg-time %d --ior-size 1g --results-dir /x",
        F.when(F.col("l_returnflag") == "N", "hpcg").otherwise("stream,osu"),
        F.col("l_linenumber"), F.col("l_quantity").cast("int"), (F.col("l_quantity") * 60).cast("int"),
    )
    rows = t.lineitem.select("l_orderkey", F.col("l_linenumber").cast("bigint").alias("l_linenumber"), "l_partkey", command.alias("command"))
    return benchmarks.run_facts(rows).drop("command")


@query(
    "benchmark_report",
    f"""
WITH latest AS (SELECT cluster, serial, max(run_id) AS run_id FROM (SELECT DISTINCT l_orderkey AS cluster, l_returnflag AS serial,
  CASE WHEN l_linestatus = 'F' THEN '1F' ELSE '2O' END AS run_id FROM lineitem) GROUP BY 1, 2),
s AS ({summary_sql().replace("SELECT cluster", "SELECT cluster", 1)})
SELECT s.* EXCLUDE (run_id, cmd), latest.run_id, CAST(cmd[1] AS BIGINT) AS nodes, CAST(cmd[2] AS BIGINT) AS ppn, CAST(cmd[2] * 60 AS BIGINT) AS hpcg_seconds,
  CAST(cmd[1] * cmd[2] AS BIGINT) AS total_ranks, cmd[2] * 60 >= 1800 AS hpcg_valid, cmd[1] * cmd[2] >= 2 AS osu_possible, CASE WHEN cmd IS NOT NULL THEN 'stream,osu' END AS tests
FROM s JOIN latest USING (cluster, serial) WHERE substr(latest.run_id, 2) = s.run_id
""",
)
def benchmark_report(t: Tables):
    numbered = F.when(F.col("run_id") == "F", "1F").otherwise("2O")
    report = reports.benchmark_report(tool_lines(t).withColumn("run_id", numbered))
    return report.drop("command")


@query(
    "awk_fields",
    f"""
WITH f AS (SELECT doc_id, line_no, trim(line, {BLANKS}) AS s FROM ({LINES})),
p AS (SELECT doc_id, line_no, CASE WHEN s = '' THEN [] ELSE string_split_regex(s, '[' || {BLANKS} || ']+') END AS parts FROM f)
SELECT doc_id, CAST(line_no AS INT) AS line_no, CAST(len(parts) AS INT) AS nf, md5(parts[1]) AS first, md5(parts[2]) AS second FROM p
""",
)
def awk_fields(t: Tables):
    parts = fields("line")
    return lines(t).select(
        "doc_id", "line_no", F.size(parts).alias("nf"), F.md5(field(parts, 1)).alias("first"), F.md5(field(parts, 2)).alias("second")
    )


@query(
    "expected_band",
    """
WITH bands(metric, band, low, high) AS (VALUES ('latency_us', 'efa', 0.0, 2.0), ('latency_us', 'ethernet', 20.0, 50.0),
  ('bandwidth_gbs', 'ethernet', 10.0, 25.0), ('bandwidth_gbs', 'efa', 100.0, NULL)),
m AS (SELECT event_id, CASE WHEN event_type IN ('click', 'view') THEN 'latency_us' ELSE 'bandwidth_gbs' END AS metric, value FROM events)
SELECT event_id, m.metric, value, band FROM m JOIN bands b ON m.metric = b.metric AND value >= low AND (high IS NULL OR value < high)
""",
)
def expected_band(t: Tables):
    metric = F.when(F.col("event_type").isin("click", "view"), "latency_us").otherwise("bandwidth_gbs")
    measured = t.events.select("event_id", metric.alias("metric"), "value")
    matched = benchmarks.expected_band(measured)
    return matched.select("event_id", "metric", "value", "band")


@query(
    "range_match",
    """
WITH r AS (SELECT c_custkey, CASE c_nationkey % 2 WHEN 0 THEN 'error' ELSE 'view' END AS kind, abs(c_acctbal) / 20 AS low,
  CASE WHEN c_nationkey <> 7 THEN abs(c_acctbal) / 20 + c_custkey % 5 END AS high FROM customer WHERE c_mktsegment = 'BUILDING'),
m AS (SELECT event_id, value, low, high FROM events JOIN r ON event_type = kind AND value >= low AND (high IS NULL OR value < high))
SELECT event_id, count(*) AS ranges, count(high) AS closed, round(sum(low), 2) AS lows FROM m GROUP BY 1
""",
)
def range_match(t: Tables):
    """Values of events against ranges made of customers, some of them open; what each event meets is counted."""
    low = F.abs("c_acctbal") / 20
    ranges = t.customer.where(F.col("c_mktsegment") == "BUILDING").select(
        F.when(F.col("c_nationkey") % 2 == 0, "error").otherwise("view").alias("event_type"), low.alias("low"),
        F.when(F.col("c_nationkey") != 7, low + F.col("c_custkey") % 5).alias("high"),
    )
    met = kernels.range_match(t.events.select("event_id", "event_type", "value"), ranges, key="event_type", value="value")
    return met.groupBy("event_id").agg(F.count("*").alias("ranges"), F.count("high").alias("closed"), F.round(F.sum("low"), 2).alias("lows"))
