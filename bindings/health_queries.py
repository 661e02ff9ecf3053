"""Node states, job failures, check roll-ups, clean-up outcomes."""

from __future__ import annotations

from pyspark.sql import functions as F

from bindings.registry import Tables, query
from fleetloom.functions.text import usable_state
from fleetloom.operators import health
from fleetloom.plans import reports


@query(
    "job_failures",
    """
SELECT * FROM (SELECT CASE event_type WHEN 'click' THEN concat(event_id, '.batch') ELSE CAST(event_id AS VARCHAR) END AS job_id,
  concat('job-', user_id) AS job_name,
  CASE event_type WHEN 'error' THEN 'FAILED' WHEN 'signup' THEN 'CANCELLED' WHEN 'click' THEN 'TIMEOUT' WHEN 'purchase' THEN 'NODE_FAIL' ELSE 'COMPLETED' END AS state,
  props AS exit_code, concat('n', user_id) AS node_list, strftime(ts, '%Y-%m-%d %H:%M:%S') AS start, value AS elapsed
  FROM events WHERE ts >= TIMESTAMP '2024-01-31' - INTERVAL 240 HOUR)
WHERE state IN ('FAILED', 'CANCELLED', 'TIMEOUT', 'NODE_FAIL') AND NOT contains(job_id, '.')
""",
)
def job_failures(t: Tables):
    kind, number = F.col("event_type"), F.col("event_id").cast("string")
    jobs = t.events.select(
        F.when(kind == "click", F.concat(number, F.lit(".batch"))).otherwise(number).alias("job_id"),
        F.concat(F.lit("job-"), F.col("user_id").cast("string")).alias("job_name"),
        F.when(kind == "error", "FAILED").when(kind == "signup", "CANCELLED").when(kind == "click", "TIMEOUT")
        .when(kind == "purchase", "NODE_FAIL").otherwise("COMPLETED").alias("state"),
        F.col("props").alias("exit_code"),
        F.concat(F.lit("n"), F.col("user_id").cast("string")).alias("node_list"),
        F.col("ts").alias("start"),
        F.col("value").alias("elapsed"),
    )
    failed = health.job_failures(
        jobs, hours=240, as_of="2024-01-31", columns=("job_id", "job_name", "state", "exit_code", "node_list", "start", "elapsed")
    )
    return failed.withColumn("start", F.date_format("start", "yyyy-MM-dd HH:mm:ss"))


NODE_LINES = """
SELECT event_id, user_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, ts,
  CASE event_type WHEN 'error' THEN concat(CAST(floor(value) AS BIGINT), ' down*')
    WHEN 'signup' THEN concat(CAST(floor(value) AS BIGINT), '  idle~')
    WHEN 'view' THEN concat(' ', CAST(floor(value) AS BIGINT), ' MIXED extra')
    WHEN 'click' THEN CASE WHEN value < 5 THEN 'slurm_load_partitions:' WHEN value < 10 THEN 'x idle' ELSE concat(CAST(floor(value) AS BIGINT), ' alloc+') END
    ELSE '   ' END AS line,
  CASE WHEN event_type = 'error' AND value > 150 THEN 1 ELSE 0 END AS rc
FROM events
"""


def node_lines(events):
    kind, count = F.col("event_type"), F.floor("value").cast("string")
    click = (
        F.when(F.col("value") < 5, "slurm_load_partitions:")
        .when(F.col("value") < 10, "x idle")
        .otherwise(F.concat(count, F.lit(" alloc+")))
    )
    line = (
        F.when(kind == "error", F.concat(count, F.lit(" down*")))
        .when(kind == "signup", F.concat(count, F.lit("  idle~")))
        .when(kind == "view", F.concat(F.lit(" "), count, F.lit(" MIXED extra")))
        .when(kind == "click", click)
        .otherwise("   ")
    )
    return events.select(
        "event_id",
        "user_id",
        F.col("ts").cast("date").cast("string").alias("day"),
        "ts",
        line.alias("line"),
        F.when((kind == "error") & (F.col("value") > 150), 1).otherwise(0).alias("rc"),
    )


COUNTED = f"""
SELECT *, CASE WHEN trim(line) = '' THEN 0 WHEN NOT regexp_matches(line, '^\\s*[0-9]+\\s+\\S') THEN 1
    WHEN regexp_matches(line, 'down') THEN CAST(string_split_regex(trim(line), '\\s+')[1] AS BIGINT) ELSE 0 END AS bad,
  CASE WHEN regexp_matches(line, '^\\s*[0-9]+\\s+\\S') AND NOT regexp_matches(line, 'down')
    THEN CAST(string_split_regex(trim(line), '\\s+')[1] AS BIGINT) ELSE 0 END AS good
FROM ({NODE_LINES})
"""
COUNTS = f"""
SELECT user_id, day, max(rc) AS rc, bool_or(trim(line) <> '') AS has_output,
  CAST(sum(good) AS BIGINT) AS usable, CAST(sum(bad) AS BIGINT) AS unusable FROM ({COUNTED}) GROUP BY 1, 2
"""


@query("node_state_counts", COUNTS)
def node_state_counts(t: Tables):
    return health.node_state_counts(node_lines(t.events), key=["user_id", "day"], rc="rc")


@query(
    "slurm_verdict",
    f"""
SELECT *, CASE WHEN rc <> 0 OR NOT has_output OR usable = 0 THEN 'FAIL' ELSE 'PASS' END AS verdict,
  CASE WHEN rc <> 0 THEN concat('sinfo returned rc=', rc) WHEN NOT has_output THEN 'sinfo reported no partitions'
    WHEN usable = 0 THEN concat('no usable nodes: ', unusable, ' node(s) down/drained/unknown')
    WHEN unusable > 0 THEN concat(usable, ' node(s) usable, ', unusable, ' down/drained') END AS detail
FROM ({COUNTS})
""",
)
def slurm_verdict(t: Tables):
    return health.slurm_verdict(health.node_state_counts(node_lines(t.events), key=["user_id", "day"], rc="rc"))


@query(
    "usable_state",
    """
SELECT event_id, CASE event_type WHEN 'error' THEN false WHEN 'view' THEN true WHEN 'click' THEN true WHEN 'signup' THEN value >= 20 ELSE false END AS ok FROM events
""",
)
def usable(t: Tables):
    kind = F.col("event_type")
    state = (
        F.when(kind == "error", "DRAIN$")
        .when(kind == "view", " Idle*~ ")
        .when(kind == "click", "powering_down%")
        .when(kind == "signup", F.when(F.col("value") < 20, "unk*").otherwise("planned^-"))
        .otherwise("idle~down")
    )
    return t.events.select("event_id", usable_state(state).alias("ok"))


@query(
    "annotate_nodes",
    """
WITH rows AS (
  SELECT DISTINCT user_id, -1 AS line_no, '' AS kind, CAST(NULL AS VARCHAR) AS state FROM events
  UNION ALL SELECT DISTINCT user_id, 0, 'header', NULL FROM events
  UNION ALL SELECT user_id, event_id + 1, event_type,
    CASE event_type WHEN 'error' THEN 'down*' WHEN 'view' THEN 'idle' WHEN 'click' THEN 'mixed#' WHEN 'signup' THEN 'drained' END FROM events)
SELECT user_id, CAST(line_no AS BIGINT) AS line_no, coalesce(state IN ('down*', 'drained'), false) AS marked FROM rows
""",
)
def annotate_nodes(t: Tables):
    narrow = F.col("user_id") < 75
    users = t.events.select("user_id").distinct()
    kind = F.col("event_type")
    state = F.when(kind == "error", "down*").when(kind == "view", "idle").when(kind == "click", "mixed#").when(kind == "signup", "drained")
    node = F.concat(F.lit("n"), F.col("event_id").cast("string"))
    data = t.events.select(
        "user_id",
        (F.col("event_id") + 1).alias("line_no"),
        F.when(state.isNull(), node)
        .otherwise(F.when(narrow, F.concat_ws("  ", node, state, F.lit("4"))).otherwise(F.concat_ws(" ", node, F.lit("down"), state)))
        .alias("line"),
    )
    banner = users.select("user_id", F.lit(-1).cast("bigint").alias("line_no"), F.lit("Fri down down down").alias("line"))
    header = users.select(
        "user_id", F.lit(0).cast("bigint").alias("line_no"),
        F.when(narrow, "NODELIST STATE CPUS").otherwise("NODELIST PARTITION State").alias("line"),
    )
    lines = data.unionByName(banner).unionByName(header)
    return health.annotate_nodes(lines, key="user_id").drop("line")


CHECK_SQL = {
    "record": "value > 2",
    "stack": "event_type <> 'error'",
    "head_ip": "CASE WHEN event_type = 'error' AND value < 20 THEN NULL ELSE value > 4 END",
    "ssh": "value < 150",
    "slurm": "value < 100",
    "postinstall": "event_type <> 'signup'",
    "grafana": "value > 10",
    "storage": "event_type <> 'purchase'",
}


def check_results(t: Tables):
    checks = F.array(*[F.struct(F.lit(name).alias("check"), F.expr(sql).alias("ok")) for name, sql in CHECK_SQL.items()])
    return t.events.select(
        F.col("event_id").alias("cluster"), F.col("event_type").isin("view", "click").alias("monitoring"), F.explode(checks).alias("c")
    ).select("cluster", "monitoring", "c.*")


RAW_CHECKS = "SELECT event_id AS cluster, event_type IN ('view', 'click') AS monitoring, " + ", ".join(
    f"{sql} AS c_{name}" for name, sql in CHECK_SQL.items()
) + " FROM events"


def verdict(expr: str) -> str:
    return f"CASE WHEN {expr} THEN 'PASS' ELSE 'FAIL' END"


def gated(checks: str) -> str:
    return f"""
WITH {checks},
g AS (SELECT cluster, {verdict('c_record')} AS record,
  CASE WHEN c_record THEN {verdict('c_stack')} END AS stack,
  CASE WHEN c_record THEN CASE WHEN c_head_ip IS NULL THEN 'SKIP' ELSE {verdict('c_head_ip')} END END AS head_ip,
  CASE WHEN c_record THEN CASE WHEN coalesce(c_head_ip, false) THEN {verdict('c_ssh')} ELSE 'SKIP' END END AS ssh,
  CASE WHEN c_record THEN CASE WHEN coalesce(c_head_ip, false) AND c_ssh THEN {verdict('c_slurm')} ELSE 'SKIP' END END AS slurm,
  CASE WHEN c_record THEN CASE WHEN coalesce(c_head_ip, false) AND c_ssh THEN {verdict('c_postinstall')} ELSE 'SKIP' END END AS postinstall,
  CASE WHEN c_record AND monitoring THEN CASE WHEN coalesce(c_head_ip, false) AND c_ssh THEN {verdict('c_grafana')} ELSE 'SKIP' END END AS grafana,
  CASE WHEN c_record THEN {verdict('c_storage')} END AS storage FROM c),
f AS (SELECT *, CAST(len(list_filter([record, stack, head_ip, ssh, slurm, postinstall, grafana, storage], lambda x: x = 'FAIL')) AS BIGINT) AS failures FROM g)
SELECT *, failures = 0 AS healthy FROM f
"""


@query("check_rollup", gated(f"c AS ({RAW_CHECKS})"))
def check_rollup(t: Tables):
    return health.check_rollup(check_results(t), key="cluster", monitoring="monitoring")


STACK = """
SELECT event_id AS cluster, event_type NOT IN ('error', 'click') AND event_type = 'purchase' AS ok,
  CASE event_type WHEN 'error' THEN 'describe call failed (rc=' || (user_id % 3 + 1) || ')' WHEN 'click' THEN 'unexpected describe response'
    WHEN 'purchase' THEN 'clusterStatus=CREATE_COMPLETE' WHEN 'view' THEN 'clusterStatus=CREATE_FAILED cloudFormationStackStatus=ROLLBACK_COMPLETE'
    ELSE 'clusterStatus=UNKNOWN cloudFormationStackStatus=UNKNOWN' END AS detail,
  CASE event_type WHEN 'purchase' THEN CASE WHEN user_id % 2 = 0 THEN '3.0.0.' ELSE '10.0.0.' END || user_id WHEN 'view' THEN '10.1.1.1' WHEN 'signup' THEN '' END AS head_ip
FROM events
"""


def describes(t: Tables):
    """An answer for each event: a failed call, no JSON, a finished stack with one address or two, a failed one, an empty answer."""
    kind, user = F.col("event_type"), F.col("user_id").cast("string")
    public = F.when(F.col("user_id") % 2 == 0, F.concat(F.lit("3.0.0."), user)).otherwise("")
    done = F.concat(
        F.lit('{"clusterStatus": "CREATE_COMPLETE", "headNode": {"publicIpAddress": "'), public,
        F.lit('", "privateIpAddress": "10.0.0.'), user, F.lit('"}, "other": [1]}'),
    )
    failed = '{"clusterStatus": "CREATE_FAILED", "cloudFormationStackStatus": "ROLLBACK_COMPLETE", "headNode": {"privateIpAddress": "10.1.1.1"}}'
    text = F.when(kind == "purchase", done).when(kind == "view", failed).when(kind == "click", "Traceback (most recent call last)").otherwise("{}")
    rc = F.when(kind == "error", F.col("user_id") % 3 + 1).otherwise(0)
    return t.events.select(F.col("event_id").alias("cluster"), rc.alias("rc"), text.alias("text"))


@query("stack_verdict", STACK)
def stack_verdict(t: Tables):
    return health.stack_verdict(describes(t), key="cluster")


@query(
    "cluster_health",
    gated(
        f"""lines AS (SELECT event_id AS cluster, rc, good FROM ({COUNTED})), described AS ({STACK}),
c AS (SELECT r.* EXCLUDE (c_slurm, c_stack, c_head_ip), rc = 0 AND good > 0 AS c_slurm, ok AS c_stack, head_ip <> '' AS c_head_ip
  FROM ({RAW_CHECKS}) r JOIN lines USING (cluster) JOIN described USING (cluster))"""
    ),
)
def cluster_health(t: Tables):
    lines = node_lines(t.events).withColumnRenamed("event_id", "cluster")
    return reports.cluster_health(check_results(t), lines, describes(t))


@query(
    "cleanup_report",
    """
WITH steps AS (SELECT l_orderkey, concat('resource ', l_linenumber) AS label, l_returnflag = 'R' AS failed, l_returnflag <> 'N' AS retained FROM lineitem),
s AS (SELECT l_orderkey,
  coalesce(string_agg(DISTINCT CASE WHEN failed THEN label END, ',' ORDER BY CASE WHEN failed THEN label END), '') AS orphaned,
  coalesce(string_agg(DISTINCT CASE WHEN retained AND NOT failed THEN label END, ',' ORDER BY CASE WHEN retained AND NOT failed THEN label END), '') AS retained
  FROM steps GROUP BY 1),
o AS (SELECT o_orderkey AS cluster, CASE WHEN o_orderstatus = 'F' OR (o_orderstatus = 'P' AND o_orderpriority = '1-URGENT') THEN 'deleted'
  WHEN o_orderstatus = 'O' THEN 'DELETE_FAILED' ELSE 'not confirmed' END AS headline FROM orders)
SELECT cluster, coalesce(orphaned, '') AS orphaned, coalesce(retained, '') AS retained, headline,
  coalesce(orphaned, '') <> '' OR headline <> 'deleted' AS exit_failing
FROM o LEFT JOIN s ON l_orderkey = cluster
""",
)
def cleanup_report(t: Tables):
    steps = t.lineitem.select(
        F.col("l_orderkey").alias("cluster"),
        F.concat(F.lit("resource "), F.col("l_linenumber").cast("string")).alias("resource"),
        (F.col("l_returnflag") == "R").alias("failed"),
        (F.col("l_returnflag") != "N").alias("retained"),
    )
    text = (
        F.when(F.col("o_orderstatus") == "F", "status: DELETE_COMPLETE")
        .when(F.col("o_orderstatus") == "O", "status: DELETE_FAILED")
        .when(F.col("o_orderpriority") == "1-URGENT", "error: ClusterNotFound")
        .when(F.col("o_orderpriority") != "5-LOW", "status: DELETE_IN_PROGRESS")
    )
    stack = t.orders.select(F.col("o_orderkey").alias("cluster"), text.alias("text"))
    report = health.cleanup_report(steps, stack, key="cluster")
    return report.withColumns({c: F.array_join(c, ",") for c in ("orphaned", "retained")})


@query(
    "archive_progress",
    "SELECT user_id, count(*) FILTER (WHERE event_type IN ('click', 'error')) AS outstanding FROM events GROUP BY 1",
)
def archive_progress(t: Tables):
    action = F.when(F.col("event_type") == "click", "(ARCHIVE) running").when(F.col("event_type") == "error", "ARCHIVE").otherwise("NOOP")
    return health.archive_progress(t.events.select("user_id", action.alias("action")), key="user_id")
