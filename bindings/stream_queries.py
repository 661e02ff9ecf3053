"""Streams over the events table, each run to the end of the data now available."""

from __future__ import annotations

from pyspark.sql import functions as F

from bindings.health_queries import COUNTED, node_lines
from bindings.registry import Tables, query
from fleetloom.session import scratch_path
from fleetloom.streaming import plans, trackers

DAY = 24 * 3600


def request():
    """Requests are made at six; samples of the night before them belong to no wait."""
    return F.date_trunc("day", "ts") + F.make_dt_interval(hours=F.lit(6))


def event_stream(t: Tables):
    rows = t.spark.readStream.schema(t.events.schema).parquet(f"{t.directory}/events*.parquet")
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def finish(t: Tables, stream, label: str):
    return plans.run_to_files(stream, scratch_path(t.spark, label), scratch_path(t.spark, f"{label}-log"))


def text_times(df):
    return df.withColumns({c: F.date_format(c, "yyyy-MM-dd HH:mm:ss") for c in ("request_ts", "outcome_ts")})


def waits_sql(good: str, bad: str, hours: int, labels: tuple[str, str, str, str], broken: str = "false", show: str = "closed") -> str:
    """Waits of a user and day; ``show`` is ``closed`` (deadline passed), ``decided`` or ``all``."""
    reached, aborted, timed_out, call_broken = labels
    keep = {"closed": "WHERE deadline < mark", "decided": "WHERE outcome <> 'PENDING'", "all": ""}[show]
    return f"""
WITH w AS (SELECT max(ts) - INTERVAL 10 MINUTE AS mark FROM events),
s AS (SELECT *, date_trunc('day', ts) + INTERVAL 6 HOUR AS request FROM events),
i AS (SELECT * FROM s WHERE ts >= request AND ts <= request + INTERVAL {hours} HOUR),
g AS (SELECT user_id, request, min(ts) FILTER (WHERE {good}) AS g, min(ts) FILTER (WHERE {bad}) AS b, request + INTERVAL {hours} HOUR AS deadline,
  arg_max({broken}, ts) AS broken FROM i GROUP BY 1, 2),
o AS (SELECT user_id, request, deadline, mark, CASE WHEN g IS NOT NULL AND (b IS NULL OR g <= b) THEN '{reached}' WHEN b IS NOT NULL THEN '{aborted}'
    WHEN deadline >= mark THEN 'PENDING' WHEN broken THEN '{call_broken}' ELSE '{timed_out}' END AS outcome,
  CASE WHEN g IS NOT NULL AND (b IS NULL OR g <= b) THEN g WHEN b IS NOT NULL THEN b WHEN deadline < mark THEN deadline END AS happened FROM g, w)
SELECT user_id, strftime(request, '%Y-%m-%d %H:%M:%S') AS request_ts, outcome, strftime(happened, '%Y-%m-%d %H:%M:%S') AS outcome_ts FROM o {keep}
"""


FLEET_LABELS = (trackers.REACHED, trackers.ABORTED, trackers.TIMEOUT, trackers.TIMEOUT)
FLEET_SQL = ("event_type = 'error'", "event_type = 'purchase'", 12, FLEET_LABELS)


def fleet_conditions():
    wait = trackers.fleet_wait("event_type", "error", abort="purchase")
    return {**wait, "timeout_seconds": 12 * 3600}


@query("track_transitions", waits_sql(*FLEET_SQL))
def track_transitions(t: Tables):
    stream = event_stream(t).withColumn("request_ts", request())
    tracked = trackers.track_transitions(stream, key="user_id", ts="ts", request_ts="request_ts", **fleet_conditions())
    return text_times(finish(t, tracked, "transitions"))


@query("track_transitions_live", waits_sql(*FLEET_SQL, show="decided"))
def track_transitions_live(t: Tables):
    stream = event_stream(t).withColumn("request_ts", request())
    tracked = trackers.track_transitions_live(stream, key="user_id", ts="ts", request_ts="request_ts", **fleet_conditions())
    return text_times(finish(t, tracked, "live"))


def history(t: Tables):
    rows = t.events.withColumn("ts", F.col("ts").cast("timestamp"))
    return rows.withColumn("request_ts", request())


def mark(rows):
    return rows.agg((F.max("ts") - F.expr("INTERVAL 10 MINUTES")).alias("mark")).scalar()


@query("track_history", waits_sql(*FLEET_SQL, show="all"))
def track_history(t: Tables):
    rows = history(t)
    return text_times(trackers.track_history(rows, key="user_id", ts="ts", request_ts="request_ts", as_of=mark(rows), **fleet_conditions()))


def update_statuses(rows):
    kind = F.col("event_type")
    return rows.withColumns(
        {
            "cluster_status": F.when(kind.isin("error", "view"), "UPDATE_COMPLETE").otherwise("UPDATE_IN_PROGRESS"),
            "stack_status": F.when(kind == "error", "UPDATE_COMPLETE").when(kind == "signup", "UPDATE_ROLLBACK_IN_PROGRESS").otherwise("UPDATE_IN_PROGRESS"),
        }
    )


@query("track_update", waits_sql("event_type = 'error'", "event_type = 'signup'", 6, FLEET_LABELS))
def track_update(t: Tables):
    stream = update_statuses(event_stream(t)).withColumn("request_ts", request())
    wait = {**trackers.update_wait("cluster_status", "stack_status"), "timeout_seconds": 6 * 3600}
    tracked = trackers.track_transitions(stream, key="user_id", ts="ts", request_ts="request_ts", **wait)
    return text_times(finish(t, tracked, "updates"))


def create_answers(rows):
    kind = F.col("event_type")
    text = (
        F.when(kind == "error", '{"clusterStatus": "CREATE_COMPLETE"}')
        .when(kind == "signup", '{"clusterStatus": "CREATE_FAILED", "stack": "ROLLBACK_COMPLETE"}')
        .otherwise('{"clusterStatus": "CREATE_IN_PROGRESS"}')
    )
    return rows.withColumns({"text": text, "rc": F.when(kind == "purchase", 1).otherwise(0)})


CREATE_SQL = ("event_type = 'error'", "event_type = 'signup'", 8, ("created", "failed", "not_terminal", "call_failed"))


@query("outcome_of_create", waits_sql(*CREATE_SQL, broken="event_type = 'purchase'"))
def outcome_of_create(t: Tables):
    stream = create_answers(event_stream(t)).withColumn("request_ts", request())
    wait = {**trackers.create_wait("text", "rc"), "timeout_seconds": 8 * 3600}
    tracked = trackers.track_transitions(stream, key="user_id", ts="ts", request_ts="request_ts", **wait)
    return text_times(finish(t, tracked, "creates"))


@query("outcome_of_create_history", waits_sql(*CREATE_SQL, broken="event_type = 'purchase'", show="all"))
def outcome_of_create_history(t: Tables):
    rows = history(t)
    wait = {**trackers.create_wait("text", "rc"), "timeout_seconds": 8 * 3600}
    return text_times(
        trackers.track_history(create_answers(rows), key="user_id", ts="ts", request_ts="request_ts", as_of=mark(rows), **wait)
    )


@query(
    "outcome_of_delete",
    waits_sql("event_type IN ('error', 'view')", "event_type = 'signup'", 5, ("confirmed", "delete_failed", "unconfirmed", "unconfirmed")),
)
def outcome_of_delete(t: Tables):
    kind = F.col("event_type")
    text = (
        F.when(kind == "error", '{"clusterStatus": "DELETE_COMPLETE"}')
        .when(kind == "view", "Bad Request: cluster does not exist")
        .when(kind == "signup", '{"clusterStatus": "DELETE_FAILED"}')
        .when(kind == "click", "DELETE_IN_PROGRESS")
    )
    stream = event_stream(t).withColumns({"text": text, "request_ts": request()})
    wait = {**trackers.delete_wait("text"), "timeout_seconds": 5 * 3600}
    tracked = trackers.track_transitions(stream, key="user_id", ts="ts", request_ts="request_ts", **wait)
    return text_times(finish(t, tracked, "deletes"))


@query(
    "plan_actions",
    """
WITH x AS (SELECT event_id, CASE event_type WHEN 'error' THEN 'PROTECTED' WHEN 'view' THEN CASE WHEN value < 30 THEN 'STOPPED' ELSE 'RUNNING' END
    WHEN 'click' THEN CASE WHEN value < 30 THEN 'STOPPING' ELSE 'START_REQUESTED' END WHEN 'signup' THEN 'UNKNOWN' END AS status,
  CASE WHEN user_id < 60 THEN 'stop' WHEN user_id < 140 THEN 'start' ELSE 'restart' END AS action FROM events)
SELECT event_id, CASE WHEN action = 'restart' THEN 'error' WHEN status = 'PROTECTED' THEN 'abort'
  WHEN (action = 'stop' AND status = 'STOPPED') OR (action = 'start' AND status = 'RUNNING') THEN 'done'
  WHEN (action = 'stop' AND status = 'STOPPING') OR (action = 'start' AND status = 'START_REQUESTED') THEN 'wait' ELSE 'request' END AS plan FROM x
""",
)
def plan_actions(t: Tables):
    kind, low = F.col("event_type"), F.col("value") < 30
    status = (
        F.when(kind == "error", "PROTECTED")
        .when(kind == "view", F.when(low, "STOPPED").otherwise("RUNNING"))
        .when(kind == "click", F.when(low, "STOPPING").otherwise("START_REQUESTED"))
        .when(kind == "signup", "UNKNOWN")
    )
    action = F.when(F.col("user_id") < 60, "stop").when(F.col("user_id") < 140, "start").otherwise("restart")
    stream = event_stream(t).select("event_id", status.alias("status"), action.alias("action"))
    return finish(t, plans.plan_actions(stream), "plans").select("event_id", "plan")


@query(
    "node_state_stream",
    f"""
SELECT user_id, day || ' 00:00:00' AS window_start, CAST(sum(good) AS BIGINT) AS usable, CAST(sum(bad) AS BIGINT) AS unusable FROM ({COUNTED})
WHERE CAST(day AS DATE) + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM events) GROUP BY 1, 2
""",
)
def node_state_stream(t: Tables):
    lines = node_lines(event_stream(t)).select("user_id", "ts", "line")
    counted = plans.node_state_stream(lines, key="user_id", ts="ts", window="1 day")
    return finish(t, counted, "states").withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd HH:mm:ss"))


@query(
    "late_rows",
    """
WITH e AS (SELECT event_id % 4 AS part, ts, date_trunc('day', ts) + INTERVAL 1 DAY AS due FROM events),
m AS (SELECT part, max(max(ts)) OVER (ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - INTERVAL 10 MINUTE AS mark FROM e GROUP BY 1),
l AS (SELECT *, coalesce(due <= mark, false) AS late, due <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM e) AS over FROM e JOIN m USING (part))
SELECT count(*) AS read, count(*) FILTER (WHERE NOT late AND over) AS closed, count(*) FILTER (WHERE NOT late AND NOT over) AS open, count(*) FILTER (WHERE late) AS late FROM l
""",
)
def late_rows(t: Tables):
    """Events that arrive in four parts, each over all days; the stream stops after each and goes on from its checkpoint."""
    source, out, log = (scratch_path(t.spark, name) for name in ("arriving", "counted", "counted-log"))
    lines = node_lines(t.events.withColumn("ts", F.col("ts").cast("timestamp"))).select("event_id", "user_id", "ts", "line")
    read = 0
    for part in range(4):
        lines.where(F.col("event_id") % 4 == part).write.parquet(f"{source}/{part}")
        stream = plans.observed_input(t.spark.readStream.schema(lines.schema).parquet(f"{source}/*"))
        counted = plans.node_state_stream(stream, key="user_id", ts="ts", window="1 day", count_lines=True)
        closed, rows = plans.run_and_count(counted, out, log)
        read += rows
    return plans.late_rows(read, closed, log)


@query(
    "open_waits",
    """
WITH w AS (SELECT max(ts) - INTERVAL 10 MINUTE AS mark FROM events),
s AS (SELECT *, date_trunc('day', ts) + INTERVAL 6 HOUR AS request FROM events)
SELECT user_id, strftime(request, '%Y-%m-%d %H:%M:%S') AS request_ts, bool_or(event_type IN ('error', 'purchase')) AS done, CAST(epoch_us(max(ts)) AS BIGINT) AS last_us, false AS last_broken
FROM s, w WHERE ts >= request AND ts <= request + INTERVAL 12 HOUR AND request + INTERVAL 12 HOUR >= mark GROUP BY 1, request
""",
)
def open_waits(t: Tables):
    rows = history(t)
    waits = trackers.open_waits(rows, key="user_id", ts="ts", request_ts="request_ts", as_of=mark(rows), **fleet_conditions())
    return waits.withColumn("request_ts", F.date_format("request_ts", "yyyy-MM-dd HH:mm:ss"))
