"""Streams fed in several micro-batches against their batch twins."""

import datetime as dt
import os

import pytest
from helpers import values
from pyspark.sql import functions as F

from fleetloom.session import scratch_path
from fleetloom.streaming import plans, trackers

T0 = dt.datetime(2026, 7, 24, 12, 0)


def at(minutes):
    return T0 + dt.timedelta(minutes=minutes)


SCHEMA = "key string, request_ts timestamp, ts timestamp, status string, rc int"

# key, request minute, sample minute, status; the last batch is a heartbeat that moves time on
BATCHES = [
    [("reached", 0, 1, "STARTING", 0), ("aborted", 0, 2, "STARTING", 0), ("slow", 0, 3, "STARTING", 0), ("tie", 0, 4, "PROTECTED", 0), ("tie", 0, 4, "RUNNING", 0)],
    [("reached", 0, 20, "RUNNING", 0), ("reached", 0, 21, "PROTECTED", 0), ("slow", 0, 25, "UNKNOWN", 1), ("again", 0, 10, "RUNNING", 0)],
    [("aborted", 0, 30, "PROTECTED", 0), ("aborted", 0, 31, "RUNNING", 0), ("again", 30, 32, "STARTING", 0)],
    [("slow", 0, 50, "RUNNING", 0), ("again", 30, 40, "PROTECTED", 0), ("late", 50, 51, "STARTING", 0)],
    [("beat", 200, 201, "STARTING", 0)],
    [("beat", 400, 401, "STARTING", 0)],
]

FINAL = [
    ("aborted", at(0), "ABORTED", at(30)), ("again", at(0), "REACHED", at(10)), ("again", at(30), "ABORTED", at(40)),
    ("beat", at(200), "TIMEOUT", at(244.5)), ("late", at(50), "TIMEOUT", at(94.5)), ("reached", at(0), "REACHED", at(20)),
    ("slow", at(0), "TIMEOUT", at(44.5)), ("tie", at(0), "REACHED", at(4)),
]


def feed(spark, folder, batches):
    os.makedirs(folder)
    for n, rows in enumerate(batches):
        made = [(k, at(r), at(s), status, rc) for k, r, s, status, rc in rows]
        spark.createDataFrame(made, SCHEMA).coalesce(1).write.parquet(f"{folder}/.tmp{n}")
        part = next(f for f in os.listdir(f"{folder}/.tmp{n}") if f.endswith(".parquet"))
        os.link(f"{folder}/.tmp{n}/{part}", f"{folder}/batch{n}.parquet")
        os.utime(f"{folder}/batch{n}.parquet", (1_800_000_000 + n, 1_800_000_000 + n))
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{folder}/batch*.parquet")


def run(spark, stream):
    return plans.run_to_files(stream, scratch_path(spark, "out"), scratch_path(spark, "log"))


@pytest.mark.parametrize("tracker", [trackers.track_transitions, trackers.track_transitions_live])
def test_each_outcome_comes_once(spark, tmp_path, tracker):
    stream = feed(spark, f"{tmp_path}/in", BATCHES)
    tracked = tracker(stream, key="key", ts="ts", request_ts="request_ts", **trackers.fleet_wait("status", "RUNNING"))
    assert values(run(spark, tracked), "key", "request_ts", "outcome", "outcome_ts") == sorted(FINAL, key=repr)


def test_history_agrees_with_the_stream(spark):
    rows = [(k, at(r), at(s), status, rc) for batch in BATCHES for k, r, s, status, rc in batch]
    history = spark.createDataFrame(rows, SCHEMA)
    conditions = trackers.fleet_wait("status", "RUNNING")
    got = trackers.track_history(history, key="key", ts="ts", request_ts="request_ts", as_of=F.lit(at(391)), **conditions)
    expected = sorted([*FINAL, ("beat", at(400), "PENDING", None)], key=repr)
    assert values(got, "key", "request_ts", "outcome", "outcome_ts") == expected


def test_samples_before_the_request_do_not_count(spark):
    rows = [("k", at(60), at(30), "RUNNING", 0), ("k", at(60), at(70), "STOPPED", 0)]
    conditions = trackers.fleet_wait("status", "RUNNING")
    got = trackers.track_history(spark.createDataFrame(rows, SCHEMA), key="key", ts="ts", request_ts="request_ts", as_of=F.lit(at(10_000)), **conditions)
    assert values(got, "key", "outcome") == [("k", "TIMEOUT")]


def test_waiting_time_is_89_intervals():
    assert trackers.fixed.FLEET_WAIT_SECONDS == 89 * 30 == 44.5 * 60


def history_of(spark, samples, schema="key string, request_ts timestamp, ts timestamp, text string, rc int, stack string"):
    return spark.createDataFrame([(k, at(0), at(m), *rest) for k, m, *rest in samples], schema)


def outcomes(df, wait):
    got = trackers.track_history(df, key="key", ts="ts", request_ts="request_ts", as_of=F.lit(at(10_000)), **wait)
    return dict(values(got, "key", "outcome"))


def test_update_needs_both_and_either_fails(spark):
    done, fail = "UPDATE_COMPLETE", "UPDATE_ROLLBACK_IN_PROGRESS"
    rows = [("both", 1, done, 0, done), ("one", 1, done, 0, "UPDATE_IN_PROGRESS"), ("fail", 1, done, 0, fail), ("fail2", 1, "UPDATE_FAILED", 0, done)]
    assert outcomes(history_of(spark, rows), trackers.update_wait("text", "stack")) == {
        "both": "REACHED", "one": "TIMEOUT", "fail": "ABORTED", "fail2": "ABORTED",
    }


def test_create_outcomes(spark):
    rows = [
        ("ok", 5, "CREATE_COMPLETE", 0, ""), ("bad", 5, "CREATE_FAILED", 0, ""), ("roll", 5, "ROLLBACK_COMPLETE CREATE_COMPLETE", 0, ""),
        ("slow", 5, "CREATE_IN_PROGRESS", 0, ""), ("mute", 5, "CREATE_IN_PROGRESS", 0, ""), ("mute", 6, "denied CREATE_COMPLETE", 1, ""), ("late", 61, "CREATE_COMPLETE", 0, ""), ("late", 5, "x", 0, ""),
    ]
    assert outcomes(history_of(spark, rows), trackers.create_wait("text", "rc")) == {
        "ok": "created", "bad": "failed", "roll": "failed", "slow": "not_terminal", "mute": "call_failed", "late": "not_terminal",
    }


def test_delete_outcomes(spark):
    rows = [
        ("gone", 5, "DELETE_COMPLETE", 0, ""), ("unknown", 5, "ClusterNotFound", 1, ""), ("missing", 5, "it does not exist", 1, ""),
        ("stuck", 5, "DELETE_FAILED", 0, ""), ("open", 5, "DELETE_IN_PROGRESS", 0, ""), ("silent", 5, None, 1, ""),
    ]
    assert outcomes(history_of(spark, rows), trackers.delete_wait("text")) == {
        "gone": "confirmed", "unknown": "confirmed", "missing": "confirmed", "stuck": "delete_failed", "open": "unconfirmed", "silent": "unconfirmed",
    }


@pytest.mark.parametrize(
    "status, stop, start",
    [
        ("RUNNING", "request", "done"), ("ENABLED", "request", "done"), ("STOPPED", "done", "request"), ("DISABLED", "done", "request"),
        ("STOP_REQUESTED", "wait", "request"), ("STOPPING", "wait", "request"), ("START_REQUESTED", "request", "wait"), ("STARTING", "request", "wait"),
        ("PROTECTED", "abort", "abort"), ("UNKNOWN", "request", "request"), (None, "request", "request"),
    ],
)
def test_action_plans(spark, status, stop, start):
    df = spark.createDataFrame([(status, "stop"), (status, "start"), (status, "reboot"), (status, None)], "status string, action string")
    assert [r["plan"] for r in plans.plan_actions(df).collect()] == [stop, start, "error", "error"]


def test_node_states_per_window(spark, tmp_path):
    batches = [[("c", 0, 1, "2 idle", 0), ("c", 0, 2, "3 down", 0)], [("c", 0, 59, "1 mix", 0), ("c", 0, 61, "5 idle", 0)], [("c", 0, 300, "1 idle", 0)], [("c", 0, 301, "1 idle", 0)]]
    stream = feed(spark, f"{tmp_path}/in", batches).withColumnRenamed("status", "line")
    got = run(spark, plans.node_state_stream(stream, key="key", ts="ts", window="1 hour"))
    assert values(got, "window_start", "usable", "unusable") == sorted([(at(0), 3, 3), (at(60), 5, 0)], key=repr)


def test_a_live_tracker_goes_on_after_a_restart(spark, tmp_path):
    """Two batches, a stop, and the rest from the same checkpoint: every outcome once."""
    feed(spark, f"{tmp_path}/in", BATCHES)
    os.makedirs(f"{tmp_path}/now")
    out, log = scratch_path(spark, "out"), scratch_path(spark, "log")
    for first, last in ((0, 2), (2, len(BATCHES))):
        for n in range(first, last):
            os.link(f"{tmp_path}/in/batch{n}.parquet", f"{tmp_path}/now/batch{n}.parquet")
            os.utime(f"{tmp_path}/now/batch{n}.parquet", (1_800_000_000 + n, 1_800_000_000 + n))
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/now/batch*.parquet")
        tracked = trackers.track_transitions_live(stream, key="key", ts="ts", request_ts="request_ts", **trackers.fleet_wait("status", "RUNNING"))
        got = values(plans.run_to_files(tracked, out, log), "key", "request_ts", "outcome", "outcome_ts")
        if last == 2:
            assert got == sorted([("reached", at(0), "REACHED", at(20)), ("again", at(0), "REACHED", at(10)), ("tie", at(0), "REACHED", at(4))], key=repr)
    assert got == sorted(FINAL, key=repr)


def test_requests_of_a_key_share_one_state(spark, tmp_path):
    """Twenty requests of each of three keys, some closed by the next batch, whose time runs out for some of the others."""
    first = [(k, 5 * n, 5 * n + 1, "RUNNING" if n % 3 == 0 else "STARTING", 0) for k in "abc" for n in range(20)]
    second = [(k, 5 * n, 5 * n + 40, "PROTECTED", 0) for k in "ab" for n in range(19)] + [("beat", 90, 91, "STARTING", 0)]
    stream = feed(spark, f"{tmp_path}/in", [first, second])
    tracked = trackers.track_transitions_live(stream, key="key", ts="ts", request_ts="request_ts", **trackers.fleet_wait("status", "RUNNING"))
    out, log = scratch_path(spark, "out"), scratch_path(spark, "log")
    got = {(r["key"], r["request_ts"]): (r["outcome"], r["outcome_ts"]) for r in plans.run_to_files(tracked, out, log).collect()}
    mark = 5 * 18 + 40 - 10
    expected = {(k, at(5 * n)): ("REACHED", at(5 * n + 1)) for k in "abc" for n in range(0, 20, 3)}
    expected |= {(k, at(5 * n)): ("ABORTED", at(5 * n + 40)) for k in "ab" for n in range(19) if n % 3}
    expected |= {("c", at(5 * n)): ("TIMEOUT", at(5 * n + 44.5)) for n in range(20) if n % 3 and 5 * n + 44.5 < mark}
    assert got == expected
    held = spark.read.format("statestore").option("stateVarName", "waits").load(log)
    assert sorted(r[0] for r in held.select("key.key").collect()) == ["a", "b", "beat", "c"]


def test_open_waits_are_carried_over(spark, tmp_path):
    """What a history table knows is the initial state of the stream behind it."""
    conditions = trackers.fleet_wait("status", "RUNNING")
    names = {"key": "key", "ts": "ts", "request_ts": "request_ts"}
    before = [(k, at(r), at(s), status, rc) for batch in BATCHES[:2] for k, r, s, status, rc in batch] + [("gone", at(-100), at(-99), "STARTING", 0)]
    history = spark.createDataFrame(before, SCHEMA)
    as_of = F.lit(at(11))
    stated = trackers.track_history(history, **names, as_of=as_of, **conditions).where("outcome <> 'PENDING'")
    waits = trackers.open_waits(history, **names, as_of=as_of, **conditions)
    assert values(waits, "key", "done") == [("aborted", False), ("again", True), ("reached", True), ("slow", False), ("tie", True)]
    stream = feed(spark, f"{tmp_path}/in", BATCHES[2:])
    tracked = trackers.track_transitions_live(stream, **names, **conditions, open_waits=waits)
    columns = ("key", "request_ts", "outcome", "outcome_ts")
    assert sorted(values(stated, *columns) + values(run(spark, tracked), *columns), key=repr) == sorted([*FINAL, ("gone", at(-100), "TIMEOUT", at(-55.5))], key=repr)
