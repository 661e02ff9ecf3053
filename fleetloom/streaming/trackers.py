"""Waits for a status: streaming state machines and their batch twins.

A request (key and request time) is watched until its status is the target, until it
turns bad, or until its waiting time is over.

``track_transitions`` treats a wait as a session that ends at its deadline and emits each
outcome once, when the watermark passes that end; it runs on built-in operators alone.
``track_transitions_live`` emits an outcome as soon as it is known: typed value state for each
key, which lists its open requests, a timer at the next deadline, and waits that are already open as initial state.
``track_history`` computes the same outcomes over a history table.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from fleetloom.functions import fixed_values as fixed
from fleetloom.operators.health import deletion_outcome

LATENESS = "10 minutes"
REACHED, ABORTED, TIMEOUT, PENDING = "REACHED", "ABORTED", "TIMEOUT", "PENDING"
_SUCCESS, _FAILURE = 2, 1


def _samples(
    df: DataFrame, keys: Sequence[str], ts: str, request_ts: str, success: Column, failure: Column, call_failed: Column | None, seconds: int
) -> DataFrame:
    """Samples that belong to a wait: from the request up to the deadline, with their verdict."""
    no = F.lit(False)
    verdict = (
        F.when(F.coalesce(success, no), _SUCCESS).when(F.coalesce(failure, no), _FAILURE).otherwise(0)
    )
    broken = no if call_failed is None else F.coalesce(call_failed, no)
    deadline = F.col(request_ts) + F.make_dt_interval(secs=F.lit(float(seconds)))
    return df.select(
        *keys,
        F.col(request_ts).alias("request_ts"),
        F.col(ts).alias("ts"),
        verdict.alias("verdict"),
        broken.alias("broken"),
        deadline.alias("deadline"),
    ).where((F.col("ts") >= F.col("request_ts")) & (F.col("ts") <= F.col("deadline")))


def _decide(grouped: DataFrame, keys: Sequence[str], labels: tuple[str, str, str, str], over: Column) -> DataFrame:
    """Outcome of each wait from its first good and first bad sample; good wins a tie."""
    reached, aborted, timed_out, call_broken = labels
    good, bad = F.col("_good"), F.col("_bad")
    good_first = good.isNotNull() & (bad.isNull() | (good <= bad))
    outcome = (
        F.when(good_first, reached)
        .when(bad.isNotNull(), aborted)
        .when(~over, PENDING)
        .when(F.col("_last") % 2 == 1, call_broken)
        .otherwise(timed_out)
    )
    at = F.when(good_first, good).when(bad.isNotNull(), bad).when(over, F.col("_deadline"))
    return grouped.select(*keys, "request_ts", outcome.alias("outcome"), at.alias("outcome_ts"))


def _facts() -> list[Column]:
    return [
        F.min(F.when(F.col("verdict") == _SUCCESS, F.col("ts"))).alias("_good"),
        F.min(F.when(F.col("verdict") == _FAILURE, F.col("ts"))).alias("_bad"),
        # time and flag of the last sample in one number, which a hash aggregate can hold
        F.max(F.unix_micros("ts") * 2 + F.col("broken").cast("int")).alias("_last"),
        F.max("deadline").alias("_deadline"),
    ]


def track_transitions(
    stream: DataFrame,
    *,
    key: str | Sequence[str],
    ts: str,
    request_ts: str,
    success: Column,
    failure: Column,
    call_failed: Column | None = None,
    timeout_seconds: int = fixed.FLEET_WAIT_SECONDS,
    lateness: str = LATENESS,
    labels: tuple[str, str, str, str] = (REACHED, ABORTED, TIMEOUT, TIMEOUT),
) -> DataFrame:
    """Final outcome of every request on a stream, once, when its deadline has passed.

    Every sample opens a session window that reaches to the deadline, so the samples of a
    request merge into one session whose end is the deadline, and the watermark closes it.
    ``labels`` name success, failure, time-out, and time-out after a last sample whose
    call failed.
    """
    keys = [key] if isinstance(key, str) else list(key)
    watched = stream.withWatermark(ts, lateness)
    samples = _samples(watched, keys, ts, request_ts, success, failure, call_failed, timeout_seconds)
    left = F.unix_micros("deadline") - F.unix_micros("ts") + 1
    gap = F.make_interval(secs=(left.cast("decimal(18,0)") / 1_000_000).cast("decimal(18,6)"))
    sessions = samples.groupBy(*keys, "request_ts", F.session_window("ts", gap).alias("wait"))
    return _decide(sessions.agg(*_facts()), keys, labels, F.lit(True))


STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _Waits(StatefulProcessor):
    """The open requests of a key: whether the outcome of each is out, and when and how its last sample came.

    Every call to the state store costs as much as many samples, so all requests of a key share one
    state and one timer, which is set for the earliest deadline among them.
    """

    def __init__(self, names: list[str], wait_us: int, labels: tuple[str, str, str, str]):
        self._row = Row(*names)
        self._wait_us, self._labels = wait_us, labels

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._state = handle.getValueState("waits", "waits array<struct<request_us: bigint, done: boolean, last_us: bigint, last_broken: boolean>>")

    def _due_ms(self, request_us: int) -> int:
        return (request_us + self._wait_us) // 1000 + 1

    def _known(self) -> dict[int, tuple[bool, int, bool]]:
        state = self._state.get()
        return {request_us: (done, last_us, last_broken) for request_us, done, last_us, last_broken in state[0]} if state else {}

    def _keep(self, waits: dict[int, tuple[bool, int, bool]], timer_ms: int | None) -> None:
        """Store ``waits`` and set the timer for the first of them, if it isn't at ``timer_ms``, where one is set."""
        if not waits:
            return self._state.clear()
        self._state.update(([(request_us, *wait) for request_us, wait in waits.items()],))
        due = self._due_ms(min(waits))
        if due != timer_ms:
            if timer_ms is not None:
                self._handle.deleteTimer(timer_ms)
            self._handle.registerTimer(due)

    def handleInitialState(self, key: tuple, initialState: Row, timerValues) -> None:
        self._keep({r["request_us"]: (bool(r["done"]), r["last_us"], bool(r["last_broken"])) for r in initialState["waits"]}, None)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        waits = self._known()
        timer_ms = self._due_ms(min(waits)) if waits else None
        best: dict[int, tuple[int, int]] = {}
        for *_, request_us, _, at, code in rows:
            done, last_us, last_broken = waits.get(request_us, (False, -1, False))
            if at > last_us:
                last_us, last_broken = at, bool(code % 2)
            waits[request_us] = done, last_us, last_broken
            if code // 2:
                found = (at, -(code // 2))
                best[request_us] = min(best.get(request_us, found), found)
        for request_us, (at, verdict) in best.items():
            done, *last = waits[request_us]
            if not done:
                waits[request_us] = True, *last
                yield self._row(*key, request_us, self._labels[0] if verdict == -_SUCCESS else self._labels[1], at)
        self._keep(waits, timer_ms)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        expired = expiredTimerInfo.getExpiryTimeInMs()
        now = max(timerValues.getCurrentWatermarkInMs(), expired + 1)
        waits = self._known()
        for request_us in [r for r in waits if self._due_ms(r) < now]:
            done, _, last_broken = waits.pop(request_us)
            if not done:
                yield self._row(*key, request_us, self._labels[3] if last_broken else self._labels[2], request_us + self._wait_us)
        self._keep(waits, None)

    def close(self) -> None:
        pass


def track_transitions_live(
    stream: DataFrame,
    *,
    key: str | Sequence[str],
    ts: str,
    request_ts: str,
    success: Column,
    failure: Column,
    call_failed: Column | None = None,
    timeout_seconds: int = fixed.FLEET_WAIT_SECONDS,
    lateness: str = LATENESS,
    labels: tuple[str, str, str, str] = (REACHED, ABORTED, TIMEOUT, TIMEOUT),
    open_waits: DataFrame | None = None,
) -> DataFrame:
    """Outcome of every request on a stream, emitted once and as soon as it is known.

    State is one typed row per key that lists its open requests; a timer drops those whose
    deadline the watermark has passed. ``open_waits`` (see there) carries over what was known before the stream began.
    The session is set to the state store that timers need; a request has at most as many samples
    as polls fit into its waiting time.
    """
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    keys = [key] if isinstance(key, str) else list(key)
    watched = stream.withWatermark(ts, lateness)
    samples = _samples(watched, keys, ts, request_ts, success, failure, call_failed, timeout_seconds)
    packed = samples.select(
        *keys,
        F.unix_micros("request_ts").alias("request_us"),
        "ts",
        F.unix_micros("ts").alias("at_us"),
        (F.col("verdict") * 2 + F.col("broken").cast("int")).alias("code"),
    )
    types = {f.name: f.dataType for f in packed.schema.fields}
    output = T.StructType(
        [T.StructField(k, types[k]) for k in keys]
        + [T.StructField("request_us", T.LongType()), T.StructField("outcome", T.StringType()), T.StructField("outcome_us", T.LongType())]
    )
    known = None
    if open_waits is not None:
        wait = F.struct(F.unix_micros("request_ts").alias("request_us"), "done", "last_us", "last_broken")
        known = open_waits.groupBy(*keys).agg(F.collect_list(wait).alias("waits")).groupBy(*keys)
    outcomes = packed.groupBy(*keys).transformWithState(
        _Waits(output.names, timeout_seconds * 1_000_000, labels), output, "Append", "EventTime", initialState=known
    )
    return outcomes.select(
        *keys,
        F.timestamp_micros("request_us").alias("request_ts"),
        "outcome",
        F.timestamp_micros("outcome_us").alias("outcome_ts"),
    )


def open_waits(
    history: DataFrame,
    *,
    key: str | Sequence[str],
    ts: str,
    request_ts: str,
    success: Column,
    failure: Column,
    as_of: Column,
    call_failed: Column | None = None,
    timeout_seconds: int = fixed.FLEET_WAIT_SECONDS,
    labels: tuple[str, str, str, str] = (REACHED, ABORTED, TIMEOUT, TIMEOUT),
) -> DataFrame:
    """Waits of a history table whose deadline is not before ``as_of``: ``key.., request_ts, done, last_us, last_broken``.

    A stream that goes on from there takes them as initial state and repeats no outcome that
    ``track_history`` has stated already.
    """
    keys = [key] if isinstance(key, str) else list(key)
    samples = _samples(history, keys, ts, request_ts, success, failure, call_failed, timeout_seconds)
    grouped = samples.groupBy(*keys, "request_ts").agg(*_facts()).where(F.col("_deadline") >= as_of)
    return grouped.select(
        *keys,
        "request_ts",
        (F.col("_good").isNotNull() | F.col("_bad").isNotNull()).alias("done"),
        F.shiftright("_last", 1).alias("last_us"),
        (F.pmod("_last", F.lit(2)) == 1).alias("last_broken"),
    )


def track_history(
    history: DataFrame,
    *,
    key: str | Sequence[str],
    ts: str,
    request_ts: str,
    success: Column,
    failure: Column,
    as_of: Column,
    call_failed: Column | None = None,
    timeout_seconds: int = fixed.FLEET_WAIT_SECONDS,
    labels: tuple[str, str, str, str] = (REACHED, ABORTED, TIMEOUT, TIMEOUT),
) -> DataFrame:
    """Batch twin of ``track_transitions``: outcomes known at ``as_of``, open waits PENDING.

    Conditional minima with map-side partial aggregation; no group is held in a task.
    """
    keys = [key] if isinstance(key, str) else list(key)
    samples = _samples(history, keys, ts, request_ts, success, failure, call_failed, timeout_seconds)
    grouped = samples.groupBy(*keys, "request_ts").agg(*_facts())
    return _decide(grouped, keys, labels, F.col("_deadline") < as_of)


# --- conditions of the known waits -------------------------------------------------------


def fleet_wait(status: str | Column, target: str | Column, abort: str = fixed.FLEET_ABORT) -> dict:
    """Wait for a fleet status; the protected state aborts."""
    value = F.col(status) if isinstance(status, str) else status
    wanted = F.lit(target) if isinstance(target, str) else target
    return {"success": value == wanted, "failure": value == abort, "timeout_seconds": fixed.FLEET_WAIT_SECONDS}


def update_wait(cluster_status: str, stack_status: str) -> dict:
    """Wait for an update: both statuses must be complete, either one can fail it."""
    both = (F.col(cluster_status) == fixed.UPDATE_DONE) & (F.col(stack_status) == fixed.UPDATE_DONE)
    either = F.col(cluster_status).isin(*fixed.UPDATE_FAILED) | F.col(stack_status).isin(*fixed.UPDATE_FAILED)
    return {"success": both, "failure": either, "timeout_seconds": fixed.FLEET_WAIT_SECONDS}


def create_wait(text: str, rc: str) -> dict:
    """Wait for a creation: created, failed, still building, or the last call failed."""
    answered = F.col(rc) == 0
    failed = F.lit(False)
    for phrase in fixed.CREATE_FAILED:
        failed = failed | F.contains(F.col(text), F.lit(phrase))
    created = F.contains(F.col(text), F.lit(fixed.CREATE_DONE))
    return {
        "success": answered & created & ~failed,
        "failure": answered & failed,
        "call_failed": ~answered,
        "timeout_seconds": fixed.CREATE_WAIT_SECONDS,
        "labels": ("created", "failed", "not_terminal", "call_failed"),
    }


def delete_wait(text: str) -> dict:
    """Wait for a deletion: confirmed, failed, or never confirmed."""
    outcome = deletion_outcome(F.col(text))
    return {
        "success": outcome == "confirmed",
        "failure": outcome == "delete_failed",
        "timeout_seconds": fixed.DELETE_WAIT_SECONDS,
        "labels": ("confirmed", "delete_failed", "unconfirmed", "unconfirmed"),
    }
