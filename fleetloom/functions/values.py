"""Value expressions: coercion, clamping, counts, dates and price labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fleetloom.functions.text import as_col, sanitize, strip

MONEY = "decimal(20,10)"


def as_instant(as_of: str | Column) -> Column:
    """A point in time: a timestamp column, or text such as ``2026-07-24`` (UTC)."""
    return F.to_timestamp(F.lit(as_of)) if isinstance(as_of, str) else as_of.cast("timestamp")


def to_int(c: str | Column, default: int = 0) -> Column:
    """Integer of a text or number; anything unreadable takes the default."""
    return F.coalesce(as_col(c).try_cast("bigint"), F.lit(default).cast("bigint"))


def to_text(c: str | Column, default: str = "") -> Column:
    return F.coalesce(sanitize(as_col(c).cast("string")), F.lit(default))


def to_bool(c: str | Column, kind: str = "string") -> Column:
    """Boolean of a configuration value; absent stays NULL so a rule can report it.

    ``kind`` is the type the value had in the source: text counts only as ``true``,
    a number counts when it is not zero.
    """
    value = as_col(c)
    if kind == "boolean":
        return value.cast("boolean")
    if kind == "int":
        return value.cast("bigint") != 0
    return F.lower(value) == "true"


def to_list(c: str | Column, kind: str = "string") -> Column:
    """String list of a comma text (blanks dropped) or of an array (nulls dropped); no dedup."""
    empty = F.array().cast("array<string>")
    if kind == "array":
        kept = F.filter(as_col(c), lambda x: x.isNotNull())
        return F.coalesce(F.transform(kept, lambda x: sanitize(x.cast("string"))), empty)
    parts = F.filter(F.transform(F.split(as_col(c), ","), strip), lambda x: x != "")
    return F.coalesce(F.transform(parts, sanitize), empty)


def to_money(c: str | Column) -> Column:
    """Decimal of an amount given as text; unparseable text is NULL and drops out of sums."""
    return as_col(c).try_cast(MONEY)


def clamp(c: str | Column, low: int, high: int) -> Column:
    """``(value, adjusted)`` with the value forced into ``[low, high]``."""
    value = as_col(c)
    forced = F.least(F.greatest(value, F.lit(low)), F.lit(high))
    kept = F.when(value.isNotNull(), forced)
    return F.struct(kept.alias("value"), (kept != value).alias("adjusted"))


def nvidia_gpu_count(gpus: str | Column) -> Column:
    """NVIDIA devices in an array of ``(manufacturer, count)``; missing levels count 0."""
    nvidia = F.filter(as_col(gpus), lambda g: F.upper(g["manufacturer"]) == "NVIDIA")
    counts = F.transform(nvidia, lambda g: F.coalesce(g["count"].cast("bigint"), F.lit(0).cast("bigint")))
    return F.coalesce(F.aggregate(counts, F.lit(0).cast("bigint"), lambda a, x: a + x), F.lit(0).cast("bigint"))


def usable_vcpus(vcpus: str | Column, threads_per_core: str | Column, hyperthreading: bool | Column) -> Column:
    """Schedulable vCPUs; without multithreading one per core."""
    total = F.coalesce(as_col(vcpus).cast("bigint"), F.lit(0).cast("bigint"))
    threads = F.coalesce(F.nullif(as_col(threads_per_core).cast("bigint"), F.lit(0).cast("bigint")), F.lit(1).cast("bigint"))
    on = F.lit(hyperthreading) if isinstance(hyperthreading, bool) else hyperthreading
    return F.when(on, total).otherwise(F.call_function("div", total, threads))


def age_label(deployed: str | Column, as_of: str | Column) -> Column:
    """Age of a ``D-Month-YYYY`` date: minutes below an hour, hours below two days, else days."""
    born = F.try_to_timestamp(as_col(deployed), F.lit("d-MMMM-yyyy"))
    minutes = F.floor((F.unix_micros(as_instant(as_of)) - F.unix_micros(born)) / F.lit(60_000_000))
    hours = F.floor(minutes / 60)
    return F.coalesce(
        F.when(minutes < 60, F.concat(minutes.cast("string"), F.lit("m")))
        .when(hours < 48, F.concat(hours.cast("string"), F.lit("h")))
        .when(minutes.isNotNull(), F.concat(F.floor(hours / 24).cast("string"), F.lit("d"))),
        F.lit("?"),
    )


def epoch_ms_text(c: str | Column) -> Column:
    """Epoch milliseconds as ``YYYY-mm-dd HH:MM:SS`` (session time zone UTC)."""
    return F.date_format(F.timestamp_millis(as_col(c)), "yyyy-MM-dd HH:mm:ss")


def price_range_label(low: str | Column, high: str | Column, *, spot: bool = False) -> Column:
    """``$lo–$hi/hr`` with three decimals; one price when they differ by less than 0.001."""
    lo, hi = as_col(low).cast("double"), as_col(high).cast("double")
    mark, tail = ("~", " spot") if spot else ("", "")
    one = F.format_string(f"{mark}$%.3f/hr{tail}", lo)
    two = F.format_string(f"{mark}$%.3f–$%.3f/hr{tail}", lo, hi)
    return F.when(lo.isNotNull(), F.when(F.abs(hi - lo) < 0.001, one).otherwise(two))


def run_cost(hourly: str | Column, instances: str | Column, minutes: str | Column) -> Column:
    """Cost of a run: rate per instance and hour over a number of minutes."""
    return as_col(hourly) * as_col(instances) * as_col(minutes) / F.lit(60)
