"""Spend per cluster: look-back windows, cost by tag, and the cost report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetloom.functions import fixed_values as fixed
from fleetloom.functions.text import as_col
from fleetloom.functions.values import as_instant, to_money

MAX_DAYS = 365


def lookback_days(df: DataFrame, ts: str, days: int, as_of: str, most: int | None = MAX_DAYS) -> DataFrame:
    """Rows of ``[as_of - days, as_of)``; the literal bounds reach the scan. More than ``most`` days (None: no limit) are an error."""
    if days < 1 or (most is not None and days > most):
        raise ValueError("days must be at least 1" + (f" and at most {most}" if most is not None else ""))
    end = F.to_timestamp(F.lit(as_of)).cast(df.schema[ts].dataType)
    start = (F.to_timestamp(F.lit(as_of)) - F.make_dt_interval(F.lit(days))).cast(df.schema[ts].dataType)
    return df.where((F.col(ts) >= start) & (F.col(ts) < end))


def lookback_hours(df: DataFrame, ts: str, hours: int, as_of: str) -> DataFrame:
    """Rows not older than ``hours`` (at least 1) before ``as_of``."""
    if hours < 1:
        raise ValueError("hours must be at least 1")
    start = F.to_timestamp(F.lit(as_of)) - F.make_dt_interval(F.lit(0), F.lit(hours))
    return df.where(F.col(ts) >= start.cast(df.schema[ts].dataType))


def _amount(lines: DataFrame, amount: str) -> Column:
    """Text amounts are parsed (broken ones drop out of the sum); numbers are used as they are."""
    if lines.schema[amount].dataType.simpleString() == "string":
        return to_money(amount)
    return F.col(amount)


def cost_by_tag(
    lines: DataFrame, *, key: str | Column, amount: str, ts: str, days: int, as_of: str, name: str = "cluster"
) -> DataFrame:
    """Total amount per tag value in the look-back window."""
    recent = lookback_days(lines, ts, days, as_of).withColumn("_amount", _amount(lines, amount))
    return recent.groupBy(as_col(key).alias(name)).agg(F.coalesce(F.sum("_amount"), F.lit(0)).alias("total"))


def cost_by_tag_month(
    lines: DataFrame, *, key: str | Column, amount: str, ts: str, days: int, as_of: str, name: str = "cluster"
) -> DataFrame:
    """Total per tag value and calendar month; the first and last month may be partial."""
    recent = lookback_days(lines, ts, days, as_of).withColumn("_amount", _amount(lines, amount))
    month = F.trunc(F.col(ts).cast("date"), "MM").alias("month")
    return recent.groupBy(as_col(key).alias(name), month).agg(F.coalesce(F.sum("_amount"), F.lit(0)).alias("total"))


def tag_active(probes: DataFrame, tags: DataFrame, *, probe: str, tag_key: str, key_column: str, status: str) -> DataFrame:
    """Whether the probed key is an active allocation tag: TRUE, FALSE, or NULL if unreadable.

    ``probes`` has one row per probe with the key asked for and ``readable``. Tags are
    reduced to one flag per key before the join.
    """
    per_key = tags.groupBy(F.col(key_column).alias(tag_key)).agg(F.bool_or(F.col(status) == "Active").alias("_active"))
    joined = probes.join(per_key, tag_key, "left")
    return joined.select(
        probe, tag_key, F.when(F.col("readable"), F.coalesce(F.col("_active"), F.lit(False))).alias("active")
    )


def cost_report(
    names: DataFrame,
    inventory: DataFrame,
    cost: DataFrame,
    errors: DataFrame | None = None,
    *,
    key: str = "cluster",
    owner: str | None = None,
) -> DataFrame:
    """One row per requested cluster with owner, region, total and a status.

    A cluster without a record keeps ``unknown``; the owner filter runs before the cost
    join. ``status`` is ``unavailable`` (source error), ``zero`` or ``value``.
    """
    known = names.join(inventory.select(key, "owner", "region"), key, "left").withColumns(
        {"owner": F.coalesce("owner", F.lit(fixed.TEXT_NO_RECORD)), "region": F.coalesce("region", F.lit(fixed.TEXT_NO_RECORD))}
    )
    if owner is not None:
        known = known.where(F.col("owner") == owner)
    joined = known.join(cost.select(key, "total"), key, "left")
    if errors is None:
        joined = joined.withColumn("error", F.lit(None).cast("string"))
    else:
        joined = joined.join(errors.select(key, "error"), key, "left")
    total = F.coalesce(F.col("total"), F.lit(0))
    failed = F.col("error").isNotNull()
    return joined.select(
        key,
        "owner",
        "region",
        F.when(~failed, total).alias("total"),
        F.when(failed, "unavailable").when(total == 0, "zero").otherwise("value").alias("status"),
        "error",
    )


def cost_label(total: str | Column, error: str | Column) -> Column:
    """Printed form of a cost: reason, ``$0.00 *`` for nothing, or dollars with two decimals."""
    amount = as_col(total).cast("double")
    return (
        F.when(as_col(error).isNotNull(), F.concat(F.lit(fixed.TEXT_COST_UNAVAILABLE), as_col(error)))
        .when(F.coalesce(amount, F.lit(0.0)) == 0, F.lit(fixed.TEXT_COST_ZERO))
        .otherwise(F.format_string("$%.2f", amount))
    )


def period_label(days: int, as_of: str) -> Column:
    """The window as ``start – end`` dates."""
    end = F.to_date(as_instant(as_of))
    return F.concat(F.date_sub(end, days).cast("string"), F.lit(" – "), end.cast("string"))
