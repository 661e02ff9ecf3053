"""Building blocks shared by the operators: group picks, top-n, set differences, range match.

Picks are aggregations: every task reduces its own rows to one per key before the shuffle,
so a key that holds a third of the input sends no more than any other. A pick that carries
text or structs is aggregated over the task's rows sorted by key; picks of numbers are hashed.
Where more than one row per key survives (``top_n_per_key``) the ranking runs twice, first
over salted sub-groups.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetloom.functions.text import as_col

BINS = 64  # parts of the values of a key that ranges are matched in
GROUP_PAIRS = 10_000_000_000  # pairs that the rows of a part of average size may be compared in, if all ranges met in it; with more, the part is split
TASK_PAIRS = 10_000_000  # pairs, by the same measure of one part, that are worth a task


def _names(value: str | Sequence[str]) -> list[str]:
    return [value] if isinstance(value, str) else list(value)


def latest_per_key(
    df: DataFrame, *, key: str | Sequence[str], order: str | Sequence[str], value: str | Sequence[str]
) -> DataFrame:
    """The values of the row with the greatest ``order`` tuple per key."""
    return _pick(df, F.max_by, key, order, value)


def first_per_key(
    df: DataFrame, *, key: str | Sequence[str], order: str | Sequence[str], value: str | Sequence[str]
) -> DataFrame:
    """The values of the row with the smallest ``order`` tuple per key."""
    return _pick(df, F.min_by, key, order, value)


def _pick(df, pick, key, order, value) -> DataFrame:
    keys, orders, values = _names(key), _names(order), _names(value)
    picked = df.groupBy(*keys).agg(
        pick(F.struct(*[F.col(v) for v in values]), F.struct(*[F.col(o) for o in orders])).alias("picked")
    )
    return picked.select(*keys, *[F.col("picked")[v].alias(v) for v in values])


def top_n_per_key(
    df: DataFrame,
    *,
    key: str | Sequence[str],
    order: Sequence[Column],
    n: int,
    spread: Sequence[str],
    salts: int = 64,
) -> DataFrame:
    """The first ``n`` rows per key under ``order`` (which must be total).

    Ranks within ``salts`` sub-groups of each key, then among the survivors. Spark prunes
    to ``n`` rows per group before each shuffle, so the last stage sees at most
    ``salts * n`` rows of one key however many rows the key has.
    """
    keys = _names(key)
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*spread), F.lit(salts)))
    first = Window.partitionBy(*keys, "_salt").orderBy(*order)
    last = Window.partitionBy(*keys).orderBy(*order)
    survivors = salted.withColumn("_rank", F.row_number().over(first)).where(F.col("_rank") <= n)
    ranked = survivors.withColumn("_rank", F.row_number().over(last)).where(F.col("_rank") <= n)
    return ranked.drop("_salt").withColumnRenamed("_rank", "rank")


def side_flags(sides: dict[str, DataFrame], keys: Sequence[str]) -> DataFrame:
    """One row per distinct key with a flag per side: a single shuffle for any set expression."""
    tagged = None
    for name, df in sides.items():
        part = df.select(*keys, F.lit(name).alias("_side"))
        tagged = part if tagged is None else tagged.unionByName(part)
    return tagged.groupBy(*keys).agg(*[F.max(F.col("_side") == name).alias(name) for name in sides])


def range_match(
    df: DataFrame,
    ranges: DataFrame,
    *,
    key: str | Sequence[str],
    value: str,
    low: str = "low",
    high: str = "high",
    bins: int = BINS,
) -> DataFrame:
    """Rows joined to the ranges ``low <= value < high`` of their key; an absent ``high`` is open, an absent ``low`` matches nothing.

    The values of each key are cut into ``bins`` parts of about equal size, at quantiles of the data, so
    values of like size do not gather in one part. A closed range goes to the parts that it
    touches, each of which holds values. An open range makes no copies: it stands in the part of its
    beginning, and a row asks for that part and for the earlier ones with open ranges, all of which
    match. So copies are bounded by the parts or by the rows that come out. Parts are equi-joined with
    an exact check behind; the planner does not see how far ranges spread, so the joins are
    always sort-merge, whose skew adaptive execution splits.

    Pairs may be many where bytes are few. So the rows of a part are dealt to as many shares as
    the numbers of rows and ranges ask for, each of which meets the part's ranges on its own, and shares go to a number of
    tasks that grows likewise.
    """
    keys = _names(key)
    number = as_col(value).cast("double")
    lo, hi = F.col(low).cast("double"), F.col(high).cast("double")
    usable = df.where(number.isNotNull() & ~F.isnan(number))
    cuts = F.array_distinct(F.percentile_approx(number, [i / bins for i in range(1, bins)], 10 * bins)).alias("_cuts")
    edges = usable.groupBy(*keys).agg(cuts).hint("merge")
    part = lambda x: F.size(F.filter("_cuts", lambda e: e <= x))
    pairs = usable.count() * ranges.count() // bins
    shares = pairs // GROUP_PAIRS + 1
    tasks = min(pairs // TASK_PAIRS + 1, bins * shares)
    met = [*keys, "_part", "_share"]
    every = F.explode(F.sequence(F.lit(0), F.lit(shares - 1)).cast("array<bigint>"))
    left = usable.join(edges, keys).withColumn("_part", part(number)).drop("_cuts").withColumn("_share", F.monotonically_increasing_id() % shares)
    placed = ranges.where(lo.isNotNull()).join(edges, keys).withColumn("_part", part(lo))
    closed = placed.where(lo < hi).withColumn("_part", F.explode(F.sequence("_part", part(hi)))).drop("_cuts")
    closed = closed.withColumn("_share", every).repartition(tasks, *met).hint("merge")
    inside = (F.col(value) >= F.col(low)) & (F.col(value) < F.col(high))
    within = left.repartition(tasks, *met).join(closed, met).where(inside).drop("_part", "_share")
    open_ = placed.where(hi.isNull()).drop("_cuts")
    begins = open_.groupBy(*keys).agg(F.collect_set("_part").alias("_begins"))  # at most as many as bins
    asking = left.join(begins.hint("merge"), keys).withColumn("_part", F.explode(F.filter("_begins", lambda b: b <= F.col("_part")))).drop("_begins")
    open_ = open_.withColumn("_share", every).repartition(tasks, *met).hint("merge")
    above = asking.repartition(tasks, *met).join(open_, met).where(F.col(value) >= F.col(low)).drop("_part", "_share")
    return within.unionByName(above)
