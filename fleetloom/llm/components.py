"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetloom.session import durable_copy


def _to_least(pairs: DataFrame, downward: bool) -> DataFrame:
    """One star step over rows ``(a, b)``, ``b`` a neighbour of ``a``: hook neighbours to the least one around ``a``."""
    least = pairs.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    hooked = pairs.join(least, "a")
    if downward:  # neighbours are all smaller than a: they and a go to the least
        edges = hooked.filter(F.col("b") != F.col("m")).select(F.col("b").alias("u"), F.col("m").alias("v"))
        return edges.unionByName(least.select(F.col("a").alias("u"), F.col("m").alias("v")))
    return hooked.filter(F.col("b") > F.col("a")).select(F.col("b").alias("u"), F.col("m").alias("v"))


def connected_components(edges: DataFrame, rounds: int = 50) -> DataFrame:
    """``node, root`` for every node that is not itself the least of its component.

    ``edges`` has columns ``u, v`` of one ordered type without nulls; direction, loops and
    repeats don't matter. Rounds grow with the logarithm of the longest chain. Each round is
    written to the shared folder, so lineage stays short and lost executors cost one round. A
    node with very many edges is no single task: its minimum is summed up before the shuffle and
    its join is one that adaptive execution may split.
    """
    ordered = edges.filter(F.col("u") != F.col("v")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    now = durable_copy(ordered.distinct(), "edges")
    seen = None
    for _ in range(rounds):
        state = now.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
        if state["n"] == 0 or (state["n"], state["x"]) == seen:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen = (state["n"], state["x"])
        both = now.select(F.col("u").alias("a"), F.col("v").alias("b")).unionByName(now.select(F.col("v").alias("a"), F.col("u").alias("b")))
        large = _to_least(both, downward=False).distinct()
        small = _to_least(large.select(F.col("u").alias("a"), F.col("v").alias("b")), downward=True)
        now = durable_copy(small.distinct(), "edges")
    raise RuntimeError(f"components did not settle in {rounds} rounds")
