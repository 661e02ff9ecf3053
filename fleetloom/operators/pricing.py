"""Prices: on-demand look-up, latest spot price, range per queue, hourly fleet cost."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetloom.functions import fixed_values as fixed
from fleetloom.functions.values import MONEY
from fleetloom.operators.kernels import first_per_key, latest_per_key

PRICE_DOC = (
    "struct<terms:struct<OnDemand:map<string,"
    "struct<priceDimensions:map<string,struct<pricePerUnit:struct<USD:string>>>>>>>"
)


def location_of(region: str | Column, locations: Mapping[str, str] = fixed.REGION_LOCATIONS) -> Column:
    """Price-list location of a region; NULL when the map has no entry."""
    pairs = [F.lit(x) for item in locations.items() for x in item]
    return F.try_element_at(F.create_map(*pairs), F.col(region) if isinstance(region, str) else region)


def price_of_document(doc: str | Column) -> Column:
    """Price of the first dimension of the first on-demand term of a price document."""
    parsed = F.from_json(doc, PRICE_DOC)
    term = F.try_element_at(F.map_values(parsed["terms"]["OnDemand"]), F.lit(1))
    dimension = F.try_element_at(F.map_values(term["priceDimensions"]), F.lit(1))
    return dimension["pricePerUnit"]["USD"].try_cast(MONEY)


def ondemand_price(
    types: DataFrame,
    catalog: DataFrame,
    *,
    instance_type: str = "instance_type",
    region: str = "region",
    locations: Mapping[str, str] = fixed.REGION_LOCATIONS,
    terms: Mapping[str, str] = fixed.PRICE_TERMS,
) -> DataFrame:
    """``types`` with ``od_price`` or the ``reason`` there is none.

    The fixed terms are filters on the catalog scan. A document gives up its price in the task that
    reads it, so documents never travel; the price of the smallest sku per type and location is joined.
    """
    wanted = catalog
    for column, value in terms.items():
        wanted = wanted.where(F.col(column) == value)
    stated = wanted.select("instance_type", "location", "sku", price_of_document("doc").alias("od_price"))
    offers = first_per_key(stated, key=["instance_type", "location"], order="sku", value="od_price")
    priced = offers.select(F.col("instance_type").alias(instance_type), F.col("location").alias("_location"), F.lit(True).alias("_found"), "od_price")
    located = types.withColumn("_location", location_of(region, locations))
    reason = (
        F.when(F.col("_location").isNull(), "region not in location map")
        .when(F.col("_found").isNull(), "not found in price catalog")
        .when(F.col("od_price").isNull(), "unexpected price document")
    )
    joined = located.join(priced, [instance_type, "_location"], "left")
    return joined.withColumn("reason", reason).drop("_location", "_found")


def region_of_zone(zone: str | Column) -> Column:
    """Region of an availability zone: its name without the letters behind the last digit."""
    return F.regexp_extract(zone, r"^(.*[0-9])[a-z]+$", 1)


def latest_spot_price(
    history: DataFrame,
    *,
    tiebreak: str | Sequence[str],
    product: str | None = fixed.SPOT_PRODUCT_COST,
    zone: str | None = None,
    key: str | Sequence[str] = "instance_type",
    ts: str = "ts",
    price: str = "spot_price",
) -> DataFrame:
    """Newest price per ``key``, equal times told apart by ``tiebreak``.

    One product is looked at (the cost path's by default, None for all); the build path fixes
    its own and the zone. A fleet that spans regions has the region in ``key``.
    """
    rows = history
    if product is not None:
        rows = rows.where(F.col("product") == product)
    if zone is not None:
        rows = rows.where(F.col("availability_zone") == zone)
    ties = [tiebreak] if isinstance(tiebreak, str) else list(tiebreak)
    return latest_per_key(rows, key=key, order=[ts, *ties], value=price)


def unavailable_types(wanted: DataFrame, prices: DataFrame, *, key: str = "instance_type") -> DataFrame:
    """Wanted types without a price."""
    return wanted.join(prices.select(key), key, "left_anti")


def queue_price_range(
    queues: DataFrame,
    ondemand: DataFrame,
    spot: DataFrame,
    *,
    keys: Sequence[str],
    types: str,
    is_spot: str | Column,
    price_keys: Sequence[str] = ("instance_type",),
) -> DataFrame:
    """Lowest and highest price over the types of a queue.

    Both price tables are joined on ``price_keys``. Spot prices count only for types whose on-demand price was found. ``note`` says how
    many types are missing when some, but not all, are. ``is_spot`` is read per row.
    """
    spot_flag = F.col(is_spot) if isinstance(is_spot, str) else is_spot
    exploded = queues.withColumn("_spot", spot_flag).withColumn("instance_type", F.explode_outer(types))
    priced = exploded.join(ondemand.select(*price_keys, "od_price"), list(price_keys), "left").join(
        spot.select(*price_keys, "spot_price"), list(price_keys), "left"
    )
    found = F.col("od_price").isNotNull()
    used_spot = F.when(found & F.col("_spot"), F.col("spot_price"))
    totals = priced.groupBy(*keys).agg(
        F.min("od_price").alias("od_min"),
        F.max("od_price").alias("od_max"),
        F.min(used_spot).alias("spot_min"),
        F.max(used_spot).alias("spot_max"),
        F.count_if(found).alias("types_found"),
        F.count_if(~found & F.col("instance_type").isNotNull()).alias("types_failed"),
    )
    partial = (F.col("types_failed") > 0) & (F.col("types_found") > 0)
    return totals.withColumn(
        "note", F.when(partial, F.concat(F.col("types_failed").cast("string"), F.lit(fixed.TEXT_TYPES_MISSING)))
    )


def fleet_hourly_cost(inventory: DataFrame, ondemand: DataFrame, spot: DataFrame, *, key: str = "cluster_name") -> DataFrame:
    """Hourly cost at full size: one row per role (head, cpu, gpu) with a low and a high.

    The three roles are laid out inside the row, so the inventory is read once and priced
    in one join. Queue rows appear only when the queue is enabled, has types and can grow.
    Prices, on demand and spot, are those of the cluster's region.
    """
    spot_fleet = F.col("cluster_type") == "spot"

    def queue(role: str) -> Column:
        shown = (
            (F.col(f"enable_{role}_queue") == "true")
            & (F.size(f"{role}_instance_types") > 0)
            & (F.col(f"max_{role}_queue_size") > 0)
        )
        return F.when(
            shown,
            F.struct(
                F.lit(role).alias("role"),
                F.col(f"{role}_instance_types").alias("types"),
                F.col(f"max_{role}_queue_size").cast("bigint").alias("count"),
                spot_fleet.alias("spot"),
            ),
        )

    head = F.struct(
        F.lit("head").alias("role"),
        F.array("headnode_instance_type").alias("types"),
        F.lit(1).cast("bigint").alias("count"),
        F.lit(False).alias("spot"),
    )
    laid_out = F.filter(F.array(head, queue("cpu"), queue("gpu")), lambda x: x.isNotNull())
    rows = inventory.select(key, "region", F.explode(laid_out).alias("_r")).select(key, "region", "_r.*")
    ranges = queue_price_range(
        rows, ondemand, spot, keys=[key, "role", "count"], types="types", is_spot="spot",
        price_keys=("instance_type", "region"),
    )

    def bounds(low: str, high: str, prefix: str) -> list[Column]:
        lo, hi = F.col(low) * F.col("count"), F.col(high) * F.col("count")
        same = F.abs(hi - lo) < 0.001
        return [lo.alias(f"{prefix}_low"), F.when(same, lo).otherwise(hi).alias(f"{prefix}_high")]

    return ranges.select(
        key, "role", "count", *bounds("od_min", "od_max", "od"), *bounds("spot_min", "spot_max", "spot"), "note"
    )
