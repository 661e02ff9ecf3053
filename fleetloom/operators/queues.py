"""Queues and instance types: summaries, ranks, architecture, capability, inheritance, changes."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetloom.functions import fixed_values as fixed
from fleetloom.functions.text import has_prefix
from fleetloom.operators.kernels import first_per_key


def instance_catalog(categories: Mapping[str, DataFrame], *, type_col: str = "instance_type") -> DataFrame:
    """Category lists as one catalog ``(instance_type, category)``."""
    catalog = None
    for category, types in categories.items():
        part = types.select(type_col, F.lit(category).alias("category"))
        catalog = part if catalog is None else catalog.unionByName(part)
    return catalog


def queue_types(queue: str = "queue") -> Column:
    """Instance types of a queue in document order, duplicates kept, absent levels empty."""
    empty = F.array().cast("array<string>")
    per_resource = F.transform(F.col(f"{queue}.resources"), lambda r: F.coalesce(r["instances"], empty))
    return F.coalesce(F.flatten(per_resource), empty)


def queue_summary(configs: DataFrame, *, key: Sequence[str] = ("cluster", "pos"), queue: str = "queue") -> DataFrame:
    """One row per queue: smallest and largest size over its resources, types, kind.

    Sums run inside the nested row, so nothing is exploded or shuffled.
    """
    zero = F.lit(0).cast("bigint")

    def total(member: str) -> Column:
        sizes = F.transform(F.col(f"{queue}.resources"), lambda r: F.coalesce(r[member].cast("bigint"), zero))
        return F.coalesce(F.aggregate(sizes, zero, lambda a, x: a + x), zero)

    types = queue_types(queue)
    gpu = F.exists(types, lambda t: has_prefix(t, fixed.GPU_PREFIXES))
    return configs.select(
        *key,
        F.col(f"{queue}.name").alias("name"),
        F.when(gpu, "gpu").otherwise("compute").alias("kind"),
        F.col(f"{queue}.capacity_type").alias("capacity_type"),
        total("min").alias("min_count"),
        total("max").alias("max_count"),
        types.alias("types"),
    )


def ranks_per_queue(
    queues: DataFrame, types: DataFrame, *, key: str | Sequence[str], type_list: str, count: str, floor: int | None = 1
) -> DataFrame:
    """Ranks every node of a queue can hold: the least count over its types.

    An unknown type counts 0 and an empty queue 0; ``floor`` lifts a queue that has types
    (vCPU ranks use 1, device ranks none).
    """
    keys = [key] if isinstance(key, str) else list(key)
    exploded = queues.select(*keys, F.explode_outer(type_list).alias("instance_type"))
    joined = exploded.join(types.select("instance_type", F.col(count).alias("_count")), "instance_type", "left")
    least = F.min(F.when(F.col("instance_type").isNotNull(), F.coalesce(F.col("_count"), F.lit(0))))
    lifted = F.greatest(least, F.lit(floor)) if floor is not None else least
    ranks = F.when(F.count("instance_type") > 0, lifted).otherwise(0)
    return joined.groupBy(*keys).agg(ranks.cast("bigint").alias("ranks"))


def arch_consistency(types: DataFrame, *, key: str | Sequence[str], type_col: str = "instance_type", arch: str = "arch") -> DataFrame:
    """Architecture of each cluster: the single one, or NULL with ``mixed`` and a detail.

    ``detail`` lists each distinct type once as ``type=arch``; clusters without a type
    keep NULL and are not mixed.
    """
    keys = [key] if isinstance(key, str) else list(key)
    present = F.col(type_col).isNotNull()
    low, high = F.min(F.when(present, F.col(arch))), F.max(F.when(present, F.col(arch)))
    mixed = F.coalesce(F.col("_low") != F.col("_high"), F.lit(False))
    judged = types.groupBy(*keys).agg(low.alias("_low"), high.alias("_high")).withColumn("mixed", mixed)
    # only mixed clusters list their types, and each type once
    of_mixed = types.where(present).join(judged.where("mixed").select(*keys), keys, "left_semi")
    labels = F.collect_set(F.concat(F.col(type_col), F.lit("="), F.col(arch)))
    details = of_mixed.groupBy(*keys).agg(F.array_join(F.array_sort(labels), ", ").alias("detail"))
    return judged.join(details, keys, "left").select(*keys, F.when(~F.col("mixed"), F.col("_low")).alias("arch"), "mixed", "detail")


def static_fabric_types(spark: SparkSession, key: str = "instance_type") -> DataFrame:
    """The fixed list of fabric-capable types, the fallback where no live answer is at hand."""
    return spark.range(1).select(F.explode(F.lit(list(fixed.FABRIC_TYPES))).alias(key))


def not_capable(types: DataFrame, live: DataFrame, fallback: DataFrame | None = None, *, key: str = "instance_type") -> DataFrame:
    """Types outside the capability set: the live one, or the static one (by default the fixed list) when that is empty."""
    fallback = static_fabric_types(types.sparkSession, key) if fallback is None else fallback
    static = fallback.select(key).where(~live.exists())
    return types.join(live.select(key).unionByName(static), key, "left_anti")


def first_per_group(
    df: DataFrame, *, key: str | Sequence[str], order: str, private: str | None = None
) -> DataFrame:
    """First member per group, the group's size and an ``ambiguous`` flag when there are more."""
    keys = [key] if isinstance(key, str) else list(key)
    rows = df.where(F.col(private)) if private else df
    return rows.groupBy(*keys).agg(
        F.min(order).alias(order), F.count("*").alias("members"), (F.count("*") > 1).alias("ambiguous")
    )


def gpu_subnets(
    requests: DataFrame, subnets: DataFrame, *, key: str = "cluster", vpc: str = "vpc", zone: str = "zone", subnet: str = "subnet_id"
) -> DataFrame:
    """Subnet of every compute and GPU zone of a request, with how it was chosen.

    A request has ``compute_zones``, ``gpu_zones`` (empty: not given), ``private_compute``,
    ``private_gpu`` and ``compute_override`` (subnets given by hand). GPU queues reuse the
    compute subnets unless they ask for private ones and compute's are not known to be.
    """
    picks = subnets.groupBy(vpc, zone).agg(
        F.min(subnet).alias("_any"), F.min(F.when(F.col("private"), F.col(subnet))).alias("_private")
    )
    compute_private = F.col("private_compute") & (F.size("compute_override") == 0)
    reuse = (F.size("gpu_zones") == 0) & ~(F.col("private_gpu") & ~compute_private)
    gpu_zones = F.when(F.size("gpu_zones") > 0, F.col("gpu_zones")).otherwise(F.col("compute_zones"))

    def wanted(role: str, zones: Column, private: Column) -> Column:
        return F.transform(
            zones, lambda z, i: F.struct(F.lit(role).alias("role"), i.alias("pos"), z.alias(zone), private.alias("_want_private"))
        )

    by_hand = F.size("compute_override") > 0
    discovered = F.concat(
        F.when(by_hand, F.array().cast(f"array<struct<role:string,pos:int,{zone}:string,_want_private:boolean>>")).otherwise(
            wanted("compute", F.col("compute_zones"), F.col("private_compute"))
        ),
        F.when(
            reuse & by_hand, F.array().cast(f"array<struct<role:string,pos:int,{zone}:string,_want_private:boolean>>")
        )
        .when(reuse, wanted("gpu", F.col("compute_zones"), F.col("private_compute")))
        .otherwise(wanted("gpu", gpu_zones, F.col("private_gpu"))),
    )
    asked = requests.select(key, vpc, F.explode(discovered).alias("_w")).select(key, vpc, "_w.*")
    found = asked.join(picks, [vpc, zone], "left").select(
        key, "role", "pos", F.when(F.col("_want_private"), F.col("_private")).otherwise(F.col("_any")).alias(subnet)
    )
    given_roles = F.when(reuse, F.array(F.lit("compute"), F.lit("gpu"))).otherwise(F.array(F.lit("compute")))
    given = (
        requests.where(by_hand)
        .select(key, F.explode(given_roles).alias("role"), "compute_override")
        .select(key, "role", F.posexplode("compute_override").alias("pos", subnet))
    )
    return found.unionByName(given)


def inherit_first(queues: DataFrame, value: Column, *, key: str, pos: str = "pos", prefer: Column | None = None, default: Column | None = None, name: str = "inherited") -> DataFrame:
    """First non-null value over a cluster's queues in document order.

    ``prefer`` marks queues that go first (GPU queues, for subnets). Without any value the
    default applies.
    """
    later = F.lit(False) if prefer is None else ~F.coalesce(prefer, F.lit(False))
    order = F.struct(later, F.col(pos))
    picked = F.min_by(F.when(value.isNotNull(), value), F.when(value.isNotNull(), order))
    if default is not None:
        picked = F.coalesce(picked, default)
    return queues.groupBy(key).agg(picked.alias(name))


def _folded(rows: DataFrame) -> DataFrame:
    """Present queues (``reason`` null) and refused changes of rows ``(cluster, change, position, queue, action)`` that come in order."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: object = None
        started = False
        present: set = set()
        out: list[tuple] = []
        schema: pa.Schema | None = None

        def flushed() -> pa.RecordBatch:
            columns = [pa.array(values, field.type) for values, field in zip(zip(*out), schema)]
            out.clear()
            return pa.RecordBatch.from_arrays(columns, schema=schema)

        def close() -> None:
            out.extend((now, True, None, queue, None, None) for queue in sorted(present))

        for batch in batches:
            if schema is None:
                of = batch.schema
                schema = pa.schema([of.field(0), ("kept", pa.bool_()), of.field(2), of.field(3), ("action", pa.string()), ("reason", pa.string())])
            for cluster, change, position, queue, action in zip(*[c.to_pylist() for c in batch.columns]):
                if not started or cluster != now:
                    close()
                    now, started, present = cluster, True, set()
                if not change:
                    present.add(queue)
                    continue
                reason = None
                if action == "add":
                    if queue in present:
                        reason = "already exists"
                    present.add(queue)
                elif action == "remove":
                    if queue not in present:
                        reason = "not found"
                    elif len(present) == 1:
                        reason = "last queue"
                    else:
                        present.remove(queue)
                if reason:
                    out.append((cluster, False, position, queue, action, reason))
                if len(out) >= 10_000:
                    yield flushed()
        close()
        if out:
            yield flushed()

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    names = rows.columns
    columns = [f"`{names[0]}` {kinds[names[0]]}", "kept boolean", *[f"`{n}` {kinds[n]}" for n in names[2:4]], "action string", "reason string"]
    return rows.mapInArrow(fold, ", ".join(columns))


def queue_apply(
    queues: DataFrame, changes: DataFrame, *, cluster: str = "cluster", queue: str = "queue", position: str = "position"
) -> tuple[DataFrame, DataFrame]:
    """Apply ``add`` and ``remove`` changes in order of ``position``; returns the new queues and the rejected changes.

    Each change is judged against what the ones before it left: adding an existing queue,
    removing an unknown one and removing the last one are rejected with a reason and change
    nothing. Changes of equal position go by queue, then action; rows without a cluster or a queue
    count for nothing, nor do other actions. Clusters without changes are passed on as they are.

    A cluster's queues and then its changes pass through one task as a sorted stream, which holds
    the names of the queues that are present and nothing else, however many changes there are.
    """
    named = lambda df: df.where(F.col(cluster).isNotNull() & F.col(queue).isNotNull())
    asked = named(changes)
    touched = asked.select(cluster).distinct()
    have = named(queues).select(cluster, queue)
    kind = changes.schema[position].dataType
    start = have.join(touched, cluster, "left_semi").distinct().select(cluster, F.lit(False).alias("change"), F.lit(None).cast(kind).alias(position), queue, F.lit(None).cast("string").alias("action"))
    rows = start.unionByName(asked.select(cluster, F.lit(True).alias("change"), position, queue, "action"))
    done = _folded(rows.repartition(cluster).sortWithinPartitions(cluster, "change", position, queue, "action"))
    untouched = have.join(touched, cluster, "left_anti").select(cluster, queue)
    applied = untouched.unionByName(done.where("kept").select(cluster, queue))
    return applied, done.where("NOT kept").select(cluster, position, queue, "action", "reason")


def first_subnets(requests: DataFrame, subnets: DataFrame, **names: str) -> DataFrame:
    """Subnets of the requests in zone order, one row per cluster and role."""
    rows = gpu_subnets(requests, subnets, **names)
    subnet = names.get("subnet", "subnet_id")
    return first_per_key(rows, key=[names.get("key", "cluster"), "role"], order="pos", value=subnet)
