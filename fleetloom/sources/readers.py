"""Sources: inventory records, tool text with line numbers, JSON snapshots, pages, manifests."""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fleetloom.functions.text import parse_results_path
from fleetloom.functions.values import to_int, to_list, to_text
from fleetloom.session import durable_copy

# Record fields, the raw field each comes from, and its default.
TEXT_FIELDS = {
    "cluster_owner": ("cluster_owner", ""),
    "serial": ("cluster_serial_number", ""),
    "region": ("region", ""),
    "headnode_instance_type": ("headnode_instance_type", ""),
    "enable_cpu_queue": ("enable_cpu_queue", "false"),
    "enable_gpu_queue": ("enable_gpu_queue", "false"),
    "cluster_type": ("cluster_type", "ondemand"),
    "deployment_date": ("DEPLOYMENT_DATE", ""),
    "ssh_keypair": ("ssh_keypair", ""),
    "ec2_user": ("ec2_user", "ubuntu"),
    "s3_bucketname": ("s3_bucketname", ""),
    "enable_monitoring": ("enable_monitoring", "false"),
}
INT_FIELDS = ("initial_cpu_queue_size", "max_cpu_queue_size", "initial_gpu_queue_size", "max_gpu_queue_size")
LIST_FIELDS = ("cpu_instance_types", "gpu_instance_types")


def normalize_records(raw: DataFrame, *, name: str = "cluster_name", directory: str | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """Raw configuration rows as typed records of 19 fields.

    Fields absent from ``raw`` take their default; text is cleaned, broken numbers become
    0, lists may be arrays or comma text. ``directory`` names the cluster when the record
    itself does not. Columns of ``keep`` are passed on in front.
    """
    have = {f.name: f.dataType.simpleString() for f in raw.schema.fields}

    def source(column: str):
        return F.col(column) if column in have else F.lit(None).cast("string")

    fallback = F.col(directory) if directory else F.lit("")
    columns = [F.coalesce(to_text(source(name), None) if name in have else F.lit(None).cast("string"), fallback).alias("cluster_name")]
    for field, (column, default) in TEXT_FIELDS.items():
        columns.append(to_text(source(column), default).alias(field))
    for field in LIST_FIELDS:
        kind = "array" if have.get(field, "string").startswith("array") else "string"
        columns.append(to_list(source(field), kind).alias(field))
    for field in INT_FIELDS:
        columns.append(to_int(source(field)).alias(field))
    return raw.select(*keep, *columns)


# Fixed value: what is wrong with a cluster that has no record.
MISSING, UNREADABLE = "missing", "unreadable"


def scan_inventory(spark: SparkSession, path: str, names: DataFrame | None = None, *, stem: str = r"([^/]+)\.json$", key: str = "cluster_name") -> DataFrame:
    """Records and what is wrong, from one read of the record files below ``path``.

    Every file is one JSON document, named after its cluster (``stem`` finds the name in the path). A
    row has ``cluster``, the 19 fields of a record, ``problem`` and ``file``. A file that is no JSON object is
    ``unreadable`` and keeps its place with empty fields; with ``names`` (active clusters, ``key``) one
    without a file is ``missing`` and files of other clusters are left out. A cluster with several
    files takes the last readable one by path. So records are the rows without a problem, and the names
    to warn of are the others; a table written from this serves both without a second read.
    """
    fields = [key, *[raw for raw, _ in TEXT_FIELDS.values()], *LIST_FIELDS, *INT_FIELDS]
    schema = "array<struct<" + ", ".join(f"`{f}`: string" for f in dict.fromkeys(fields)) + ">>"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    files = files.select(F.regexp_extract("path", stem, 1).alias("cluster"), F.col("path").alias("file"), F.try_validate_utf8(F.col("content").cast("string")).alias("value"))
    # in brackets, for whatever stands behind an object would be passed over; an array inside is no record
    listed = F.from_json(F.concat(F.lit("["), "value", F.lit("]")), schema, {"mode": "PERMISSIVE"})
    read = files.select("cluster", "file", F.startswith(F.ltrim("value", F.lit(" \t\r\n")), F.lit("{")).alias("_object"), listed.alias("_list"))
    good = F.coalesce(F.col("_object") & (F.size("_list") == 1) & F.get("_list", F.lit(0)).isNotNull(), F.lit(False))
    read = read.select("cluster", "file", good.alias("_good"), F.when(good, F.get("_list", F.lit(0))).alias("_doc"))
    picked = read.groupBy("cluster").agg(F.max_by(F.struct("file", "_doc", "_good"), F.struct("_good", "file")).alias("_f"))
    if names is not None:
        picked = names.select(F.col(key).alias("cluster")).distinct().join(picked, "cluster", "left")
    flat = picked.select("cluster", "_f.file", "_f._good", "_f._doc.*")
    problem = F.when(F.col("file").isNull(), MISSING).when(~F.col("_good"), UNREADABLE)
    # lists may be arrays, comma text, or a JSON array that arrives as text
    listed = {f: F.when(F.startswith(f, F.lit("[")), F.from_json(f, "array<string>")).otherwise(F.transform(F.split(f, ","), lambda x: F.trim(x))) for f in LIST_FIELDS}
    cleared = flat.withColumns(listed).withColumn("_problem", problem)
    records = normalize_records(cleared, name=key, directory="cluster", keep=("cluster", "file", "_problem"))
    return records.withColumnRenamed("_problem", "problem")


def records_of(scan: DataFrame) -> DataFrame:
    """The typed records of ``scan_inventory``."""
    return scan.where(F.col("problem").isNull()).drop("cluster", "problem", "file")


def unreadable_names(scan: DataFrame) -> DataFrame:
    """``cluster, problem`` of clusters that ``scan_inventory`` found no record of."""
    return scan.where(F.col("problem").isNotNull()).select("cluster", "problem")


# Above any value of monotonically_increasing_id, and in range of a decimal of 19 digits.
SEQ_RANGE = Decimal(2**63)


def scan_tool_text(spark: SparkSession, path: str, *, root: str = "", files: Sequence[str] = ()) -> DataFrame:
    """Lines below ``path`` with the run keys of their file and a position within it.

    Files are split like any other input, so a huge one does not become one row. ``block``
    is the start of the split and ``seq`` grows within it; ``place`` is both in one number, which
    orders the lines of a file and serves wherever an operator asks for a position. Use
    ``number_lines`` only where a dense line number is wanted. ``files`` names the files wanted (patterns
    are allowed, without their folders); others are left out when files are listed and never opened.
    """
    reader = spark.read.option("lineSep", "\n").option("recursiveFileLookup", "true")
    if files:
        reader = reader.option("pathGlobFilter", "{" + ",".join(sorted({f.rpartition("/")[2] for f in files})) + "}")
    lines = reader.text(path)
    lines = lines.select(
        F.col("value").alias("line"),
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("seq"),
    )
    place = F.col("block").cast("decimal(19,0)") * F.lit(SEQ_RANGE) + F.col("seq")
    lines = lines.withColumn("place", place.cast("decimal(38,0)"))
    return lines.withColumn("_keys", parse_results_path("file", root)).select("*", "_keys.*").drop("_keys")


def number_lines(lines: DataFrame) -> DataFrame:
    """Add a dense 1-based ``line_no`` per file to the output of ``scan_tool_text``.

    Only the splits of a file are ranked (its size over the split size), never its lines.
    The lines are stored once first, because both uses below must see the same splits.
    """
    stored = durable_copy(lines, "lines")
    splits = stored.groupBy("file", "block").agg(F.min("seq").alias("_first"), F.count("*").alias("_count"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = splits.select("file", "block", "_first", F.coalesce(F.sum("_count").over(before), F.lit(0)).alias("_offset"))
    joined = stored.join(offsets, ["file", "block"])
    return joined.withColumn("line_no", F.col("seq") - F.col("_first") + F.col("_offset") + 1).drop("_first", "_offset", "block", "seq", "place")


def parse_snapshot(df: DataFrame, json_col: str, schema: str, *, into: str = "doc") -> DataFrame:
    """JSON text as typed columns; a broken document gives NULL fields, not a failed job."""
    return df.withColumn(into, F.from_json(json_col, schema, {"mode": "PERMISSIVE"}))


def paged_union(*pages: DataFrame) -> DataFrame:
    """Result pages as one table; columns a page lacks are NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), pages)


def read_pages(spark: SparkSession, paths: str | Sequence[str], fmt: str = "json", schema: str | None = None) -> DataFrame:
    """Stored pages read together as one scan."""
    reader = spark.read.format(fmt)
    if schema:
        reader = reader.schema(schema)
    return reader.load(list(paths) if not isinstance(paths, str) else paths)


# How a chain of pages ends, and what is wrong with a page.
COMPLETE, LOST, CYCLIC, NO_START = "complete", "missing", "cyclic", "no_start"
REPEATED, UNREACHED = "repeated", "unreached"


def order_pages(pages: DataFrame, *, chain: str, token: str = "token", next_token: str = "next_token") -> DataFrame:
    """Pages with their number in the walk from the first page of their chain along its tokens.

    A page has the ``token`` that it was asked for with (null or empty for the first) and the ``next_token`` that
    it names (null or empty for none). ``page_no`` counts from 1; ``defect`` is ``repeated`` for further copies of a page
    (the one with the least next token stands) and ``unreached`` for pages that the walk never comes to.

    The walk of all chains at once is list ranking: a jump of two to the k pages is two jumps of half of
    that, and what is reached doubles in each round. So rounds grow with the logarithm of the longest
    walk; the state of each is written to the shared folder, keys are unique, and rows are narrow.
    """
    known = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(""))
    rank = F.row_number().over(Window.partitionBy(chain, known(token)).orderBy(known(next_token), F.xxhash64(*pages.columns)))
    marked = pages.withColumn("_copy", rank > 1)
    stored = durable_copy(marked, "pages")
    links = stored.where(~F.col("_copy")).select(F.col(chain).alias("_chain"), known(token).alias("_token"), known(next_token).alias("_next"))
    # only jumps to pages that are there
    there = links.select(F.col("_chain").alias("_c"), F.col("_token").alias("_t"))
    meets = lambda a, b: F.col(a).eqNullSafe(F.col(b))
    jumps = durable_copy(links.where("_next <> ''").join(there, meets("_chain", "_c") & (F.col("_next") == F.col("_t")), "left_semi"), "jumps")
    reached = links.where("_token = ''").select("_chain", "_token", F.lit(1).cast("long").alias("page_no"))
    reached = durable_copy(reached, "reached")
    count, step = reached.count(), 1
    while True:
        hop = jumps.select(F.col("_chain").alias("_c"), F.col("_token").alias("_t"), "_next")
        further = reached.join(hop, meets("_chain", "_c") & (F.col("_token") == F.col("_t"))).select("_chain", F.col("_next").alias("_token"), (F.col("page_no") + step).alias("page_no"))
        # a page that a cycle comes to again keeps its first number
        reached = durable_copy(reached.unionByName(further).groupBy("_chain", "_token").agg(F.min("page_no").alias("page_no")), "reached")
        now = reached.count()
        if now == count:
            break
        twice = jumps.join(hop.withColumnRenamed("_next", "_after"), meets("_chain", "_c") & (F.col("_next") == F.col("_t")))
        jumps = durable_copy(twice.select("_chain", "_token", F.col("_after").alias("_next")), "jumps")
        count, step = now, step * 2
    joined = stored.join(reached, stored[chain].eqNullSafe(reached["_chain"]) & (known(token) == reached["_token"]) & ~stored["_copy"], "left")
    defect = F.when(F.col("_copy"), REPEATED).when(F.col("page_no").isNull(), UNREACHED)
    return joined.withColumn("defect", defect).select(*pages.columns, "page_no", "defect")


def page_walks(ordered: DataFrame, *, chain: str, token: str = "token", next_token: str = "next_token") -> DataFrame:
    """How the walk of each chain of ``order_pages`` ends: ``pages`` walked, ``ending`` and the token that ``stopped`` it.

    ``complete`` without a further token, ``missing`` where no page has the next one, ``cyclic`` where its page has been
    walked already, ``no_start`` without a first page; ``repeated`` and ``unreached`` count pages left aside.
    """
    known = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(""))
    walks = ordered.groupBy(chain).agg(
        F.count("page_no").alias("pages"),
        F.max_by(known(next_token), F.col("page_no")).alias("_next"),
        F.count_if(F.col("defect") == REPEATED).alias("repeated"),
        F.count_if(F.col("defect") == UNREACHED).alias("unreached"),
    )
    walked = ordered.where(F.col("page_no").isNotNull()).select(F.col(chain).alias("_chain"), known(token).alias("_token"), F.lit(True).alias("_there"))
    met = walks.join(walked, walks[chain].eqNullSafe(walked["_chain"]) & (F.col("_next") == F.col("_token")) & (F.col("_next") != ""), "left")
    ending = F.when(F.col("pages") == 0, NO_START).when(F.col("_next") == "", COMPLETE).when(F.col("_there"), CYCLIC).otherwise(LOST)
    return met.select(chain, "pages", ending.alias("ending"), F.when(F.col("_next") != "", F.col("_next")).alias("stopped"), "repeated", "unreached")


def verify_manifest(
    manifest: DataFrame, objects: DataFrame, *, key: str = "key", content: str = "content", expected: str = "expected"
) -> DataFrame:
    """Status per manifest entry: ``no_expected``, ``missing``, ``empty``, ``mismatch`` or ``ok``.

    Objects are reduced to their digest and size before the join, so content is not shuffled.
    """
    digests = objects.select(
        key, F.sha2(F.col(content), 256).alias("_digest"), F.octet_length(content).alias("_size"), F.lit(True).alias("_there")
    )
    joined = manifest.join(digests, key, "left")
    status = (
        F.when(F.coalesce(F.col(expected), F.lit("")) == "", "no_expected")
        .when(F.col("_there").isNull(), "missing")
        .when(F.coalesce(F.col("_size"), F.lit(0)) == 0, "empty")
        .when(F.col("_digest") != F.col(expected), "mismatch")
        .otherwise("ok")
    )
    return joined.withColumn("status", status).drop("_digest", "_size", "_there")


def read_objects(spark: SparkSession, path: str) -> DataFrame:
    """Files as ``(key, content)`` for ``verify_manifest``."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select(
        F.col("path").alias("key"), "content"
    )
