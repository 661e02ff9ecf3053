"""Access policies and sets: grants, scope, size, drift, coverage, prefixes."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetloom.functions import fixed_values as fixed
from fleetloom.functions.text import as_col, glob_match, glob_parts
from fleetloom.operators.kernels import side_flags
from fleetloom.session import tasks_for

RENDERED_A_TASK = 5_000  # policies that one task renders


def action_grants(docs: DataFrame, banned: Sequence[str], *, keys: Sequence[str] = ("doc", "sid"), actions: str = "actions") -> DataFrame:
    """Statements that grant a banned action, with the pattern that does.

    The banned actions are an argument: each statement tests its own patterns, with no join. A pattern is
    cut once; its literal beginning rules most actions out, and what is left is a search for its segments.
    """
    patterns = docs.select(*keys, F.explode(actions).alias("pattern"))
    cut = patterns.select(*keys, "pattern", glob_parts("pattern").alias("_parts"))
    hits = F.filter(F.array(*[F.lit(b) for b in banned]), lambda b: glob_match(b, F.col("_parts")))
    return cut.select(*keys, "pattern", F.explode(hits).alias("action"))


def arn_scope(docs: DataFrame, candidates: DataFrame, *, sid: str, doc: str = "doc", arn: str = "arn", patterns: str = "condition_patterns") -> DataFrame:
    """Candidates with ``allowed``: reachable through the patterns of the named statement.

    A policy document is at most 6,144 bytes, so one statement's patterns fit in a row, cut once, and
    candidates meet them through an equi-join on the document.
    """
    scoped = docs.where(F.col("sid") == sid).select(doc, F.transform(patterns, glob_parts).alias("_patterns"))
    joined = candidates.join(scoped, doc, "left")
    allowed = F.exists("_patterns", lambda p: glob_match(arn, p))
    return joined.withColumn("allowed", F.coalesce(allowed, F.lit(False))).drop("_patterns")


def render_template(template: str | Column, values: Mapping[str, str | Column]) -> Column:
    """Template text with each placeholder replaced, one after the other."""
    text = as_col(template)
    for placeholder, value in values.items():
        text = F.replace(text, F.lit(placeholder), as_col(value))
    return text


def policy_size(
    attachments: DataFrame,
    templates: DataFrame,
    values: Mapping[str, str | Column],
    *,
    template: str = "template",
    text: str = "text",
    limit: int = fixed.POLICY_BYTES_MAX,
    placeholders: Sequence[str] = fixed.POLICY_PLACEHOLDERS,
) -> DataFrame:
    """Rendered, minified size of each attached policy and whether it fits.

    ``attachments`` names the template each cluster uses, so the templates come in by an
    equi-join on their name. Text that is not JSON after rendering has no size. ``unfilled`` marks
    text in which one of ``placeholders`` is left. Attachments are dealt to tasks by their number
    first: a row is small, but costs its whole template many times over.
    """
    dealt = attachments.repartition(tasks_for(attachments, RENDERED_A_TASK))
    joined = dealt.join(templates.select(template, F.col(text).alias("_text")), template, "left")
    joined = joined.withColumn("_text", render_template("_text", values))
    minified = F.to_json(F.try_parse_json("_text"))
    size = F.octet_length(minified).cast("bigint")
    left = F.coalesce(F.exists(F.lit(list(placeholders)), lambda p: F.contains("_text", p)), F.lit(False))
    return joined.withColumns({"bytes": size, "fits": F.coalesce(size <= limit, F.lit(False)), "unfilled": left}).drop("_text")


def drift(expected: DataFrame, attached: DataFrame, known: DataFrame, *, keys: Sequence[str]) -> DataFrame:
    """Rows out of sync: ``stale`` (attached and known, not expected) and ``missing``.

    The three sets are reduced together in one shuffle.
    """
    flags = side_flags({"_expected": expected, "_attached": attached, "_known": known}, keys)
    stale = F.col("_attached") & F.col("_known") & ~F.col("_expected")
    missing = F.col("_expected") & ~F.col("_attached")
    status = F.when(stale, "stale").when(missing, "missing")
    return flags.select(*keys, status.alias("drift")).where(F.col("drift").isNotNull())


def coverage_diff(a: DataFrame, b: DataFrame, *, keys: Sequence[str], names: tuple[str, str] = ("left_only", "right_only")) -> DataFrame:
    """Keys found on one side only, with the side."""
    flags = side_flags({"_a": a, "_b": b}, keys)
    one = F.when(~F.col("_b"), names[0]).when(~F.col("_a"), names[1])
    return flags.select(*keys, one.alias("side")).where(F.col("side").isNotNull())


#: Size of prefixes, with their buckets and places, that may be broadcast.
DICTIONARY_BYTES = 64 << 20


def _met(listing: DataFrame, asked: Sequence[tuple]) -> DataFrame:
    """``(bucket, prefix)`` of ``asked`` that some key of ``listing`` (bucket, key) begins with, at most once from each task."""
    by_bucket: dict = {}
    for name, text in sorted(asked, key=lambda r: r[1]):
        by_bucket.setdefault(name, []).append(text)
    dictionary = {}
    for name, texts in by_bucket.items():
        above: list[int] = []  # the longest prefix that each prefix begins with
        open_: list[int] = []
        for at, text in enumerate(texts):
            while open_ and not text.startswith(texts[open_[-1]]):
                open_.pop()
            above.append(open_[-1] if open_ else -1)
            open_.append(at)
        dictionary[name] = (texts, above)
    shared = listing.sparkSession.sparkContext.broadcast(dictionary)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict = {}
        kind = None
        for batch in batches:
            kind = batch.schema.field(0).type
            for name, key in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                entry = shared.value.get(name)
                if entry is None or key is None:
                    continue
                texts, above = entry
                at = bisect_right(texts, key) - 1
                while at >= 0 and not key.startswith(texts[at]):
                    at = above[at]
                if at >= 0:
                    found.setdefault(name, set()).add(at)
        rows: list[tuple] = []
        for name, places in found.items():
            texts, above = shared.value[name]
            for at in list(places):
                while (at := above[at]) >= 0 and at not in places:
                    places.add(at)
            rows += [(name, texts[at]) for at in places]
        for at in range(0, len(rows), 10_000):
            part = rows[at : at + 10_000]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in part], kind), pa.array([r[1] for r in part], pa.string())], names=["bucket", "prefix"])

    return listing.mapInArrow(search, f"bucket {listing.schema[0].dataType.simpleString()}, prefix string")


def _cut(listing: DataFrame, asked: DataFrame, bucket: str, prefix: str, object_key: str) -> DataFrame:
    """The same by a join: keys cut to all lengths asked for anywhere; whole keys are not shuffled."""
    lengths = F.coalesce(asked.agg(F.collect_set(F.length(prefix))).scalar(), F.array().cast("array<int>"))
    cuts = F.transform(F.filter("_lengths", lambda n: n <= F.length(object_key)), lambda n: F.substring(F.col(object_key), F.lit(1), n))
    cut = listing.select(bucket, object_key, lengths.alias("_lengths")).select(bucket, F.explode(cuts).alias(prefix))
    return cut.distinct().join(asked, [bucket, prefix], "left_semi")


def prefix_status(
    prefixes: DataFrame,
    listing: DataFrame,
    buckets: DataFrame | None = None,
    *,
    bucket: str = "bucket",
    prefix: str = "prefix",
    object_key: str = "key",
    required: str = "required",
) -> DataFrame:
    """Status of each prefix: an undefined bucket is ``skipped``, an export prefix ``exempt``, others ``nonempty`` or ``empty``.

    ``buckets`` optionally lists ``(bucket, code)`` answers; a code other than NULL makes
    every prefix of that bucket ``access_denied`` (403) or ``bucket_not_found``.

    Prefixes asked for become a dictionary, sorted by bucket and text, with the longest one that each
    begins with. A key's successor search finds where it would stand; the prefixes that it begins
    with are the one before that place or those that one begins with in turn. A task marks what it meets and
    passes on each prefix once, so rows are bounded by the prefixes and keys are never shuffled. A
    dictionary above ``DICTIONARY_BYTES`` isn't broadcast: keys are then cut to the lengths asked for and joined.
    """
    asked = prefixes.where(F.col(required) & F.col(bucket).isNotNull() & F.col(prefix).isNotNull()).select(bucket, prefix).distinct()
    size = asked.agg(F.sum(F.octet_length(F.col(bucket).cast("string")) + F.octet_length(prefix) + 100)).first()[0] or 0
    seen = _met(listing.select(bucket, object_key), asked.collect()) if size <= DICTIONARY_BYTES else _cut(listing, asked, bucket, prefix, object_key)
    seen = seen.toDF(bucket, prefix).distinct().withColumn("_seen", F.lit(True))
    joined = prefixes.join(seen, [bucket, prefix], "left")
    if buckets is None:
        joined = joined.withColumn("_code", F.lit(None).cast("string"))
    else:
        joined = joined.join(buckets.select(bucket, F.col("code").cast("string").alias("_code")), bucket, "left")
    status = (
        F.when(F.coalesce(F.col(bucket), F.lit("")).isin("", fixed.TEXT_UNDEFINED), "skipped")
        .when(F.col("_code") == "403", "access_denied")
        .when(F.col("_code").isNotNull(), "bucket_not_found")
        .when(~F.col(required), "exempt")
        .when(F.col("_seen").isNotNull(), "nonempty")
        .otherwise("empty")
    )
    return joined.withColumn("status", status).drop("_seen", "_code")
