"""Secret scan: fixed patterns, and character Markov models for random strings, in DataFrame operations only.

Places are found without a user function: every match is set between two marks that the text
cannot contain, the text is split at the marks, and lengths of the parts add up to places.

The models state how likely one character follows another in random strings and in ordinary
identifiers. They are learned from strings of all documents: values that the fixed patterns find are
random, long words elsewhere are ordinary. A run of token characters whose log-likelihood
ratio is high enough is reported too.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetloom.llm.common import id_and_text
from fleetloom.session import durable_copy

# fixed values: the patterns of the three kinds
_NAME = r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])"""
ASSIGN = rf"""({_NAME}["']?\x20*[:=]\x20*["']?)([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"()(AKIA[A-Z0-9]{14,})"
HEX = r"()([0-9a-f]{16,})"
KINDS = ("assign", "access", "hex", "markov")
LEAST_VALUE = 12

LEAST_RUN = 16  # characters of a run that the models judge: those of the shortest fixed pattern
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
WORD = r"[A-Za-z_]{8,}"
HELD_OUT = 5  # one in so many strings is kept to choose the limit
UNSEEN_RANDOM, UNSEEN_ORDINARY = 0.3, 0.02  # weight of the uniform model in each

_MARK, _INNER, _PLAIN, _TAKEN = "\ue000", "\ue001", "\ue002", "\ue003"  # of the private-use area
SPAN = "struct<start: int, kind: int, end: int>"
_CHUNK = 64  # numbers that are added up at once
_BLOCK = 64  # code points of a text that are cut at once


def spans_of(text: Column, pattern: str, kind: int, least: int) -> Column:
    """Spans of the matches of ``pattern`` whose second group has ``least`` or more characters.

    The pattern has two groups that cover it. Places are code points, the end exclusive. A text
    without a match is not taken apart.
    """
    return F.transform(_matches(text, pattern, kind, least), lambda m: F.struct(m["start"].alias("start"), m["kind"].alias("kind"), m["end"].alias("end")))


def _matches(text: Column, pattern: str, kind: int, least: int) -> Column:
    """``spans_of`` with the ``value`` of each second group."""
    marked = F.regexp_replace(text, pattern, f"{_MARK}$1{_INNER}$2{_MARK}")
    size = lambda p: F.length(p) - F.contains(p, F.lit(_INNER)).cast("int")

    def placed(parts: Column) -> Column:
        def at(ends: Column) -> Column:
            def match(part: Column, i: Column) -> Column:
                end, value = F.get(ends, i), F.substring_index(part, _INNER, -1)
                found = F.struct((end - size(part)).alias("start"), F.lit(kind).alias("kind"), end.alias("end"), value.alias("value"))
                return F.when(F.contains(part, F.lit(_INNER)) & (F.length(value) >= least), found)

            return F.filter(F.transform(parts, match), lambda m: m.isNotNull())

        return _let(_running(F.transform(parts, size), lambda a, b: a + b), at)

    return F.when(F.rlike(text, F.lit(pattern)), _let(F.split(marked, _MARK), placed)).otherwise(F.array().cast(f"array<{_MATCH}>"))


_MATCH = "struct<start: int, kind: int, end: int, value: string>"


def _let(value: Column, then) -> Column:
    """``then(value)`` with the value worked out once, however often it is used."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _running(values: Column, join) -> Column:
    """What ``join`` makes of each number and all before it (0 counts for nothing).

    An array that grows with a fold is copied in each of its steps. So only numbers are folded: over
    chunks, over the chunks before, and within a chunk up to each place.
    """
    fold = lambda part: F.aggregate(part, F.lit(0), join)
    chunk = lambda i: F.floor(i / _CHUNK).cast("int")
    numbered = lambda n: F.sequence(F.lit(0), n - 1)

    def whole(v: Column) -> Column:
        chunks = chunk(F.size(v) - 1) + 1
        each = F.transform(numbered(chunks), lambda j: fold(F.slice(v, j * _CHUNK + 1, F.lit(_CHUNK))))
        before = lambda sums: F.transform(numbered(chunks), lambda j: fold(F.slice(sums, F.lit(1), j)))
        within = lambda i: fold(F.slice(v, chunk(i) * _CHUNK + 1, i - chunk(i) * _CHUNK + 1))
        placed = lambda held: F.transform(numbered(F.size(v)), lambda i: join(F.get(held, chunk(i)), within(i)))
        return F.when(F.size(v) > 0, _let(_let(each, before), placed)).otherwise(F.array().cast("array<int>"))

    return _let(values, whole)


def plain(text: Column) -> Column:
    """``text`` (null: empty) with the marks' code points replaced one for one by another, so places stay."""
    return F.translate(F.coalesce(text, F.lit("")), _MARK + _INNER + _TAKEN, _PLAIN * 3)


def _pieces(text: Column, spans: Column, between: Column | str) -> Column:
    """``text`` with each of its ``spans`` (sorted, none within another's) replaced; ``between`` is a text, or a function of the span."""
    blocks = F.regexp_extract_all(text, F.lit(rf"(?s).{{1,{_BLOCK}}}"), F.lit(0))

    def joined(v: Column) -> Column:
        def cut(start: Column, end: Column) -> Column:
            first = F.floor(start / _BLOCK).cast("int")
            part = F.array_join(F.slice(v["blocks"], first + 1, F.floor((end - 1) / _BLOCK).cast("int") - first + 1), "")
            return F.when(end > start, F.substr(part, start - first * _BLOCK + 1, end - start)).otherwise("")

        n, span = F.size(v["spans"]), lambda i: F.get(v["spans"], i)
        start = lambda i: F.when(i == 0, 0).otherwise(span(i - 1)["end"])
        end = lambda i: F.when(i == n, v["size"]).otherwise(span(i)["start"])
        filled = lambda i: F.when(i == n, "").otherwise(between(span(i)) if callable(between) else F.lit(between))
        return F.array_join(F.transform(F.sequence(F.lit(0), n), lambda i: F.concat(cut(start(i), end(i)), filled(i))), "")

    return _let(F.struct(blocks.alias("blocks"), spans.alias("spans"), F.length(text).alias("size")), joined)


def _merged(spans: Column) -> Column:
    """Sorted spans, with those that overlap as one."""

    def reach(ends: Column) -> Column:
        fresh = F.filter(F.sequence(F.lit(0), F.size(spans) - 1), lambda i: (i == 0) | (F.get(spans, i)["start"] >= F.get(ends, i - 1)))

        def groups(first: Column) -> Column:
            last = lambda k: F.coalesce(F.get(first, k + 1), F.size(spans)) - 1
            return F.transform(first, lambda i, k: F.struct(F.get(spans, i)["start"].alias("start"), F.get(ends, last(k)).alias("end")))

        return _let(fresh, groups)

    none = F.array().cast("array<struct<start: int, end: int>>")
    return F.when(F.size(spans) > 0, _let(_running(F.transform(spans, lambda s: s["end"]), lambda a, b: F.greatest(a, b)), reach)).otherwise(none)


def base_spans(text: Column) -> Column:
    """Spans of the three fixed kinds, by start and then kind."""
    found = F.concat(spans_of(text, ASSIGN, 0, LEAST_VALUE), spans_of(text, ACCESS, 1, 0), spans_of(text, HEX, 2, 0))
    return F.array_sort(found)


@dataclass(frozen=True)
class Models:
    """Log-likelihood ratio (random over ordinary) of each character after each, row-major over ``ALPHABET``; from ``limit`` on a run is random."""

    ratios: tuple[float, ...]
    limit: float = 0.0

    def ratio(self, token: Column) -> Column:
        """Sum of the ratios over all neighbouring characters of ``token`` (characters of ``ALPHABET`` only)."""
        table = F.lit(list(self.ratios))
        place = lambda i: F.instr(F.lit(ALPHABET), F.substr(token, i, F.lit(1))) - 1
        step = lambda total, i: total + F.element_at(table, place(i) * len(ALPHABET) + place(i + 1) + 1)
        return F.when(F.length(token) > 1, F.aggregate(F.sequence(F.lit(1), F.length(token) - 1), F.lit(0.0), step)).otherwise(F.lit(0.0))


def _strings(rows: DataFrame) -> DataFrame:
    """``kind, value, n``: each distinct string of ``rows`` (``text``) that the models learn from, and how often it counts.

    Values that the fixed patterns find are ``random`` and count once, long words outside of them ``ordinary`` and count as often as they stand.
    """
    cut = lambda s: F.struct(F.lit("random").alias("kind"), F.substr("text", s["start"] + 1, s["end"] - s["start"]).alias("value"))
    bare = F.regexp_replace(F.regexp_replace("text", ASSIGN, " "), f"{ACCESS}|{HEX}", " ")
    words = F.transform(F.regexp_extract_all(bare, F.lit(WORD), F.lit(0)), lambda w: F.struct(F.lit("ordinary").alias("kind"), w.alias("value")))
    found = rows.select(F.inline(F.concat(F.transform(base_spans(F.col("text")), cut), words)))
    random = F.col("kind") == "random"
    value = F.when(random, F.regexp_extract("value", r"([A-Za-z0-9+/_=-]+)$", 1)).otherwise(F.col("value")).alias("value")
    counted = found.select("kind", value).groupBy("kind", "value").agg(F.count(F.lit(1)).alias("n"))
    return counted.filter(F.length("value") > 1).select("kind", "value", F.when(random, F.lit(1)).otherwise(F.col("n")).cast("long").alias("n"))


def _reached(scores: list[tuple[float, int]], share: float) -> float | None:
    """The least score that ``share`` of the strings do not exceed; ``scores`` are sorted, with the number of strings of each."""
    left = share * sum(n for _, n in scores)
    for score, n in scores:
        left -= n
        if left <= 0:
            return score
    return scores[-1][0] if scores else None


def learn(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> Models:
    """Learn both models from all of ``docs``.

    Random: the distinct values found by the fixed patterns. Ordinary: words of eight letters or more outside of
    such values. Strings are counted first, so each distinct one is taken apart once. What reaches the
    driver is one count for each pair of characters and for each thousandth of a score. Without any string all ratios are those of
    the uniform parts alone.

    One in ``HELD_OUT`` of the strings (by hash) is not learned from and chooses the limit: between what all but
    one in a thousand of the ordinary stay below and what nineteen in twenty of the random reach, judged for a run of
    ``LEAST_RUN`` characters. Where those overlap, the ordinary decide.
    """
    rows = id_and_text(docs, id_column, text_column).select(plain(F.col("text")).alias("text"))
    # written, for all documents are searched for it and it is read twice
    strings = durable_copy(_strings(rows), "strings")
    held = F.pmod(F.xxhash64(F.lit("held out"), "value"), F.lit(HELD_OUT)) == 0

    at = F.explode(F.sequence(F.lit(1), F.length("value") - 1)).alias("at")
    pairs = strings.filter(~held).select("kind", "value", "n", at).select("kind", F.substr("value", F.col("at"), F.lit(2)).alias("pair"), "n")
    counts = {(r["kind"], r["pair"]): r["n"] for r in pairs.groupBy("kind", "pair").agg(F.sum("n").alias("n")).collect()}

    size, ratios = len(ALPHABET), []
    for a in ALPHABET:
        totals = {k: sum(counts.get((k, a + b), 0) for b in ALPHABET) for k in ("random", "ordinary")}
        for b in ALPHABET:
            likely = lambda k, u: u / size + (1 - u) * counts.get((k, a + b), 0) / totals[k] if totals[k] else u / size  # noqa: E731, B023
            ratios.append(log(likely("random", UNSEEN_RANDOM) / likely("ordinary", UNSEEN_ORDINARY)))
    models = Models(tuple(ratios))
    each = F.round(models.ratio(F.col("value")) / (F.length("value") - 1) * (LEAST_RUN - 1), 3).alias("score")
    scores = strings.filter(held).select("kind", each, "n").groupBy("kind", "score").agg(F.sum("n").alias("n")).collect()
    judged = lambda kind, share: _reached(sorted((r["score"], r["n"]) for r in scores if r["kind"] == kind), share)
    ordinary, reached = judged("ordinary", 0.999), judged("random", 0.05)
    ordinary = 0.0 if ordinary is None else ordinary
    return Models(models.ratios, max(0.0, ordinary, ordinary if reached is None else (ordinary + reached) / 2))


def _own_spans(text: Column, base: Column, models: Models, limit: float) -> Column:
    """Runs of token characters that no base span touches and that the models call random.

    Base spans are overwritten with a mark that counts as a token character, so that a run which one touches holds it.
    """
    taken = lambda s: F.repeat(F.lit(_TAKEN), s["end"] - s["start"])
    free = F.when(F.size(base) > 0, _pieces(text, _merged(base), taken)).otherwise(text)
    runs = _let(free, lambda t: _matches(t, rf"()([A-Za-z0-9+/_={_TAKEN}-]{{{LEAST_RUN},}})", 3, 0))
    odd = F.filter(runs, lambda r: ~F.contains(r["value"], F.lit(_TAKEN)) & (models.ratio(r["value"]) >= limit))
    return F.transform(odd, lambda r: F.struct(r["start"].alias("start"), r["kind"].alias("kind"), r["end"].alias("end")))


def scan(docs: DataFrame, models: Models, least_ratio: float | None = None, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``doc_id, text, base, spans`` for every row: spans of the fixed kinds, and these with the models' own.

    ``text`` is the text that was scanned, null as empty. The models judge runs of ``LEAST_RUN`` or more token
    characters that no fixed span touches, by their own limit or ``least_ratio``. Spans are sorted by start, then kind; an empty text has none.
    """
    limit = models.limit if least_ratio is None else least_ratio
    rows = id_and_text(docs, id_column, text_column).select("doc_id", "text", plain(F.col("text")).alias("plain"))
    rows = rows.withColumn("base", base_spans(F.col("plain")))
    own = _own_spans(F.col("plain"), F.col("base"), models, limit)
    return rows.select("doc_id", "text", "base", F.array_sort(F.concat("base", own)).alias("spans"))


def stated(spans: str) -> Column:
    """Spans as ``kind:start:end``, joined by commas."""
    kind = lambda s: F.element_at(F.lit(list(KINDS)), s["kind"] + 1)
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", kind(s), s["start"], s["end"])), ",")


def redact(docs: DataFrame, models: Models, by: str = "<secret>", least_ratio: float | None = None, text_column: str = "text") -> DataFrame:
    """``docs`` with every span replaced by ``by`` in the text; overlapping spans become one. Null text stays null.

    All rows and columns stay; a column ``n_chars`` is set to the new number of characters where the text changed.
    """
    limit = models.limit if least_ratio is None else least_ratio
    # rows in one column, so that no name of theirs can clash
    named = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), plain(docs[text_column]).alias("plain"))
    named = named.withColumn("base", base_spans(F.col("plain")))
    named = named.select("row", F.array_sort(F.concat("base", _own_spans(F.col("plain"), F.col("base"), models, limit))).alias("spans"))
    changed, text = F.size("spans") > 0, F.col("row")[text_column]
    clean = F.when(changed, _pieces(text, _merged(F.col("spans")), by)).otherwise(text)
    named = named.select("row", changed.alias("changed"), clean.alias("clean"))
    out = {text_column: F.col("clean").alias(text_column)}
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out["n_chars"] = F.when(F.col("changed"), F.length("clean").cast(kind)).otherwise(F.col("row.n_chars")).alias("n_chars")
    return named.select(*[out.get(c, F.col("row")[c].alias(c)) for c in docs.columns])
