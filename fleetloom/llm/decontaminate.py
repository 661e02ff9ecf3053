"""Benchmark decontamination by templates, in DataFrame operations only.

Texts are canonicalised to templates: any word with a digit becomes a number, a unit right
behind a number a unit, a capitalised word within a sentence a name; other words lose case and
punctuation. Windows of ``WINDOW`` template words are hash-joined; documents and benchmark items
both state one at every word, so every common run of ``WINDOW`` words is met and counts (windows
of mostly placeholders state nothing). With ``any_case``, windows of the lower-cased literal
words are joined as well, so that a copy in capitals, title case or lower case is met, and a
place agrees if either its template word or its literal word does. An item of fewer than
``WINDOW`` words is looked for as one window of all its literal words.
What meets is laid side by side: the share of the item that agrees in such runs, and whether the
values in its placeholders map one to one, which tells a question with new parameters from chance.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetloom.llm.common import id_and_text
from fleetloom.session import durable_copy

WINDOW = 8
LEAST_SHARE = 0.5
LEAST_LITERAL = 4  # words of a window that must not be placeholders
BROADCAST_WINDOWS = 2_000_000  # windows of the benchmark that may be broadcast; more are joined by a shuffle
LISTED_PAIRS = 50_000  # beginnings of windows that are listed in the plan to rule others out; with more, every window is joined

_NUMBER, _NAME, _UNIT = "\ue010", "\ue011", "\ue012"  # of the private-use area
# fixed values: units of measure and money
UNITS = (
    "mm", "cm", "m", "km", "inch", "inches", "ft", "foot", "feet", "yard", "yards", "mile", "miles", "mg", "g", "kg", "gram", "grams", "ton", "tons",
    "lb", "lbs", "pound", "pounds", "ounce", "ounces", "ml", "l", "liter", "liters", "litre", "litres", "gallon", "gallons", "second", "seconds",
    "minute", "minutes", "hour", "hours", "day", "days", "week", "weeks", "month", "months", "year", "years", "percent", "degree", "degrees", "dollar",
    "dollars", "cent", "cents", "euro", "euros", "meter", "meters", "metre", "metres", "kilometer", "kilometers", "watt", "watts", "volt", "volts",
)


def _words(text: Column) -> Column:
    """Lower-case words without punctuation; words of punctuation alone vanish."""
    bare = F.regexp_replace(F.lower(text), rf"[^\p{{L}}\p{{N}}\s{_NUMBER}{_NAME}{_UNIT}]+", "")
    return F.filter(F.split(bare, r"\s+"), lambda w: w != "")


def literal_words(text: str | Column) -> Column:
    """The words of ``text`` as they stand in their slots; one for each of ``template_words``."""
    return _words(F.col(text) if isinstance(text, str) else text)


def template_words(text: str | Column) -> Column:
    """The words of ``text`` with typed placeholders for numbers, units and names.

    Each step is a single pass that starts at a character few words have, and no step reads the
    one before it twice. A placeholder's own code point in a text counts as that placeholder.
    """
    text = F.col(text) if isinstance(text, str) else text
    named = F.regexp_replace(text, r"\p{Lu}(?<=[\p{L}\p{N},;:]\s\p{Lu})[\p{L}'-]*", _NAME)
    numbered = F.regexp_replace(named, r"(?<!\S)[^\s\d]*+\d\S*", _NUMBER)
    units = "|".join(sorted(UNITS, key=len, reverse=True))
    return _words(F.regexp_replace(numbered, rf"{_NUMBER}(\s)(?i:{units})(?![\p{{L}}\p{{N}}])", f"{_NUMBER}$1{_UNIT}"))


def _hashes(words: Column) -> Column:
    """A hash of each word."""
    return F.transform(words, lambda w: F.xxhash64(w))


def _windows(words: str, length: int | Column = WINDOW) -> Column:
    """``(at, h)`` for the window of ``length`` words at every word of ``words``, an array of hashes."""
    length = F.lit(length)
    hashed = lambda i: F.struct(i.alias("at"), F.xxhash64(F.slice(words, i + F.lit(1), length)).alias("h"))
    starts = F.sequence(F.lit(0), F.size(words) - length)
    return F.when(F.size(words) >= length, F.transform(starts, hashed)).otherwise(F.array().cast("array<struct<at: int, h: bigint>>"))


def _first(words: str, at: str, length: int) -> str:
    """What is told of the first two words of a window (of the only word, where it has one), as SQL."""
    return f"xxhash64(get({words}, {at}), get({words}, {at} + 1))" if length > 1 else f"get({words}, {at})"


def _met_windows(words: str, length: int, wanted: list[int] | None) -> Column:
    """``_windows`` whose first words are among ``wanted``; all, where no list is given.

    A look at two words rules most windows out before one is cut and hashed.
    """
    if wanted is None:
        return _windows(words, length)
    if not wanted:
        return F.array().cast("array<struct<at: int, h: bigint>>")
    starts = f"CASE WHEN size({words}) >= {length} THEN sequence(0, size({words}) - {length}) ELSE array() END"
    met = F.expr(f"filter({starts}, i -> {_first(words, 'i', length)} IN ({', '.join(f'{w}L' if w > -(1 << 63) else 'bigint(-9223372036854775807) - 1L' for w in wanted)}))")
    return F.transform(met, lambda i: F.struct(i.alias("at"), F.xxhash64(F.slice(words, i + F.lit(1), F.lit(length))).alias("h")))


def item_windows(items: DataFrame) -> DataFrame:
    """``h, key, item_at, first`` for every window of ``items`` (``key, words``, ``hashes`` of these) with enough literal words."""
    literal = lambda at: F.size(F.filter(F.slice("words", at + 1, WINDOW), lambda w: ~w.isin(_NUMBER, _NAME, _UNIT)))
    rows = items.select("key", "words", "hashes", F.inline(_windows("hashes")))
    return rows.filter(literal(F.col("at")) >= LEAST_LITERAL).select("h", "key", F.col("at").alias("item_at"), F.expr(_first("hashes", "at", WINDOW)).alias("first"))


def leaks(
    docs: DataFrame, benchmark: DataFrame, least_share: float = LEAST_SHARE, id_column: str = "doc_id", text_column: str = "text",
    item_column: str = "item_id", item_text: str = "text", any_case: bool = False, null_ids: bool = False,
) -> DataFrame:
    """A row for each document and benchmark item that it holds: ``doc_id, item_id, share, at, slots, changed``.

    ``share`` is the part of the item's template words that lie in agreeing runs of
    ``WINDOW`` words or more, at the place ``at`` of the document where that is largest (of equal ones the first).
    ``slots`` counts the item's placeholders in these runs, ``changed`` those whose value differs. A
    pair counts only if every value maps to one value and no two to the same. ``any_case`` also finds
    copies whose words stand in other case, which changes what counts as a name. An item of fewer than
    ``WINDOW`` words counts if all its words stand in the document as they are, apart from case and
    punctuation. Null and empty texts hold and meet nothing; rows with a null id are left out, or
    with ``null_ids`` judged by their texts. Repeated rows give one row; of items with one id and several texts each text is looked for. Items without an id are one item, whose id is null.
    """
    found = _leaks(docs, benchmark, least_share, id_column, text_column, item_column, item_text, any_case, null_ids)
    return found.select(F.when(F.col("known"), F.col("row")).alias("doc_id"), "item_id", "share", "at", "slots", "changed")


def _listed(windows: DataFrame) -> list[int] | None:
    """The beginnings of ``windows``, if they are few enough to list."""
    found = windows.select("first").distinct().limit(LISTED_PAIRS + 1).collect()
    return sorted(r["first"] for r in found) if len(found) <= LISTED_PAIRS else None


def _row_key(doc_id: Column, text: Column) -> list[Column]:
    """``known, row``: a row's id, or the hash of its text where it has none."""
    return [doc_id.isNotNull().alias("known"), F.coalesce(doc_id, F.xxhash64(F.coalesce(text, F.lit("")))).alias("row")]


def _leaks(
    docs: DataFrame, benchmark: DataFrame, least_share: float, id_column: str, text_column: str, item_column: str, item_text: str, any_case: bool, null_ids: bool,
) -> DataFrame:
    """``leaks`` with ``known, row`` in place of ``doc_id``."""
    items = id_and_text(benchmark, item_column, item_text).select(F.col("doc_id").alias("item_id"), "text").distinct()
    items = items.select("item_id", template_words("text").alias("words"), literal_words("text").alias("values")).filter(F.size("words") > 0)
    items = durable_copy(items.withColumn("key", F.xxhash64("item_id", "words", "values")), "items")
    of = lambda name: items.select("key", name, _hashes(F.col(name)).alias("hashes"))
    templates = item_windows(of("words"))
    literal = of("values").select("key", "hashes", F.inline(_windows("hashes")))
    literal = literal.select("h", "key", F.col("at").alias("item_at"), F.expr(_first("hashes", "at", WINDOW)).alias("first"))
    short = of("values").filter(F.size("values") < WINDOW).select(F.xxhash64("hashes").alias("h"), "key", F.lit(0).alias("item_at"), "hashes", F.size("values").alias("n"))
    lengths = sorted(x["n"] for x in short.select("n").distinct().collect())  # WINDOW - 1 at most
    # windows that documents state: of templates, of literal words, and of the lengths of short items
    stated = [("th", WINDOW, templates.drop("item_at"))]
    if any_case:
        stated.append(("vh", WINDOW, literal.drop("item_at")))
    stated += [("vh", n, short.filter(F.col("n") == n).select("h", "key", F.expr(_first("hashes", "0", n)).alias("first"))) for n in lengths]
    windows = templates.drop("first").unionByName(short.select("h", "key", "item_at"))
    if any_case:
        windows = windows.unionByName(literal.drop("first"))
    windows = durable_copy(windows.distinct(), "windows")
    few = windows.limit(BROADCAST_WINDOWS + 1).count() <= BROADCAST_WINDOWS

    rows = id_and_text(docs, id_column, text_column)
    rows = (rows if null_ids else rows.filter("doc_id is not null")).select(*_row_key(F.col("doc_id"), F.col("text")), "text")
    hashed = rows.select("known", "row", _hashes(template_words("text")).alias("th"), _hashes(literal_words("text")).alias("vh"))
    probes = hashed.select("known", "row", F.inline(F.concat(*[_met_windows(name, n, _listed(of)) for name, n, of in stated])))
    met = probes.join(F.broadcast(windows) if few else windows, "h")
    shifts = durable_copy(met.select("known", "row", "key", (F.col("at") - F.col("item_at")).alias("shift")).distinct(), "shifts")

    candidates = shifts.select("known", "row").distinct()
    sides = rows.join(candidates, ["known", "row"], "left_semi").distinct()
    sides = sides.select("known", "row", template_words("text").alias("dwords"), literal_words("text").alias("dvalues"))
    laid = shifts.join(items, "key").join(sides, ["known", "row"])

    # 0-based places of the item that fall into the document, as a string of agreements
    first = F.greatest(F.lit(0), -F.col("shift"))
    last = F.least(F.size("words"), F.size("dwords") - F.col("shift")) - 1
    laid = laid.withColumns({"first": first, "last": last}).filter("first <= last")
    equal = lambda a, b, i: F.get(a, i) == F.get(b, i + F.col("shift"))
    literally = F.lit(any_case) | (F.size("words") < WINDOW)
    agrees = lambda i: equal("words", "dwords", i) | (literally & equal("values", "dvalues", i))
    agree = lambda i: F.when(agrees(i), "1").otherwise("0")
    laid = laid.withColumn("agree", F.array_join(F.transform(F.sequence("first", "last"), agree), ""))
    run = F.least(F.lit(WINDOW), F.size("words"))
    full = lambda i: F.substr("agree", i - F.col("first") + 1, run) == F.repeat(F.lit("1"), run)
    starts = F.when(F.contains("agree", F.repeat(F.lit("1"), run)), F.filter(F.sequence("first", "last"), full)).otherwise(F.array().cast("array<int>"))
    held = F.array_distinct(F.flatten(F.transform(starts, lambda i: F.sequence(i, i + run - 1))))
    is_slot = lambda i: F.get("words", i).isin(_NUMBER, _NAME, _UNIT)
    pair = lambda i: F.struct(F.get("words", i).alias("k"), F.get("values", i).alias("a"), F.get("dvalues", i + F.col("shift")).alias("b"))
    laid = laid.withColumn("held", held).withColumn("pairs", F.transform(F.filter("held", is_slot), pair))
    side = lambda name: F.size(F.array_distinct(F.transform("pairs", lambda p: F.struct(p["k"], p[name]))))
    both = F.size(F.array_distinct("pairs"))
    scored = laid.select(
        "known", "row", "item_id", (F.size("held") / F.size("words")).alias("share"), F.greatest("shift", F.lit(0)).alias("at"),
        F.size("pairs").alias("slots"), F.size(F.filter("pairs", lambda p: p["a"] != p["b"])).alias("changed"),
        ((side("a") == both) & (side("b") == both)).alias("consistent"),
    )
    fit = scored.filter((F.col("share") >= least_share) & F.col("consistent"))
    best = fit.groupBy("known", "row", "item_id").agg(F.max(F.struct("share", (-F.col("at")).alias("at"), "slots", "changed")).alias("x"))
    return best.select("known", "row", "item_id", "x.share", (-F.col("x.at")).alias("at"), "x.slots", "x.changed")


def drop_leaks(
    docs: DataFrame, benchmark: DataFrame, least_share: float = LEAST_SHARE, id_column: str = "doc_id", text_column: str = "text", any_case: bool = False,
    null_ids: bool = False,
) -> DataFrame:
    """Rows of ``docs`` that hold no item of ``benchmark``; columns unchanged. Rows with a null id stay, unless ``null_ids`` has them judged, too."""
    found = _leaks(docs, benchmark, least_share, id_column, text_column, "item_id", "text", any_case, null_ids)
    known, row = _row_key(docs[id_column].cast("long"), docs[text_column])
    # rows in one column, so that no name of theirs can clash
    keyed = docs.select(known, row, F.struct(*[docs[c] for c in docs.columns]).alias("kept"))
    return keyed.join(found.select("known", "row").distinct(), ["known", "row"], "left_anti").select("kept.*")
