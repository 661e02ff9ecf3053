"""Text expressions: cleaning, splitting, patterns, and keys encoded in names and paths."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from fleetloom.functions import fixed_values as fixed

# Fixed value: every character that counts as white space in a configuration value.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)


def as_col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def sanitize(c: str | Column) -> Column:
    """Delete every character outside printable ASCII."""
    return F.regexp_replace(as_col(c), r"[^\x20-\x7e]", "")


def strip(c: str | Column) -> Column:
    return F.btrim(as_col(c), F.lit(WHITESPACE))


def parse_type_list(c: str | Column) -> Column:
    """Comma list to an array: trimmed, blanks dropped, first occurrence kept."""
    parts = F.transform(F.split(as_col(c), ","), strip)
    return F.coalesce(F.array_distinct(F.filter(parts, lambda x: x != "")), F.array().cast("array<string>"))


def is_blank(c: str | Column) -> Column:
    return ~as_col(c).rlike(f"[^{WHITESPACE}]")


def fields(c: str | Column, blanks: str = WHITESPACE) -> Column:
    """White-space separated fields; a blank line gives an empty array.

    Other blanks become spaces first, so the split needs no pattern matching.
    """
    others = "".join(b for b in blanks if b != " ")
    spaced = F.translate(as_col(c), others, " " * len(others))
    return F.array_remove(F.split(spaced, " "), "")


def field(parts: Column, n: int | Column) -> Column:
    """The n-th field, NULL when the line is shorter."""
    return F.try_element_at(parts, F.lit(n) if isinstance(n, int) else n)


def leading_number(c: str | Column) -> Column:
    """Numeric value of the longest numeric prefix, 0 when there is none.

    A value that is a number as a whole skips the pattern search.
    """
    value = as_col(c)
    prefix = F.regexp_extract(value, r"^\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)", 1)
    number = F.coalesce(value.try_cast("double"), prefix.try_cast("double"))
    return F.coalesce(F.when(value.rlike(r"^\s*[+-]?[.\d]"), number), F.lit(0.0))


def glob_to_regex(c: str | Column) -> Column:
    """Wildcard pattern (``*`` any run, ``?`` one character) to an anchored regular expression."""
    escaped = F.regexp_replace(as_col(c), r"([\\^$.|+()\[\]{}])", r"\\$1")
    return F.concat(F.lit("^(?s:"), F.replace(F.replace(escaped, F.lit("*"), F.lit(".*")), F.lit("?"), F.lit(".")), F.lit(")$"))


def glob_parts(c: str | Column) -> Column:
    """A wildcard pattern (``*`` any run, ``?`` one character) as its ``literal`` beginning and the ``segments`` between its runs."""
    pattern = as_col(c)
    return F.struct(F.regexp_extract(pattern, r"^[^*?]*", 0).alias("literal"), F.split(pattern, r"\*").alias("segments"))


def glob_match(c: str | Column, parts: Column) -> Column:
    """Whether a text fits a pattern of ``glob_parts``, without an expression that is compiled for each pattern.

    The literal beginning decides most rows. The rest is a search for one segment after the other, each at
    the first place behind the one before it; the first segment stands at the start, the last at the end.
    """
    value, segments = as_col(c), parts["segments"]
    length, n = F.length(value), F.size(segments)
    one = lambda text, at: F.substr(text, at, F.lit(1))

    def fits(at: Column, segment: Column) -> Column:
        """Whether the segment stands ``at`` characters into the value."""
        size = F.length(segment)
        same = lambda i: (one(segment, i) == "?") | (one(segment, i) == one(value, at + i))
        wild = F.forall(F.sequence(F.lit(1), size), same)
        there = F.substr(value, at + 1, size) == segment
        return (at >= 0) & (at + size <= length) & ((size == 0) | F.when(F.contains(segment, F.lit("?")), wild).otherwise(there))

    def behind(at: Column, segment: Column) -> Column:
        """Where the first place of the segment from ``at`` on ends; -1 without one."""
        size = F.length(segment)
        literal = F.position(segment, value, at + 1) - 1
        places = F.filter(F.sequence(at, length - size), lambda i: fits(i, segment))
        wild = F.when(length - size >= at, F.coalesce(F.get(places, F.lit(0)), F.lit(-1))).otherwise(F.lit(-1))
        found = F.when(F.contains(segment, F.lit("?")), wild).otherwise(literal)
        return F.when(at < 0, -1).when(size == 0, at).when(found < 0, -1).otherwise(found + size)

    first, last = F.get(segments, F.lit(0)), F.element_at(segments, -1)
    start = F.when(fits(F.lit(0), first), F.length(first)).otherwise(F.lit(-1))
    middle = F.slice(segments, F.lit(2), F.greatest(n - 2, F.lit(0)))
    reached = F.aggregate(middle, start, behind)
    ends = (reached >= 0) & (reached <= length - F.length(last)) & fits(length - F.length(last), last)
    whole = F.when(n == 1, fits(F.lit(0), first) & (length == F.length(first))).otherwise(ends)
    return F.startswith(value, parts["literal"]) & whole


def has_prefix(c: str | Column, prefixes: Sequence[str]) -> Column:
    """True when the value starts with one of a fixed, short list of prefixes."""
    alternatives = "|".join(p.replace(".", r"\.") for p in prefixes)
    return as_col(c).rlike(f"^({alternatives})")


def usable_state(c: str | Column, ok_states: Sequence[str] = fixed.USABLE_NODE_STATES) -> Column:
    """Node state usable: flags after the base state are dropped, they never change its class."""
    base = F.lower(F.rtrim(strip(c), F.lit(fixed.NODE_STATE_FLAGS)))
    return base.isin(*ok_states)


def parse_serial(c: str | Column) -> Column:
    """Serial ``name-SSMMHHddmmYYYY`` to ``(cluster, stamp, built_at)``; junk stamps give NULL."""
    value = as_col(c)
    stamp = F.substring_index(value, "-", -1)
    cluster = F.regexp_extract(value, r"^(.*)-[^-]*$", 1)
    return F.struct(
        cluster.alias("cluster"),
        stamp.alias("stamp"),
        F.try_to_timestamp(stamp, F.lit("ssmmHHddMMyyyy")).alias("built_at"),
    )


def parse_run_id(c: str | Column) -> Column:
    """Run id ``YYYYmmdd_HHMMSS_<pid>`` to ``(started_at, pid)``."""
    value = as_col(c)
    return F.struct(
        F.try_to_timestamp(F.regexp_extract(value, r"^(\d{8}_\d{6})_\d+$", 1), F.lit("yyyyMMdd_HHmmss")).alias("started_at"),
        F.regexp_extract(value, r"^\d{8}_\d{6}_(\d+)$", 1).try_cast("bigint").alias("pid"),
    )


def parse_results_path(c: str | Column, root: str = "") -> Column:
    """``<root>/<cluster>/<serial>/<run>/<file>`` to its four keys (file may contain ``/``)."""
    value = as_col(c)
    pattern = (f".*{root}/" if root else "^/?") + r"([^/]+)/([^/]+)/([^/]+)/(.+)$"
    return F.struct(
        *[F.regexp_extract(value, pattern, i + 1).alias(n) for i, n in enumerate(("cluster", "serial", "run_id", "relpath"))]
    )
