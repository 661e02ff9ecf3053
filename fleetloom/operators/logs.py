"""Log groups, streams, tails and marker lines."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetloom.functions.text import is_blank
from fleetloom.operators.kernels import first_per_key, latest_per_key, top_n_per_key


def latest_log_group(groups: DataFrame, *, name: str = "name", prefix: str) -> DataFrame:
    """Newest group per cluster among names ``<prefix><cluster>-<12 digits>``."""
    pattern = "^" + re.escape(prefix) + r"(.+)-([0-9]{12})$"
    parsed = groups.select(
        F.regexp_extract(name, pattern, 1).alias("cluster"), F.col(name).alias("log_group")
    ).where(F.col("cluster") != "")
    return parsed.groupBy("cluster").agg(F.max("log_group").alias("log_group"))


def match_streams(
    streams: DataFrame,
    tokens: Sequence[str],
    *,
    key: str | Sequence[str],
    stream: str = "stream",
    last_event: str = "last_event",
) -> DataFrame:
    """For each wanted token the stream whose name contains it and that wrote last.

    The tokens are an argument, so each row lists its matches itself; no join is needed.
    """
    keys = [key] if isinstance(key, str) else list(key)
    matches = F.filter(F.array(*[F.lit(t) for t in tokens]), lambda t: F.contains(F.col(stream), t))
    matched = streams.select(*keys, F.explode(matches).alias("token"), stream, last_event)
    return latest_per_key(matched, key=[*keys, "token"], order=[last_event, stream], value=[stream, last_event])


def log_tail(
    events: DataFrame, *, key: str | Sequence[str], ts: str, n: int, tiebreak: str | Sequence[str], salts: int = 64
) -> DataFrame:
    """Last ``n`` events per stream; ``rank`` 1 is the newest, so a report sorts it downwards."""
    if n < 1:
        raise ValueError("n must be at least 1")
    ties = [tiebreak] if isinstance(tiebreak, str) else list(tiebreak)
    order = [F.col(ts).desc(), *[F.col(t).desc() for t in ties]]
    return top_n_per_key(events, key=key, order=order, n=n, spread=[ts, *ties], salts=salts)


def tail_nonblank(lines: DataFrame, *, key: str | Sequence[str], n: int, line: str = "line", pos: str = "line_no", salts: int = 64) -> DataFrame:
    """Last ``n`` non-blank lines per file; nothing for ``n <= 0``."""
    written = lines.where(~is_blank(line))
    if n <= 0:
        return written.where(F.lit(False)).withColumn("rank", F.lit(0))
    return top_n_per_key(written, key=key, order=[F.col(pos).desc()], n=n, spread=[pos], salts=salts)


def rebuild_line(line: str, script: str) -> Column:
    """Lines that record a command: they name the build script or start like a path."""
    text = F.col(line)
    return F.contains(text, F.lit(script)) | F.startswith(text, F.lit("./")) | F.startswith(text, F.lit("/"))


def last_matching_line(lines: DataFrame, matches: Column, *, key: str | Sequence[str], line: str = "line", pos: str = "line_no") -> DataFrame:
    """Last line per file for which ``matches`` holds, right-trimmed; NULL when none does."""
    keys = [key] if isinstance(key, str) else list(key)
    last = F.max_by(F.when(matches, F.col(line)), F.when(matches, F.col(pos)))
    return lines.groupBy(*keys).agg(F.regexp_replace(last, r"\s+$", "").alias("last_line"))


def first_line(lines: DataFrame, *, key: str | Sequence[str], line: str = "line", pos: str = "line_no") -> DataFrame:
    """First line per file (the serial of a build)."""
    return first_per_key(lines, key=key, order=pos, value=line)
