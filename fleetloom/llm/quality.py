"""Text quality by Bradley-Terry ranking of document pairs.

A document's score is linear in features of its whole text. Of a good and a bad document the
good one should win: the weights minimise the logistic loss on feature differences of all such
pairs. A quantile of the scores, at the share of bad rows among the labelled ones, then says
where good begins. Learning sees every labelled row that is not held out; every row is scored.

Pairs are never listed. The loss of a pair depends on the difference of two strengths alone and is
smooth, so within cells of strengths of length 1 it is a polynomial of both, to rounding. Rows
are summed up for each cell and label at ``NODES`` points, in their tasks, and the points are
compared: sums over all pairs at the cost of one pass over the rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace
from operator import eq

import numpy as np
import pandas as pd
import pyarrow as pa
from numpy.polynomial import chebyshev
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetloom.llm.common import id_and_text, map_arrow, ready_workers
from fleetloom.session import durable_copy

RIDGE = 1e-3
NODES = 12  # of a cell of strengths; leaves an error of about 1e-13
FEW_ROWS = 10_000  # that the driver sorts

_NODES = np.cos(np.pi * (np.arange(NODES) + 0.5) / NODES)
_TO_NODES = chebyshev.chebvander(_NODES, NODES - 1).T * np.where(np.arange(NODES) > 0, 2.0, 1.0)[:, None] / NODES

FEATURES = (
    "log_words", "mean_word", "upper", "digits", "other_bytes", "stops", "commas", "exclaims", "bars", "symbols", "quotes",
    "lines", "repeats", "distinct", "short_words",
)

_KIND = np.zeros(256, dtype=np.int64)  # of each byte: 0 white space and control
_KIND[ord("a") : ord("z") + 1] = 1
_KIND[ord("A") : ord("Z") + 1] = 2
_KIND[ord("0") : ord("9") + 1] = 3
_KIND[128:] = 4
for _kind, _chars in enumerate((".", ",;:", "!?", "|<>{}[]\\/", "#$%&*@^~=+_", "\"'()-`"), start=5):
    _KIND[[ord(c) for c in _chars]] = _kind
_KIND[ord("\n")] = 11


def features(text: str | None) -> np.ndarray:
    """``FEATURES`` of one text; an empty or null one has zeros, and 1 for the share of distinct words."""
    data = (text or "").encode("utf-8", "replace")
    words = data.split()
    n = len(words)
    if not n:
        return np.array([0.0] * 13 + [1.0, 0.0])
    by_byte = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    kinds = np.bincount(_KIND, weights=by_byte, minlength=12)
    letters = max(1.0, kinds[1] + kinds[2] + kinds[4])
    size = len(data)
    per_word = np.sqrt(kinds[5:12] / n)
    lengths = np.fromiter(map(len, words), np.int64, n)
    return np.array([
        np.log1p(n), np.log1p(lengths.mean()), np.sqrt(kinds[2] / letters), np.sqrt(kinds[3] / size), np.sqrt(kinds[4] / size),
        *per_word, np.sqrt(sum(map(eq, words, words[1:])) / n), len(set(words)) / n, float((lengths <= 3).mean()),
    ])


@dataclass(frozen=True)
class Ranking:
    """A fitted ranking: ``score`` is the chance that a document beats one that stands at the threshold."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    threshold: float

    def strength(self, x: np.ndarray) -> np.ndarray:
        # each row on its own, so that equal rows have equal strengths wherever they stand
        return ((x - self.mean) / self.scale * self.weights).sum(axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.strength(x) - self.threshold, -30, 30)))


def _summed(ranking: Ranking, x: np.ndarray, good: np.ndarray) -> dict[int, np.ndarray]:
    """For each cell of strengths (twice its number, and 1 if the rows are good) 1, z and the products of z, summed at its nodes; z is scaled ``x``."""
    z = (x - ranking.mean) / ranking.scale
    strengths = (z * ranking.weights).sum(axis=1)
    cells = np.floor(strengths)
    shares = chebyshev.chebvander(2 * (strengths - cells) - 1, NODES - 1) @ _TO_NODES
    each = np.hstack([np.ones((len(z), 1)), z, (z[:, :, None] * z[:, None, :]).reshape(len(z), z.shape[1] ** 2)])
    parts = 2 * cells.astype(np.int64) + good
    order = np.argsort(parts, kind="stable")
    found, starts = np.unique(parts[order], return_index=True)
    return {int(p): shares[rows].T @ each[rows] for p, rows in zip(found, np.split(order, starts[1:]))}


def _all_pairs(sums: dict[int, np.ndarray], width: int) -> tuple[float, np.ndarray, np.ndarray]:
    """Mean loss of all pairs of a good and a bad row, its slope downwards and its second derivatives, from ``_summed`` rows."""
    sides = []
    for good in (1, 0):
        parts = sorted(p for p in sums if p % 2 == good)
        rows = np.concatenate([sums[p] for p in parts])
        sides.append((np.concatenate([p // 2 + (_NODES + 1) / 2 for p in parts]), rows / rows[:, 0].sum()))
    (at, best), (bad_at, worst) = sides
    one, first, second = 0, slice(1, width + 1), slice(width + 1, None)
    loss, slope, bend = 0.0, np.zeros(width), np.zeros((width, width))
    for start in range(0, len(at), NODES):
        apart = at[start : start + NODES, None] - bad_at
        here = best[start : start + NODES]
        lost = np.exp(-np.logaddexp(0.0, apart))  # chance that the loser wins
        loss += here[:, one] @ np.logaddexp(0.0, -apart) @ worst[:, one]
        slope += here[:, first].T @ (lost @ worst[:, one]) - here[:, one] @ lost @ worst[:, first]
        curve = (lost * (1 - lost)) @ worst
        both = here[:, first].T @ curve[:, first]
        bend += (here[:, second].T @ curve[:, one] + here[:, one] @ curve[:, second]).reshape(width, width) - both - both.T
    return float(loss), slope, bend


def _fit(start: Ranking, summed: Callable[[Ranking], dict[int, np.ndarray]], ridge: float) -> Ranking:
    """Newton steps, shortened where one would raise the loss, until none moves a weight by 1e-8."""
    w, step, least = start.weights, np.zeros(len(start.weights)), np.inf
    while True:
        tried = w + step
        loss, slope, bend = _all_pairs(summed(Ranking(start.mean, start.scale, tried, 0.0)), len(w))
        loss += ridge / 2 * (tried @ tried)
        if loss > least + 1e-12 and np.abs(step).max() > 1e-8:
            step = step / 2
            continue
        w, least = tried, loss
        step = np.linalg.solve(bend + ridge * np.eye(len(w)), slope - ridge * w)
        if np.abs(step).max() < 1e-8:
            # rounded, so that the order in which rows were summed does not show
            return Ranking(start.mean, start.scale, np.round(w + step, 9), 0.0)


def _start(mean: np.ndarray, scale: np.ndarray) -> Ranking:
    scale = np.round(scale, 12)
    return Ranking(np.round(mean, 12), np.where(scale > 1e-9, scale, 1.0), np.zeros(len(mean)), 0.0)


def fit_ranking(x: np.ndarray, good: np.ndarray, ridge: float = RIDGE) -> Ranking:
    """Fit on rows ``x`` with labels ``good``.

    Newton steps minimise the mean loss of all pairs of a good and a bad row. With no pair (one
    label only, or no rows) all weights are 0 and every score is 0.5.
    """
    width = x.shape[1]
    start = _start(*(x.mean(axis=0), x.std(axis=0)) if len(x) else (np.zeros(width), np.ones(width)))
    cut = int((~good).sum())  # as many of the rows fall below as are labelled bad
    if not 0 < cut < len(good):
        return start
    found = _fit(start, lambda at: _summed(at, x, good), ridge)
    strengths = np.sort(found.strength(x))
    return replace(found, threshold=float((strengths[cut - 1] + strengths[cut]) / 2))


def _vectors(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column(0).flatten().to_numpy().reshape(-1, len(FEATURES))


def _summed_in_tasks(taught: DataFrame, at: Ranking) -> dict[int, np.ndarray]:
    """``_summed`` over rows ``x, good``; parts of a cell are added up before the driver sees one."""
    names = ["part", "sums"]

    def rows(sums: dict[int, np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int64()), pa.array([a.tobytes() for a in sums.values()], pa.binary())], names=names)

    def within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, a in _summed(at, _vectors(batch), batch.column(1).to_numpy(zero_copy_only=False)).items():
                sums[part] = sums[part] + a if part in sums else a
        yield rows(sums)

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, a in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                sums[part] = sums.get(part, 0.0) + np.frombuffer(a)
        yield rows(sums)

    schema = "part long, sums binary"
    found = map_arrow(map_arrow(taught, within, schema).repartition("part"), across, schema)
    return {r["part"]: np.frombuffer(r["sums"]).reshape(NODES, -1) for r in found.collect()}


def _value_at(values: DataFrame, rank: int) -> float:
    """The value of ``values`` (one column, ``s``) of a rank from 0: parts of the range are counted until the driver can sort one."""
    lo, hi = values.agg(F.min("s"), F.max("s")).first()
    while hi - lo > 1e-300:
        part = F.floor((F.col("s") - lo) / ((hi - lo) / 1024))
        counts = sorted(values.filter(F.col("s").between(lo, hi)).groupBy(part.alias("part")).agg(F.count("*"), F.min("s"), F.max("s")).collect())
        for _, n, lo, hi in counts:  # noqa: B007
            if rank < n:
                break
            rank -= n
        if n <= FEW_ROWS:
            return sorted(r["s"] for r in values.filter(F.col("s").between(lo, hi)).collect())[rank]
    return lo


def with_features(rows: DataFrame) -> DataFrame:
    """``doc_id, hash, x`` for rows of ``doc_id, hash, text``."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [features(t.as_py()) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(x, pa.list_(pa.float64()))], names=["doc_id", "hash", "x"])

    return map_arrow(rows, each, "doc_id long, hash long, x array<double>")


def held_out(id_column: str):
    """True for the third of ids (crc32 of the id as text, remainder 1) that learning never sees."""
    return F.coalesce(F.crc32(F.col(id_column).cast("string")) % 3 == 1, F.lit(False))


def learn(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> Ranking:
    """Fit a ranking on all rows of ``labels`` (``doc_id, quality``) that are not held out and whose document is there.

    Rows with a null id or a null label teach nothing; a label of 1 is good. Of several texts of an id the
    one with the least hash is learned from. Features are worked out where the texts are read, so no
    text is shuffled; the driver gets sums, counts and at most ``FEW_ROWS`` strengths.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), (F.col("quality").cast("int") == 1).alias("good")).dropna()
    rows = id_and_text(docs, id_column, text_column).filter(F.col("doc_id").isNotNull() & ~held_out("doc_id"))
    found = with_features(rows.select("doc_id", F.xxhash64("text").alias("hash"), "text"))
    found = found.groupBy("doc_id").agg(F.min_by("x", F.struct("hash", "x")).alias("x"))
    taught = durable_copy(found.join(known.filter(~held_out("doc_id")), "doc_id").select("x", "good"), "taught")
    each = [F.col("x")[i] for i in range(len(FEATURES))]
    n, cut, *of = taught.agg(F.count("*"), F.count_if(~F.col("good")), *map(F.avg, each), *map(F.stddev_pop, each)).first()
    if not n:
        return fit_ranking(np.zeros((0, len(FEATURES))), np.zeros(0, bool))
    start = _start(np.array(of[: len(FEATURES)]), np.array(of[len(FEATURES) :]))
    if not 0 < cut < n:
        return start
    ranking = _fit(start, lambda at: _summed_in_tasks(taught, at), RIDGE)

    def strengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(ranking.strength(_vectors(batch)))], names=["s"])

    values = durable_copy(map_arrow(taught, strengths, "s double"), "strengths")
    # as many of the rows fall below as are labelled bad
    return replace(ranking, threshold=(_value_at(values, cut - 1) + _value_at(values, cut)) / 2)


def score(docs: DataFrame, ranking: Ranking, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``doc_id, score`` of every row; null and empty texts are scored by their features like any other."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([features(t.as_py()) for t in batch.column(1)]).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ranking.score(x))], names=["doc_id", "score"])

    return map_arrow(id_and_text(docs, id_column, text_column), each, "doc_id long, score double")


def keep_good(docs: DataFrame, ranking: Ranking, least: float = 0.5, text_column: str = "text") -> DataFrame:
    """Rows of ``docs`` that score ``least`` or more, with their columns unchanged."""

    ready_workers(docs.sparkSession)

    @F.pandas_udf("double")
    def scored(text: pd.Series) -> pd.Series:
        return pd.Series(ranking.score(np.array([features(t) for t in text]).reshape(-1, len(FEATURES))))

    return docs.filter(scored(F.coalesce(docs[text_column], F.lit(""))) >= least)
