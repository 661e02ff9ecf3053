"""Whitening of vectors: eigenvectors in single precision, refined to double by matrix products.

Entries become integers, so that counts, sums and products of centred entries are exact sums of
integers in any order of rows: the covariance does not depend on partitions. Products are taken
of entries less the rounded mean, which keeps them small; what rounding left is taken off as an
exact fraction. Only sums as wide as a vector, and their products, come to the driver.

There ``eigh`` in float32 gives a first basis. Each step of Ogita and Aishima's refinement takes
the basis ``X`` to ``X + X E``, with ``E`` read off the residuals ``I - X'X`` and ``X'VX``, in extended
precision; the error of a step is squared by the next. Eigenvalues nearer to each other than the
residuals tell apart form a cluster, within which ``E`` only makes the basis orthogonal; the cluster
is then solved by itself, shifted to its middle, so that its small differences are the leading digits.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetloom.llm.common import map_arrow
from fleetloom.session import durable_copy

SCALE, SHIFT = 1024, 100_000
LARGEST = 2.0**52  # entries from here on have no integer of 64 bits
STEPS = 40
_SUM = "decimal(38,0)"
_EXTENDED = np.longdouble


@dataclass(frozen=True)
class Whitening:
    """``n`` rows fitted; ``middle`` (rounded means) and ``rest`` (exact sums less ``n`` times these); the basis by falling eigenvalue, and all the variance."""

    n: int
    middle: list[int]
    rest: list[int]
    vectors: np.ndarray
    values: np.ndarray
    trace: float

    def share(self, component: int) -> float:
        """The part of the variance along ``component``; 0 where nothing varies."""
        return float(self.values[component] / self.trace) if self.trace > 0 else 0.0

    def scaled(self, components: int) -> np.ndarray:
        """The basis over the square roots of its eigenvalues; zero along directions in which nothing varies."""
        varies = self.values[:components] > self.values[:1] * 1e-15
        root = np.sqrt(np.where(varies, self.values[:components], 1.0))
        return self.vectors[:, :components] / root * varies


def usable(vectors: DataFrame, id_column: str = "vec_id", column: str = "embedding") -> DataFrame:
    """``vec_id, v`` (array of double) of rows whose vector is neither null nor empty and holds finite entries below ``LARGEST`` alone; ids may be null."""
    rows = vectors.select(vectors[id_column].cast("long").alias("vec_id"), vectors[column].cast("array<double>").alias("v"))
    fits = F.forall("v", lambda a: a.isNotNull() & ~F.isnan(a) & (F.abs(a) < F.lit(LARGEST)))
    return rows.filter(F.coalesce(fits, F.lit(False)) & (F.size("v") > 0))


def integers(lists: pa.Array, width: int) -> np.ndarray:
    """Rows of entries as integers."""
    flat = lists.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
    return np.floor(flat * SCALE).astype(np.int64) + SHIFT


def _exactly(values: np.ndarray, largest: float) -> np.ndarray:
    """``values`` in a type in which numbers up to ``largest`` stay exact."""
    return values if largest < 2.0**62 else values.astype(object)


def _largest(values: np.ndarray) -> float:
    return float(np.abs(values.astype(np.float64)).max(initial=0)) + 1


def _products(y: np.ndarray) -> np.ndarray:
    """``y'y`` as exact integers: by floating-point products where all their sums are exact."""
    most = _largest(y) ** 2
    rows = int(2.0**53 / most)
    if rows < 1:
        wide = y.astype(object)
        return wide.T @ wide
    total = 0
    for at in range(0, len(y), rows):
        part = y[at : at + rows].astype(np.float64)
        total = total + (part.T @ part).astype(np.int64).astype(object)
    return total


def _as_sums(values) -> pa.Array:
    from decimal import Decimal

    return pa.array([Decimal(int(v)) for v in values], pa.decimal128(38, 0))


def moments(rows: DataFrame, width: int) -> tuple[int, list[int], list[int], list[list[int]]]:
    """``n``, rounded means, sums less ``n`` times these, and the products of entries less these; all exact."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, np.zeros(width, dtype=object)
        for batch in batches:
            x = integers(batch.column(0), width)
            n += len(x)
            total = total + _exactly(x, _largest(x) * max(1, len(x))).sum(axis=0).astype(object)
        if n:
            at = pa.array(range(width + 1), pa.int32())
            yield pa.RecordBatch.from_arrays([at, _as_sums([*total, n])], names=["i", "s"])

    found = map_arrow(rows.select("v"), sums, f"i int, s {_SUM}").groupBy("i").agg(F.sum("s").alias("s")).collect()
    by_place = {r["i"]: int(r["s"]) for r in found}
    n = by_place.get(width, 0)
    if not n:
        return 0, [], [], []
    middle = [(2 * by_place[i] + n) // (2 * n) for i in range(width)]
    rest = [by_place[i] - n * middle[i] for i in range(width)]
    upper = np.triu_indices(width)

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, any_row = 0, False
        for batch in batches:
            if batch.num_rows:
                any_row = True
                total = total + _products(integers(batch.column(0), width) - np.array(middle, dtype=np.int64))
        if any_row:
            yield pa.RecordBatch.from_arrays([pa.array(k.astype(np.int32)) for k in upper] + [_as_sums(total[upper])], names=["i", "j", "g"])

    gram = [[0] * width for _ in range(width)]
    for r in map_arrow(rows.select("v"), products, f"i int, j int, g {_SUM}").groupBy("i", "j").agg(F.sum("g").alias("g")).collect():
        gram[r["i"]][r["j"]] = gram[r["j"]][r["i"]] = int(r["g"])
    return n, middle, rest, gram


def covariance(n: int, rest: list[int], gram: list[list[int]]) -> np.ndarray:
    """Products of centred entries over ``n``, in extended precision and right to its last digits."""
    width, under = len(rest), n * n
    out = np.zeros((width, width), dtype=_EXTENDED)
    for i in range(width):
        for j in range(i + 1):
            over = n * gram[i][j] - rest[i] * rest[j]
            high = over / under
            a, b = high.as_integer_ratio()
            out[i, j] = out[j, i] = _EXTENDED(high) + _EXTENDED((over * b - a * under) / (under * b))
    return out


def _norm(a: np.ndarray) -> float:
    return float(np.linalg.norm(a.astype(np.float64), 2))


def _clusters(values: np.ndarray, apart: float) -> list[np.ndarray]:
    """Places of values that chains of steps of at most ``apart`` connect, two or more."""
    order = np.argsort(values)
    cuts = np.flatnonzero(np.diff(values[order]) > apart) + 1
    return [c for c in np.split(order, cuts) if len(c) > 1]


def refined(v: np.ndarray, basis: np.ndarray | None = None, steps: int = STEPS) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (falling) and unit eigenvectors of the symmetric ``v``, from a ``basis`` in single precision (``eigh``, where none is given)."""
    scale = float(np.abs(v).max(initial=0)) or 1.0
    a = (v / _EXTENDED(scale)).astype(_EXTENDED)
    if basis is None:
        basis = np.linalg.eigh(a.astype(np.float32))[1]
    x, width = basis.astype(_EXTENDED), len(a)
    one, size = np.eye(width, dtype=_EXTENDED), _norm(a)
    least = float(np.finfo(_EXTENDED).eps) * 8 * max(width, 1)
    before = np.inf
    for _ in range(steps):
        r = one - x.T @ x
        r = (r + r.T) / 2
        s = x.T @ (a @ x)
        s = (s + s.T) / 2  # what rounding made unlike would be divided by the gaps
        values = np.diag(s) / (1 - np.diag(r))
        told = 2 * (_norm(s - np.diag(values)) + size * _norm(r))
        gap = values[None, :] - values[:, None]
        apart = np.abs(gap) > told
        e = np.where(apart, (s + values[None, :] * r) / np.where(apart, gap, 1), r / 2)
        x = x + x @ e
        for cluster in _clusters(values, told):
            part = x[:, cluster]
            middle = values[cluster].mean()
            inner = part.T @ (a @ part - middle * part)
            turn = np.linalg.eigh(((inner + inner.T) / 2).astype(np.float64))[1]
            x[:, cluster] = part @ turn.astype(_EXTENDED)
        step = float(np.abs(e).max(initial=0))
        if step <= least or step >= before / 2 and step < 1e-12:
            break
        before = step
    for _ in range(2):  # the last turn of a cluster is right to double precision only
        x = x + x @ ((one - x.T @ x) / 2)
    values = (x * (a @ x)).sum(axis=0)
    order = np.argsort(-values, kind="stable")
    x, values = x[:, order], values[order]
    x = x * np.where(x[np.abs(x).argmax(axis=0), np.arange(width)] < 0, -1, 1)  # one sign for all rows
    return np.maximum(values * _EXTENDED(scale), 0).astype(np.float64), x.astype(np.float64)


def learn(vectors: DataFrame, id_column: str = "vec_id", column: str = "embedding") -> Whitening | None:
    """Fit on every usable row. Where widths differ the commonest counts, of equally common ones the largest; None without rows."""
    rows = usable(vectors, id_column, column)
    common = rows.groupBy(F.size("v").alias("width")).count().orderBy(F.desc("count"), F.desc("width")).first()
    if common is None:
        return None
    width = common["width"]
    n, middle, rest, gram = moments(rows.filter(F.size("v") == width), width)
    v = covariance(n, rest, gram)
    values, basis = refined(v)
    return Whitening(n, middle, rest, basis, values, float(np.trace(v)))


def whiten(vectors: DataFrame, fitted: Whitening | None, components: int = 8, id_column: str = "vec_id", column: str = "embedding") -> DataFrame:
    """``vec_id, deviation`` (decimal), ``whitened`` (array) for each usable row of the fitted width; nothing where nothing was fitted.

    ``deviation`` is the exact sum over entries of ``(n x - S) ** 2`` for the integers ``x`` and
    their sums ``S``; null beyond 38 digits. Directions in which nothing varies are 0. Rows with
    null ids and repeated rows are rows like others; other columns are not read.
    """
    kind = f"vec_id long, deviation {_SUM}, whitened array<double>"
    rows = usable(vectors, id_column, column)
    if fitted is None:
        return rows.select("vec_id", F.lit(None).cast(_SUM).alias("deviation"), F.col("v").alias("whitened")).limit(0)
    width, n = len(fitted.middle), fitted.n
    middle, rest = np.array(fitted.middle, dtype=np.int64), np.array(fitted.rest, dtype=object)
    mean = np.array([r / n for r in fitted.rest])
    onto = fitted.scaled(min(components, width))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y = integers(batch.column(1), width) - middle
            far = (_largest(y) * n + _largest(rest)) ** 2 * width
            apart = _exactly(y, far) * n - (rest if far >= 2.0**62 else rest.astype(np.int64))
            squares = (apart * apart).sum(axis=1)
            if squares.dtype == object:
                from decimal import Decimal

                deviation = pa.array([Decimal(q) if q < 10**38 else None for q in squares], pa.decimal128(38, 0))
            else:
                deviation = pa.array(squares).cast(pa.decimal128(38, 0))
            z = (y.astype(np.float64) - mean) @ onto
            ends = pa.array(np.arange(0, z.size + 1, z.shape[1], dtype=np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0), deviation, pa.ListArray.from_arrays(ends, pa.array(z.ravel()))], names=["vec_id", "deviation", "whitened"])

    return map_arrow(rows.filter(F.size("v") == width), each, kind)


def identity_error(whitened: DataFrame, components: int) -> float | None:
    """Largest entry of the covariance of ``whitened`` less the identity; None without rows."""
    z = [F.get("whitened", F.lit(k)) for k in range(components)]
    pairs = [(i, j) for i in range(components) for j in range(i + 1)]
    row = whitened.agg(*[F.covar_pop(z[i], z[j]).alias(f"c{i}_{j}") for i, j in pairs]).first()
    found = [abs(row[f"c{i}_{j}"] - (i == j)) for i, j in pairs if row[f"c{i}_{j}"] is not None]
    return float(max(found)) if found else None


def components_of(vectors: DataFrame, components: int = 8, id_column: str = "vec_id", column: str = "embedding") -> DataFrame:
    """A row for each usable row and component: ``vec_id, component, n, deviation, whitened, explained, identity_error``.

    The whitened rows are written once to the shared folder, where their covariance is measured.
    """
    fitted = learn(vectors, id_column, column)
    kept = durable_copy(whiten(vectors, fitted, components, id_column, column), "whitened")
    count = min(components, len(fitted.middle)) if fitted else 0
    error = identity_error(kept, count) if fitted else None
    shares = F.array(*[F.lit(fitted.share(k)) for k in range(count)]) if count else F.array(F.lit(0.0))
    return kept.select("vec_id", "deviation", F.posexplode("whitened").alias("_at", "whitened")).select(
        "vec_id", (F.col("_at") + 1).alias("component"), F.lit(fitted.n if fitted else 0).cast("long").alias("n"), "deviation", "whitened",
        F.get(shares, F.col("_at")).alias("explained"), F.lit(error).cast("double").alias("identity_error"),
    )
