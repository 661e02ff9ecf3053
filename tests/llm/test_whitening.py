"""Whitening against exact sums, plain eigensolvers and odd rows."""

from decimal import Decimal
from fractions import Fraction

import numpy as np
import pytest

from fleetloom.llm import whitening
from fleetloom.llm.queries import QUERIES


def rotation(width, seed):
    q = np.linalg.qr(np.random.default_rng(seed).normal(size=(width, width)))[0].astype(np.longdouble)
    for _ in range(3):
        q = q @ ((3 * np.eye(width, dtype=np.longdouble) - q.T @ q) / 2)
    return q


@pytest.mark.parametrize(
    "values",
    [[5, 3, 1, 0.5], [4.0], [1, 1 + 1e-9, 1 + 2e-9, 0.5, 0.25, 1e-3], [2, 2, 2, 1, 1], [1e6, 1, 1e-6], [0, 0, 0], [2 + 1e-12 * k for k in range(10)] + [1, 0.9, 0]],
)
def test_refinement_reaches_double_precision(values):
    q = rotation(len(values), 3)
    a = (q * np.array(values, dtype=np.longdouble)) @ q.T
    a = (a + a.T) / 2
    found, x = whitening.refined(a)
    size = max(map(abs, values)) or 1
    assert np.abs(found - sorted(values, reverse=True)).max() <= 1e-15 * size
    wide = x.astype(np.longdouble)
    assert np.abs(wide.T @ wide - np.eye(len(values))).max() < 1e-15
    assert np.abs(a @ wide - wide * found).max() <= 4e-16 * size


def test_near_eigenvalues_are_told_apart_from_single_precision():
    """Values 1e-9 apart look equal to float32; their own vectors are found all the same."""
    values = [1 + 2e-9, 1 + 1e-9, 1, 0.5, 0.2]
    q = rotation(5, 8)
    a = (q * np.array(values, dtype=np.longdouble)) @ q.T
    _, x = whitening.refined((a + a.T) / 2)
    assert np.abs(np.abs(q.T @ x) - np.eye(5)).max() < 1e-8
    plain = np.linalg.eigh(a.astype(np.float32))[1][:, ::-1]
    assert np.abs(np.abs(q.T @ plain) - np.eye(5)).max() > 1e-3


def brute(vectors):
    """Exact sums and deviations, and eigenvectors in double precision."""
    x = [[int(np.floor(np.float64(c) * 1024)) + 100_000 for c in v] for v in vectors]
    n, width = len(x), len(x[0])
    sums = [sum(r[i] for r in x) for i in range(width)]
    deviation = [sum((n * r[i] - sums[i]) ** 2 for i in range(width)) for r in x]
    v = np.array([[float(Fraction(sum((n * r[i] - sums[i]) * (n * r[j] - sums[j]) for r in x), n**3)) for j in range(width)] for i in range(width)])
    return x, sums, deviation, v


def test_query_equals_brute_force(spark, data):
    found = QUERIES["op13_refined_whitening"](spark, data).toPandas()
    table = spark.read.parquet(f"{data}/embeddings.parquet").select("vec_id", "embedding").toPandas()
    x, sums, deviation, v = brute(table["embedding"])
    n = len(x)
    values, basis = np.linalg.eigh(v)
    values, basis = values[::-1], basis[:, ::-1]
    assert len(found) == 8 * n and set(found["n"]) == {n}
    assert found["identity_error"].nunique() == 1 and found["identity_error"].iloc[0] < 1e-9
    assert dict(zip(found["vec_id"], found["deviation"])) == dict(zip(table["vec_id"], deviation))
    centred = np.array(x, dtype=float) - np.array([s / n for s in sums])
    for k in range(8):
        mine = found[found["component"] == k + 1].set_index("vec_id").loc[table["vec_id"]]
        expected = centred @ basis[:, k] / np.sqrt(values[k])
        sign = np.sign(expected @ mine["whitened"].to_numpy())
        assert np.abs(sign * expected - mine["whitened"]).max() < 1e-9
        assert np.allclose(mine["explained"], values[k] / np.trace(v), rtol=1e-12)


def test_products_stay_exact_for_large_entries(spark):
    vectors = [(k, [float(3**k % 1_000_003) * 2.0**20, -1.5 * k, 0.25]) for k in range(40)]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>")
    _, _, deviation, v = brute([r[1] for r in vectors])
    rows = whitening.components_of(df, components=3).collect()
    assert {r["vec_id"]: int(r["deviation"]) for r in rows} == dict(enumerate(deviation))
    fitted = whitening.learn(df)
    assert np.allclose(fitted.trace, np.trace(v), rtol=1e-14)


def test_odd_rows(spark):
    schema = "vec_id long, embedding array<float>, label int, whitened string, component int, v int, n int"
    nan, inf = float("nan"), float("inf")
    vectors = [[1.0, 2.0], [3.0, -1.0], [0.5, 0.25], None, [nan, 1.0], [1.0, None], [inf, 0.0], [], [1.0], [3.0, -1.0]]
    rows = [(k, v, 0, "x", 1, 1, 1) for k, v in enumerate(vectors)] + [(None, [0.0, 0.0], 0, "x", 1, 1, 1)]
    found = whitening.components_of(spark.createDataFrame(rows, schema)).collect()
    assert sorted((-1 if r["vec_id"] is None else r["vec_id"], r["component"]) for r in found) == [(k, c) for k in (-1, 0, 1, 2, 9) for c in (1, 2)]
    assert {r["n"] for r in found} == {5} and found[0]["identity_error"] < 1e-12
    assert len({(r["component"], r["whitened"]) for r in found if r["vec_id"] in (1, 9)}) == 2  # repeated rows
    assert whitening.components_of(spark.createDataFrame(rows[3:8], schema)).count() == 0
    assert whitening.components_of(spark.createDataFrame([], schema)).count() == 0


def test_nothing_varies(spark):
    """One vector, and equal vectors: all is 0 and no part of the variance, and the error says so."""
    for n in (1, 3):
        found = whitening.components_of(spark.createDataFrame([(k, [1.0, 2.0]) for k in range(n)], "vec_id long, embedding array<double>")).collect()
        assert len(found) == 2 * n
        assert {(r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for r in found} == {(Decimal(0), 0.0, 0.0, 1.0)}
