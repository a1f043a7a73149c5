"""Whitening against numpy on the whole list of vectors, and the refinement against known eigenvectors."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from footfall.llm import whitening

COLUMNS = ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def brute(vectors, components=4):
    """(vec_id, component): (n, deviation, |whitened|, explained) in whole numbers and float64."""
    good = [(i, [math.floor(float(c) * 256) for c in v]) for i, v in vectors if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    wide = max(len(v) for _, v in good)
    good = [(i, v + [0] * (wide - len(v))) for i, v in good]
    fit = sorted(set(tuple(v) for _, v in good))
    n, total = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    y = np.array([[float(n * a - s) / n for a, s in zip(v, total, strict=True)] for v in fit])
    values, vectors = np.linalg.eigh(y.T @ y / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    found = {}
    for i, v in good:
        c = np.array([float(n * a - s) / n for a, s in zip(v, total, strict=True)])
        deviation = sum((n * a - s) ** 2 for a, s in zip(v, total, strict=True))
        for k in range(min(components, wide)):
            full = values[k] > 1e-9 * max(values[0], 1e-300)
            found[i, k + 1] = (n, deviation, abs(float(c @ vectors[:, k])) / math.sqrt(values[k]) if full else 0.0, values[k] / values.sum() if full else 0.0)
    return found


def check(spark, rows, components=4):
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("component", F.lit("x")).withColumn("x", F.lit(1))
    got = whitening.whiten(table, components)
    assert got.columns == COLUMNS
    exact = [(i, v if v is None else [None if c is None else float(np.float32(c)) for c in v]) for i, v in rows]
    want, seen = brute(exact, components), set()
    for r in got.collect():
        n, deviation, whitened, explained = want[r.vec_id, r.component]
        seen.add((r.vec_id, r.component))
        assert (r.n, int(r.deviation)) == (n, deviation)
        assert abs(r.whitened) == pytest.approx(whitened, abs=1e-7) and r.explained == pytest.approx(explained, rel=1e-9)
        assert r.identity_error < 1e-9
    assert seen == set(want)


def test_by_brute_force(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(c) for c in rng.normal(size=12) * np.linspace(1, 3, 12)]) for i in range(300)]
    rows += [(300 + i, rows[i % 3][1]) for i in range(200)]
    rows += [(600, None), (601, [1.0] * 11 + [None]), (602, [float("nan")] * 12), (603, [float("-inf")] + [0.0] * 11), (0, rows[5][1])]
    check(spark, rows[:-1])
    assert whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).where("vec_id = 0").count() == 8


def test_odd_vectors(spark):
    check(spark, [(1, [1.0, 2.0]), (2, [1.0]), (3, []), (4, [-0.0, 5.5])], 4)  # shorter ones, fewer dimensions than components
    check(spark, [(i, [float(i), 2.0 * i, 7.0, 0.0, 1.0]) for i in range(9)])  # one direction only
    check(spark, [(1, [3.0, 4.0]), (2, [3.0, 4.0])])  # no variance at all
    check(spark, [(i, [4000.0 * (i % 7), -70000.0 * (i % 5), 1e7 * i]) for i in range(40)])  # sums and products beyond blocks of doubles
    for rows in ([], [(1, None)], [(1, [])]):
        assert whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect() == []


def known(values, seed):
    rng = np.random.default_rng(seed)
    q = np.linalg.qr(rng.normal(size=(len(values), len(values))))[0].astype(np.longdouble)
    for _ in range(3):  # orthonormal in extended precision
        q = q @ (1.5 * np.eye(len(values), dtype=np.longdouble) - 0.5 * (q.T @ q))
    return (q * np.array(values, np.longdouble)) @ q.T, q.astype(np.float64)


@pytest.mark.parametrize(
    "values",
    [
        np.linspace(5, 1, 30),
        [3.0, 3.0 - 1e-9, 3.0 - 2e-9, 2.0, 1.0, 1.0 - 1e-10, 0.5, 1e-6],
        [1.0, 1.0 - 1e-11, 1.0 - 1e-6, 0.9, 0.9 - 1e-8, 0.1, 0.1 - 1e-12, 0.0],
        2.0 ** -np.arange(40),
    ],
)
def test_refinement_finds_clustered_eigenvectors(values):
    v, q = known(values, 7)
    got, x = whitening.refined_eigenvectors(v)
    assert np.abs(got - np.array(values)).max() < 1e-15 * max(values) * 8
    gaps = np.array([min([abs(a - b) for b in np.delete(values, i)]) for i, a in enumerate(values)])
    off = np.abs(np.abs((x * q).sum(axis=0)) - 1)
    assert (off < np.maximum((1e-18 * len(values) / gaps) ** 2, 4e-15)).all(), off
    assert np.abs(x.T @ x - np.eye(len(values))).max() < 1e-15 * len(values)


def test_refinement_of_equal_eigenvalues():
    v, q = known([2.0, 2.0, 2.0, 1.0, 1.0, 0.0], 3)
    got, x = whitening.refined_eigenvectors(v)
    assert got == pytest.approx([2, 2, 2, 1, 1, 0], abs=1e-15)
    for part in (slice(0, 3), slice(3, 5)):
        assert np.abs(x[:, part] @ x[:, part].T - q[:, part] @ q[:, part].T).max() < 1e-14
    assert whitening.refined_eigenvectors(np.zeros((3, 3)))[0].tolist() == [0, 0, 0]


def test_whole_table(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    check(spark, [(r.vec_id, r.embedding) for r in table.collect()])
