"""Whitening of embeddings: exact distributed covariance, float32 eigenvectors, refinement in higher precision.

Entries become whole numbers first, so the sums are exact: Spark adds them as decimals in any order. The covariance is
taken around whole numbers nearest to the mean; what the rounding leaves is corrected in whole numbers too.

The eigenvectors X of the float32 matrix are corrected by Ogita and Aishima's iteration: with R = I - X'X and S = X'VX in
extended precision, X becomes X + XE, where E comes from R, S and the gaps between the eigenvalues. Eigenvalues closer
than the error of S form a cluster, where E can't tell directions apart: its small matrix Y'(V - m)Y is solved on its
own, shifted by the cluster's mean m so that close eigenvalues stand out, and turns the cluster's vectors Y.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from footfall.llm.common import in_tasks, keep_only, slices, stored

#: Entries count in steps of 1 / STEPS.
STEPS = 256
#: Rows of one block product; whole numbers below 2^20 stay exact in it.
ROWS = 4096
_WHOLE = "decimal(38,0)"


def whole_numbers(vectors: DataFrame) -> DataFrame:
    """`vectors` (vec_id, embedding) as (vec_id, x: array of long), without those that are null or hold a null, NaN or infinity."""
    finite = F.col("embedding").isNotNull() & F.forall("embedding", lambda c: F.coalesce(F.abs(c.cast("double")) < float("inf"), F.lit(False)))
    return vectors.where(finite).select("vec_id", F.transform("embedding", lambda c: F.floor(c.cast("double") * STEPS)).alias("x"))


def _matrix(batch: pa.RecordBatch, wide: int) -> np.ndarray:
    """The vectors of a batch as rows of long, shorter ones filled up with zeros."""
    column = batch.column("x")
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if (sizes == wide).all():
        return flat.reshape(-1, wide)
    found = np.zeros((len(sizes), wide), np.int64)
    found[np.arange(wide) < sizes[:, None]] = flat
    return found


def _long(values: np.ndarray) -> np.ndarray:
    return values.astype(object) if values.dtype != object else values


def _decimals(values: np.ndarray) -> pa.Array:
    return pa.array([Decimal(int(v)) for v in values.ravel()], pa.decimal128(38, 0))


def sums(fit: DataFrame, wide: int) -> tuple[int, list[int], int]:
    """(number of vectors, sum per dimension, largest absolute entry)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_only()
        n, total, most = 0, np.zeros(wide, object), 0
        for batch in slices(batches, ROWS):
            x = _matrix(batch, wide)
            n += len(x)
            # halves below 2^32 can't overflow in a block
            total = total + (_long((x >> 32).sum(axis=0)) << 32) + _long((x & 0xFFFFFFFF).sum(axis=0))
            most = max(most, int(x.max(initial=0)), -int(x.min(initial=0)))
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(range(wide), pa.int32()), _decimals(total), pa.array([n] * wide, pa.int64()), _decimals(np.array([most] * wide, object))], ["i", "total", "n", "most"])

    parts = fit.select("x").transform(in_tasks, run, f"i int, total {_WHOLE}, n long, most {_WHOLE}")
    rows = parts.groupBy("i").agg(F.sum("total").alias("total"), F.sum("n").alias("n"), F.max("most").alias("most")).orderBy("i").collect()
    return rows[0]["n"], [int(r["total"]) for r in rows], max(int(r["most"]) for r in rows)


def covariance(fit: DataFrame, n: int, total: list[int], most: int) -> np.ndarray:
    """n * n times the covariance of the vectors, as exact whole numbers."""
    wide = len(total)
    middle = np.array([(2 * s + n) // (2 * n) for s in total], object)
    upper = np.triu_indices(wide)
    exact_blocks = most < 1 << 19  # then differences stay below 2^20 and a block's products below 2^53

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_only()
        whole, part, left = np.zeros((wide, wide), object), np.zeros((wide, wide), np.int64), 1 << 9
        seen = False
        for batch in slices(batches, ROWS):
            seen = True
            x = _matrix(batch, wide)
            if exact_blocks:
                y = (x - middle.astype(np.int64)).astype(np.float64)
                part += (y.T @ y).astype(np.int64)
                left -= 1
                if not left:
                    whole, part, left = whole + part, np.zeros((wide, wide), np.int64), 1 << 9
            else:
                y = x.astype(object) - middle
                whole = whole + y.T @ y
        if seen:
            yield pa.RecordBatch.from_arrays([*[pa.array(k, pa.int32()) for k in upper], _decimals((whole + part)[upper])], ["i", "j", "part"])

    parts = fit.select("x").transform(in_tasks, run, f"i int, j int, part {_WHOLE}")
    rows = parts.groupBy("i", "j").agg(F.sum("part").alias("part")).collect()
    found = np.zeros((wide, wide), object)
    for r in rows:
        if r["part"] is None:
            raise OverflowError("the sums of products pass 38 digits")
        found[r["i"], r["j"]] = found[r["j"], r["i"]] = int(r["part"])
    off = np.array(total, object) - n * middle
    return n * found - np.outer(off, off)


def _clusters(values: np.ndarray, gap: float) -> list[np.ndarray]:
    """Runs of positions of falling `values` whose neighbours are `gap` or less apart."""
    ends = np.flatnonzero(values[:-1] - values[1:] > gap) + 1
    return np.split(np.arange(len(values)), ends)


def refined_eigenvectors(v: np.ndarray, rounds: int = 20) -> tuple[np.ndarray, np.ndarray]:
    """(falling eigenvalues, unit eigenvectors as columns) of a symmetric matrix of extended precision.

    An eigenvector's largest entry (the first of equal ones) is positive. Equal eigenvalues share their space: its
    vectors are some orthonormal ones of it.
    """
    size = float(np.abs(v).max(initial=0))
    wide = len(v)
    if not size:
        return np.zeros(wide), np.eye(wide)
    v = v.astype(np.longdouble) / np.longdouble(size)
    _, start = np.linalg.eigh(v.astype(np.float32))
    x = start[:, ::-1].astype(np.longdouble)
    eye = np.eye(wide, dtype=np.longdouble)
    tiny = float(np.finfo(np.longdouble).eps) * wide
    for _ in range(rounds):
        r = eye - x.T @ x
        s = x.T @ v @ x
        r, s = (r + r.T) / 2, (s + s.T) / 2
        values = np.diag(s) / (1 - np.diag(r))
        order = np.argsort(-values, kind="stable")
        x, values, r, s = x[:, order], values[order], r[np.ix_(order, order)], s[np.ix_(order, order)]
        rest = s - np.diag(values)
        error = 2 * float(np.sqrt((rest * rest).sum()) + np.sqrt((r * r).sum()) * np.abs(values).max())
        groups = _clusters(values, max(error, tiny))
        label = np.repeat(np.arange(len(groups)), [len(g) for g in groups])
        apart = label[:, None] != label[None, :]
        gaps = np.where(apart, values[None, :] - values[:, None], 1)
        # half of R keeps the vectors orthonormal; the rest only turns them, by as much either way
        e = r / 2 + np.where(apart, (s + r * (values[None, :] + values[:, None]) / 2) / gaps, 0)
        x = x + x @ e
        turned = 0.0
        for g in groups:
            if len(g) > 1:
                y = x[:, g]
                middle = values[g].mean()
                small = y.T @ v @ y - middle * (y.T @ y)
                scale = np.abs(small).max()
                if scale > tiny:
                    _, turn = np.linalg.eigh((small / scale).astype(np.float64))
                    x[:, g] = y @ turn[:, ::-1].astype(np.longdouble)
                    turned = max(turned, float(scale))
        if float(np.abs(e).max()) < 1e-17 * wide and turned <= tiny:
            break
    x = x / np.sqrt((x * x).sum(axis=0))
    values = (x * (v @ x)).sum(axis=0)
    order = np.argsort(-values, kind="stable")
    x, values = x[:, order], values[order]
    x = x * np.where(x[np.abs(x).argmax(axis=0), np.arange(wide)] < 0, -1, 1)
    return (values * size).astype(np.float64), x.astype(np.float64)


class Fit:
    """What the fit list gives: n, the sums, falling eigenvalues, unit eigenvectors as columns, and the trace."""

    def __init__(self, n: int, total: list[int], scatter: np.ndarray):
        self.n, self.total = n, total
        v = np.array([[np.longdouble(int(c)) for c in row] for row in scatter], np.longdouble) / np.longdouble(n) / np.longdouble(n)
        self.trace = float(np.trace(v))
        self.values, self.vectors = refined_eigenvectors(v)
        # eigenvalues that are zero but for rounding have no direction to be scaled
        self.full = self.values > self.values.max(initial=0) * len(v) * np.finfo(np.float64).eps

    def scaled(self, components: int) -> np.ndarray:
        """Columns that turn centred vectors into whitened ones; zero for components without variance."""
        scale = np.where(self.full, 1 / np.sqrt(np.where(self.full, self.values, 1)), 0)
        return (self.vectors * scale)[:, :components]

    def centred(self, x: np.ndarray) -> np.ndarray:
        middle = np.array([(2 * s + self.n) // (2 * self.n) for s in self.total], object)
        off = np.array([float(np.longdouble(int(s - self.n * m)) / np.longdouble(self.n)) for s, m in zip(self.total, middle, strict=True)])
        y = x - middle.astype(np.int64) if np.abs(x).max(initial=0) < 1 << 52 else x.astype(object) - middle
        return y.astype(np.float64) - off


def identity_error(fit_list: DataFrame, fit: Fit, components: int) -> float:
    """The largest absolute entry of the whitened fit list's covariance minus the identity, over components with variance."""
    scaled, wide = fit.scaled(components), len(fit.total)
    k = scaled.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_only()
        total, products = np.zeros(k), np.zeros((k, k))
        for batch in slices(batches, ROWS):
            w = fit.centred(_matrix(batch, wide)) @ scaled
            total += w.sum(axis=0)
            products += w.T @ w
        flat = np.concatenate([total, products.ravel()])
        yield pa.RecordBatch.from_arrays([pa.array(range(len(flat)), pa.int32()), pa.array(flat)], ["at", "part"])

    rows = fit_list.select("x").transform(in_tasks, run, "at int, part double").groupBy("at").agg(F.sum("part").alias("part")).collect()
    flat = np.zeros(k + k * k)
    for r in rows:
        flat[r["at"]] = r["part"]
    mean, products = flat[:k] / fit.n, flat[k:].reshape(k, k) / fit.n
    off = np.abs(products - np.outer(mean, mean) - np.eye(k))
    full = fit.full[:k]
    return float(off[np.ix_(full, full)].max(initial=0))


def _deviations(x: np.ndarray, fit: Fit) -> list[int]:
    """The sum over dimensions of (n * x - S)^2 of each row, exactly."""
    total = np.array(fit.total, object)
    far = max(int(np.abs(x).max(initial=0)), 1) * fit.n + max((abs(s) for s in fit.total), default=0)
    if far * far * max(len(fit.total), 1) < 1 << 62:
        y = x * fit.n - total.astype(np.int64)
        return (y * y).sum(axis=1).tolist()
    y = x.astype(object) * fit.n - total
    return [int(v) for v in (y * y).sum(axis=1)]


def whiten(vectors: DataFrame, components: int = 4) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) for each vector and component.

    `vectors` has vec_id and embedding (any numeric array); other columns are not looked at. Null vectors and those with a null, NaN or
    infinity have no rows. The fit list is each distinct vector of whole numbers once; repeated vectors have repeated results. Shorter
    vectors count as filled up with zeros. There are no more components than dimensions. A component without variance has whitened and explained 0; an
    empty table gives an empty one. `deviation` is a decimal, exact to 38 digits.
    """
    columns = f"vec_id long, component int, n long, deviation {_WHOLE}, whitened double, explained double, identity_error double"
    rows = whole_numbers(vectors)
    fit_list = stored(rows.select("x").distinct(), "fit_list")
    wide = fit_list.agg(F.max(F.size("x"))).first()[0]
    if not wide:  # no vector at all, or only ones without entries
        return rows.sparkSession.createDataFrame([], columns)
    n, total, most = sums(fit_list, wide)
    fit = Fit(n, total, covariance(fit_list, n, total, most))
    k = min(components, wide)
    scaled = fit.scaled(k)
    explained = [float(v / fit.trace) if fit.trace and full else 0.0 for v, full in zip(fit.values[:k], fit.full, strict=False)]
    error = identity_error(fit_list, fit, k)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_only()
        for batch in slices(batches, ROWS):
            x = _matrix(batch, wide)
            m = len(x)
            ids = batch.column("vec_id").take(pa.array(np.repeat(np.arange(m), k)))
            deviations = pa.array([Decimal(d) for d in _deviations(x, fit)], pa.decimal128(38, 0)).take(pa.array(np.repeat(np.arange(m), k)))
            yield pa.RecordBatch.from_arrays(
                [
                    ids.cast(pa.int64()), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, n)), deviations,
                    pa.array((fit.centred(x) @ scaled).ravel()), pa.array(np.tile(np.array(explained), m)), pa.array(np.full(m * k, error)),
                ],
                ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return rows.transform(in_tasks, run, columns)
