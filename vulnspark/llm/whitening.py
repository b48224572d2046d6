"""Embedding whitening by polarisation covariance.

Only squares are summed: of every centred dimension and of every sum of two centred dimensions.
Var(a + b) - Var(a) - Var(b) = 2 Cov(a, b) gives the cross-covariances. All sums are exact
integers: values are centred by the whole part of their mean before they are squared, and the rest
of the mean, a fraction with denominator n, is taken off in integers at the end. The assembled
matrix of d x d numbers goes through `eigh` on the driver.

Tasks sum their own rows and send one row per pair of dimensions, whatever they read.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCALE, SHIFT, COMPONENTS = 64, 1_000_000, 32
#: Entries are held within these bounds, so that every x is a long.
WIDEST = float(1 << 61)
SUMS = "i int, j int, total decimal(38,0)"


def _usable(vector: Column) -> Column:
    return vector.isNotNull() & F.forall(
        vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))
    )


def _fixed_point(batch: pa.RecordBatch, dims: int) -> np.ndarray:
    """x of every row, as longs."""
    flat = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    whole = np.clip(np.floor(flat * SCALE), -WIDEST, WIDEST)
    return whole.astype(np.int64).reshape(-1, dims) + SHIFT


def _exact(values: np.ndarray, most: int) -> np.ndarray:
    """The values as they are if sums up to `most` fit in longs, else as whole numbers of any size."""
    return values if most < 1 << 62 else values.astype(object)


def _bound(values: np.ndarray) -> int:
    return max(int(values.max()), -int(values.min()), 1) if values.size else 1


def _emit(totals: np.ndarray, pairs: tuple[np.ndarray, np.ndarray]) -> pa.RecordBatch:
    exact = pa.array([Decimal(int(t)) for t in totals], pa.decimal128(38, 0))
    columns = [pa.array(pairs[0], pa.int32()), pa.array(pairs[1], pa.int32()), exact]
    return pa.RecordBatch.from_arrays(columns, names=["i", "j", "total"])


def _sum_dimensions(dims: int):
    """Per task: the number of rows as (-1, -1) and the sum of each dimension as (i, i)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = np.zeros(dims + 1, object)
        for batch in batches:
            x = _fixed_point(batch, dims)
            totals[0] += len(x)
            totals[1:] += _exact(x, _bound(x) * max(len(x), 1)).sum(axis=0).astype(object)
        at = np.arange(-1, dims)
        yield _emit(totals, (at, at))

    return run


def _sum_squares(dims: int, middle: np.ndarray):
    """Per task: sums of squares of centred dimensions as (-1, i), of sums of two of them as (i, j)."""
    upper = np.triu_indices(dims, 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        single, double = np.zeros(dims, object), np.zeros(len(upper[0]), object)
        for batch in batches:
            y = _fixed_point(batch, dims) - middle
            y = _exact(y, 4 * _bound(y) ** 2 * max(len(y), 1))
            single += (y * y).sum(axis=0).astype(object)
            parts = []
            for i in range(dims - 1):
                both = y[:, i + 1 :] + y[:, i : i + 1]
                parts.append((both * both).sum(axis=0))
            if parts:
                double += np.concatenate(parts).astype(object)
        rows = np.concatenate([np.full(dims, -1), upper[0]]), np.concatenate([np.arange(dims), upper[1]])
        yield _emit(np.concatenate([single, double]), rows)

    return run


def covariance(n: int, sums: list[int], single: list[int], double: dict[tuple[int, int], int], middle: list[int]):
    """The covariance matrix from sums of squares, exact until each entry's one division."""
    rest = [s - n * m for s, m in zip(sums, middle, strict=True)]
    own = [n * q - r * r for q, r in zip(single, rest, strict=True)]
    v = np.diag([q / (n * n) for q in own])
    for (i, j), q in double.items():
        pair = n * q - (rest[i] + rest[j]) ** 2
        v[i, j] = v[j, i] = (pair - own[i] - own[j]) / (2 * n * n)
    return v


class _Fit:
    """What the tasks need of the fit; small, so it travels with their code."""

    def __init__(self, n: int, sums: list[int], middle: list[int], v: np.ndarray, components: int):
        dims = len(sums)
        values, vectors = np.linalg.eigh(v)
        order = np.argsort(values, kind="stable")[::-1][: min(components, dims)]
        values, vectors = values[order], vectors[:, order]
        largest = vectors[np.abs(vectors).argmax(axis=0), np.arange(len(order))]
        trace = float(np.trace(v))
        self.n, self.dims, self.sums = n, dims, sums
        self.middle = np.array(middle, np.int64)
        self.rest = np.array([(s - n * m) / n for s, m in zip(sums, middle, strict=True)])
        self.spread = values > values[0] * dims * np.finfo(float).eps if trace > 0 else np.zeros(len(values), bool)
        roots = np.sqrt(np.where(self.spread, values, 1.0))
        self.project = np.where(self.spread, vectors * np.where(largest < 0, -1.0, 1.0) / roots, 0.0)
        self.explained = [float(max(e, 0.0) / trace) if trace > 0 else 0.0 for e in values]

    def whiten(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.middle) - self.rest) @ self.project

    def deviation(self, x: np.ndarray) -> pa.Array:
        """Sum of (n * x - S)^2 of each row; null where it is no long."""
        sums = np.array(self.sums, object)
        reach = self.n * _bound(x) + max(map(abs, self.sums))
        if reach < 1 << 62:
            z = self.n * x - sums.astype(np.int64)
            if self.dims * _bound(z) ** 2 < 1 << 62:
                return pa.array((z * z).sum(axis=1))
        z = self.n * x.astype(object) - sums
        return pa.array([int(s) if s < 1 << 63 else None for s in (z * z).sum(axis=1)], pa.int64())


def _sum_products(fit: _Fit):
    """Per task: its own means and centred products of whitened components."""
    upper = np.triu_indices(fit.project.shape[1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, mean, products = 0, np.zeros(fit.project.shape[1]), 0.0
        for batch in batches:
            w = fit.whiten(_fixed_point(batch, fit.dims))
            if not len(w):
                continue
            step = w.mean(axis=0) - mean
            own = w - w.mean(axis=0)
            products = products + own.T @ own + np.outer(step, step) * (n * len(w) / (n + len(w)))
            mean, n = mean + step * (len(w) / (n + len(w))), n + len(w)
        if n:
            columns = [*map(pa.array, upper), mean[upper[0]], mean[upper[1]], products[upper], np.full(len(upper[0]), float(n))]
            yield pa.RecordBatch.from_arrays(list(map(pa.array, columns)), names=["i", "j", "a", "b", "p", "n"])

    return run


def _identity_error(rows: DataFrame, fit: _Fit) -> float:
    """Largest absolute entry of the whitened covariance minus the identity, over components that vary."""
    sent = rows.mapInArrow(_sum_products(fit), "i long, j long, a double, b double, p double, n double")
    n = F.sum("n")
    total = F.sum("p") + F.sum(F.col("n") * F.col("a") * F.col("b"))
    total -= F.sum(F.col("n") * F.col("a")) * F.sum(F.col("n") * F.col("b")) / n
    entries = sent.groupBy("i", "j").agg((total / n).alias("c")).collect()
    return max((abs(e.c - (e.i == e.j)) for e in entries if fit.spread[e.i] and fit.spread[e.j]), default=0.0)


def whiten(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS
) -> DataFrame:
    """One row per usable vector: id, n, deviation, whitened and explained (arrays by component, by
    falling variance), identity_error.

    An entry c becomes x = floor(64 c) + 1,000,000; n vectors with sums S are fitted. `deviation`
    is the exact sum of (n x - S)^2, null beyond the range of a long. There are min(components,
    dimensions) components; one without variance has whitened 0.0 and does not count in
    identity_error. Signs: the largest entry of a component is positive.

    Dropped are null vectors, vectors with null or non-finite entries, and vectors of another
    length than most have (of equally many the greater length stays). Entries beyond 2^61 / 64
    count as that bound. Null ids and repeated rows stay as they are, each a row of the fit. Other
    columns are not read. An empty table gives an empty result. Empty vectors have no component and
    are no result rows unless they are all there is: then their arrays are empty.
    """
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("vector")).filter(_usable(F.col("vector")))
    sizes = rows.groupBy(F.size("vector").alias("dims")).agg(F.count("*").alias("n"))
    most = sizes.orderBy(F.desc("n"), F.desc("dims")).first()
    shape = "deviation long, whitened array<double>"
    id_type = rows.schema["id"].dataType.simpleString()
    if most is None or not most.dims:
        return rows.filter(F.lit(most is not None)).select(
            F.col("id").alias(id_col),
            F.lit(most.n if most else 0).cast("long").alias("n"),
            F.lit(0).cast("long").alias("deviation"),
            F.array().cast("array<double>").alias("whitened"),
            F.array().cast("array<double>").alias("explained"),
            F.lit(0.0).alias("identity_error"),
        )
    dims = most.dims
    rows = rows.filter(F.size("vector") == dims)
    added = lambda df: df.groupBy("i", "j").agg(F.sum("total").alias("total")).collect()
    first = {r.i: int(r.total) for r in added(rows.mapInArrow(_sum_dimensions(dims), SUMS))}
    n, sums = first[-1], [first[i] for i in range(dims)]
    middle = [s // n for s in sums]
    squares = {
        (r.i, r.j): int(r.total) for r in added(rows.mapInArrow(_sum_squares(dims, np.array(middle, np.int64)), SUMS))
    }
    single = [squares.pop((-1, i)) for i in range(dims)]
    fit = _Fit(n, sums, middle, covariance(n, sums, single, squares, middle), components)
    error = _identity_error(rows, fit)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _fixed_point(batch, dims)
            w = fit.whiten(x)
            ends = np.arange(len(w) + 1, dtype=np.int32) * w.shape[1]
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(w.ravel()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), fit.deviation(x), lists], names=["id", "deviation", "whitened"]
            )

    return rows.mapInArrow(run, f"id {id_type}, {shape}").select(
        F.col("id").alias(id_col),
        F.lit(n).cast("long").alias("n"),
        "deviation",
        "whitened",
        F.lit(fit.explained).cast("array<double>").alias("explained"),
        F.lit(error).alias("identity_error"),
    )


def by_component(whitened: DataFrame, id_col: str = "vec_id") -> DataFrame:
    """One row per vector and component, numbered from 1."""
    each = F.posexplode("whitened").alias("place", "value")
    return whitened.select(id_col, "n", "deviation", "explained", "identity_error", each).select(
        id_col,
        (F.col("place") + 1).cast("int").alias("component"),
        "n",
        "deviation",
        F.col("value").alias("whitened"),
        F.get("explained", F.col("place")).alias("explained"),
        "identity_error",
    )
