"""Embedding whitening by mixed-precision refinement of eigenvectors.

Vectors become whole numbers on a fixed scale. Their covariance is summed over all tasks
from products of centred whole numbers, so it is exact, whatever the offset of the values
and the order of the tasks; it is rounded once, to extended precision. Eigenvectors
are first computed in float32. Iterations of the Ogita-Aishima kind then correct them by
matrix products in extended precision, doubling the right digits each time. Where
eigenvalues lie too close for that, the correction cannot tell their vectors apart: such
a cluster is solved by itself, in the space its vectors span, shifted by its mean so that
the small differences keep their digits, and then refined on.

Only the covariance (dimensions squared) passes the driver, never rows. The vectors are
read twice for the fit and once to be whitened.

Defined results: vectors that are null, or hold a null, NaN or infinite component, or one
whose whole number leaves 2^40, take no part; nor do vectors whose length is not the most
frequent one (the smallest of the most frequent). Rows without an id, and rows with one
id, are rows like others. Components whose eigenvalue is zero (to rounding) do not exist,
so equal vectors give no rows. ``deviation`` is null where it leaves 64 bits. An empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from stayline.llm.common import as_row, keep

SCALE, OFFSET = 64, 1_000_000
#: Whole numbers beyond this are not taken: products must fit 38 digits when summed.
LARGEST = float(1 << 40)
_EXACT = float(1 << 53)
_WIDE = np.longdouble
_ROUNDS = 30


def usable(df: DataFrame, vector: str, carry: list[str] | None = None, scale: int = SCALE, offset: int = OFFSET) -> DataFrame:
    """``row`` (see ``as_row``) and ``x``, the vector in whole numbers, of all usable rows of
    the most frequent length."""
    v = F.col(f"`{vector}`").cast("array<double>")
    good = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(LARGEST / scale - offset))
    whole = df.select(as_row(df, carry), v.alias("v")).where(F.col("v").isNotNull()).where(F.forall("v", good))
    rows = whole.select("row", F.transform("v", lambda c: F.floor(c * scale) + offset).alias("x"))
    lengths = rows.groupBy(F.size("x").alias("d")).agg(F.count(F.lit(1)).alias("n"))
    best = lengths.orderBy(F.col("n").desc(), "d").first()
    return rows.where(F.size("x") == (best["d"] if best else 0))


def _matrix(column: pa.Array | pa.ChunkedArray, kind: type) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False).reshape(len(column), -1)


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per task: rows and exact sums per dimension."""
    n, total = 0, None
    for batch in batches:
        if batch.num_rows:
            n += batch.num_rows
            own = _matrix(batch.column("x"), np.int64).sum(axis=0).astype(object)
            total = own if total is None else total + own
    if n:
        yield _cells(range(len(total)), [0] * len(total), [n] * len(total), total)


def _cells(i, j, n, values) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([
        pa.array(list(i), pa.int32()), pa.array(list(j), pa.int32()), pa.array(list(n), pa.int64()),
        pa.array([str(int(v)) for v in values], pa.string())], ["i", "j", "n", "v"])


_CELLS = "i int, j int, n long, v string"


def gram(z: np.ndarray) -> np.ndarray:
    """z'z of whole numbers, exact: in doubles where no sum can leave 53 bits, else in
    halves of the numbers."""
    most = float(np.abs(z).max(initial=0))
    if most * most * max(len(z), 1) < _EXACT:
        f = z.astype(float)
        return (f.T @ f).astype(np.int64).astype(object)
    if len(z) > 256:
        return gram(z[:256]) + gram(z[256:])
    high, low = z >> 21, z & ((1 << 21) - 1)
    a, b = high.astype(float), low.astype(float)
    part = lambda p, q: (p.T @ q).astype(np.int64).astype(object)
    cross = part(a, b)
    return part(a, a) * (1 << 42) + (cross + cross.T) * (1 << 21) + part(b, b)


def _products(centre: np.ndarray):
    """One set of cells per task: exact products of vectors less ``centre``, and their sums
    (in column -1)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, sums = None, None
        for batch in batches:
            x = _matrix(batch.column("x"), np.int64) if batch.num_rows else np.zeros((0, len(centre)), np.int64)
            for at in range(0, len(x), 4096):
                z = x[at:at + 4096] - centre
                total = gram(z) if total is None else total + gram(z)
                own = z.sum(axis=0).astype(object)
                sums = own if sums is None else sums + own
        if total is not None:
            i, j = np.triu_indices(len(total))
            yield _cells(i, j, [0] * len(i), total[i, j])
            yield _cells(range(len(sums)), [-1] * len(sums), [0] * len(sums), sums)

    return run


def _summed(cells: DataFrame) -> list:
    exact = F.sum(F.col("v").cast("decimal(38,0)")).cast("string").alias("v")
    return cells.groupBy("i", "j").agg(F.sum("n").alias("n"), exact).collect()


@dataclass(frozen=True)
class Fit:
    """What whitening needs: rows, sums per dimension, components as columns, eigenvalues."""

    n: int
    sums: list[int]
    components: np.ndarray
    values: np.ndarray
    trace: float


def covariance(rows: DataFrame) -> tuple[int, list[int], np.ndarray]:
    """Rows, sums, and n^2 times the covariance as exact whole numbers.

    Products are of ``x`` less the rounded mean, a whole number; what the rounding leaves
    is taken off exactly at the end.
    """
    spark = rows.sparkSession
    first = _summed(rows.select("x").mapInArrow(_sums, _CELLS))
    d = len(first)
    if not d:
        return 0, [], np.zeros((0, 0), object)
    sums, n = [0] * d, first[0]["n"]
    for r in first:
        sums[r["i"]] = int(r["v"])
    centre = spark.sparkContext.broadcast(np.array([round_half(s, n) for s in sums], np.int64))
    products, left = np.zeros((d, d), object), [0] * d

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _products(centre.value)(batches)

    for r in _summed(rows.select("x").mapInArrow(task, _CELLS)):
        if r["j"] < 0:
            left[r["i"]] = int(r["v"])
        else:
            products[r["i"], r["j"]] = products[r["j"], r["i"]] = int(r["v"])
    rest = np.array(left, object)
    return n, sums, n * products - np.outer(rest, rest)


def round_half(a: int, b: int) -> int:
    return (2 * a + b) // (2 * b)


def wide(matrix: np.ndarray, divisor: int) -> np.ndarray:
    """Exact fractions rounded once to extended precision."""
    high = matrix.astype(float)
    rest = (matrix - np.vectorize(int, otypes=[object])(high) if matrix.size else matrix).astype(float)
    return (high.astype(_WIDE) + rest.astype(_WIDE)) / _WIDE(divisor)


def _clusters(values: np.ndarray, gap: float) -> list[np.ndarray]:
    """Indices of eigenvalues that follow each other within ``gap``, if two or more."""
    order = np.argsort(values)
    cuts = np.nonzero(np.diff(values[order]) > gap)[0] + 1
    return [c for c in np.split(order, cuts) if len(c) > 1]


def _corrected(v: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """One step: better vectors, the eigenvalues, and the gap below which it cannot tell
    vectors apart."""
    r = np.eye(len(v), dtype=_WIDE) - x.T @ x
    s = x.T @ (v @ x)
    values = np.diag(s) / (1 - np.diag(r))
    off = s - np.diag(np.diag(s))
    gap = 2 * (np.sqrt((off ** 2).sum()) + np.abs(values).max() * np.sqrt((r ** 2).sum()))
    apart = values[None, :] - values[:, None]
    told = np.abs(apart) > gap
    e = np.where(told, (s + values[None, :] * r) / np.where(told, apart, 1), r / 2)
    return x + x @ e, values, float(gap)


def _orthonormal(x: np.ndarray) -> np.ndarray:
    """Newton steps towards the nearest matrix with orthonormal columns."""
    eye = np.eye(x.shape[1], dtype=_WIDE)
    for _ in range(4):
        x = x + x @ ((eye - x.T @ x) / 2)
    return x


def refined(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors (columns) of a symmetric matrix in
    extended precision, as doubles.

    A cluster whose sub-solve moves no digit any more is one of equal eigenvalues: any
    basis of its space will do.
    """
    d = len(v)
    if not d:
        return np.zeros(0), np.zeros((0, 0))
    size = np.abs(v).max()
    if size == 0:
        return np.zeros(d), np.eye(d)
    scaled = v / size
    x = _orthonormal(np.linalg.eigh(scaled.astype(np.float32))[1].astype(_WIDE))
    done = 4 * d * float(np.finfo(_WIDE).eps)
    last = np.inf
    for _ in range(_ROUNDS):
        x, values, gap = _corrected(scaled, x)
        x = _orthonormal(x)
        s = x.T @ (scaled @ x)
        values = np.diag(s).copy()
        for own in _clusters(values, gap):
            mean = values[own].mean()
            shifted = x[:, own].T @ (scaled @ x[:, own] - mean * x[:, own])
            span = np.abs(shifted).max()
            if span > done:
                turn = np.linalg.eigh((shifted / span).astype(float))[1].astype(_WIDE)
                x[:, own] = x[:, own] @ _orthonormal(turn)
        s = x.T @ (scaled @ x)
        off = float(np.abs(s - np.diag(np.diag(s))).max())
        if off <= done or off >= last:
            break
        last = off
    values = np.diag(x.T @ (scaled @ x)) * size
    order = np.argsort(-values, kind="stable")
    return values[order].astype(float), x[:, order].astype(float)


def fit(rows: DataFrame, components: int = 32) -> Fit | None:
    """The first ``components`` with eigenvalues above zero, or None without any."""
    n, sums, exact = covariance(rows)
    if not n:
        return None
    values, vectors = refined(wide(exact, n * n))
    trace = sum(int(exact[i, i]) for i in range(len(sums))) / (n * n)
    real = values > max(values[0], 0) * len(sums) * np.finfo(float).eps * 4
    count = min(components, int(real.sum()))
    return Fit(n, sums, vectors[:, :count], values[:count], trace) if count else None


def deviations(x: np.ndarray, n: int, sums: list[int]) -> tuple[np.ndarray, list[int | None]]:
    """(x - S/n) of whole rows, rounded once, and the exact sums of (n x - S)^2."""
    top = float(np.abs(x).max(initial=0)) * n + max(map(abs, sums))
    if top < float(1 << 62):
        moved = x * n - np.array(sums, np.int64)
        centred = moved / n
        if float(np.abs(moved).max(initial=0)) ** 2 * x.shape[1] < float(1 << 62):
            return centred, (moved * moved).sum(axis=1).tolist()
    else:
        moved = x.astype(object) * n - np.array(sums, object)
        centred = np.array([[int(c) / n for c in r] for r in moved], float).reshape(x.shape)
    squares = [sum(int(c) ** 2 for c in r) for r in moved]
    return centred, [s if s < 1 << 63 else None for s in squares]


def whitened(rows: DataFrame, fitted: Fit) -> DataFrame:
    """``row``, ``deviation`` and ``whitened``, one entry per component."""
    spark: SparkSession = rows.sparkSession
    sent = spark.sparkContext.broadcast((fitted.n, fitted.sums, fitted.components / np.sqrt(fitted.values)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, turn = sent.value
        for batch in batches:
            if batch.num_rows:
                centred, exact = deviations(_matrix(batch.column("x"), np.int64), n, sums)
                out = centred @ turn
                ends = np.arange(len(out) + 1, dtype=np.int32) * out.shape[1]
                yield pa.RecordBatch.from_arrays([
                    batch.column("row"), pa.array(exact, pa.int64()),
                    pa.ListArray.from_arrays(ends, pa.array(out.ravel()))], ["row", "deviation", "whitened"])

    row = rows.schema["row"].dataType.simpleString()
    return rows.select("row", "x").mapInArrow(run, f"row {row}, deviation long, whitened array<double>")


def _pairs(mean: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(mean), len(mean)))
        for batch in batches:
            if batch.num_rows:
                w = _matrix(batch.column("whitened"), float) - mean
                total += w.T @ w
        i, j = np.triu_indices(len(mean))
        yield pa.RecordBatch.from_arrays([
            pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(total[i, j])], ["i", "j", "v"])

    return run


def identity_error(done: DataFrame, n: int) -> float:
    """How far the covariance of a written ``whitened`` column is from the identity: its
    mean first, then the centred products, both over all rows."""
    entries = done.select(F.posexplode("whitened").alias("i", "w")).groupBy("i").agg(F.sum("w").alias("s"))
    means = {r["i"]: r["s"] / n for r in entries.collect()}
    mean = np.array([means[i] for i in range(len(means))])
    cells = done.select("whitened").mapInArrow(_pairs(mean), "i int, j int, v double")
    summed = cells.groupBy("i", "j").agg((F.sum("v") / n).alias("v"))
    return summed.agg(F.max(F.abs(F.col("v") - (F.col("i") == F.col("j")).cast("double"))).alias("e")).first()["e"]


_SCHEMA = "component int, n long, deviation long, whitened double, explained double, identity_error double"


def whiten(df: DataFrame, vector: str, components: int = 32, carry: list[str] | None = None) -> tuple[DataFrame, Fit | None]:
    """A written table of ``row``, ``deviation`` and ``whitened``, and the fit behind it."""
    rows = keep(usable(df, vector, carry), "vectors")
    fitted = fit(rows, components)
    if fitted is None:
        row = rows.schema["row"].dataType.simpleString()
        return df.sparkSession.createDataFrame([], f"row {row}, deviation long, whitened array<double>"), None
    return keep(whitened(rows, fitted), "whitened"), fitted


def by_component(done: DataFrame, fitted: Fit | None) -> DataFrame:
    """One row per vector and component, with the figures of the fit."""
    if fitted is None:
        return done.select("row", *[F.lit(None).cast(f.split()[1]).alias(f.split()[0]) for f in _SCHEMA.split(", ")])
    error = identity_error(done, fitted.n)
    explained = F.array(*[F.lit(float(e / fitted.trace)) for e in fitted.values])
    each = done.select("row", "deviation", F.posexplode("whitened").alias("i", "w"))
    return each.select(
        "row", (F.col("i") + 1).cast("int").alias("component"), F.lit(fitted.n).cast("long").alias("n"), "deviation",
        F.col("w").alias("whitened"), F.get(explained, F.col("i")).alias("explained"), F.lit(error).alias("identity_error"))
