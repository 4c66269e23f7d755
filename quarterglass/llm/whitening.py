"""Whitening of embeddings by spectrum slicing.

Entries become integers x = floor(64 * c) + 1000000, so that the sums behind the covariance are exact and do not depend on
how rows are dealt out: Spark adds up S, then the products of the entries less the integer nearest to their mean, and the
rest of the mean is taken out of the sums as a fraction. What reaches the driver is one matrix of the embedding's dimension.

Eigenvalues are found by slicing its spectrum. The numbers of negative pivots of the LDL' factors of V - s say how many
eigenvalues are below s (Sylvester); bisection of these counts isolates the leading eigenvalues one by one, on a tridiagonal
matrix similar to V, where a count takes one pass for all shifts at once. Rayleigh quotient iteration then converges to the
eigenpair in V itself, and pivoted LDL' counts of V between neighbours certify the numbering.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal
from fractions import Fraction
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCALE, SHIFT = 64, 1_000_000
#: Integers are held to this size, so that sums of their products fit 38 digits.
LARGEST = 2**48


class Components(NamedTuple):
    """Leading eigenpairs of a covariance; ``vectors`` has one column each. ``counts`` has the certifying
    shifts and how many eigenvalues are above each."""

    values: np.ndarray
    vectors: np.ndarray
    trace: float
    counts: list[tuple[float, int]]


# -- eigenpairs ---------------------------------------------------------------


def tridiagonal(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(diagonal, off-diagonal, Q) with Q' v Q tridiagonal, by Householder reflections."""
    a, d = v.copy(), len(v)
    q = np.eye(d)
    for k in range(d - 2):
        x = a[k + 1 :, k].copy()
        norm = np.linalg.norm(x)
        if norm == 0 or not np.any(x[1:]):
            continue
        x[0] += np.copysign(norm, x[0])
        x /= np.linalg.norm(x)
        tail = a[k + 1 :, k + 1 :]
        p = tail @ x
        w = p - (x @ p) * x
        tail -= 2 * (np.outer(x, w) + np.outer(w, x))
        a[k + 1 :, k] = a[k, k + 1 :] = 0
        a[k + 1, k] = a[k, k + 1] = -np.copysign(norm, x[0])
        q[:, k + 1 :] -= 2 * np.outer(q[:, k + 1 :] @ x, x)
    return np.diag(a).copy(), np.diag(a, -1).copy(), q


def counts_below(diagonal: np.ndarray, off: np.ndarray, shifts: np.ndarray) -> np.ndarray:
    """How many eigenvalues of a tridiagonal matrix are below each shift: negative pivots of its LDL' factors."""
    tiny = np.finfo(float).tiny ** 0.5
    pivot = diagonal[0] - shifts
    below = (pivot < 0).astype(np.int64)
    for i in range(1, len(diagonal)):
        pivot = np.where(np.abs(pivot) < tiny, -tiny, pivot)
        pivot = diagonal[i] - shifts - off[i - 1] ** 2 / pivot
        below += pivot < 0
    return below


def inertia_above(v: np.ndarray, shift: float) -> int:
    """How many eigenvalues of a symmetric matrix are above the shift: positive eigenvalues of D in P (v - shift) P' = L D L',
    with pivots of one or two rows chosen as Bunch and Kaufman do."""
    a, n, k, above = v - shift * np.eye(len(v)), len(v), 0, 0
    alpha = (1 + 17**0.5) / 8
    while k < n:
        own, column = abs(a[k, k]), np.abs(a[k + 1 :, k])
        most = column.max(initial=0.0)
        width = 1
        if own < alpha * most:
            r = k + 1 + int(column.argmax())
            others = max(np.abs(a[r, k:r]).max(), np.abs(a[r, r + 1 :]).max(initial=0.0))
            if own * others < alpha * most * most:
                width = 1 if abs(a[r, r]) >= alpha * others else 2
                at = k + width - 1
                a[[at, r]] = a[[r, at]]
                a[:, [at, r]] = a[:, [r, at]]
        rest, block = k + width, a[k : k + width, k : k + width]
        above += 1 if width == 2 else int(a[k, k] > 0)  # two rows are a pivot where they have one eigenvalue on each side
        if np.any(a[rest:, k:rest]):
            side = a[rest:, k:rest].copy()
            a[rest:, rest:] -= side @ np.linalg.solve(block, side.T)
        k = rest
    return above


def isolate(diagonal: np.ndarray, off: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(low, high) around each of the ``most`` largest eigenvalues, from the largest on.

    All intervals are halved together until each is narrow beside the gaps to its neighbours, or as narrow as rounding in
    the matrix is wide, as those of equal eigenvalues become.
    """
    reach = np.abs(np.r_[off, 0]) + np.abs(np.r_[0, off])
    bottom, top = float((diagonal - reach).min()), float((diagonal + reach).max())
    size = max(abs(bottom), abs(top))
    low, high = np.full(most, bottom - 1e-12 * size), np.full(most, top + 1e-12 * size)
    order = len(diagonal) - np.arange(most)  # the k-th largest is number d - k + 1 from below
    while True:
        gap = low[:-1] - high[1:]
        gap = np.minimum(np.r_[np.inf, gap], np.r_[gap, np.inf])
        wide = (high - low > 1e-13 * size) & (high - low > gap / 8)
        if not wide.any():
            return low, high
        middle = low + (high - low) / 2
        under = counts_below(diagonal, off, middle) >= order
        high, low = np.where(wide & under, middle, high), np.where(wide & ~under, middle, low)


def rayleigh(v: np.ndarray, low: float, high: float, start: np.ndarray, found: np.ndarray, steps: int = 20) -> tuple[float, np.ndarray]:
    """Eigenpair in the interval: two inverse iterations from its middle, then shifts by the Rayleigh quotient while that
    stays there, all at a right angle to the ``found`` ones."""
    across = lambda y: y - found @ (found.T @ y)
    middle, width, eye = (low + high) / 2, high - low, np.eye(len(v))
    size = max(abs(low), abs(high), float(np.abs(v).max()))
    x = across(across(start))
    x /= np.linalg.norm(x)
    shift, best = middle, (np.inf, middle, x)
    for step in range(steps):
        try:
            y = np.linalg.solve(v - shift * eye, x)
        except np.linalg.LinAlgError:  # the shift is the eigenvalue
            y = np.linalg.solve(v - (shift + 1e-15 * size) * eye, x)
        y = across(across(y / np.linalg.norm(y)))
        x = y / np.linalg.norm(y)
        quotient = float(x @ v @ x)
        left = float(np.linalg.norm(v @ x - quotient * x))
        if step > 2 and left >= best[0] / 2:
            break
        best = (left, quotient, x)
        shift = quotient if step > 0 and low - width <= quotient <= high + width else middle
    return best[1], best[2]


def leading_components(v: np.ndarray, most: int) -> Components:
    """The leading eigenpairs of a symmetric positive semidefinite matrix, numbered by falling eigenvalue; those that are
    zero to double precision are left out. The largest entry of a vector is positive."""
    d, trace = len(v), float(np.trace(v))
    if d == 0 or trace <= 0:
        return Components(np.zeros(0), np.zeros((d, 0)), 0.0, [])
    diagonal, off, q = tridiagonal(v)
    low, high = isolate(diagonal, off, min(most + 1, d))  # one more, for the gap behind the last
    floor = 8 * d * np.finfo(float).eps * trace
    rng, values, vectors = np.random.default_rng(13), [], np.zeros((d, 0))
    for a, b in zip(low[:most], high[:most], strict=True):
        value, x = rayleigh(v, a, b, q @ rng.standard_normal(d), vectors) if b > floor else (0.0, None)
        if value <= floor:
            break
        values.append(value)
        vectors = np.c_[vectors, x]
    values = np.array(values)
    counts = certify(v, values, float(high[len(values)]) if len(values) < len(high) else 0.0)
    order = np.argsort(-values, kind="stable")  # equal ones differ by rounding
    values, vectors = values[order], vectors[:, order]
    largest = vectors[np.abs(vectors).argmax(axis=0), np.arange(len(values))]
    return Components(values, vectors * np.where(largest < 0, -1.0, 1.0), trace, counts)


def certify(v: np.ndarray, values: np.ndarray, following: float, gap: float = 1e-9) -> list[tuple[float, int]]:
    """(shift, eigenvalues of ``v`` above it) behind every gap between neighbours, ``following`` being the one behind the
    last. Raises where a count differs from the number of values found above. Neighbours without a gap are counted together."""
    counts = []
    for k, (value, after) in enumerate(zip(values, [*values[1:], max(following, 0.0)], strict=True), 1):
        if value - after > gap * values[0]:
            shift = float(value + after) / 2
            counts.append((shift, inertia_above(v, shift)))
            if counts[-1][1] != k:
                raise ArithmeticError(f"{counts[-1][1]} eigenvalues are above {shift}, {k} were found")
    return counts


# -- sums by Spark ------------------------------------------------------------


def _vectors(batch: pa.RecordBatch, dimension: int | None) -> tuple[np.ndarray, np.ndarray]:
    """(row numbers, integers x) of the rows of a batch (id, vector) whose vector is whole; rows of another length than
    ``dimension`` are left out."""
    column = batch.column(1)
    sizes = column.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    flat = column.flatten().cast(pa.float64())
    numbers = flat.fill_null(np.nan).to_numpy(zero_copy_only=False)
    rows = np.flatnonzero(sizes == dimension)
    starts = np.cumsum(np.maximum(sizes, 0)) - np.maximum(sizes, 0)
    c = numbers[starts[rows][:, None] + np.arange(dimension)[None, :]]
    whole = np.isfinite(c).all(axis=1)
    x = np.clip(np.floor(SCALE * c[whole]), -LARGEST, LARGEST).astype(np.int64) + SHIFT
    return rows[whole], x


def _exact(a: np.ndarray, bound: int) -> np.ndarray:
    """Integers that can hold sums up to ``bound``: 64 bits, or Python's own where those don't do."""
    return a if bound < 2**63 else a.astype(object)


def _dimension(rows: DataFrame) -> int:
    """The length that most whole vectors have, the larger of equally frequent ones."""
    whole = F.forall("vector", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    counted = rows.filter(whole).groupBy(F.size("vector").alias("size")).count()
    first = counted.orderBy(F.desc("count"), F.desc("size")).first()
    return first["size"] if first else 0


def _totals(rows: DataFrame, dimension: int) -> tuple[int, list[int]]:
    """(n, S): number of whole vectors and the sum of x in every dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s = 0, np.zeros(dimension, object)
        for batch in batches:
            x = _vectors(batch, dimension)[1]
            n += len(x)
            s = s + _exact(x, len(x) * 2 * LARGEST).sum(axis=0)
        if n:
            yield pa.RecordBatch.from_pylist([{"n": n, "s": [Decimal(int(v)) for v in s]}], schema=schema)

    schema = pa.schema([("n", pa.int64()), ("s", pa.list_(pa.decimal128(38, 0)))])
    parts = rows.mapInArrow(run, "n long, s array<decimal(38,0)>")
    sums = [F.sum(F.col("s")[i]).alias(f"s{i}") for i in range(dimension)]
    out = parts.agg(F.sum("n").alias("n"), *sums).first()
    return (out["n"] or 0), [int(out[f"s{i}"] or 0) for i in range(dimension)]


def _products(rows: DataFrame, dimension: int, n: int, s: list[int]) -> np.ndarray:
    """Covariance, divisor n: products of x less the nearest integers m to the means, less those of the means' rest."""
    middle = np.array([(2 * v + n) // (2 * n) for v in s], np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((dimension, dimension), object)
        for batch in batches:
            z = _vectors(batch, dimension)[1] - middle
            if len(z):
                largest = int(np.abs(z).max())
                exact_in_doubles = largest * largest * len(z) < 2**53
                sums = sums + ((f := z.astype(float)).T @ f).astype(np.int64) if exact_in_doubles else sums + (o := z.astype(object)).T @ o
        yield pa.RecordBatch.from_pylist(
            [{"i": i, "products": [Decimal(int(v)) for v in sums[i]]} for i in range(dimension)], schema=schema
        )

    schema = pa.schema([("i", pa.int32()), ("products", pa.list_(pa.decimal128(38, 0)))])
    parts = rows.mapInArrow(run, "i int, products array<decimal(38,0)>")
    summed = parts.groupBy("i").agg(F.array(*[F.sum(F.col("products")[j]) for j in range(dimension)]).alias("products"))
    rest = [v - n * int(m) for v, m in zip(s, middle, strict=True)]
    out = np.zeros((dimension, dimension))
    for row in summed.collect():
        for j in range(dimension):
            out[row["i"], j] = float(Fraction(n * int(row["products"][j]) - rest[row["i"]] * rest[j], n * n))
    return out


def _identity_error(rows: DataFrame, dimension: int, n: int, white) -> float:
    """Largest absolute entry of the whitened rows' covariance, divisor n, less the identity.

    Whitened rows have the mean 0; what rounding leaves of it is taken out of the products as well.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = 0.0
        for batch in batches:
            w = white(_vectors(batch, dimension)[1])
            w = np.c_[np.ones(len(w)), w]
            total = total + w.T @ w
        if np.ndim(total):
            yield pa.RecordBatch.from_pylist([{"i": i, "products": row} for i, row in enumerate(total.tolist())], schema=schema)

    schema = pa.schema([("i", pa.int32()), ("products", pa.list_(pa.float64()))])
    size = white(np.zeros((1, dimension), np.int64)).shape[1] + 1
    parts = rows.mapInArrow(run, "i int, products array<double>")
    summed = parts.groupBy("i").agg(F.array(*[F.sum(F.col("products")[j]) for j in range(size)]).alias("products"))
    total = np.zeros((size, size))
    for row in summed.collect():
        total[row["i"]] = row["products"]
    mean = total[0, 1:] / n
    return float(np.abs(total[1:, 1:] / n - np.outer(mean, mean) - np.eye(size - 1)).max())


def whiten(embeddings: DataFrame, most: int = 32, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) for each whole vector and each component.

    Rows whose vector is NULL or has a NULL or non-finite entry are left out, and so are vectors of another length than the
    one that most whole vectors have. NULL ids and repeated rows are rows like any other; other columns don't matter. A
    component without variance can't be scaled, so there are as many as V has eigenvalues above zero, ``most`` at most:
    none, and so no rows, for a table that is empty or has one distinct vector only. Integers beyond 2 ** 48 count as that.
    ``deviation`` is NULL where it is beyond a long. The driver holds one square of the vectors' length.
    """
    rows = embeddings.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector"))
    spark, dimension = rows.sparkSession, _dimension(rows)
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    n, s = _totals(rows, dimension) if dimension else (0, [])
    found = leading_components(_products(rows, dimension, n, s), most) if n else None
    if found is None or not len(found.values):
        return spark.createDataFrame([], schema)
    whole, rest = np.array([v // n for v in s], np.int64), np.array([v % n for v in s], np.int64)
    part, turn, k = rest / n, found.vectors / np.sqrt(found.values), len(found.values)
    explained = found.values / found.trace

    def white(x: np.ndarray) -> np.ndarray:
        """Less the mean, whose whole part goes exactly, and on the components."""
        return ((x - whole) - part) @ turn

    error = _identity_error(rows, dimension, n, white)

    def deviations(x: np.ndarray) -> list[int | None]:
        far = n * (int(np.abs(x - whole).max(initial=0)) + 1)
        y = _exact(x - whole, far * far * dimension) * n - rest
        return [int(v) if v < 2**63 else None for v in (y * y).sum(axis=1)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 2_000):
                piece = batch.slice(at, 2_000)
                kept, x = _vectors(piece, dimension)
                m = len(kept)
                ids = piece.column(0).take(pa.array(np.repeat(kept, k)))
                yield pa.RecordBatch.from_arrays(
                    [
                        ids, pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, n)),
                        pa.array(deviations(x), pa.int64()).take(pa.array(np.repeat(np.arange(m), k))), pa.array(white(x).ravel()),
                        pa.array(np.tile(explained, m)), pa.array(np.full(m * k, error)),
                    ],
                    ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return rows.mapInArrow(run, schema)
