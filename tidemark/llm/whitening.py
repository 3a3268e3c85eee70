"""Whitening of embeddings on eigenvectors refined in mixed precision.

Entries become whole numbers, so the sums of a table are exact. Tasks form the Gram
matrices of rows centred on the rounded mean; whole numbers below 2 ** 53 make these exact
too, and the rest of the mean is taken off at the end in extended precision. Float32
eigenvectors of the covariance are then corrected by iterations of Ogita and Aishima:
every iteration multiplies matrices in extended precision, measures how far the vectors
are from orthonormal and from diagonalising the covariance, and roughly doubles the
correct digits. Pairs of eigenvalues closer than the iteration can tell apart form
clusters; inside a cluster a small eigenproblem of the shifted covariance is solved and
its vectors are turned accordingly.

Partial sums and Gram matrices are added up by Spark, one row per dimension, and only
d sums and a d x d matrix reach the driver, whatever the number of rows.

Defined results: a vector that is null, empty or holds a null or a non-finite entry is
dropped. Vectors of another length than the commonest one (of equally common ones the
longest) are dropped too, since no covariance is defined over them. Entries beyond 2 ** 52
saturate there. Repeated rows count as often as they occur, null ids stay null. A component
without variance, numerically (e below d * 2 ** -52 times the largest), has a null
whitened value and does not enter identity_error; explained is null if the trace is 0. A
deviation beyond the range of a long is null. An empty table gives an empty result.
Columns besides id and vector are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.session import materialize

SCALE, SHIFT = 1024, 100000
COMPONENTS = 8
#: Whole numbers up to here are exact as doubles and far from the ends of a long.
MOST = float(2**52)
#: Rows of a block in a task.
BLOCK = 4096

Extended = np.longdouble


def whole(entries: np.ndarray) -> np.ndarray:
    """floor(1024 * c) + 100000 of each entry, as whole doubles."""
    return np.clip(np.floor(SCALE * entries.astype(np.float64)) + SHIFT, -MOST, MOST)


# --- the eigenproblem ------------------------------------------------------


def clusters(values: np.ndarray, nearest: float) -> list[np.ndarray]:
    """Runs of two or more neighbours among the sorted values that lie within `nearest`."""
    order = np.argsort(values)
    breaks = np.flatnonzero(np.diff(values[order]) > nearest) + 1
    return [run for run in np.split(order, breaks) if len(run) > 1]


def refine(matrix: np.ndarray, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """One correction of approximate eigenvectors; (vectors, values, what is not told apart)."""
    lack = np.eye(len(matrix), dtype=Extended) - vectors.T @ vectors
    turned = vectors.T @ (matrix @ vectors)
    # Symmetric, so that opposite corrections of a pair leave it orthogonal however near its values are.
    lack, turned = (lack + lack.T) / 2, (turned + turned.T) / 2
    values = np.diag(turned) / (1 - np.diag(lack))
    off = turned - np.diag(values)
    norm = lambda m: Extended(np.sqrt((m * m).sum()))
    nearest = 2 * (norm(off) + Extended(np.abs(values).max()) * norm(lack))
    gap = values[None, :] - values[:, None]
    apart = np.abs(gap) > nearest
    step = np.where(apart, (turned + values[None, :] * lack) / np.where(apart, gap, 1), lack / 2)
    return vectors + vectors @ step, values, nearest


def eigenvectors(matrix: np.ndarray, rounds: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors of a symmetric matrix in extended precision."""
    matrix = np.asarray(matrix, Extended)
    d = len(matrix)
    size = Extended(np.abs(matrix).max(initial=0))
    if not size:
        return np.zeros(d, Extended), np.eye(d, dtype=Extended)
    scaled = matrix / size
    vectors = np.linalg.eigh(scaled.astype(np.float32))[1].astype(Extended)
    floor = d * np.finfo(Extended).eps
    for _ in range(rounds):
        before = vectors
        vectors, values, nearest = refine(scaled, vectors)
        for members in clusters(values, nearest):
            inside = vectors[:, members]
            middle = values[members].mean()
            small = inside.T @ (scaled @ inside) - middle * (inside.T @ inside)
            spread = Extended(np.abs(small).max())
            if spread > floor:
                turn = np.linalg.eigh(((small + small.T) / (2 * spread)).astype(np.float64))[1]
                vectors[:, members] = inside @ turn.astype(Extended)
        if np.abs(vectors - before).max() <= floor:
            break
    vectors = vectors + vectors @ (np.eye(d, dtype=Extended) - vectors.T @ vectors) / 2
    values = (vectors * (scaled @ vectors)).sum(axis=0) / (vectors * vectors).sum(axis=0)
    order = np.argsort(-values, kind="stable")
    vectors = vectors[:, order] / np.sqrt((vectors[:, order] ** 2).sum(axis=0))
    return values[order] * size, vectors


# --- sums over the table ---------------------------------------------------


@dataclass(frozen=True)
class Fit:
    """What the rows are transformed by; small arrays of d numbers or d x k."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float

    @property
    def usable(self) -> np.ndarray:
        least = len(self.sums) * 2.0**-52 * self.values.max(initial=0)
        return self.values > least

    def whiten(self, x: np.ndarray, k: int) -> np.ndarray:
        """Rows of whole numbers on the first k components; nan for those without variance."""
        mean = np.array([s // self.n for s in self.sums], np.float64)
        rest = np.array([s % self.n / self.n for s in self.sums])
        # The rest of the mean is projected apart, so centring loses no digit.
        basis = (self.vectors[:, :k] / np.sqrt(np.where(self.usable[:k], self.values[:k], 1))).astype(np.float64)
        found = (x - mean) @ basis - rest @ basis
        found[:, ~self.usable[:k]] = np.nan
        return found


def _blocks(batches: Iterator[pa.RecordBatch], at: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Pieces of batches with the matrix of the vectors in column `at`, all of one length."""
    for batch in batches:
        for start in range(0, batch.num_rows, BLOCK):
            piece = batch.slice(start, BLOCK)
            column = piece.column(at)
            entries = column.flatten().to_numpy(zero_copy_only=False)
            yield piece, whole(entries.reshape(len(piece), -1))


def _column_sums(vectors: DataFrame) -> DataFrame:
    """(i, n, total) per dimension, exact decimals."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, 0
        for _, x in _blocks(batches, 0):
            n += len(x)
            # Halves keep sums of large whole numbers exact: neither overflows 64 bits.
            high, low = np.divmod(x.astype(np.int64), 1 << 26)
            total = total + high.sum(axis=0).astype(object) * (1 << 26) + low.sum(axis=0).astype(object)
        if n:
            count = len(total)
            yield pa.record_batch(
                [pa.array(range(count), pa.int32()), pa.array([n] * count, pa.int64()), pa.array([str(t) for t in total])],
                ["i", "n", "total"],
            )

    parts = vectors.mapInArrow(add, "i INT, n LONG, total STRING")
    return parts.groupBy("i").agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))


def _gram(rows: DataFrame, centred, d: int) -> np.ndarray:
    """Sum over all rows of the outer products of `centred(batch rows)`, d x d."""

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((d, d), Extended)
        for _, x in _blocks(batches, 0):
            c = centred(x)
            total += c.T @ c
        if total.any():
            high = total.astype(np.float64)
            low = (total - high).astype(np.float64)
            i, j = np.divmod(np.arange(d * d), d)
            yield pa.record_batch([pa.array(v) for v in (i, j, high.ravel(), low.ravel())], ["i", "j", "high", "low"])

    parts = rows.mapInArrow(multiply, "i LONG, j LONG, high DOUBLE, low DOUBLE")
    found = parts.groupBy("i", "j").agg(F.sum("high").alias("high"), F.sum("low").alias("low")).toArrow()
    total = np.zeros((d, d), Extended)
    at = (found["i"].to_numpy(), found["j"].to_numpy())
    total[at] = found["high"].to_numpy().astype(Extended) + found["low"].to_numpy().astype(Extended)
    return total


def usable_vectors(table: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, vector) of the rows that are kept; vectors of the commonest length."""
    vector = F.col(f"`{vector_col}`").cast("array<double>")
    bad = F.exists(vector, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    rows = table.select(F.col(f"`{id_col}`").alias("id"), F.when(~bad, vector).alias("vector"))
    rows = rows.filter(F.size("vector") > 0)
    sizes = rows.groupBy(F.size("vector").alias("size")).count()
    commonest = sizes.agg(F.max_by("size", F.struct("count", "size"))).first()[0]
    return rows.filter(F.size("vector") == F.lit(commonest or 0))


def fit(vectors: DataFrame, most: int = COMPONENTS) -> Fit | None:
    """Mean and leading components of (vector) rows; None without rows."""
    sums = sorted(_column_sums(vectors.select("vector")).collect())
    if not sums:
        return None
    n, d, totals = sums[0]["n"], len(sums), [int(r["total"]) for r in sums]
    middle = np.array([(2 * t + n) // (2 * n) for t in totals], np.float64)
    # A sum of whole numbers less the rounded mean is exact; the rest of the mean, at most a half, is taken off after.
    gram = _gram(vectors.select("vector"), lambda x: x - middle, d)
    rest = np.array([Extended(t - int(m) * n) for t, m in zip(totals, middle, strict=True)]) / n
    covariance = gram / n - np.outer(rest, rest)
    values, axes = eigenvectors((covariance + covariance.T) / 2)
    k = min(most, d)
    return Fit(n, totals, np.maximum(values[:k], 0), axes[:, :k], float(np.trace(covariance)))


def whiten(vectors: DataFrame, model: Fit) -> DataFrame:
    """(id, component, deviation, whitened) of every row, components from 1."""
    k, n = model.vectors.shape[1], model.n

    def transform(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece, x in _blocks(batches, 1):
            found = model.whiten(x, k)
            deviation = _deviations(x, n, model.sums)
            ids = piece.column(0).take(pa.array(np.repeat(np.arange(len(x)), k)))
            values = found.ravel()
            yield pa.record_batch(
                [
                    ids,
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                    pa.array([v for v in deviation for _ in range(k)], pa.int64()),
                    pa.array(values, mask=np.isnan(values)),
                ],
                ["id", "component", "deviation", "whitened"],
            )

    kind = vectors.schema["id"].dataType.simpleString()
    return vectors.select("id", "vector").mapInArrow(transform, f"id {kind}, component INT, deviation LONG, whitened DOUBLE")


def _deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Sum over dimensions of (n * x - S) ** 2 per row, exact; null beyond a long."""
    most = 2**63 - 1
    if n * (int(np.abs(x).max()) + 1) + max(abs(s) for s in sums) < 2**62:
        far = n * x.astype(np.int64) - np.array(sums, np.int64)
        if x.shape[1] * int(np.abs(far).max()) ** 2 < most:
            return (far * far).sum(axis=1).tolist()
    exact = [sum((n * int(c) - s) ** 2 for c, s in zip(row, sums, strict=True)) for row in x]
    return [v if v <= most else None for v in exact]


def whitened_covariance(vectors: DataFrame, model: Fit) -> np.ndarray:
    """Covariance of the whitened rows over the usable components, summed by Spark."""
    k = model.vectors.shape[1]
    use = model.usable[:k]
    # A last column of ones brings the sums for the mean along.
    rows = _gram(
        vectors.select("vector"), lambda x: np.column_stack([model.whiten(x, k)[:, use], np.ones(len(x))]), int(use.sum()) + 1
    )
    mean = rows[:-1, -1] / model.n
    return (rows[:-1, :-1] / model.n - np.outer(mean, mean)).astype(np.float64)


def whiten_table(
    table: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", most: int = COMPONENTS
) -> DataFrame:
    """Whitened rows with n, deviation, explained and identity_error."""
    vectors = materialize(usable_vectors(table, id_col, vector_col), "whitening")
    model = fit(vectors, most)
    if model is None:
        kind = vectors.schema["id"].dataType.simpleString()
        none = f"CAST(NULL AS {kind}) AS id, 1 AS component, 0L AS n, 0L AS deviation, 0D AS whitened, 0D AS explained, 0D AS identity_error"
        return vectors.sparkSession.range(0).selectExpr(*none.split(", "))
    covariance = whitened_covariance(vectors, model)
    error = float(np.abs(covariance - np.eye(len(covariance))).max(initial=0))
    shares = [float(v) / model.trace if model.trace > 0 else None for v in model.values]
    share: Column = F.element_at(F.array(*[F.lit(s).cast("double") for s in shares]), F.col("component"))
    return whiten(vectors, model).select(
        "id",
        "component",
        F.lit(model.n).cast("long").alias("n"),
        "deviation",
        "whitened",
        share.alias("explained"),
        F.lit(error).alias("identity_error"),
    )
