"""Linear models over a normalized frame, by its own products: data stay in Spark, only short vectors and p x p blocks come to the driver.

All minimise ``|A b - y|^2 / (2 n)`` plus a penalty. Responses are long vectors,
as ``rmatvec`` takes them: expressions over the key and kept columns, or tables
of key and value.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace
from typing import Any

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.recipes import ColumnParams
from ..sources.chunks import ChunkedMatrix
from ..sources.layouts import Array, Coo, Matrix, Wide, matched
from ..sources.storage import Buckets, remove, shared_path
from . import weighted
from .frame import NormalizedFrame, _dot


def normal_equations(z: NormalizedFrame, ys: Sequence[Any]) -> tuple[np.ndarray, np.ndarray]:
    """A^T A / n and A^T Y / n: two scans, whatever the number of responses."""
    n = z.raw.count()
    if n == 0:
        raise ValueError("the matrix has no rows to fit on")
    return z.gram() / n, z.rmatmat(list(ys)) / n


def ridge(z: NormalizedFrame, ys: Sequence[Any], penalty: float) -> np.ndarray:
    """Coefficients (columns x responses) for ``penalty * |b|^2 / 2``, from the normal equations: for up to thousands of columns."""
    if penalty < 0:
        raise ValueError("the penalty must not be negative")
    g, b = normal_equations(z, ys)
    return np.linalg.solve(g + penalty * np.eye(len(g)), b)


def gram_matvec(z: NormalizedFrame, v: np.ndarray) -> np.ndarray:
    """A^T A v. Dense layouts take one scan without a shuffle: the product of a row with ``v`` is a weight of that row."""
    if isinstance(z.raw, (Coo, ChunkedMatrix)) or z.intercept:
        return z.rmatvec(z.matvec(v))
    m = z.matrix.dense()
    return weighted.sums(m, m.df, [_dot(m, v)])[:-1, 0]


def ridge_cg(z: NormalizedFrame, y: Any, penalty: float, tolerance: float = 1e-10, max_iterations: int = 200) -> np.ndarray:
    """The same coefficients by conjugate gradients, where the Gram matrix is too large to hold: one scan an iteration."""
    if penalty < 0:
        raise ValueError("the penalty must not be negative")
    n = z.raw.count()
    if n == 0:
        raise ValueError("the matrix has no rows to fit on")
    left = z.rmatvec(y) / n
    out, along = np.zeros_like(left), left
    size = first = float(left @ left)
    for _ in range(max_iterations):
        if size <= tolerance**2 * first:
            return out
        image = gram_matvec(z, along) / n + penalty * along
        step = size / float(along @ image)
        out, left = out + step * along, left - step * image
        size, before = float(left @ left), size
        along = left + size / before * along
    raise ArithmeticError(f"no convergence in {max_iterations} iterations")


def lasso(z: NormalizedFrame, y: Any, penalty: float, tolerance: float = 1e-10, max_sweeps: int = 10_000) -> np.ndarray:
    """Coefficients for ``penalty * |b|_1``: coordinate descent on the normal equations, which reads the data twice in all."""
    if penalty < 0:
        raise ValueError("the penalty must not be negative")
    g, b = normal_equations(z, [y])
    out, slope = np.zeros(len(g)), b[:, 0].copy()  # slope: what is left of A^T (y - A b) / n
    active = np.flatnonzero(np.diag(g) > 0)
    for _ in range(max_sweeps):
        moved = 0.0
        for j in active:
            pull = slope[j] + g[j, j] * out[j]
            new = np.sign(pull) * max(abs(pull) - penalty, 0.0) / g[j, j]
            if new != out[j]:
                slope -= g[:, j] * (new - out[j])
                moved, out[j] = max(moved, abs(new - out[j]) * np.sqrt(g[j, j])), new
        if moved <= tolerance:
            return out
    raise ArithmeticError(f"no convergence in {max_sweeps} sweeps")


# More columns than rows: the unknowns are one number a row, and stay in a table


def ridge_dual(z: NormalizedFrame, y: Any, penalty: float, tolerance: float = 1e-10, max_iterations: int = 200) -> np.ndarray:
    """The coefficients of ``ridge`` from (A A^T / n + penalty I) a = y / n, b = A^T a, by conjugate gradients over rows.

    For matrices with more columns than rows, whose Gram matrix can't be held.
    Raw rows are written once in buckets of their keys, which are unique; solution, residual and
    direction are columns of a small table in the same buckets. An iteration
    reads the matrix twice and writes that table: joins find both sides in place, and nothing is
    shuffled. The driver holds p numbers for the coefficients and a few sums.
    """
    if penalty <= 0:
        raise ValueError("the penalty must be positive")
    if not isinstance(z.raw, (Wide, Array)) or z.intercept:
        raise ValueError("the dual solver takes dense layouts without an intercept")
    n, key = z.raw.count(), z.key
    if n == 0:
        raise ValueError("the matrix has no rows to fit on")
    df, (target,) = z._with(z.raw.df, [y])
    spark = df.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = Buckets(df.select(*z.raw.df.columns), key, buckets)
    state = Buckets(df.select(key, F.lit(0.0).alias("_a"), (target / F.lit(float(n))).alias("_r")).withColumn("_p", F.col("_r")), key, buckets)
    old: list[Buckets] = []

    def placed() -> tuple[Any, DataFrame]:
        """The normalized matrix over rows with their state beside them."""
        met = rows.df.join(state.df, key)
        extra = [*z.raw.extra, "_a", "_r", "_p"]
        raw = Wide.of(met, key, z.raw.columns, extra) if isinstance(z.raw, Wide) else Array.of(met, key, z.raw.column, z.raw.ncols, extra)
        m = NormalizedFrame(raw, z.stages).matrix.dense()
        return m, m.df

    square = lambda c: F.coalesce(F.sum(F.col(c) * F.col(c)), F.lit(0.0))
    try:
        size = first = state.df.agg(square("_r")).first()[0]
        for _ in range(max_iterations):
            if size <= tolerance**2 * first:
                m, met = placed()
                return weighted.sums(m, met, [F.col("_a")])[:-1, 0]
            m, met = placed()
            along = weighted.sums(m, met, [F.col("_p")])[:-1, 0]
            curve = float(along @ along) / n + penalty * state.df.agg(square("_p")).first()[0]  # p^T (A A^T / n + penalty) p
            step = F.lit(size / curve)
            image = _dot(m, along) / F.lit(float(n)) + F.lit(float(penalty)) * F.col("_p")
            moved = Buckets(met.select(key, (F.col("_a") + step * F.col("_p")).alias("_a"), (F.col("_r") - step * image).alias("_r"), "_p"), key, buckets, dealt=True)
            old.append(state)
            size, before = moved.df.agg(square("_r")).first()[0], size
            state = moved.with_columns(_p=F.col("_r") + F.lit(size / before) * F.col("_p"))
            old.pop().drop()
        raise ArithmeticError(f"no convergence in {max_iterations} iterations")
    finally:
        for t in (rows, state, *old):
            t.drop()


# Mini-batches


@dataclass(frozen=True)
class DescentState:
    """Where gradient descent by batches stands: all that a run needs to go on, also in another session."""

    coefficients: tuple[float, ...]
    intercept: float = 0.0
    epoch: int = 0
    batch: int = 0

    def save(self, spark: Any, path: str) -> None:
        row = [(list(self.coefficients), self.intercept, self.epoch, self.batch)]
        spark.createDataFrame(row, "coefficients array<double>, intercept double, epoch bigint, batch bigint").coalesce(1).write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark: Any, path: str) -> DescentState:
        c, *rest = spark.read.parquet(path).select("coefficients", "intercept", "epoch", "batch").first()
        return cls(tuple(c), *rest)


def batch_of(key: Column, epoch: int, batches: int, seed: int = 0) -> Column:
    """The batch of a row in an epoch: a hash of its key, so batches are the same wherever the rows are, and differ by epoch."""
    return F.pmod(F.xxhash64(key, F.lit(seed), F.lit(epoch)), F.lit(batches))


def descend(rows: Matrix, params: ColumnParams, y: Any, batches: int, epochs: int, rate: float, penalty: float = 0.0, state: DescentState | None = None, seed: int = 0, steps: int | None = None) -> DescentState:
    """Least squares by mini-batches on raw rows with frozen column parameters: ``epochs`` passes of ``batches`` steps each.

    The response is an expression over the key and kept columns, or a table of key and value, which is met
    once and not for each batch. A step is one small job over the rows of its batch: sums of errors times
    normalized entries. ``steps`` ends a run early; its state goes on from there with the same batches and the same results.
    """
    z = NormalizedFrame(rows, [params])
    m = z.matrix.dense()
    df, (target,) = z._with(m.df, [y])
    df = df.withColumn("_y", target)
    at = state or DescentState((0.0,) * m.ncols)
    while at.epoch < epochs and steps != 0:
        error = _dot(m, np.array(at.coefficients)) + F.lit(float(at.intercept)) - F.col("_y")
        got = weighted.sums(m, df.filter(batch_of(F.col(m.key), at.epoch, batches, seed) == at.batch), [error, F.lit(1.0)])
        size, b = got[-1, 1], np.array(at.coefficients)
        if size:  # a batch without rows is no step
            at = replace(at, coefficients=tuple((b - rate * (got[:-1, 0] / size + penalty * b)).tolist()), intercept=float(at.intercept - rate * got[-1, 0] / size))
        last = at.batch + 1 == batches
        at = replace(at, epoch=at.epoch + last, batch=0 if last else at.batch + 1)
        steps = None if steps is None else steps - 1
    return at


# Columns one after the other, with the residual in a table


def lasso_columns(z: NormalizedFrame, y: Any, penalty: float, tolerance: float = 1e-8, max_sweeps: int = 1000) -> np.ndarray:
    """The coefficients of ``lasso`` by coordinate descent on the columns themselves: no p x p matrix anywhere.

    For coordinates with column stages and for dense layouts. The residual is a
    table of one number a row. A sweep walks over blocks of columns; those of a block are solved
    from the block's own small Gram matrix and its products with the residual, and the residual is written anew once a block.
    """
    if penalty < 0:
        raise ValueError("the penalty must not be negative")
    n, p, key = z.raw.count(), z.raw.ncols, z.key
    if n == 0:
        raise ValueError("the matrix has no rows to fit on")
    if z.intercept:
        raise ValueError("center the columns and the response instead of an intercept")
    domain = z.sparse.rows.select("i") if z.sparse is not None else z.matrix.dense().df
    spark = domain.sparkSession
    df, (target,) = z._with(domain, [y])
    paths: list[str] = []

    def kept(table: DataFrame) -> DataFrame:
        paths.append(shared_path(spark, "residual"))
        table.write.parquet(paths[-1])
        if len(paths) > 1:
            remove(spark, paths.pop(0))
        return spark.read.schema(table.schema).parquet(paths[-1])

    residual = kept(df.select(key, target.alias("r")))
    blocks = [(a, min(a + COLUMN_BLOCK, p)) for a in range(0, p, COLUMN_BLOCK)]
    parts = [z.submatrix(None, b) for b in blocks]
    grams = [part.gram() / n for part in parts]
    out = np.zeros(p)
    for _ in range(max_sweeps):
        largest = 0.0
        for (a, b), part, g in zip(blocks, parts, grams, strict=True):
            old = out[a:b].copy()
            new = _block_descent(g, part.rmatvec(residual) / n + g @ old, old, penalty, tolerance)
            change = new - old
            size = float(np.max(np.abs(change) * np.sqrt(np.maximum(np.diag(g), 0.0)), initial=0.0))
            largest, out[a:b] = max(largest, size), new
            if size:
                moved = matched(residual, key, {"_d": part.matvec(change, "d")})
                residual = kept(moved.select(key, (F.col("r") - F.col("_d")).alias("r")))
        if largest <= tolerance:
            remove(spark, paths[-1])
            return out
    raise ArithmeticError(f"no convergence in {max_sweeps} sweeps")


#: Columns that are solved together between two passes over the residual.
COLUMN_BLOCK = 256


def _block_descent(g: np.ndarray, target: np.ndarray, start: np.ndarray, penalty: float, tolerance: float, sweeps: int = 10_000) -> np.ndarray:
    """Minimum of b^T G b / 2 - target^T b + penalty |b|_1 for a block of columns."""
    out = start.copy()
    slope = target - g @ out
    for _ in range(sweeps):
        moved = 0.0
        for j in np.flatnonzero(np.diag(g) > 0):
            pull = slope[j] + g[j, j] * out[j]
            new = np.sign(pull) * max(abs(pull) - penalty, 0.0) / g[j, j]
            if new != out[j]:
                slope -= g[:, j] * (new - out[j])
                moved, out[j] = max(moved, abs(new - out[j]) * np.sqrt(g[j, j])), new
        if moved <= tolerance / 10:
            break
    return out
