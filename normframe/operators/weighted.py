"""Weighted sums, Gram matrices, and reductions of single columns."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.layouts import Wide, matched

#: Columns up to which a Gram matrix is one aggregate of p (p + 1) / 2 sums; wider ones add up Arrow blocks.
EXPRESSION_GRAM = 12
#: Rows of a Gram matrix that one scan adds up in a task.
PANEL = 2048
#: Sums in one aggregate of a wide matrix, beyond which the array form is used.
EXPRESSION_SUMS = 400


def sums(m: Any, df: DataFrame, weights: Sequence[Column]) -> np.ndarray:
    """Rows 0..p-1: sums of weight times entry for each weight; row p: sums of the weights."""
    p, k = m.ncols, len(weights)
    if isinstance(m, Wide) and p * k <= EXPRESSION_SUMS:
        exprs = [F.sum(x * w) for x in m.row().values for w in weights] + [F.sum(w) for w in weights]
        row = df.agg(*[F.coalesce(e, F.lit(0.0)) for e in exprs]).first()
        return np.array(row, float).reshape(p + 1, k)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        acc = np.zeros((p + 1, k))
        for batch in batches:
            x, w = (batch.column(c).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1) for c in (0, 1))
            with np.errstate(invalid="ignore", over="ignore"):
                acc[:p] += x.T @ w if p else 0.0
                acc[p] += w.sum(0)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(p + 2) * k, pa.int32()), pa.array(acc.ravel()))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(p + 1)), lists], ["j", "s"])

    # p + 1 rows of k sums a task, whatever its rows
    parts = df.select(m.row().array().alias("x"), F.array(*weights).alias("w")).mapInArrow(partial, "j bigint, s array<double>")
    out = np.zeros((p + 1, k))
    for r in parts.groupBy("j").agg(*[F.sum(F.col("s")[c]) for c in range(k)]).collect():
        out[r[0]] = r[1:]
    return out


def gram(m: Any, df: DataFrame, weight: Column) -> np.ndarray:
    """The weighted Gram matrix of [1, A]: index 0 is the intercept. Entries are normalized before they are multiplied."""
    p = m.ncols
    out = np.zeros((p + 1, p + 1))
    if isinstance(m, Wide) and p <= EXPRESSION_GRAM:
        z = [F.lit(1.0), *m.row().values]
        pairs = [(a, b) for a in range(p + 1) for b in range(a, p + 1)]
        row = df.agg(*[F.coalesce(F.sum(z[a] * weight * z[b]), F.lit(0.0)) for a, b in pairs]).first()
        for (a, b), value in zip(pairs, row, strict=True):
            out[a, b] = out[b, a] = value
        return out

    rows = df.select(m.row().array().alias("x"), weight.alias("w"))
    for start in range(0, p + 1, PANEL):  # a task holds one panel of rows of the result; up to PANEL columns take one scan
        stop = min(start + PANEL, p + 1)

        def partial(batches: Iterator[pa.RecordBatch], start: int = start, stop: int = stop) -> Iterator[pa.RecordBatch]:
            acc = np.zeros((stop - start, p + 1 - start))
            for batch in batches:
                x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, p)
                w = batch.column(1).to_numpy(zero_copy_only=False)
                z = np.column_stack((np.ones(len(x)), x))[:, start:]
                with np.errstate(invalid="ignore"):
                    acc += z[:, : stop - start].T @ (w[:, None] * z)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(stop - start + 1) * (p + 1 - start), pa.int32()), pa.array(acc.ravel()))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(start, stop)), lists], ["r", "g"])

        # One panel a task, then one sum for each of its entries: what moves depends on tasks and p only.
        parts = rows.mapInArrow(partial, "r bigint, g array<double>").select("r", F.posexplode("g").alias("c", "v")).groupBy("r", "c").agg(F.sum("v").alias("v")).toArrow()
        r, c, v = (parts.column(n).to_numpy() for n in ("r", "c", "v"))
        out[r, start + c] = v
    return np.triu(out) + np.triu(out, 1).T


class ColumnView:
    """One normalized column as a long vector: key and ``value``."""

    def __init__(self, df: DataFrame, key: str):
        self.df, self.key = df, key

    def _sum(self, value: Column, df: DataFrame | None = None) -> float:
        return (self.df if df is None else df).agg(F.coalesce(F.sum(value), F.lit(0.0))).first()[0]

    def _with(self, **vectors: Any) -> tuple[DataFrame, dict[str, Column]]:
        cols: dict[str, Column] = {}
        tables: dict[str, DataFrame] = {}
        for name, u in vectors.items():
            if isinstance(u, DataFrame):
                tables[f"_{name}"] = u
                cols[name] = F.col(f"_{name}")
            else:
                cols[name] = (F.col(u) if isinstance(u, str) else u).cast("double")
        return (matched(self.df, self.key, tables) if tables else self.df), cols

    def sum(self) -> float:
        return self._sum(F.col("value"))

    def norm_squared(self) -> float:
        return self._sum(F.col("value") * F.col("value"))

    def dot(self, u: Any) -> float:
        df, c = self._with(u=u)
        return self._sum(F.col("value") * c["u"], df)

    def weighted_dot(self, w: Any, u: Any) -> float:
        df, c = self._with(w=w, u=u)
        return self._sum(c["w"] * F.col("value") * c["u"], df)

    def weighted_norm_squared(self, w: Any) -> float:
        df, c = self._with(w=w)
        return self._sum(c["w"] * F.col("value") * F.col("value"), df)

    def add_to(self, alpha: float, d: DataFrame) -> DataFrame:
        """d + alpha times the column."""
        df, c = self._with(d=d)
        return df.select(self.key, (c["d"] + F.lit(float(alpha)) * F.col("value")).alias("value"))

    def get(self, key: Any) -> float:
        return self.df.filter(F.col(self.key) == F.lit(key)).first()["value"]


# Long vectors: tables of key and value.


def dot(a: DataFrame, b: DataFrame) -> float:
    """The inner product of two long vectors with equal keys; other keys raise."""
    key = a.columns[0]
    return matched(a, key, {"_b": b}).agg(F.coalesce(F.sum(F.col(a.columns[1]) * F.col("_b")), F.lit(0.0))).first()[0]


def l2_norm(a: DataFrame) -> float:
    return float(np.sqrt(a.agg(F.coalesce(F.sum(F.col(a.columns[1]) * F.col(a.columns[1])), F.lit(0.0))).first()[0]))


def axpy(alpha: float, a: DataFrame, b: DataFrame) -> DataFrame:
    """alpha * a + b, by key."""
    key, value = b.columns[:2]
    return matched(b, key, {"_a": a}).select(key, (F.lit(float(alpha)) * F.col("_a") + F.col(value)).alias(value))


def scale(alpha: float, a: DataFrame) -> DataFrame:
    return a.select(a.columns[0], (F.lit(float(alpha)) * F.col(a.columns[1])).alias(a.columns[1]))
