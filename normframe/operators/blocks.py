"""Products of chunked matrices block by block: partial results of chunks are added up, no row is put together."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.chunks import ChunkedMatrix
from ..sources.layouts import BROADCAST_ENTRIES

Normalize = Callable[[np.ndarray, int], np.ndarray]


def normalizer(stages: Sequence[Any]) -> Normalize:
    """Column stages for a block that starts at a column: each entry is normalized before it is multiplied."""
    params = [(None if s.centers is None else np.array(s.centers), None if s.scales is None else np.array(s.scales)) for s in stages]

    def apply(x: np.ndarray, left: int) -> np.ndarray:
        at = slice(left, left + x.shape[1])
        for c, s in params:
            x = x if c is None else x - c[at]
            x = x if s is None else x / s[at]
        return x

    return apply


def _added(batches: Iterator[tuple[int, np.ndarray]]) -> Iterator[tuple[int, np.ndarray]]:
    """Consecutive blocks with one first row, added up."""
    top, held = -1, np.zeros(0)
    for at, y in batches:
        if at == top:
            held = held + y
            continue
        if top >= 0:
            yield top, held
        top, held = at, y
    if top >= 0:
        yield top, held


def matmat(m: ChunkedMatrix, stages: Sequence[Any], b: np.ndarray, names: Sequence[str]) -> DataFrame:
    """A B: a product for each chunk; those of one chunk row meet in one shuffle of n x k numbers, or in none if one chunk spans the columns."""
    k = b.shape[1]
    if not m.ncols or not k:
        return m.keys().select("i", *[F.lit(0.0).alias(n) for n in names])
    cut, size, norm = m._cutter(), m.chunk[0] * m.chunk[1], normalizer(stages)
    across = m._spans()[1]
    alone = across[1] - across[0] == 1

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray]]:
        for batch in batches:
            values = batch.column(2).flatten().to_numpy(zero_copy_only=False).reshape(-1, size)
            for ci, cj, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), values, strict=True):
                top, left, block = cut(ci, cj, x)
                with np.errstate(invalid="ignore", over="ignore"):
                    yield top, norm(block, left) @ b[left : left + block.shape[1]]

    def rows(parts: Iterator[tuple[int, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        for top, y in _added(parts):
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(top, top + len(y))), *[pa.array(np.ascontiguousarray(c)) for c in y.T]], ["i", *names])

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for top, y in _added(products(batches)):
            yield pa.RecordBatch.from_arrays([pa.array([top]), pa.array([y.ravel()], pa.list_(pa.float64()))], ["top", "y"])

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from rows((t, y.values.to_numpy(zero_copy_only=False).reshape(-1, k)) for batch in batches for t, y in zip(batch.column(0).to_pylist(), batch.column(1), strict=True))

    schema = "i bigint" + "".join(f", `{n}` double" for n in names)
    if alone:
        return m.chunks.mapInArrow(lambda batches: rows(products(batches)), schema)
    met = m.chunks.mapInArrow(partial, "top bigint, y array<double>").repartition("top").sortWithinPartitions("top")
    return met.mapInArrow(whole, schema)


def rmatmat(m: ChunkedMatrix, stages: Sequence[Any], df: DataFrame, us: Sequence[Column]) -> tuple[np.ndarray, np.ndarray]:
    """A^T U (columns x vectors) and the sums of the vectors. ``df``: the row keys with the vectors as ``us``.

    The vectors are cut like the chunk rows and meet whole chunks; a task adds
    up p x k numbers over all its chunks.
    """
    k, r = len(us), m.chunk[0]
    sums = np.array(df.agg(*[F.coalesce(F.sum(u), F.lit(0.0)) for u in us]).first(), float)
    out = np.zeros((m.ncols, k))
    if not m.ncols or not m.nrows:
        return out, sums
    cut, size, norm = m._cutter(), r * m.chunk[1], normalizer(stages)
    cells = F.array_sort(F.collect_list(F.struct("i", F.array(*us).alias("u"))))
    pieces = df.groupBy(F.floor(F.col("i") / F.lit(r)).cast("long").alias("ci")).agg(F.flatten(F.transform(cells, lambda e: e["u"])).alias("u"))
    met = m.chunks.join(F.broadcast(pieces) if m.nrows * k <= BROADCAST_ENTRIES else pieces, "ci").select("ci", "cj", "values", "u")

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        acc: dict[int, np.ndarray] = {}
        for batch in batches:
            values = batch.column(2).flatten().to_numpy(zero_copy_only=False).reshape(-1, size)
            for ci, cj, x, u in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), values, batch.column(3), strict=True):
                _, left, block = cut(ci, cj, x)
                with np.errstate(invalid="ignore", over="ignore"):
                    y = norm(block, left).T @ u.values.to_numpy(zero_copy_only=False).reshape(-1, k)
                    acc[left] = acc[left] + y if left in acc else y
        for left, y in acc.items():
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(y) + 1) * k, pa.int32()), pa.array(y.ravel()))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(left, left + len(y))), lists], ["j", "s"])

    parts = met.mapInArrow(partial, "j bigint, s array<double>")
    for row in parts.groupBy("j").agg(*[F.sum(F.col("s")[c]) for c in range(k)]).collect():
        out[row[0]] = row[1:]
    return out, sums
