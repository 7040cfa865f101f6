"""Chunked two-dimensional arrays: grids of chunks, and their tables in Parquet."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .layouts import Array, Matrix

Span = tuple[int, int]


class ChunkedMatrix(Matrix):
    """A grid of chunks (ci, cj, values): row-major doubles of whole chunks, edges padded, absent chunks all ``fill``.

    ``stored`` is a chunk table, or a function of ranges of chunk rows and chunk
    columns that gives the chunks there. It may leave out absent chunks, or, if
    ``complete``, gives them filled. Reading a rectangle touches the chunks
    that meet it, nothing else; a rectangle of a chunked matrix is one too.
    Statistics and products work on blocks: rows are put together only for what needs whole rows.
    """

    key = "i"

    def __init__(self, stored: DataFrame | Callable[[Span, Span], DataFrame], shape: Span, chunk: Span, fill: float = 0.0, complete: bool = False, window: tuple[Span, Span] | None = None):
        if len(shape) != 2 or len(chunk) != 2:
            raise ValueError("a chunked matrix has two dimensions")
        if min(shape) < 0 or min(chunk) < 1:
            raise ValueError("shapes must be nonnegative and chunks positive")
        self.stored, self.shape, self.chunk, self.fill, self.complete = stored, tuple(shape), tuple(chunk), float(fill), complete
        self.rows, self.cols = window or ((0, shape[0]), (0, shape[1]))
        self.nrows, self.ncols = self.rows[1] - self.rows[0], self.cols[1] - self.cols[0]

    def _rectangle(self, rows: Span | None, cols: Span | None) -> tuple[Span, Span]:
        """Bounds within the window: of rows as keys, of columns from the window's first."""
        rows, cols = rows or self.rows, cols or (0, self.ncols)
        if not (self.rows[0] <= rows[0] <= rows[1] <= self.rows[1] and 0 <= cols[0] <= cols[1] <= self.ncols):
            raise ValueError("the rectangle is out of bounds")
        return rows, (cols[0] + self.cols[0], cols[1] + self.cols[0])

    def rectangle(self, rows: Span | None = None, cols: Span | None = None) -> ChunkedMatrix:
        """The rows with keys and columns in the bounds, as a chunked matrix: no chunk is read."""
        return ChunkedMatrix(self.stored, self.shape, self.chunk, self.fill, self.complete, self._rectangle(rows, cols))

    def _spans(self) -> tuple[Span, Span]:
        """The chunk rows and chunk columns that meet the window."""
        spans = [(low // size, -(-high // size)) if low < high else (0, 0) for (low, high), size in zip((self.rows, self.cols), self.chunk, strict=True)]
        return (spans[0], spans[1]) if self.nrows and self.ncols else ((0, 0), (0, 0))

    @property
    def chunks(self) -> DataFrame:
        """(ci, cj, values) of all chunks that meet the window. Stored chunks are not shuffled to find the absent ones."""
        tall, across = self._spans()
        if callable(self.stored):
            near = self.stored(tall, across).select("ci", "cj", "values")
        else:  # the filters reach the scan of the chunk table: partitions and row groups outside are not read
            near = self.stored.filter((F.col("ci") >= tall[0]) & (F.col("ci") < tall[1]) & (F.col("cj") >= across[0]) & (F.col("cj") < across[1])).select("ci", "cj", "values")
        if self.complete:
            return near
        width = max(1, across[1] - across[0])
        grid = near.sparkSession.range((tall[1] - tall[0]) * (across[1] - across[0])).select(
            (F.lit(tall[0]) + F.floor(F.col("id") / F.lit(width))).cast("long").alias("ci"), (F.lit(across[0]) + F.col("id") % F.lit(width)).cast("long").alias("cj")
        )
        absent = grid.join(near.select("ci", "cj"), ["ci", "cj"], "left_anti")
        return near.unionByName(absent.withColumn("values", F.array_repeat(F.lit(self.fill), self.chunk[0] * self.chunk[1])))

    def _cutter(self) -> Callable[[int, int, np.ndarray], tuple[int, int, np.ndarray]]:
        """From a chunk's numbers and values: the key of its first row and the number of its first column in the window, and the part inside."""
        (r, c), rows, cols = self.chunk, self.rows, self.cols

        def cut(ci: int, cj: int, values: np.ndarray) -> tuple[int, int, np.ndarray]:
            top, left = max(rows[0] - ci * r, 0), max(cols[0] - cj * c, 0)
            return ci * r + top, cj * c + left - cols[0], values.reshape(r, c)[top : rows[1] - ci * r, left : cols[1] - cj * c]

        return cut

    def blocks(self) -> tuple[DataFrame, Callable[[pa.RecordBatch], Iterator[tuple[int, np.ndarray]]]]:
        cut, size = self._cutter(), self.chunk[0] * self.chunk[1]

        def unpack(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
            values = batch.column(2).flatten().to_numpy(zero_copy_only=False).reshape(-1, size)
            for ci, cj, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), values, strict=True):
                _, left, block = cut(ci, cj, x)
                yield left, block

        return self.chunks, unpack

    def _cells(self, rows: bool) -> DataFrame:
        """The chunks cut in tasks: rows as pieces (i, j, x), or single entries (i, j, v)."""
        cut, size = self._cutter(), self.chunk[0] * self.chunk[1]

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                values = batch.column(2).flatten().to_numpy(zero_copy_only=False).reshape(-1, size)
                for ci, cj, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), values, strict=True):
                    top, left, block = cut(ci, cj, x)
                    n, width = block.shape
                    flat = pa.array(np.ascontiguousarray(block).ravel())
                    if rows:
                        lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * width, pa.int32()), flat)
                        yield pa.RecordBatch.from_arrays([pa.array(np.arange(top, top + n)), pa.array(np.full(n, left)), lists], ["i", "j", "x"])
                    else:
                        at = [np.repeat(np.arange(top, top + n), width), np.tile(np.arange(left, left + width), n)]
                        yield pa.RecordBatch.from_arrays([*map(pa.array, at), flat], ["i", "j", "v"])

        return self.chunks.mapInArrow(scan, "i bigint, j bigint, x array<double>" if rows else "i bigint, j bigint, v double")

    def entries(self, rows: Span | None = None, cols: Span | None = None) -> DataFrame:
        """(i, j, v) of a rectangle: padding left out, fill values kept. Columns keep their numbers."""
        first = (cols or (0, 0))[0]
        found = self.rectangle(rows, cols)._cells(False)
        return found.select("i", (F.col("j") + first).alias("j"), "v") if first else found

    def long(self) -> DataFrame:
        return self.entries()

    def to_array(self, rows: Span | None = None, cols: Span | None = None, column: str = "x") -> Array:
        """Whole rows of a rectangle as a matrix: the pieces of a row meet and are put together. One chunk across needs no shuffle."""
        cut = self.rectangle(rows, cols)
        across = cut._spans()[1]
        if not cut.ncols:
            spark = SparkSession.active()
            return Array.of(spark.range(*cut.rows).select(F.col("id").alias("i"), F.array().cast("array<double>").alias(column)), "i", column, 0)
        pieces = cut._cells(True)
        if across[1] - across[0] > 1:
            whole = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("j", "x"))), lambda e: e["x"]))
            pieces = pieces.groupBy("i").agg(whole.alias("x"))
        return Array.of(pieces.select("i", F.col("x").alias(column)), "i", column, cut.ncols)

    def dense(self) -> Array:
        return self.to_array()

    @property
    def df(self) -> DataFrame:
        return self.to_array().df

    def count(self) -> int:
        return self.nrows

    def keys(self) -> DataFrame:
        """The row keys: no chunk is read for them."""
        return SparkSession.active().range(*self.rows).withColumnRenamed("id", "i")

    def select(self, start: int, stop: int) -> ChunkedMatrix:
        return self.rectangle(None, (start, stop))

    def where(self, condition: Any) -> Array:
        return self.to_array().where(condition)

    def row(self) -> Any:
        return self.to_array().row()

    def read_block(self, rows: Span, cols: Span) -> np.ndarray:
        """A rectangle on the driver, row-major: one row for each chunk comes, not for each cell."""
        part = self.rectangle(rows, cols)
        out, cut = np.empty((part.nrows, part.ncols)), part._cutter()
        for e in part.chunks.collect():
            top, left, block = cut(e["ci"], e["cj"], np.array(e["values"]))
            out[top - rows[0] : top - rows[0] + block.shape[0], left : left + block.shape[1]] = block
        return out


#: Folders that a chunk table is divided into at most, by ranges of chunk rows, and bytes of values that one holds at least.
FOLDERS, FOLDER_BYTES = 1000, 64 << 20


def _band(shape: Span, tall: int) -> int:
    """Chunk rows in a folder."""
    return max(1, -(-(-(-shape[0] // tall)) // FOLDERS), FOLDER_BYTES // max(1, 8 * tall * shape[1]))


def to_chunks(matrix: Any, chunk: Span, fill: float = 0.0, row_of: str | None = None, keep_fill: bool = False) -> DataFrame:
    """(ci, cj, values) of a dense matrix with row numbers as keys; chunks of fill values are left out unless ``keep_fill``.

    Whole rows are shuffled, once, by ranges of chunk rows; a task then holds one chunk row at a time.
    """
    r, c = chunk
    dense = matrix.dense()
    p, padded = dense.ncols, -(-dense.ncols // c) * c
    parts = int(dense.df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = dense.df.select(F.col(row_of or dense.key).cast("long").alias("i"), dense.row().array().alias("x")).withColumn("ci", F.floor(F.col("i") / F.lit(r)).cast("long"))
    ordered = rows.repartitionByRange(parts, "ci").sortWithinPartitions("ci").select("ci", "i", "x")

    def cut(ci: int, block: np.ndarray) -> Iterator[pa.RecordBatch]:
        chunks = block.reshape(r, padded // c, c).transpose(1, 0, 2).reshape(-1, r * c)
        some = np.arange(len(chunks)) if keep_fill else np.flatnonzero((~(np.isnan(chunks) if np.isnan(fill) else chunks == fill)).any(1))
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(some) + 1) * (r * c), pa.int32()), pa.array(chunks[some].ravel()))
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), ci)), pa.array(some), lists], ["ci", "cj", "values"])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, block = -1, np.zeros(0)
        for batch in batches:
            ci, i = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            x = batch.column(2).flatten().to_numpy(zero_copy_only=False).reshape(-1, p)
            for first, end in zip(*(lambda e: (e[:-1], e[1:]))(np.append(np.flatnonzero(np.diff(ci, prepend=-1)), len(ci))), strict=True):
                if ci[first] != at:
                    if at >= 0:
                        yield from cut(at, block)
                    at, block = int(ci[first]), np.full((r, padded), float(fill))
                block[i[first:end] - at * r, :p] = x[first:end]
        if at >= 0:
            yield from cut(at, block)

    return ordered.mapInArrow(gather, "ci bigint, cj bigint, values array<double>")


def write_chunks(matrix: Any, path: str, nrows: int, chunk: Span, fill: float = 0.0, row_of: str | None = None) -> None:
    """Write a dense matrix with row numbers as keys as a chunk table, in folders of ranges of chunk rows; chunks of fill values are left out."""
    chunks = to_chunks(matrix, chunk, fill, row_of).withColumn("band", F.floor(F.col("ci") / F.lit(_band((nrows, matrix.ncols), chunk[0]))).cast("long"))
    chunks.write.mode("overwrite").partitionBy("band").parquet(path)


def read_chunks(spark: SparkSession, path: str, shape: Span, chunk: Span, fill: float = 0.0) -> ChunkedMatrix:
    """A table that ``write_chunks`` wrote: a rectangle reads the folders and row groups of its chunks."""
    table, band = spark.read.schema("ci bigint, cj bigint, values array<double>, band bigint").parquet(path), _band(shape, chunk[0])

    def near(tall: Span, across: Span) -> DataFrame:
        folders = (F.col("band") >= tall[0] // band) & (F.col("band") <= (tall[1] - 1) // band)
        return table.filter(folders & (F.col("ci") >= tall[0]) & (F.col("ci") < tall[1]) & (F.col("cj") >= across[0]) & (F.col("cj") < across[1]))

    return ChunkedMatrix(near, shape, chunk, fill)
