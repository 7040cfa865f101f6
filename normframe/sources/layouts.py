"""The three layouts of a matrix in a DataFrame: wide columns, an array column, and coordinates."""

from __future__ import annotations

import operator
from collections.abc import Callable, Iterator, Sequence
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numeric import IDENTITY, NAN, Elementwise, RowVector, nan_max, nan_min, strict_double
from ..plans.selection import Cells, Target, between, column_ranks, linear_quantiles, order_statistics

Reduction = tuple[str, Elementwise]  # sum, min or max, of f(value, center)
Ends = list[tuple[float, float, float]] | None  # of each quantile: the values around it and the share of the second

Unpack = Callable[[pa.RecordBatch], Iterator[tuple[int, np.ndarray]]]  # blocks of a matrix, each with the number of its first column

#: Vectors with more entries than this are joined as tables, not put into plans as literals.
LITERALS = 4096
#: Entries of a table of vector values up to which it is broadcast (a few tens of MB).
BROADCAST_ENTRIES = 1_000_000


def _fold(kind: str, value: Column) -> Column:
    if kind == "sum":
        return F.coalesce(F.sum(value), F.lit(0.0))
    return nan_min(value) if kind == "min" else nan_max(value)


def vector_table(spark: SparkSession, values: Sequence[float] | np.ndarray, index: str, value: str) -> DataFrame:
    """A vector as a table; marked for broadcast only while its size is bounded."""
    data = np.asarray(values, float)
    table = spark.createDataFrame(pa.Table.from_arrays([pa.array(np.arange(len(data))), pa.array(data)], [index, value]))
    return F.broadcast(table) if len(data) <= BROADCAST_ENTRIES else table


def _stacked(vectors: dict[str, DataFrame]) -> DataFrame:
    """Tables of key and value put under each other, and grouped by key once: ``_key``, a column for each, and how often each has the key in ``_found``."""
    tables = [t.select(F.col(t.columns[0]).alias("_key"), F.lit(r).alias("_r"), F.col(t.columns[1]).cast("double").alias("_v")) for r, t in enumerate(vectors.values())]
    rows = tables[0]
    for t in tables[1:]:
        rows = rows.unionByName(t)
    values = [F.first(F.when(F.col("_r") == r, F.col("_v")), ignorenulls=True).alias(name) for r, name in enumerate(vectors)]
    return rows.groupBy("_key").agg(F.array(*[F.count_if(F.col("_r") == r) for r in range(len(vectors))]).alias("_found"), *values)


def _checked(met: DataFrame, key: str, what: str, strange: Column | None) -> DataFrame:
    """The rows of a join with ``_stacked``; raises where a vector lacks or repeats a key, or, by ``strange``, has one of its own."""
    name = F.coalesce(F.col(key).cast("string"), F.lit("NULL"))
    wrong = F.when(F.col("_found").isNull() | F.array_contains("_found", F.lit(0)), F.concat(F.lit(f"the {what} lacks the key "), name)).when(
        F.exists("_found", lambda n: n > 1), F.concat(F.lit(f"the {what} repeats the key "), name)
    )
    if strange is not None:
        own = F.concat(F.lit(f"the {what} has a key that the matrix lacks: "), F.coalesce(F.col("_key").cast("string"), F.lit("NULL")))
        wrong = F.when(strange, own).otherwise(wrong)
    return met.filter(F.when(wrong.isNotNull(), F.raise_error(wrong).cast("boolean")).otherwise(F.lit(True)))


def matched(df: DataFrame, key: str, vectors: dict[str, DataFrame], what: str = "vector") -> DataFrame:
    """``df`` with a column for each long vector (a table of key and value), by key: one join for all of them.

    A vector has each key of ``df`` once, and no others: anything else raises
    when the rows are read. Rows of ``df`` may share a key.
    """
    met = df.withColumn("_own", F.lit(True)).join(_stacked(vectors), F.col(key) == F.col("_key"), "full_outer")
    return _checked(met, key, what, F.col("_own").isNull()).select(*df.columns, *vectors)


def looked_up(df: DataFrame, key: str, table: DataFrame, names: dict[str, str], what: str) -> DataFrame:
    """``df`` with columns of a frozen table, by its first column, with the same rules.

    The table is counted. Up to a bound it is broadcast, and ``df`` is not
    shuffled: that its keys are all there is asked of the keys of ``df`` alone,
    at once. A larger table meets ``df`` in one join.
    """
    one = table.groupBy(F.col(table.columns[0]).alias("_key")).agg(F.array(F.count(F.lit(1))).alias("_found"), *[F.first(F.col(old)).cast("double").alias(new) for old, new in names.items()])
    rows = table.count()
    if rows * (1 + len(names)) > BROADCAST_ENTRIES:
        met = df.withColumn("_own", F.lit(True)).join(one, F.col(key) == F.col("_key"), "full_outer")
        return _checked(met, key, what, F.col("_own").isNull()).select(*df.columns, *names.values())
    keys = F.broadcast(one.select("_key"))
    there = df.select(F.col(key).alias("_of")).join(keys, F.col("_of") == F.col("_key"), "left_semi").distinct()
    strange = one.select("_key").join(there, F.col("_key") == F.col("_of"), "left_anti").limit(1).collect()
    if strange:
        raise ValueError(f"the {what} has a key that the matrix lacks: {strange[0][0]}")
    met = df.join(F.broadcast(one), F.col(key) == F.col("_key"), "left")
    return _checked(met, key, what, None).select(*df.columns, *names.values())


class Matrix:
    """A matrix with named rows (``key``) and columns numbered from 0."""

    df: DataFrame
    key: str
    ncols: int

    def count(self) -> int:
        """The number of rows: an aggregation job."""
        return self.df.count()

    def blocks(self) -> tuple[DataFrame, Unpack]:
        """A DataFrame whose batches are read as blocks of the matrix. Each row's entry in a column is in one block."""
        raise NotImplementedError

    def reduce(self, wanted: dict[str, Reduction], centers: Sequence[float]) -> dict[str, Any]:
        """All reductions in one job: a task folds its blocks with NumPy and hands on one number for each column and reduction. ``n`` is the number of rows."""
        df, unpack = self.blocks()
        folds = {"sum": (np.sum, 0.0), "min": (np.min, np.inf), "max": (np.max, -np.inf)}
        names, p, c = list(wanted), self.ncols, np.asarray(centers, float)

        def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            seen = np.zeros(p, np.int64)
            acc = {name: np.full(p, folds[wanted[name][0]][1]) for name in names}
            for j, x in (block for batch in batches for block in unpack(batch)):
                at = slice(j, j + x.shape[1])
                if not len(x):
                    continue
                seen[at] += len(x)
                with np.errstate(invalid="ignore", over="ignore"):
                    for name in names:
                        kind, f = wanted[name]
                        one = folds[kind][0](f.array(x, c[at]), axis=0)
                        acc[name][at] = acc[name][at] + one if kind == "sum" else (np.minimum if kind == "min" else np.maximum)(acc[name][at], one)
            if seen.any():
                columns = [pa.array(np.arange(p)), pa.array(seen), *[pa.array(acc[name]) for name in names]]
                yield pa.RecordBatch.from_arrays([x.filter(pa.array(seen > 0)) for x in columns], ["j", "n", *names])

        parts = df.mapInArrow(fold, "j bigint, n bigint" + "".join(f", `{name}` double" for name in names))
        rows = parts.groupBy("j").agg(F.sum("n").alias("n"), *[_fold(wanted[name][0], F.col(f"`{name}`")).alias(name) for name in names]).collect()
        out: dict[str, Any] = {name: np.full(p, 0.0 if kind == "sum" else NAN) for name, (kind, _) in wanted.items()}
        for r in rows:
            for name in names:
                out[name][r["j"]] = r[name]
        return out | {"n": rows[0]["n"] if rows else 0 if p else self.count()}

    def cells(self) -> tuple[DataFrame, Cells]:
        """The same data as column numbers and values."""
        df, unpack = self.blocks()

        def flat(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
            for j, x in unpack(batch):
                yield np.tile(np.arange(j, j + x.shape[1]), len(x)), np.ascontiguousarray(x).ravel()

        return df, flat

    def ends(self, qs: Sequence[float]) -> tuple[int, list[Ends]]:
        """The number of rows, and for each column the exact order statistics around its linear quantiles; None if a NaN poisons it or it is empty."""
        df, flat = self.cells()
        n, found = column_ranks(df, flat, self.ncols, lambda n: [r for place in linear_quantiles(n, qs) for r in place[:2]])
        return n, self._put(found, linear_quantiles(n, qs))

    def _put(self, found: Sequence[list[float] | None], places: list[tuple[int, int, float]]) -> list[Ends]:
        return [None if v is None else [(v[2 * k], v[2 * k + 1], share) for k, (_, _, share) in enumerate(places)] for v in found]

    def quantiles(self, qs: Sequence[float]) -> np.ndarray:
        """Exact linear quantiles of each column; a NaN poisons its column."""
        return np.array([[NAN] * len(qs) if e is None else [between(*x) for x in e] for e in self.ends(qs)[1]], float).reshape(self.ncols, len(qs))


class Wide(Matrix):
    """One DataFrame column for each matrix column: expressions stay in generated code, unused columns unread.

    ``nulls``: 'error' raises on a NULL where it is read, 'nan' reads it as NaN,
    'trust' skips the check for columns known to have none.
    """

    def __init__(self, df: DataFrame, key: str, columns: Sequence[str], nulls: str = "error", extra: Sequence[str] = ()):
        if nulls not in ("error", "nan", "trust"):
            raise ValueError("nulls must be 'error', 'nan' or 'trust'")
        self.key, self.columns, self.ncols, self.extra = key, list(columns), len(columns), list(extra)
        read = {
            "error": lambda c: strict_double(F.col(f"`{c}`"), c),
            "nan": lambda c: F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(NAN)),
            "trust": lambda c: F.col(f"`{c}`").cast("double"),
        }[nulls]
        self.df = df.select(key, *[F.col(e) for e in self.extra if e not in self.columns], *[read(c).alias(c) for c in self.columns])

    @classmethod
    def of(cls, df: DataFrame, key: str, columns: Sequence[str], extra: Sequence[str] = ()) -> Wide:
        """A frame whose columns are doubles already."""
        out = cls.__new__(cls)
        out.df, out.key, out.columns, out.ncols, out.extra = df, key, list(columns), len(columns), list(extra)
        return out

    def dense(self) -> Wide:
        return self

    def row(self) -> RowVector:
        return RowVector([F.col(f"`{c}`") for c in self.columns], self.ncols)

    def replaced(self, values: Sequence[Column], df: DataFrame | None = None) -> Wide:
        """The same columns with other values."""
        df = self.df if df is None else df
        return Wide.of(df.select(self.key, *self.extra, *[v.alias(c) for v, c in zip(values, self.columns, strict=True)]), self.key, self.columns, self.extra)

    def select(self, start: int, stop: int) -> Wide:
        cols = self.columns[start:stop]
        return Wide.of(self.df.select(self.key, *self.extra, *[f"`{c}`" for c in cols]), self.key, cols, self.extra)

    def where(self, condition: Column | DataFrame) -> Wide:
        df = self.df.filter(condition) if isinstance(condition, Column) else self.df.join(condition, self.key, "left_semi")
        return Wide.of(df, self.key, self.columns, self.extra)

    def reduce(self, wanted: dict[str, Reduction], centers: Sequence[float]) -> dict[str, Any]:
        """All reductions of all columns in one job. ``n`` is the number of rows."""
        exprs = [F.count(F.lit(1)).alias("n")]
        for name, (kind, f) in wanted.items():
            exprs += [_fold(kind, f(F.col(f"`{c}`"), F.lit(float(m)))).alias(f"{name}_{k}") for k, (c, m) in enumerate(zip(self.columns, centers, strict=True))]
        row = self.df.agg(*exprs).first()
        out: dict[str, Any] = {name: np.array([row[f"{name}_{k}"] for k in range(self.ncols)], float) for name in wanted}
        return out | {"n": row["n"]}

    def blocks(self) -> tuple[DataFrame, Unpack]:
        def unpack(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
            yield 0, np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns])

        return self.df.select(*[F.col(f"`{c}`") for c in self.columns]), unpack

    def long(self) -> DataFrame:
        """(key, j, v), one row for each entry."""
        entries = [F.struct(F.lit(k).cast("long").alias("j"), F.col(f"`{c}`").alias("v")) for k, c in enumerate(self.columns)]
        return self.df.select(self.key, *self.extra, F.inline(F.array(*entries)))

    def to_array(self, column: str = "x") -> Array:
        return Array.of(self.df.select(self.key, *self.extra, self.row().array().alias(column)), self.key, column, self.ncols, self.extra)

    def to_coo(self, keep_zeros: bool = False) -> Coo:
        long = self.long().select(F.col(self.key).alias("i"), "j", "v")
        return Coo(long if keep_zeros else long.filter("v != 0"), self.count(), self.ncols, rows=self.df.select(F.col(self.key).alias("i")), coalesced=True)


class Array(Matrix):
    """One array column of ``ncols`` doubles a row; the length is checked where a row is read."""

    def __init__(self, df: DataFrame, key: str, column: str, ncols: int, nulls: str = "error", extra: Sequence[str] = ()):
        self.key, self.column, self.ncols, self.extra = key, column, operator.index(ncols), list(extra)
        x = F.col(column).cast("array<double>")
        if nulls == "nan":
            x = F.transform(x, lambda v: F.coalesce(v, F.lit(NAN)))
        good = F.coalesce((F.size(x) == self.ncols) & (F.lit(nulls == "trust") | ~F.exists(x, lambda v: v.isNull())), F.lit(False))
        message = F.lit(f"a row of {column} does not hold {ncols} values")
        checked = F.when(good, x).otherwise(F.raise_error(message).cast("array<double>"))
        self.df = df.select(key, *self.extra, checked.alias(column))

    @classmethod
    def of(cls, df: DataFrame, key: str, column: str, ncols: int, extra: Sequence[str] = ()) -> Array:
        out = cls.__new__(cls)
        out.df, out.key, out.column, out.ncols, out.extra = df, key, column, ncols, list(extra)
        return out

    def dense(self) -> Array:
        return self

    def row(self) -> RowVector:
        return RowVector(F.col(self.column), self.ncols)

    def replaced(self, values: Column, df: DataFrame | None = None) -> Array:
        df = self.df if df is None else df
        return Array.of(df.select(self.key, *self.extra, values.alias(self.column)), self.key, self.column, self.ncols, self.extra)

    def select(self, start: int, stop: int) -> Array:
        cut = F.slice(self.column, start + 1, stop - start)
        return Array.of(self.df.select(self.key, *self.extra, cut.alias(self.column)), self.key, self.column, stop - start, self.extra)

    def where(self, condition: Column | DataFrame) -> Array:
        df = self.df.filter(condition) if isinstance(condition, Column) else self.df.join(condition, self.key, "left_semi")
        return Array.of(df, self.key, self.column, self.ncols, self.extra)

    def long(self) -> DataFrame:
        return self.df.select(self.key, *self.extra, F.posexplode(self.column).alias("j", "v")).withColumn("j", F.col("j").cast("long"))

    def blocks(self) -> tuple[DataFrame, Unpack]:
        column, p = self.df.select(self.column), self.ncols

        def unpack(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
            yield 0, batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, p)

        return column, unpack

    def to_wide(self, names: Sequence[str] | None = None) -> Wide:
        names = list(names or [f"x{k}" for k in range(self.ncols)])
        return Wide.of(self.df.select(self.key, *self.extra, *[F.col(self.column)[k].alias(n) for k, n in enumerate(names)]), self.key, names, self.extra)

    def to_array(self) -> Array:
        return self

    def to_coo(self, keep_zeros: bool = False) -> Coo:
        long = self.long().select(F.col(self.key).alias("i"), "j", "v")
        return Coo(long if keep_zeros else long.filter("v != 0"), self.count(), self.ncols, rows=self.df.select(F.col(self.key).alias("i")), coalesced=True)


class Coo(Matrix):
    """Stored entries (i, j, v); absent entries are zeros and repeated ones are summed.

    The shape is explicit: empty rows and columns have no entries but count.
    ``rows`` is the table of row keys ``i``; without it rows are 0 .. nrows - 1.
    ``listed``: the same entries before they were dealt, for column sums that need no dealing.
    """

    def __init__(self, entries: DataFrame, nrows: int, ncols: int, rows: DataFrame | None = None, coalesced: bool = False, listed: DataFrame | None = None):
        self.nrows, self.ncols, self.key = operator.index(nrows), operator.index(ncols), "i"
        if self.nrows < 0 or self.ncols < 0:
            raise ValueError("the shape must be nonnegative")
        cells = entries.select("i", F.col("j").cast("long").alias("j"), strict_double(F.col("v"), "v").alias("v"))
        self.df = cells if coalesced else cells.groupBy("i", "j").agg(F.sum("v").alias("v"))
        self._rows, self._listed = rows, listed

    def count(self) -> int:
        return self.nrows

    @property
    def rows(self) -> DataFrame:
        return self._rows if self._rows is not None else self.df.sparkSession.range(self.nrows).withColumnRenamed("id", "i")

    def dealt(self, by: str) -> Coo:
        """Entries in partitions by 'rows' or by 'columns', sorted: joins and sums over that axis then need no other shuffle."""
        first, second = {"rows": ("i", "j"), "columns": ("j", "i")}[by]
        return Coo(self.df.repartition(first).sortWithinPartitions(first, second), self.nrows, self.ncols, self._rows, coalesced=True)

    def transposed(self) -> Coo:
        """Rows and columns swapped; row keys must be numbers from 0."""
        return Coo(self.df.select(F.col("j").alias("i"), F.col("i").alias("j"), "v"), self.ncols, self.nrows, coalesced=True)

    def reduce(self, wanted: dict[str, Reduction], centers: Sequence[float]) -> dict[str, Any]:
        """Reductions of stored entries, and of the zero of the other rows as often as it stands there."""
        n, p = self.nrows, self.ncols
        if self._listed is not None and wanted and all(w == ("sum", IDENTITY) for w in wanted.values()):
            sums = np.zeros(p)
            own = self._listed.filter((F.col("j") >= 0) & (F.col("j") < p))
            for j, s in own.groupBy(F.col("j").cast("long")).agg(F.sum(strict_double(F.col("v"), "v"))).collect():
                sums[j] = s
            return dict.fromkeys(wanted, sums) | {"n": n}
        spark = self.df.sparkSession
        joined = self.df.join(vector_table(spark, centers, "j", "c"), "j")
        stored = joined.groupBy("j").agg(F.count(F.lit(1)).alias("k"), *[_fold(kind, f(F.col("v"), F.col("c"))).alias(name) for name, (kind, f) in wanted.items()])
        implicit = vector_table(spark, centers, "j", "c").select("j", *[f(F.lit(0.0), F.col("c")).alias(f"z_{name}") for name, (_, f) in wanted.items()])
        out: dict[str, Any] = {name: np.zeros(p) for name in wanted}
        for r in implicit.join(stored, "j", "left").collect():
            j, k = r["j"], r["k"] or 0
            for name, (kind, _) in wanted.items():
                zero, got = r[f"z_{name}"], r[name]
                if kind == "sum":
                    out[name][j] = (got or 0.0) + ((n - k) * zero if n > k else 0.0)
                else:
                    values = ([got] if k else []) + ([zero] if n > k else [])
                    out[name][j] = (np.min if kind == "min" else np.max)(values) if values else NAN
        return out | {"n": n}

    def ends(self, qs: Sequence[float]) -> tuple[int, list[Ends]]:
        """As for the other layouts, with the implicit zeros in their ranks: a rank among a column's zeros is known from counts, others are of stored entries."""
        n, p = self.nrows, self.ncols
        if not n:
            return 0, [None] * p
        counts = self.df.groupBy("j").agg(F.count_if(F.col("v") < 0).alias("less"), F.count_if(F.col("v") > 0).alias("more"), F.bool_or(F.isnan("v")).alias("bad")).collect()
        stored = {r["j"]: r for r in counts}
        places = linear_quantiles(n, qs)
        wanted: list[list[Target | None] | None] = []
        for j in range(p):
            less, more, bad = stored[j][1:] if j in stored else (0, 0, False)
            own = lambda r, less=less, more=more, j=j: Target(j, r if r < less else r - (n - more) + less) if r < less or r >= n - more else None  # noqa: E731  the rank among entries that are not zero
            wanted.append(None if bad else [own(r) for place in places for r in place[:2]])

        def flat(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
            yield batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)

        order_statistics(self.df.select("j", "v").filter("v != 0"), flat, [t for own in wanted for t in own or [] if t is not None])
        return n, self._put([None if own is None else [0.0 if t is None else t.value for t in own] for own in wanted], places)

    def dense(self) -> Array:
        return self.to_array()

    def long(self) -> DataFrame:
        """Every entry, zeros too."""
        return self.to_array().long()

    def to_array(self, column: str = "x") -> Array:
        """Rows as arrays with zeros filled in: one shuffle by row, then a join with the row domain. A row's entries are put in their places at once."""
        cells = self.df.groupBy("i").agg(F.collect_list(F.struct("j", "v")).alias("cells"))
        joined = self.rows.join(cells, "i", "left")
        p, kind = self.ncols, self.rows.schema["i"].dataType.simpleString()

        def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                cells = batch.column(1).fill_null([])
                row = np.repeat(np.arange(batch.num_rows), np.diff(cells.offsets.to_numpy()))
                entry = cells.flatten()
                x = np.zeros((batch.num_rows, p))
                x[row, entry.field("j").to_numpy(zero_copy_only=False)] = entry.field("v").to_numpy(zero_copy_only=False)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1) * p, pa.int32()), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0), lists], ["i", column])

        return Array.of(joined.select("i", "cells").mapInArrow(fill, f"i {kind}, `{column}` array<double>"), "i", column, p)

    def select(self, start: int, stop: int) -> Coo:
        cut = self.df.filter((F.col("j") >= start) & (F.col("j") < stop)).withColumn("j", F.col("j") - start)
        return Coo(cut, self.nrows, stop - start, self._rows, coalesced=True)

    def where(self, condition: Column | DataFrame) -> Coo:
        keep = (lambda d: d.filter(condition)) if isinstance(condition, Column) else (lambda d: d.join(condition, "i", "left_semi"))
        rows = keep(self.rows)
        return Coo(keep(self.df), rows.count(), self.ncols, rows, coalesced=True)


def from_numpy(spark: SparkSession, x: Any, key: str = "i", column: str = "x") -> Array:
    """A dense matrix in memory as an Array with row numbers as keys."""
    data = np.asarray(x)
    if data.dtype.kind not in "biuf":
        raise TypeError("a matrix takes real numbers")
    if data.ndim != 2:
        raise ValueError("a matrix has two dimensions")
    rows = [(k, r) for k, r in enumerate(data.astype(float).tolist())]
    return Array.of(spark.createDataFrame(rows, f"{key} bigint, {column} array<double>"), key, column, data.shape[1])


def from_coo(spark: SparkSession, rows: Any, cols: Any, values: Any, shape: tuple[int, int]) -> Coo:
    """A sparse matrix in memory; repeated entries are summed."""
    i, j, v = (np.asarray(a) for a in (rows, cols, values))
    if len(i) and not (0 <= i.min() and i.max() < shape[0] and 0 <= j.min() and j.max() < shape[1]):
        raise ValueError("an index is outside the shape")
    data = list(zip(i.tolist(), j.tolist(), v.astype(float).tolist(), strict=True))
    return Coo(spark.createDataFrame(data, "i bigint, j bigint, v double"), *shape)
