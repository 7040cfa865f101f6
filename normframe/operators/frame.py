"""A raw matrix and its stages: every operation is a lazy DataFrame plan over the raw data."""

from __future__ import annotations

import operator
from collections.abc import Sequence
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import total
from ..plans.fitting import row_components
from ..plans.recipes import ColumnParams, RowNormalization, RowParams
from ..sources.chunks import ChunkedMatrix
from ..sources.layouts import LITERALS, Coo, Matrix, Wide, looked_up, matched, vector_table
from . import blocks, sparse, weighted


def _index(at: Any, size: int, what: str) -> int:
    """A number from 0; negative ones count from the end. Booleans are no numbers here."""
    if isinstance(at, (bool, np.bool_)):
        raise TypeError(f"a {what} is named by a whole number")
    at = operator.index(at)
    if not -size <= at < size:
        raise IndexError(f"{what} {at} is out of bounds for {size}")
    return at % size


def _normalized(x: Column, center: Column | None, scale: Column | None) -> Column:
    """Subtract, then divide; an inactive component is no operation."""
    if center is not None:
        x = x - center
    return x if scale is None else x / scale


def _column_stage(m: Any, params: ColumnParams) -> Any:
    if m.ncols != params.ncols:
        raise ValueError(f"parameters for {params.ncols} columns do not fit a matrix of {m.ncols}")
    if params.centers is None and params.scales is None:
        return m
    if isinstance(m, Coo) and params.centers is None:  # zeros stay zeros
        scaled = m.df.join(vector_table(m.df.sparkSession, params.scales, "j", "s"), "j").select("i", "j", (F.col("v") / F.col("s")).alias("v"))
        return Coo(scaled, m.nrows, m.ncols, m._rows, coalesced=True)
    m = m.dense()
    c, s = ([None] * m.ncols if x is None else list(x) for x in (params.centers, params.scales))
    if isinstance(m, Wide):
        lit = lambda x: None if x is None else F.lit(x)
        return m.replaced([_normalized(x, lit(a), lit(b)) for x, a, b in zip(m.row().values, c, s, strict=True)])
    x = F.col(m.column)
    if params.centers is not None:
        x = F.zip_with(x, F.lit(list(params.centers)), lambda a, b: a - b)
    if params.scales is not None:
        x = F.zip_with(x, F.lit(list(params.scales)), lambda a, b: a / b)
    return m.replaced(x)


def _row_stage(m: Any, df: DataFrame, center: Column | None, scale: Column | None) -> Any:
    if isinstance(m, Wide):
        df = df.withColumns({k: v for k, v in (("_center", center), ("_scale", scale)) if v is not None})
        c, s = (None if x is None else F.col(n) for n, x in (("_center", center), ("_scale", scale)))
        return m.replaced(m.row().map(lambda x: _normalized(x, c, s)).values, df)
    row = m.row()
    none = F.lit(None).cast("double")
    both = F.struct((none if center is None else center).alias("c"), (none if scale is None else scale).alias("s"))
    out = row.let(both, lambda p: F.transform(row.values, lambda x: _normalized(x, None if center is None else p["c"], None if scale is None else p["s"])))
    return m.replaced(out, df)


def apply_stage(m: Any, stage: Any) -> Any:
    """The output of one stage as a matrix of its own, lazily."""
    if isinstance(stage, ColumnParams):
        return _column_stage(m, stage)
    if isinstance(m, Coo) and m.ncols and (isinstance(stage, RowParams) and not stage.centered or isinstance(stage, RowNormalization) and stage.center == "none"):
        return sparse.scaled_rows(m, stage)
    if isinstance(stage, RowParams):
        m = m.dense()
        own = stage.table.select(stage.key, "center", "scale")
        joined = looked_up(m.df, m.key, own, {"center": "_c", "scale": "_s"}, "table of row parameters")
        return _row_stage(m, joined, F.col("_c") if stage.centered else None, F.col("_s") if stage.scaled else None)
    if isinstance(stage, RowNormalization):
        m = m.dense()
        if m.ncols == 0:
            raise ValueError("the matrix has no columns to fit on")
        center, scale = row_components(m.row(), stage)
        return _row_stage(m, m.df, center, scale)
    raise TypeError(f"{type(stage).__name__} is not a stage")


def logical(m: Any, stages: Sequence[Any]) -> Any:
    for stage in stages:
        m = apply_stage(m, stage)
    return m


class NormalizedFrame:
    """A raw matrix with fitted stages. Building it runs nothing; each method returns a lazy DataFrame or runs one job.

    Long vectors (one value a row) are DataFrames of key and value, short ones
    (one value a column) NumPy arrays. The raw DataFrame is never changed.
    """

    def __init__(self, raw: Matrix, stages: Sequence[Any] = (), intercept: bool = False):
        self.raw, self.stages, self.intercept = raw, list(stages), intercept
        for s in self.stages:
            if isinstance(s, ColumnParams) and s.ncols != raw.ncols:
                raise ValueError(f"parameters for {s.ncols} columns do not fit a matrix of {raw.ncols}")
        self._logical: Any = None
        self._low_rank: Any = None
        self._transpose: Transposed | None = None

    # What it is

    @property
    def matrix(self) -> Any:
        """The normalized matrix as a lazy layout."""
        if self._logical is None:
            self._logical = logical(self.raw, self.stages)
        return self._logical

    @property
    def sparse(self) -> sparse.LowRank | None:
        """Coordinates as stored entries plus a background of low rank; None for other layouts, or if rows have to be filled."""
        if self._low_rank is None and isinstance(self.raw, Coo):
            self._low_rank = sparse.low_rank(self.raw, self.stages)
        return self._low_rank

    @property
    def chunked(self) -> bool:
        """Whether products go chunk by chunk: column stages only, for rows would have to be put together for others."""
        return isinstance(self.raw, ChunkedMatrix) and all(isinstance(s, ColumnParams) for s in self.stages)

    @property
    def key(self) -> str:
        return self.raw.key

    @property
    def ncols(self) -> int:
        return self.raw.ncols + self.intercept

    @property
    def shape(self) -> tuple[int, int]:
        """Counts the rows of layouts that don't know them."""
        return self.raw.count(), self.ncols

    @property
    def normalization(self) -> Any:
        return self.stages[-1] if self.stages else None

    @property
    def centers(self) -> Any:
        """Column centers as an array, row centers as a table, None if inactive."""
        return self._component("centers", "center")

    @property
    def scales(self) -> Any:
        return self._component("scales", "scale")

    def _component(self, many: str, one: str) -> Any:
        p = self.normalization
        if isinstance(p, ColumnParams):
            return None if getattr(p, many) is None else np.array(getattr(p, many))
        if isinstance(p, RowNormalization):
            p = p.fit(logical(self.raw, self.stages[:-1]))
        if isinstance(p, RowParams):
            return p.table.select(p.key, one) if (p.centered if one == "center" else p.scaled) else None
        return None

    @property
    def T(self) -> Transposed:  # noqa: N802
        if self._transpose is None:
            self._transpose = Transposed(self)
        return self._transpose

    def with_intercept(self) -> NormalizedFrame:
        """[1, A]: coefficient 0 is the intercept. No column is stored."""
        return NormalizedFrame(self.raw, self.stages, True)

    # Products

    def matvec(self, v: Any, name: str = "value") -> DataFrame:
        """A v: key and value for each row."""
        return self.matmat(np.asarray(v, float).reshape(-1, 1), [name])

    def matmat(self, b: Any, names: Sequence[str] | None = None) -> DataFrame:
        """A B: key and one column for each column of B, in one scan of the data."""
        b = np.asarray(b, float)
        if b.ndim != 2 or b.shape[0] != self.ncols:
            raise ValueError(f"the operand needs {self.ncols} rows")
        names = list(names or [f"y{r}" for r in range(b.shape[1])])
        first, rest = (b[0], b[1:]) if self.intercept else (None, b)
        if self.sparse is not None:
            out = sparse.matmat(self.sparse, rest, names)
        elif self.chunked:
            out = blocks.matmat(self.raw, self.stages, rest, names)
        else:
            m = self.matrix.dense()
            out = m.df.select(m.key, *[_dot(m, rest[:, r]).alias(n) for r, n in enumerate(names)])
        if first is None:
            return out
        return out.select(self.key, *[(F.col(n) + F.lit(float(first[r]))).alias(n) for r, n in enumerate(names)])

    def rmatvec(self, u: Any) -> np.ndarray:
        """A^T u: one value a column. ``u``: an expression over the key and kept columns, or a table of key and value."""
        return self.rmatmat([u])[:, 0]

    def rmatmat(self, us: Sequence[Any]) -> np.ndarray:
        """A^T U for several long vectors: one scan of the data, and one join for all vectors that are tables."""
        k = len(us)
        if self.sparse is not None:
            out, sums = sparse.rmatmat(self.sparse, *self._with(self.sparse.rows, us))
        elif self.chunked:
            out, sums = blocks.rmatmat(self.raw, self.stages, *self._with(self.raw.keys(), us))
        else:
            m = self.matrix.dense()
            sums_and = weighted.sums(m, *self._with(m.df, us))
            out, sums = sums_and[:-1], sums_and[-1]
        out = out.reshape(self.raw.ncols, k)
        return np.vstack([sums.reshape(1, k), out]) if self.intercept else out

    def _with(self, df: DataFrame, us: Sequence[Any]) -> tuple[DataFrame, list[Column]]:
        """``df`` with long vectors joined to it, and these as columns. Tables are stacked by key and met once, however many there are."""
        tables = {f"_u{r}": u for r, u in enumerate(us) if isinstance(u, DataFrame)}
        cols = [F.col(f"_u{r}") if f"_u{r}" in tables else (F.col(u) if isinstance(u, str) else u).cast("double") for r, u in enumerate(us)]
        return (matched(df, self.key, tables) if tables else df), cols

    def matvec_scaled(self, v: Any, alpha: float, out: DataFrame, beta: float, name: str = "value") -> DataFrame:
        """alpha * A v + beta * out. A zero alpha reads no matrix, a zero beta ignores the old values, even NaN."""
        if len(np.asarray(v)) != self.ncols:
            raise ValueError(f"the operand needs {self.ncols} rows")
        key, value = out.columns[:2]
        if alpha == 0:
            old = out.select(F.col(key).alias(self.key), F.col(value).alias("_old"))
            return old.select(self.key, (F.lit(0.0) if beta == 0 else F.lit(float(beta)) * F.col("_old")).alias(name))
        new = self.matvec(v, "_new")
        if beta == 0:
            return new.select(self.key, (F.lit(float(alpha)) * F.col("_new")).alias(name))
        return matched(new, self.key, {"_old": out.select(key, value)}).select(self.key, (F.lit(float(alpha)) * F.col("_new") + F.lit(float(beta)) * F.col("_old")).alias(name))

    def rmatvec_scaled(self, u: Any, alpha: float, out: Any, beta: float) -> np.ndarray:
        """alpha * A^T u + beta * out, with the same rules."""
        old = np.asarray(out, float)
        if old.shape != (self.ncols,):
            raise ValueError(f"the output needs {self.ncols} values")
        kept = np.zeros(self.ncols) if beta == 0 else beta * old
        return kept if alpha == 0 else alpha * self.rmatvec(u) + kept

    def __matmul__(self, other: Any) -> DataFrame:
        b = np.asarray(other, float)
        if b.ndim not in (1, 2):
            raise ValueError("products take a vector or a matrix")
        return self.matvec(b) if b.ndim == 1 else self.matmat(b)

    def __rmatmul__(self, other: Any) -> np.ndarray:
        """u A: the vectors stand on the left. A NumPy operand has one value for each row, in ascending order of the keys."""
        if isinstance(other, (DataFrame, Column, str)):
            return self.rmatvec(other)
        other = np.asarray(other, float)
        if other.ndim not in (1, 2):
            raise ValueError("products take a vector or a matrix")
        rows = other.reshape(-1, other.shape[-1])
        placed = self._placed(rows)
        got = self.rmatmat([placed.select("k", f"u{r}") for r in range(len(rows))])
        return got[:, 0] if other.ndim == 1 else got.T

    def _placed(self, u: np.ndarray) -> DataFrame:
        """In-memory long vectors, one in each row of ``u``, as columns of a table: their values go to the keys in ascending order. Rows are counted before a key is fetched."""
        raw = self.raw
        domain = raw.keys() if isinstance(raw, ChunkedMatrix) else raw.rows.select("i") if isinstance(raw, Coo) else self.matrix.dense().df.select(self.key)
        n = raw.count()
        if n != u.shape[1]:
            raise ValueError(f"the operand has {u.shape[1]} values for {n} rows")
        keys = domain.orderBy(self.key).toArrow().column(0)  # no more than the caller holds in memory
        return domain.sparkSession.createDataFrame(pa.table([keys, *map(pa.array, u)], ["k", *[f"u{r}" for r in range(len(u))]]))

    def __array_ufunc__(self, ufunc: Any, method: str, *inputs: Any, **options: Any) -> Any:
        """np.matmul(u, A) and u @ A come here for NumPy arrays u; other functions of NumPy do not apply."""
        if ufunc is not np.matmul or method != "__call__" or options or len(inputs) != 2:
            return NotImplemented
        left, right = inputs
        return self.__matmul__(right) if left is self else self.__rmatmul__(left)

    def aslinearoperator(self) -> Any:
        """A SciPy LinearOperator for iterative solvers on the driver: each product is a Spark job, rows are in key order. SciPy is imported here."""
        from scipy.sparse.linalg import LinearOperator

        parts = InMemory(self)
        return LinearOperator(parts.shape, matvec=parts.matvec, rmatvec=parts.rmatvec, matmat=parts.matmat, rmatmat=parts.rmatmat, dtype=np.float64)

    # Weighted operations

    def weighted_sums(self, w: Any) -> np.ndarray:
        """Sums of w_i A_ij over rows, each entry normalized before it is weighted and added. No difference of totals is taken."""
        if self.sparse is None:
            return self.rmatvec(w)
        df, cols = self._with(self.sparse.rows, [w])
        return sparse.weighted_sums(self.sparse, df, cols[0])[0 if self.intercept else 1 :]

    def gram(self, w: Any = None) -> np.ndarray:
        """A^T diag(w) A, both triangles."""
        w = F.lit(1.0) if w is None else w
        if self.sparse is not None:
            full = self.gram_pairs(w).dense()
        else:
            m = self.matrix.dense()
            df, cols = self._with(m.df, [w])
            full = weighted.gram(m, df, cols[0])
        return full if self.intercept else full[1:, 1:]

    def gram_pairs(self, w: Any = None) -> sparse.GramParts:
        """The same for coordinates with many columns: stored pairs stay a table, the background comes as vectors of p numbers."""
        if self.sparse is None:
            raise ValueError("only coordinates that are not filled have stored pairs")
        df, cols = self._with(self.sparse.rows, [F.lit(1.0) if w is None else w])
        return sparse.gram_parts(self.sparse, df, cols[0])

    # Columns, rows, selections

    def column(self, j: int, name: str = "value") -> DataFrame:
        """Key and the normalized column j; negative j count from the end."""
        p = self.raw.ncols
        j = _index(j, p, "column")
        if self.sparse is not None:
            return sparse.column(self.sparse, j, name)
        only = [s.select(j, j + 1) if isinstance(s, ColumnParams) else s for s in self.stages]
        if all(isinstance(s, ColumnParams) for s in self.stages):
            m = logical(self.raw.select(j, j + 1), only).dense()
            x = m.row().array()[0] if not isinstance(m, Wide) else m.row().values[0]
        else:
            m = self.matrix.dense()
            x = m.row().values[j] if isinstance(m, Wide) else F.col(m.column)[j]
        return m.df.select(m.key, *m.extra, x.alias(name))

    def __getitem__(self, at: Any) -> DataFrame:
        if not (isinstance(at, tuple) and len(at) == 2 and at[0] == slice(None)):
            raise TypeError("only columns can be taken: Z[:, j]")
        return self.column(at[1])

    def column_view(self, j: int) -> weighted.ColumnView:
        """Reductions of one normalized column."""
        return weighted.ColumnView(self.column(j), self.key)

    def corrections(self, j: int) -> tuple[float | DataFrame, DataFrame]:
        """Of coordinates: the normalized value of a raw zero in column j (a table if it differs by row), and what stored entries add to it."""
        if not isinstance(self.raw, Coo):
            raise TypeError("only coordinates have corrections")
        if self.sparse is None:
            raise ValueError("a row recipe after a centered stage fills the rows; freeze its parameters first")
        return sparse.corrections(self.sparse, _index(j, self.raw.ncols, "column"))

    def row_corrections(self, key: Any) -> tuple[np.ndarray, DataFrame]:
        """Of coordinates: the normalized values of a row of raw zeros, and what its stored entries add to them (column number and value)."""
        if not isinstance(self.raw, Coo):
            raise TypeError("only coordinates have corrections")
        if self.sparse is None:
            raise ValueError("a row recipe after a centered stage fills the rows; freeze its parameters first")
        return sparse.row_corrections(self.sparse, key)

    def normalize_value(self, key: Any, j: int, value: float) -> float:
        """What ``value`` in place of entry (key, j) is after the stages with their parameters as fitted."""
        for stage in self.stages:
            if isinstance(stage, ColumnParams):
                c, s = (None if x is None else x[j] for x in (stage.centers, stage.scales))
            elif isinstance(stage, RowParams):
                found = stage.table.filter(F.col(stage.key) == F.lit(key)).select("center", "scale").first()
                if found is None:
                    raise IndexError("the row is not there")
                c, s = found["center"] if stage.centered else None, found["scale"] if stage.scaled else None
            else:
                raise ValueError("a row recipe has no parameters before it is fitted")
            value = value if c is None else value - c
            value = value if s is None else value / s
        return float(value)

    def row(self, key: Any) -> DataFrame:
        """Column number and value of one row."""
        m = self.matrix.dense()
        return m.where(F.col(m.key) == F.lit(key)).long().select("j", F.col("v").alias("value"))

    def entry(self, key: Any, j: int) -> float:
        found = self.column(j).filter(F.col(self.key) == F.lit(key)).first()
        if found is None:
            raise IndexError("the row is not there")
        return found["value"]

    def submatrix(self, rows: tuple[Any, Any] | None = None, cols: tuple[int, int] | None = None) -> NormalizedFrame:
        """A rectangle of the normalized matrix, with the parameters as fitted: keys in [from, to), columns in [from, to)."""
        start, stop = cols or (0, self.raw.ncols)
        if not 0 <= start <= stop <= self.raw.ncols:
            raise ValueError("the columns are out of bounds")
        if self.chunked and all(k is None or isinstance(k, int) for k in rows or ()):
            low, high = self.raw.rows
            inside = None if rows is None else (min(max(rows[0], low), high), max(min(rows[1], high), min(max(rows[0], low), high)))
            return NormalizedFrame(self.raw.rectangle(inside, (start, stop)), [s.select(start, stop) for s in self.stages], self.intercept)
        keep = lambda m: m if rows is None else m.where((F.col(m.key) >= F.lit(rows[0])) & (F.col(m.key) < F.lit(rows[1])))
        if all(isinstance(s, ColumnParams) for s in self.stages):  # columns outside are not read
            return NormalizedFrame(keep(self.raw).select(start, stop), [s.select(start, stop) for s in self.stages], self.intercept)
        return NormalizedFrame(keep(self.matrix).select(start, stop), [], self.intercept)

    # Outputs

    def to_eager(self) -> DataFrame:
        """All normalized entries as a DataFrame of the matrix's dense layout; write or cache it as needed."""
        return self.matrix.dense().df

    def write(self, path: str, mode: str = "errorifexists") -> None:
        self.to_eager().write.mode(mode).parquet(path)

    def toarray(self) -> np.ndarray:
        """The whole matrix on the driver, rows in key order: for small matrices only."""
        m = self.matrix.dense()
        rows = m.df.select(m.key, m.row().array().alias("_x")).orderBy(m.key).collect()
        return np.array([r["_x"] for r in rows], float).reshape(len(rows), self.raw.ncols)

    def read_block(self, rows: tuple[Any, Any], cols: tuple[int, int]) -> np.ndarray:
        """A rectangle on the driver, rows in key order."""
        return self.submatrix(rows, cols).toarray()

    def __array__(self, dtype: Any = None, copy: Any = None) -> np.ndarray:
        raise TypeError("use toarray() to collect the matrix")


def _dot(m: Any, v: np.ndarray) -> Column:
    """The product of a row with a short vector."""
    if isinstance(m, Wide):
        return total([x * F.lit(float(b)) for x, b in zip(m.row().values, v, strict=True)])
    products = F.zip_with(F.col(m.column), F.lit([float(b) for b in v]), lambda a, b: a * b)
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


class InMemory:
    """Products with NumPy vectors on both sides, rows in key order: for solvers that iterate on the driver over vectors that fit there."""

    dtype = np.dtype(float)

    def __init__(self, frame: NormalizedFrame):
        self.frame, self.shape = frame, frame.shape

    def matvec(self, v: Any) -> np.ndarray:
        return self.matmat(np.asarray(v, float).reshape(-1, 1))[:, 0]

    def matmat(self, b: Any) -> np.ndarray:
        b = np.asarray(b, float)
        rows = self.frame.matmat(b).orderBy(self.frame.key).collect()
        return np.array([tuple(r)[1:] for r in rows], float).reshape(len(rows), b.shape[1])

    def rmatvec(self, u: Any) -> np.ndarray:
        return np.asarray(u, float).ravel() @ self.frame

    def rmatmat(self, u: Any) -> np.ndarray:
        return (np.asarray(u, float).T @ self.frame).T


class Transposed:
    """The transpose: products swap, nothing moves."""

    def __init__(self, frame: NormalizedFrame):
        self.T = frame

    @property
    def shape(self) -> tuple[int, int]:
        n, p = self.T.shape
        return p, n

    @property
    def centers(self) -> Any:
        """Of rows, where the matrix has them of columns."""
        return self.T.centers

    @property
    def scales(self) -> Any:
        return self.T.scales

    def matvec(self, u: Any) -> np.ndarray:
        return self.T.rmatvec(u)

    def rmatvec(self, v: Any) -> DataFrame:
        return self.T.matvec(v)

    def matmat(self, us: Sequence[Any]) -> np.ndarray:
        return self.T.rmatmat(us)

    def rmatmat(self, b: Any) -> DataFrame:
        return self.T.matmat(b)

    def __matmul__(self, u: Any) -> np.ndarray:
        if isinstance(u, np.ndarray):
            return (u.T @ self.T).T
        return self.T.rmatmat(u) if isinstance(u, (list, tuple)) else self.T.rmatvec(u)

    def __rmatmul__(self, v: Any) -> DataFrame:
        """v A^T, a product with the matrix's rows: a table with a column for each vector."""
        v = np.asarray(v, float)
        return self.T @ (v if v.ndim == 1 else v.T)

    def __array_ufunc__(self, ufunc: Any, method: str, *inputs: Any, **options: Any) -> Any:
        if ufunc is not np.matmul or method != "__call__" or options or len(inputs) != 2:
            return NotImplemented
        return self.__matmul__(inputs[1]) if inputs[0] is self else self.__rmatmul__(inputs[0])

    def __getitem__(self, at: Any) -> DataFrame:
        """T[:, k]: a row of the matrix, as column number and value. Rows whose keys are numbers from 0 are counted from the end by negative ones; any other key that is not there raises."""
        if not (isinstance(at, tuple) and len(at) == 2 and at[0] == slice(None)):
            raise TypeError("only columns can be taken: T[:, key]")
        key, raw = at[1], self.T.raw
        if isinstance(key, (bool, np.bool_)):
            raise TypeError("a column of the transpose is named by a key")
        if isinstance(raw, ChunkedMatrix) or isinstance(raw, Coo) and raw._rows is None:
            return self.T.row(_index(key, raw.count(), "row"))
        domain = (raw.rows if isinstance(raw, Coo) else raw.df).select(self.T.key)
        if isinstance(key, (int, np.integer)) and key < 0:  # from the end of the keys in ascending order
            found = [r[0] for r in domain.orderBy(F.desc(self.T.key)).limit(-int(key)).collect()]
            if len(found) < -key:
                raise IndexError(f"row {key} is out of bounds for {len(found)}")
            return self.T.row(found[-1])
        if not domain.filter(F.col(self.T.key) == F.lit(key)).limit(1).count():
            raise IndexError(f"there is no row {key}")
        return self.T.row(key)

    def toarray(self) -> np.ndarray:
        return self.T.toarray().T


def take_rows(m: Matrix, keys: Sequence[Any] | DataFrame) -> Any:
    """A subset of raw rows, to fit on. Listed keys must be strictly increasing; a table of keys is semi-joined."""
    if isinstance(keys, DataFrame):
        return m.where(keys.select(F.col(keys.columns[0]).alias(m.key)))
    keys = list(keys)
    if any(a >= b for a, b in zip(keys[:-1], keys[1:], strict=True)):
        raise ValueError("row keys must be strictly increasing")
    if len(keys) <= LITERALS:
        return m.where(F.col(m.key).isin(keys))
    kind = m.df.schema[m.key].dataType.simpleString()
    return m.where(m.df.sparkSession.createDataFrame([(k,) for k in keys], f"{m.key} {kind}"))

