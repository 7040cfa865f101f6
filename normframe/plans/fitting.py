"""Fitting passes: which reductions a recipe needs, and in which jobs."""

from __future__ import annotations

from typing import Any

import numpy as np
from pyspark.sql import functions as F

from ..functions.numeric import IDENTITY, NAN, Elementwise, RowVector, normal_range, usable_scale
from .recipes import ColumnParams, Recipe, RowParams
from .selection import between

#: Columns up to which a row's statistics are plain expressions; wider rows are folded as arrays.
INLINE = 8

# Elementwise functions of the reductions; c is the center of the column.
DEVIATION = Elementwise(lambda x, c: x - c, lambda x, c: x - c)
ABSOLUTE = Elementwise(lambda x, c: F.abs(x - c), lambda x, c: np.abs(x - c))
SQUARE = Elementwise(lambda x, c: (x - c) * (x - c), lambda x, c: (x - c) ** 2)


def fit_columns(matrix: Any, recipe: Recipe, allow_empty: bool = False) -> ColumnParams:
    """Centers and scales of all columns.

    One job takes every one-pass statistic of all columns; a second, if the
    scale needs it, deviations from the mean or from the chosen center.
    Quantiles share their scans: one for counts and one for the values if the
    columns are short, a few more if they are long.
    An empty axis raises unless ``allow_empty``, which gives NaN (0 for norms
    without centering, and so a scale of 1).
    """
    p = matrix.ncols
    norms = {"maxabs": ("max", ABSOLUTE), "l1": ("sum", ABSOLUTE), "l2": ("sum", SQUARE)}
    first: dict[str, tuple[str, Any]] = {}
    if recipe.center == "mean" or recipe.scale == "sd":
        first["sum"] = ("sum", IDENTITY)
    if recipe.center == "min" or recipe.scale == "range":
        first["min"] = ("min", IDENTITY)
    if recipe.scale == "range":
        first["max"] = ("max", IDENTITY)
    if recipe.center == "none" and recipe.scale in norms:
        first["norm"] = norms[recipe.scale]
    qs = ([0.5] if recipe.center == "median" else []) + (list(recipe.quantile_range) if recipe.scale == "quantile_range" else [])
    n, ends = matrix.ends(qs) if qs else (0, [])
    got = matrix.reduce(first, [0.0] * p) if first or not qs else {"n": n}
    n = got["n"]
    if n == 0 and not allow_empty:
        raise ValueError("the matrix has no rows to fit on")
    mean = got["sum"] / n if "sum" in got and n else np.full(p, NAN)
    median = np.array([NAN if e is None else between(*e[0]) for e in ends]) if recipe.center == "median" else None
    center = {"none": None, "mean": mean, "min": got.get("min"), "median": median}[recipe.center]
    scale: np.ndarray | None = None
    if recipe.scale == "sd":
        scale = _sd(matrix, mean, n, recipe.df)
    elif recipe.scale == "range":
        scale = got["max"] - got["min"]
    elif recipe.scale == "quantile_range":
        scale = spread(ends)
        if recipe.unit_variance:
            scale = scale / normal_range(*recipe.quantile_range)
    elif recipe.scale in norms:
        value = got["norm"] if "norm" in got else matrix.reduce({"norm": norms[recipe.scale]}, list(center))["norm"]
        scale = np.sqrt(value) if recipe.scale == "l2" else value
        if n == 0:
            scale = np.zeros(p) if recipe.center == "none" else np.full(p, NAN)
    if scale is not None:
        scale = np.where(scale == 0, 1.0, scale)
    return ColumnParams(p, None if center is None else tuple(center), None if scale is None else tuple(scale))


def _sd(matrix: Any, mean: np.ndarray, n: int, df: int) -> np.ndarray:
    """Corrected two-pass standard deviations, exact for large offsets."""
    if n <= df:
        return np.full(matrix.ncols, NAN)
    got = matrix.reduce({"d": ("sum", DEVIATION), "dd": ("sum", SQUARE)}, list(mean))
    with np.errstate(invalid="ignore"):
        return np.sqrt(np.maximum(got["dd"] - got["d"] ** 2 / n, 0) / (n - df))


def spread(ends: list[Any]) -> np.ndarray:
    """Upper minus lower quantile, the last two of each column, from values shifted by the lower one so that offsets do not erase the spread."""
    out = np.full(len(ends), NAN)
    for j, e in enumerate(ends):
        if e is not None:
            (a, b, f), (c, d, g) = e[-2:]
            shift = a if np.isfinite(a) else 0.0
            with np.errstate(invalid="ignore"):
                out[j] = np.float64(between(c - shift, d - shift, g)) - between(a - shift, b - shift, f)
    return out


class ColumnStatistics:
    """The statistics of a matrix's columns by name, each as a vector. An empty axis gives NaN, uncentered norms 0."""

    def __init__(self, matrix: Any):
        self.matrix = matrix

    def _one(self, kind: str, f: Any, centers: Any = None) -> tuple[np.ndarray, int]:
        c = [0.0] * self.matrix.ncols if centers is None else [float(x) for x in centers]
        got = self.matrix.reduce({"x": (kind, f)}, c)
        return got["x"], got["n"]

    def means(self) -> np.ndarray:
        s, n = self._one("sum", IDENTITY)
        return s / n if n else np.full(self.matrix.ncols, NAN)

    def sds(self, df: int = 0) -> np.ndarray:
        s, n = self._one("sum", IDENTITY)
        return _sd(self.matrix, s / n, n, df) if n > df else np.full(self.matrix.ncols, NAN)

    def mins(self) -> np.ndarray:
        return self._one("min", IDENTITY)[0]

    def ranges(self) -> np.ndarray:
        got = self.matrix.reduce({"a": ("min", IDENTITY), "b": ("max", IDENTITY)}, [0.0] * self.matrix.ncols)
        return got["b"] - got["a"]

    def maxabs(self, centers: Any = None) -> np.ndarray:
        x, n = self._one("max", ABSOLUTE, centers)
        return x if n or centers is not None else np.zeros(self.matrix.ncols)

    def l1(self, centers: Any = None) -> np.ndarray:
        return self._one("sum", ABSOLUTE, centers)[0]

    def l2(self, centers: Any = None) -> np.ndarray:
        return np.sqrt(self._one("sum", SQUARE, centers)[0])

    def medians(self) -> np.ndarray:
        return self.matrix.quantiles([0.5])[:, 0]

    def quantile_ranges(self, bounds: tuple[float, float] = (0.25, 0.75), unit_variance: bool = False) -> np.ndarray:
        out = spread(self.matrix.ends(list(bounds))[1])
        return out / normal_range(*bounds) if unit_variance else out


def row_components(row: RowVector, recipe: Recipe) -> tuple[Any, Any]:
    """The center and scale of a row as expressions over its own values; None where inactive."""
    p = row.size
    if p == 0:
        center = None if recipe.center == "none" else F.lit(NAN)
        zero = recipe.center == "none" and recipe.scale in ("maxabs", "l1", "l2")
        return center, None if recipe.scale == "none" else F.lit(1.0 if zero else NAN)
    if row.wide and p > INLINE:
        row = RowVector(row.array(), p)
    mean = row.sum() / F.lit(float(p))
    center = {"none": lambda: None, "mean": lambda: mean, "min": row.min, "median": lambda: row.quantiles([0.5])[0]}[recipe.center]()

    def moved(f: Any) -> Any:
        """``f`` of the centered row."""
        return f(row) if center is None else row.let(center, lambda c: f(row.map(lambda x: x - c)))

    def sd(away: RowVector) -> Any:
        return row.let(away.sum(), lambda off: F.sqrt((away.map(lambda x: x * x).sum() - off * off / F.lit(float(p))) / F.lit(float(p - recipe.df))))

    if recipe.scale == "none":
        return center, None
    if recipe.scale == "sd":
        if p <= recipe.df:
            return center, F.lit(NAN)
        scale = row.let(mean, lambda m: sd(row.map(lambda x: x - m)))
    elif recipe.scale == "range":
        scale = row.max() - row.min()
    elif recipe.scale == "quantile_range":
        both = row.let(row.min(), lambda low: row.map(lambda x: x - low).quantiles(recipe.quantile_range))
        scale = F.aggregate(both, F.lit(0.0), lambda acc, q: q - acc)  # upper minus lower
        if recipe.unit_variance:
            scale = scale / F.lit(normal_range(*recipe.quantile_range))
    elif recipe.scale == "maxabs":
        scale = moved(lambda r: r.map(F.abs).max())
    elif recipe.scale == "l1":
        scale = moved(lambda r: r.map(F.abs).sum())
    else:
        scale = F.sqrt(moved(lambda r: r.map(lambda x: x * x).sum()))
    return center, usable_scale(scale)


def fit_rows(matrix: Any, recipe: Recipe, allow_empty: bool = False) -> RowParams:
    from ..operators.sparse import row_table
    from ..sources.layouts import Coo

    if matrix.ncols == 0 and not allow_empty:
        raise ValueError("the matrix has no columns to fit on")
    if isinstance(matrix, Coo):  # zeros are counted, not filled in
        return RowParams(row_table(matrix.df, matrix.rows, matrix.ncols, recipe), matrix.key, recipe.center != "none", recipe.scale != "none")
    dense = matrix.dense()
    none = F.lit(None).cast("double")
    center, scale = row_components(dense.row(), recipe)
    table = dense.df.select(dense.key, (none if center is None else center).alias("center"), (none if scale is None else scale).alias("scale"))
    return RowParams(table, dense.key, center is not None, scale is not None)
