"""NaN-aware folds, exact quantiles of arrays, and guards, as Spark columns."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce
from statistics import NormalDist

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

NAN = float("nan")


@dataclass(frozen=True)
class Elementwise:
    """A function of a value and its column's center, for Spark columns and for NumPy arrays."""

    column: Callable[[Column, Column], Column]
    array: Callable[[np.ndarray, np.ndarray], np.ndarray]

    def __call__(self, x: Column, c: Column) -> Column:
        return self.column(x, c)


#: Sums of it need no values of equal place added up before.
IDENTITY = Elementwise(lambda x, c: x, lambda x, c: x)


def strict_double(value: Column, what: str) -> Column:
    """The value as a double; a NULL raises, because aggregates would skip it silently."""
    message = f"NULL in matrix column {what}; replace it or pass nulls='nan'"
    return F.coalesce(value.cast("double"), F.raise_error(F.lit(message)).cast("double"))


def nan_min(value: Column) -> Column:
    """Aggregate minimum that a NaN poisons; NaN over no rows."""
    return F.when(F.max(F.isnan(value)), F.lit(NAN)).otherwise(F.coalesce(F.min(value), F.lit(NAN)))


def nan_max(value: Column) -> Column:
    """Aggregate maximum that a NaN poisons (it is Spark's largest double); NaN over no rows."""
    return F.coalesce(F.max(value), F.lit(NAN))


def usable_scale(scale: Column) -> Column:
    """A computed scale with exact zeros of either sign replaced by one."""
    return F.element_at(F.transform(F.array(scale), lambda s: F.when(s == 0.0, F.lit(1.0)).otherwise(s)), 1)


def normal_range(lower: float, upper: float) -> float:
    """The distance between two quantiles of the standard normal distribution."""
    return NormalDist().inv_cdf(upper) - NormalDist().inv_cdf(lower)


def total(values: Sequence[Column]) -> Column:
    """The sum of some columns; zero of none."""
    return reduce(lambda a, b: a + b, values) if values else F.lit(0.0)


def sorted_quantile(ordered: Column, size: int, q: float) -> Column:
    """The exact linear quantile at (size - 1) * q of an array in ascending order."""
    at = (size - 1) * q
    low = math.floor(at)
    value = F.element_at(ordered, low + 1)
    if at > low:
        value = value + (F.element_at(ordered, low + 2) - value) * F.lit(at - low)
    return value


class RowVector:
    """One row's values, as separate columns or as one array column, with folds over them."""

    def __init__(self, values: Sequence[Column] | Column, size: int):
        self.values, self.size = values, size
        self.wide = not isinstance(values, Column)

    def map(self, f: Callable[[Column], Column]) -> RowVector:
        return RowVector([f(x) for x in self.values] if self.wide else F.transform(self.values, f), self.size)

    def sum(self) -> Column:
        if self.wide:
            return total(self.values)
        return F.aggregate(self.values, F.lit(0.0), lambda acc, x: acc + x)

    def array(self) -> Column:
        return (F.array(*self.values) if self.values else F.array().cast("array<double>")) if self.wide else self.values

    def max(self) -> Column:
        """The largest value; a NaN is larger than all."""
        if self.wide:
            return F.greatest(*self.values) if len(self.values) > 1 else self.values[0]
        return F.array_max(self.values)

    def min(self) -> Column:
        """The smallest value, or NaN if any is."""
        if self.wide:
            low = F.least(*self.values) if len(self.values) > 1 else self.values[0]
        else:
            low = F.array_min(self.values)
        return F.when(F.isnan(self.max()), F.lit(NAN)).otherwise(low)

    def let(self, value: Column, f: Callable[[Column], Column]) -> Column:
        """``f`` of a value that is computed once a row.

        A lambda over an array evaluates what it closes over for every element;
        a value bound as a lambda's own variable is not computed again.
        """
        return f(value) if self.wide else F.element_at(F.transform(F.array(value), f), 1)

    def quantiles(self, qs: Sequence[float]) -> Column:
        """An array of exact linear quantiles, all NaN if any value is."""
        pick = lambda ordered: F.array(*[sorted_quantile(ordered, self.size, q) for q in qs])
        found = F.element_at(F.transform(F.array(F.array_sort(self.array())), pick), 1)
        return F.when(F.isnan(self.max()), F.array(*[F.lit(NAN) for _ in qs])).otherwise(found)
