"""Exact order statistics in bounded memory, by histograms of the bits of doubles.

Doubles in their order are unsigned integers. A scan counts the values of a
column by their leading bits; the bin with a wanted rank is the band of the next
scan, which counts by the bits that follow. A bin also knows its smallest and
largest value, so one that holds a single value ends the search. There are few
scans (at most 4 of 16 bits; 1 or 2 for columns of few distinct values) whatever the
number of rows, no sketch and no sort, and all columns and ranks share them. A task holds
counts for a bounded number of bins, and only these are shuffled.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bins of all bands together that a task counts in arrays, and leading bits of one scan.
BINS, MOST_BITS, LEAST_BITS = 1 << 20, 16, 4

Cells = Callable[[pa.RecordBatch], Iterator[tuple[np.ndarray, np.ndarray]]]  # column numbers and values of a batch

_SIGN = np.uint64(1 << 63)


def ordered(x: np.ndarray) -> np.ndarray:
    """Doubles as unsigned integers in the same order: both zeros are one, and a NaN is above all."""
    bits = np.where(np.isnan(x), np.nan, x + 0.0).view(np.uint64)
    return np.where(bits >> np.uint64(63), ~bits, bits | _SIGN)


def double(key: int) -> float:
    """The double with that number."""
    bits = key & ~(1 << 63) if key >> 63 else ~key & ((1 << 64) - 1)
    return float(np.uint64(bits).view(np.float64))


INFINITY = int(ordered(np.array([math.inf]))[0])


@dataclass
class Target:
    """The value at ``rank`` (from 0) among those values of column ``j`` whose first ``depth`` bits are ``prefix``."""

    j: int
    rank: int
    depth: int = 0
    prefix: int = 0
    value: float | None = None


@dataclass
class Bins:
    """Of one band, by ascending leading bits: counts, and the smallest and largest key."""

    bin: np.ndarray
    n: np.ndarray
    low: np.ndarray
    high: np.ndarray

    def narrow(self, t: Target, bits: int) -> None:
        upto = np.cumsum(self.n)
        k = int(np.searchsorted(upto, t.rank, side="right"))
        if self.low[k] == self.high[k]:
            t.value = double(int(self.low[k]))
        t.rank -= int(upto[k] - self.n[k])
        t.depth, t.prefix = t.depth + bits, t.prefix << bits | int(self.bin[k])


def _width(bands: int, depth: int) -> int:
    """Leading bits that the next scan counts by."""
    return min(MOST_BITS, max(LEAST_BITS, BINS.bit_length() - 1 - max(0, bands - 1).bit_length()), 64 - depth)


def _layers(bands: Sequence[tuple[int, int]]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Bands by column, so that a value finds its band by column number: in each layer the columns, ascending, and their bands."""
    layers: list[list[tuple[int, int]]] = []
    seen: dict[int, int] = {}
    for number, (j, _) in enumerate(bands):
        at = seen[j] = seen.get(j, -1) + 1
        if at == len(layers):
            layers.append([])
        layers[at].append((j, number))
    return [tuple(np.array(sorted(layer), np.int64).T) for layer in layers]  # type: ignore[misc]


def histogram(df: DataFrame, cells: Cells, bands: Sequence[tuple[int, int]], depth: int, bits: int) -> dict[int, Bins]:
    """Counts by the ``bits`` after the first ``depth``, in bands (column, prefix)."""
    layers, prefix = _layers(bands), np.array([x for _, x in bands], np.uint64)
    size, shift, mask = len(bands) << bits, np.uint64(64 - depth - bits), np.uint64((1 << bits) - 1)
    dense = size <= 2 * BINS

    def rows(code: np.ndarray, n: np.ndarray, low: np.ndarray, high: np.ndarray) -> pa.RecordBatch:
        signed = [pa.array((x ^ _SIGN).view(np.int64)) for x in (low, high)]
        return pa.RecordBatch.from_arrays([pa.array(code), pa.array(n), *signed], ["code", "n", "low", "high"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if dense:
            n, low, high = np.zeros(size, np.int64), np.full(size, np.iinfo(np.uint64).max), np.zeros(size, np.uint64)
        for j, x in (part for batch in batches for part in cells(batch)):
            u = ordered(x)
            for columns, numbers in layers:
                at = np.minimum(np.searchsorted(columns, j), len(columns) - 1)
                band, inside = numbers[at], columns[at] == j
                if depth:
                    inside &= (u >> np.uint64(64 - depth)) == prefix[band]
                key = u[inside]
                code = (band[inside] << bits) + ((key >> shift) & mask).astype(np.int64)
                if dense:
                    n += np.bincount(code, minlength=size)
                    np.minimum.at(low, code, key)
                    np.maximum.at(high, code, key)
                elif len(code):
                    found, place = np.unique(code, return_inverse=True)
                    least, most = np.full(len(found), np.iinfo(np.uint64).max), np.zeros(len(found), np.uint64)
                    np.minimum.at(least, place, key)
                    np.maximum.at(most, place, key)
                    yield rows(found, np.bincount(place), least, most)
        if dense:
            some = np.flatnonzero(n)
            yield rows(some, n[some], low[some], high[some])

    parts = df.mapInArrow(count, "code bigint, n bigint, low bigint, high bigint")
    found = parts.groupBy("code").agg(F.sum("n"), F.min("low"), F.max("high")).toArrow()
    code, n, low, high = (c.to_numpy() for c in found.columns)
    order = np.argsort(code)
    code, n, low, high = code[order], n[order], *((x[order].view(np.uint64) ^ _SIGN) for x in (low, high))
    edges = np.searchsorted(code >> bits, np.arange(len(bands) + 1))
    return {k: Bins(code[a:b] & int(mask), n[a:b], low[a:b], high[a:b]) for k, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True))}


def order_statistics(df: DataFrame, cells: Cells, targets: Sequence[Target]) -> list[float]:
    """The values of the targets, all of the same depth."""
    while open_ := [t for t in targets if t.value is None]:
        depth = open_[0].depth
        bands = sorted({(t.j, t.prefix) for t in open_})
        number, bits = {b: k for k, b in enumerate(bands)}, _width(len(bands), depth)
        bins = histogram(df, cells, bands, depth, bits)
        for t in open_:
            bins[number[t.j, t.prefix]].narrow(t, bits)
    return [t.value for t in targets if t.value is not None]


def column_ranks(df: DataFrame, cells: Cells, ncols: int, ranks: Callable[[int], Sequence[int]]) -> tuple[int, list[list[float] | None]]:
    """The number of rows, and for each column the values at ``ranks(rows)``; None if it holds a NaN or there are no rows. The first scan counts the rows too."""
    bits = _width(ncols, 0)
    bins = histogram(df, cells, [(j, 0) for j in range(ncols)], 0, bits)
    n = int(bins[0].n.sum()) if ncols else 0
    if not n:
        return 0, [None] * ncols
    found: list[list[Target] | None] = []
    for j in range(ncols):
        if bins[j].high.max() > INFINITY:
            found.append(None)
            continue
        own = [Target(j, rank) for rank in ranks(n)]
        for t in own:
            bins[j].narrow(t, bits)
        found.append(own)
    order_statistics(df, cells, [t for own in found for t in own or []])
    return n, [None if own is None else [t.value for t in own if t.value is not None] for own in found]


def linear_quantiles(n: int, qs: Sequence[float]) -> list[tuple[int, int, float]]:
    """(rank, next rank, share of the next) of each linear quantile at (n - 1) * q."""
    at = [(n - 1) * q for q in qs]
    return [(math.floor(x), min(math.floor(x) + 1, n - 1), x - math.floor(x)) for x in at]


def between(low: float, high: float, share: float) -> float:
    """Linear interpolation; infinite ends are allowed."""
    if share == 0 or low == high:
        return low
    return low + (high - low) * share if math.isfinite(high - low) else (1 - share) * low + share * high
