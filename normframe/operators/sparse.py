"""Normalized coordinates without dense rows: stored entries plus a background of low rank.

Column and row stages move a raw zero to a background value and a stored entry
by an amount of its own. The background of any chain is a sum of few products of
a row factor and a column factor, so A = D + R B: D holds as many entries as the
raw matrix, R has a column and B a row for each such product.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, replace
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import NAN, RowVector, nan_max, nan_min, normal_range, usable_scale
from ..plans.fitting import row_components
from ..plans.recipes import ColumnParams, RowNormalization, RowParams
from ..plans.selection import Target, linear_quantiles, order_statistics
from ..sources.layouts import Coo, looked_up, vector_table

#: Rows that a task turns into one block for a Gram matrix.
BLOCK_ROWS = 1024


@dataclass(frozen=True)
class LowRank:
    """``entries`` (i, j, v): D; ``rows`` (i, and the named columns in ``factors``): R, where None stands for ones; ``back``: B."""

    entries: DataFrame
    rows: DataFrame
    ncols: int
    factors: tuple[str | None, ...] = ()
    back: tuple[tuple[float, ...], ...] = ()

    @property
    def b(self) -> np.ndarray:
        return np.array(self.back, float).reshape(len(self.back), self.ncols)

    def factor(self, k: int) -> Column:
        return F.lit(1.0) if self.factors[k] is None else F.col(self.factors[k])

    def _columns(self, params: ColumnParams) -> LowRank:
        out = self
        if params.centers is not None:
            own, back = list(self.factors), self.b
            if None not in own:
                own, back = [*own, None], np.vstack([back, np.zeros(self.ncols)])
            back[own.index(None)] -= params.centers
            out = replace(self, factors=tuple(own), back=tuple(map(tuple, back)))
        if params.scales is not None:
            table = vector_table(self.entries.sparkSession, params.scales, "_j", "_s")
            scaled = out.entries.join(table, F.col("j") == F.col("_j")).select("i", "j", (F.col("v") / F.col("_s")).alias("v"))
            out = replace(out, entries=scaled, back=tuple(map(tuple, out.b / np.array(params.scales))))
        return out

    def _rows(self, table: DataFrame, centered: bool, scaled: bool) -> LowRank:
        """``table``: key, center, scale of each row."""
        at = len(self.factors)
        c, s = f"_c{at}", f"_s{at}"
        rows = looked_up(self.rows, "i", table.select(table.columns[0], "center", "scale"), {"center": c, "scale": s}, "table of row parameters")
        entries, names, back = self.entries, list(self.factors), list(self.back)
        if centered:
            rows = rows.withColumn(c, -F.col(c))
            names, back = [*names, c], [*back, (1.0,) * self.ncols]
        if scaled:
            own = rows.select(F.col("i").alias("_i"), F.col(s).alias("_s"))
            entries = entries.join(own, F.col("i") == F.col("_i")).select("i", "j", (F.col("v") / F.col("_s")).alias("v"))
            for k, name in enumerate(names):
                new = f"_f{at}_{k}"
                rows = rows.withColumn(new, (F.lit(1.0) if name is None else F.col(name)) / F.col(s))
                names[k] = new
        return replace(self, entries=entries, rows=rows, factors=tuple(names), back=tuple(back))


#: Stored entries of a row that are sorted in one list; quantiles of longer rows come from histograms that all tasks fill.
LONG_ROW = 1_000_000


def row_table(entries: DataFrame, rows: DataFrame, ncols: int, recipe: Any) -> DataFrame:
    """(i, center, scale) of the rows of a matrix whose background is zero, from what is stored.

    Sums, extremes and deviations are aggregates of stored entries, added up in
    part before the shuffle; the zeros of a row come in by their number. Ranks
    are looked up among stored values and counted zeros. Rows are not filled,
    however many columns there are. Lazy, but for quantiles, which count the longest rows.
    """
    p = ncols
    if not p:
        center, scale = row_components(RowVector([], 0), recipe)
        none = F.lit(None).cast("double")
        return rows.select("i", (none if center is None else center).alias("center"), (none if scale is None else scale).alias("scale"))
    v = F.col("v")
    stored = entries.groupBy("i").agg(
        F.count(F.lit(1)).alias("k"), F.sum(v).alias("sum"), nan_min(v).alias("low"), nan_max(v).alias("high"), F.sum(F.abs(v)).alias("l1"), F.sum(v * v).alias("l2"),
        F.count_if(v < 0).alias("less"), F.count_if(v > 0).alias("more"),
    )
    base = rows.select("i").join(stored, "i", "left")
    base = base.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("k", "sum", "l1", "l2", "less", "more")})
    zeros = F.lit(p) - F.col("k")
    low, high = (F.when(F.col("k") == 0, 0.0).when(F.isnan(c), F.lit(NAN)).when(zeros > 0, f(F.col(c), F.lit(0.0))).otherwise(F.col(c)) for c, f in (("low", F.least), ("high", F.greatest)))
    base = base.withColumns({"low": low, "high": high, "mean": F.col("sum") / F.lit(float(p)), "zeros": zeros})
    qs = ([0.5] if recipe.center == "median" else []) + (list(recipe.quantile_range) if recipe.scale == "quantile_range" else [])
    places = linear_quantiles(p, qs)
    if qs:
        ranks = sorted({r for place in places for r in place[:2]})
        base = base.join(_row_ranks(entries, base, p, ranks), "i", "left")
        at = {r: F.when(F.isnan("high"), F.lit(NAN)).when(F.col("v_ranks").isNull(), 0.0).otherwise(F.col("v_ranks")[k]) for k, r in enumerate(ranks)}
        blend = lambda place, f=lambda x: x: f(at[place[0]]) if not place[2] else f(at[place[0]]) + (f(at[place[1]]) - f(at[place[0]])) * F.lit(place[2])
    center = {"none": None, "mean": F.col("mean"), "min": F.col("low"), "median": blend(places[0]) if recipe.center == "median" else None}[recipe.center]
    base = base.withColumn("center", F.lit(None).cast("double") if center is None else center)
    away = "mean" if recipe.scale == "sd" else "center" if center is not None and recipe.scale in ("l1", "l2", "maxabs") else None
    if away:  # a second pass: deviations from a value of the row
        d = F.col("v") - F.col("_away")
        moved = entries.join(base.select(F.col("i").alias("_i"), F.col(away).alias("_away")), F.col("i") == F.col("_i")).groupBy("i").agg(
            F.sum(d).alias("d"), F.sum(d * d).alias("dd"), F.sum(F.abs(d)).alias("da"), nan_max(F.abs(d)).alias("dm")
        )
        c = F.col(away)
        base = base.join(moved, "i", "left").withColumns({n: F.coalesce(n, F.lit(0.0)) for n in ("d", "dd", "da")})
        implied = lambda x: F.when(F.col("zeros") > 0, F.col("zeros") * x).otherwise(0.0)
        off, square, absolute = F.col("d") - implied(c), F.col("dd") + implied(c * c), F.col("da") + implied(F.abs(c))
        most = F.when(F.col("k") == 0, F.abs(c)).when(F.col("zeros") > 0, F.greatest("dm", F.abs(c))).otherwise(F.col("dm"))
    else:
        square, absolute = F.col("l2"), F.col("l1")
        most = F.when(F.isnan("high"), F.lit(NAN)).otherwise(F.greatest(F.abs("low"), F.abs("high")))
    if recipe.scale == "none":
        return base.select("i", "center", F.lit(None).cast("double").alias("scale"))
    if recipe.scale == "sd":
        scale = F.lit(NAN) if p <= recipe.df else F.sqrt(F.greatest(square - off * off / F.lit(float(p)), F.lit(0.0)) / F.lit(float(p - recipe.df)))
    elif recipe.scale == "range":
        scale = F.col("high") - F.col("low")
    elif recipe.scale == "quantile_range":
        lower, upper = (blend(place, lambda x: x - F.col("low")) for place in places[-2:])
        scale = upper - lower
        if recipe.unit_variance:
            scale = scale / F.lit(normal_range(*recipe.quantile_range))
    else:
        scale = {"maxabs": most, "l1": absolute, "l2": F.sqrt(square)}[recipe.scale]
    return base.select("i", "center", usable_scale(scale).alias("scale"))


def _row_ranks(entries: DataFrame, base: DataFrame, p: int, ranks: Sequence[int]) -> DataFrame:
    """(i, v_ranks): each row's values at the ranks, for rows with stored values other than zero."""
    found = entries.filter("v != 0")
    counted = base.select("i", "less", "more")
    place = lambda r, less, more: r if r < less else None if r < p - more else r - (p - more) + less  # noqa: E731  among values other than zero
    long = [tuple(r) for r in counted.filter(F.col("less") + F.col("more") > LONG_ROW).collect()]  # few, for each has so many entries
    listed = found.groupBy("i").agg(F.array_sort(F.collect_list("v")).alias("_v")) if not long else None
    kind = entries.schema["i"].dataType.simpleString()
    if long:
        spark = entries.sparkSession
        numbers = F.broadcast(spark.createDataFrame([(i, k) for k, (i, _, _) in enumerate(long)], f"_i {kind}, _k bigint"))
        met = found.join(numbers, F.col("i") == F.col("_i"), "left")
        targets = [[None if (at := place(r, less, more)) is None else Target(k, at) for r in ranks] for k, (_, less, more) in enumerate(long)]

        def flat(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
            yield batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)

        order_statistics(met.filter("_k is not null").select("_k", "v"), flat, [t for own in targets for t in own if t is not None])
        known = [(i, [0.0 if t is None else t.value for t in own]) for (i, _, _), own in zip(long, targets, strict=True)]
        rest = met.filter("_k is null").groupBy("i").agg(F.array_sort(F.collect_list("v")).alias("_v"))
    else:
        known, rest = [], listed
    less, more = F.col("less"), F.col("more")
    pick = [F.when(F.lit(r) < less, F.element_at("_v", F.lit(r + 1))).when(F.lit(r) < F.lit(p) - more, 0.0).otherwise(F.try_element_at("_v", (F.lit(r + 1 - p) + more + less).cast("int"))) for r in ranks]
    out = rest.join(counted, "i").select("i", F.array(*pick).alias("v_ranks"))
    return out.unionByName(entries.sparkSession.createDataFrame(known, f"i {kind}, v_ranks array<double>")) if known else out


def scaled_rows(m: Coo, stage: RowParams | RowNormalization) -> Coo:
    """Coordinates with their rows divided by scales: zeros stay zeros, so no row is filled, but for those whose scale is NaN, as 0 / NaN is."""
    if isinstance(stage, RowParams):
        table = stage.table.select(stage.key, "center", "scale")
        rows = looked_up(m.rows.select("i"), "i", table, {"scale": "scale"}, "table of row parameters")
        scaled = stage.scaled
    else:
        rows, scaled = row_table(m.df, m.rows, m.ncols, stage), stage.scale != "none"
    if not scaled:
        return m
    own = rows.filter(~F.isnan("scale")).select(F.col("i").alias("_i"), F.col("scale").alias("_s"))
    entries = m.df.join(own, F.col("i") == F.col("_i")).select("i", "j", (F.col("v") / F.col("_s")).alias("v"))
    poisoned = rows.filter(F.isnan("scale")).select("i", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(m.ncols - 1).cast("long"))).alias("j"), F.lit(NAN).alias("v"))
    return Coo(entries.unionByName(poisoned), m.nrows, m.ncols, m._rows, coalesced=True)


def low_rank(raw: Coo, stages: Sequence[Any]) -> LowRank | None:
    """The form above of a normalized matrix; None if a row recipe has to be fitted on rows that are not sparse any more."""
    out = LowRank(raw.df.select("i", "j", "v"), raw.rows.select("i"), raw.ncols)
    for stage in stages:
        if isinstance(stage, ColumnParams):
            out = out._columns(stage)
        elif isinstance(stage, RowParams):
            out = out._rows(stage.table.select(stage.key, "center", "scale"), stage.centered, stage.scaled)
        elif isinstance(stage, RowNormalization) and not out.factors and raw.ncols:
            out = out._rows(row_table(out.entries, out.rows, raw.ncols, stage), stage.center != "none", stage.scale != "none")
        else:
            return None
    return out


def matmat(z: LowRank, b: np.ndarray, names: Sequence[str]) -> DataFrame:
    """A B: stored entries meet the rows of B, and each row adds its share of the background."""
    k = b.shape[1]
    if k > WIDE:
        return _wide_matmat(z, b, names)
    sums = z.entries.join(_operand(z, b), F.col("j") == F.col("_j")).groupBy("i").agg(F.count(F.lit(1)), *[F.sum(F.col("v") * F.col(f"_b{r}")).alias(f"_y{r}") for r in range(k)])
    full = z.rows.join(sums, "i", "left")
    shares = z.b @ b
    out = []
    for r, name in enumerate(names):
        y = F.coalesce(F.col(f"_y{r}"), F.lit(0.0))
        for f in range(len(z.factors)):
            y = y + z.factor(f) * F.lit(float(shares[f, r]))
        out.append(y.alias(name))
    return full.select("i", *out)


#: Columns of B that are sums of one aggregate; wider operands go by blocks of this many entries, against this many rows.
WIDE, PANEL_ENTRIES, PANEL_ROWS = 64, 1 << 20, 4096


def _wide_matmat(z: LowRank, b: np.ndarray, names: Sequence[str]) -> DataFrame:
    """The same for hundreds or thousands of columns: blocks of the rows of B meet blocks of stored entries, and partial rows are added up.

    A task holds one block of B and the products of one block of rows, whatever p, n and the length of a row.
    """
    k, spark = b.shape[1], z.entries.sparkSession
    width = max(1, PANEL_ENTRIES // k)
    groups = max(1, -(-z.rows.count() // PANEL_ROWS))
    kind = z.rows.schema["i"].dataType.simpleString()
    lows = list(range(0, z.ncols, width))
    flat = pa.LargeListArray.from_arrays(pa.array([k * low for low in [*lows, z.ncols]], pa.int64()), pa.array(np.ascontiguousarray(b).ravel()))
    panels = spark.createDataFrame(pa.Table.from_arrays([pa.array(np.arange(len(lows))), flat], ["_jb", "b"]))
    cells = z.entries.groupBy(F.floor(F.col("j") / F.lit(width)).cast("long").alias("jb"), F.pmod(F.xxhash64("i"), F.lit(groups)).alias("ib")).agg(
        F.collect_list("i").alias("i"), F.collect_list(F.struct("j", "v")).alias("cells")
    )
    met = cells.join(F.broadcast(panels) if b.size <= 1_000_000 else panels, F.col("jb") == F.col("_jb")).select("jb", "i", "cells", "b")

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n, jb in enumerate(batch.column(0).to_pylist()):
                coded = batch.column(1)[n].values.dictionary_encode()
                entry, panel = batch.column(2)[n].values, batch.column(3)[n].values.to_numpy(zero_copy_only=False).reshape(-1, k)
                row, j, v = coded.indices.to_numpy(), entry.field("j").to_numpy() - jb * width, entry.field("v").to_numpy()
                order = np.argsort(row, kind="stable")
                row, j, v = row[order], j[order], v[order]
                first = np.flatnonzero(np.diff(row, prepend=-1))
                y = np.zeros((len(coded.dictionary), k))
                ends = np.append(first[1:], len(row))
                for r, a, c in zip(row[first].tolist(), first.tolist(), ends.tolist(), strict=True):
                    y[r] = v[a:c] @ panel[j[a:c]]
                yield pa.RecordBatch.from_arrays([coded.dictionary, _vectors(y)], ["i", "y"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, np.zeros(0)
        for batch in batches:
            for i, y in zip(batch.column(0), batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, k), strict=True):
                if at is not None and i == at:
                    held = held + y
                    continue
                if at is not None:
                    yield pa.RecordBatch.from_arrays([pa.array([at.as_py()], batch.column(0).type), _vectors(held[None])], ["i", "y"])
                at, held = i, y
        if at is not None:
            yield pa.RecordBatch.from_arrays([pa.array([at.as_py()], at.type), _vectors(held[None])], ["i", "y"])

    sums = met.mapInArrow(products, f"i {kind}, y array<double>").repartition("i").sortWithinPartitions("i").mapInArrow(add, f"i {kind}, y array<double>")
    shares = z.b @ b
    factors = F.array(*[z.factor(f) for f in range(len(z.factors))]).cast("array<double>")
    full = z.rows.select("i", factors.alias("f")).join(sums, "i", "left")

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y = np.zeros((batch.num_rows, k))
            some = batch.column(2).is_valid().to_numpy(zero_copy_only=False)
            y[some] = batch.column(2).flatten().to_numpy(zero_copy_only=False).reshape(-1, k)
            if len(shares):
                y += batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1) @ shares
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(np.ascontiguousarray(c)) for c in y.T]], ["i", *names])

    return full.mapInArrow(spread, f"i {kind}" + "".join(f", `{n}` double" for n in names))


def _vectors(x: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(np.ascontiguousarray(x).ravel()))


def _operand(z: LowRank, b: np.ndarray) -> DataFrame:
    spark = z.entries.sparkSession
    columns = [pa.array(np.arange(z.ncols)), *[pa.array(np.ascontiguousarray(c)) for c in b.T]]
    table = spark.createDataFrame(pa.Table.from_arrays(columns, ["_j", *[f"_b{r}" for r in range(b.shape[1])]]))
    return F.broadcast(table) if b.size <= 1_000_000 else table


def rmatmat(z: LowRank, rows: DataFrame, us: Sequence[Column]) -> tuple[np.ndarray, np.ndarray]:
    """A^T U (columns x vectors) and the sums of the vectors. ``rows``: R with the vectors as ``us``."""
    k = len(us)
    totals = [F.sum(u) for u in us] + [F.sum(z.factor(f) * u) for f in range(len(z.factors)) for u in us]
    got = np.array(rows.agg(*[F.coalesce(t, F.lit(0.0)) for t in totals]).first(), float).reshape(-1, k)
    own = rows.select(F.col("i").alias("_i"), *[u.alias(f"_w{r}") for r, u in enumerate(us)])
    found = z.entries.join(own, F.col("i") == F.col("_i")).groupBy("j").agg(*[F.sum(F.col("v") * F.col(f"_w{r}")) for r in range(k)]).collect()
    out = z.b.T @ got[1:] if len(z.factors) else np.zeros((z.ncols, k))
    for row in found:
        out[row[0]] += row[1:]
    return out, got[0]


def _by_row(z: LowRank, rows: DataFrame, weight: Column) -> DataFrame:
    """(w, f, cells): each row's weight, its factors with a one before them, and its stored entries in one list, of p at most."""
    cells = z.entries.groupBy("i").agg(F.collect_list(F.struct("j", "v")).alias("cells"))
    joined = rows.select("i", weight.alias("w"), _factors(z).alias("f")).join(cells, "i", "left")
    return joined.select("w", "f", F.coalesce("cells", F.array().cast("array<struct<j:bigint,v:double>>")).alias("cells"))


def _factors(z: LowRank) -> Column:
    return F.array(F.lit(1.0), *[z.factor(f) for f in range(len(z.factors))])


def _row_blocks(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Weights, factors (rows x 1 + k), and row, column and value of the stored entries, for blocks of rows."""
    for whole in batches:
        for batch in (whole.slice(at, BLOCK_ROWS) for at in range(0, whole.num_rows, BLOCK_ROWS)):
            lists = batch.column(2)
            row, entry = np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy())), lists.flatten()
            factors = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, 1 + k)
            yield batch.column(0).to_numpy(zero_copy_only=False), factors, row, entry.field("j").to_numpy(zero_copy_only=False), entry.field("v").to_numpy(zero_copy_only=False)


def _sum_tree(x: np.ndarray) -> list[np.ndarray]:
    """Sums of 1, 2, 4, ... consecutive rows, aligned."""
    levels = [np.vstack((x, np.zeros(((1 << max(0, len(x) - 1).bit_length()) - len(x), x.shape[1]))))]
    while len(levels[-1]) > 1:
        levels.append(levels[-1][0::2] + levels[-1][1::2])
    return levels


def _range_sums(tree: Sequence[np.ndarray], low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Sums of rows low .. high - 1 for many ranges: two aligned pieces a level, and no difference of totals."""
    out, low, high = np.zeros((len(low), tree[0].shape[1])), low.copy(), high.copy()
    for level in tree:
        left = np.flatnonzero((low < high) & (low & 1 == 1))
        out[left] += level[low[left]]
        low[left] += 1
        right = np.flatnonzero((low < high) & (high & 1 == 1))
        high[right] -= 1
        out[right] += level[high[right]]
        low, high = low >> 1, high >> 1
    return out


def _gaps(group: np.ndarray, at: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ranges between the places ``at`` of each group (both sorted), before the first and behind the last: group number of each, and its bounds."""
    first = np.flatnonzero(np.diff(group, prepend=group[:1] - 1))
    last = np.append(first[1:], len(group)) - 1
    number = np.zeros(len(group), np.int64)
    number[first[1:]] = 1
    number = np.cumsum(number)
    low, high = np.zeros(len(group), np.int64), at
    inner = np.ones(len(group), bool)
    inner[first] = False
    low[inner] = at[:-1][inner[1:]] + 1
    return np.concatenate((number, np.arange(len(first)))), np.concatenate((low, at[last] + 1)), np.concatenate((high, np.full(len(first), size)))


def _background(sums: np.ndarray, b: np.ndarray) -> np.ndarray:
    """What sums of weighted factors (ranges x k) add to columns with backgrounds ``b`` (k x ranges)."""
    return (sums.T * b).sum(0)


#: Rows that a task takes together in ``weighted_sums``.
SUM_ROWS = 1 << 14


def weighted_sums(z: LowRank, rows: DataFrame, weight: Column) -> np.ndarray:
    """Sums of w_i [1, A]_ij over rows, with work in proportion to what is stored.

    A stored entry is normalized before it is weighted. The rows that a column
    has no entry in are ranges between those it has: their weighted factors come from
    a tree of sums, within blocks of rows, and then over the blocks in which the
    column has none. No difference of totals is taken, so weights that cancel do
    no harm; rows with weights that are not finite are added entry by entry.
    """
    p, k, b = z.ncols, len(z.factors), z.b
    names = [f"_g{f}" for f in range(1 + k)]
    blocks = max(1, -(-rows.count() // SUM_ROWS))
    block = F.pmod(F.xxhash64("i"), F.lit(blocks)).cast("int")
    own = rows.select("i", block.alias("block"), weight.alias("w"), _factors(z).alias("f"))
    even = ~F.exists(F.transform("f", lambda f: f * F.col("w")), lambda x: F.isnan(x) | (F.abs(x) == F.lit(np.inf)))
    parts = own.groupBy("block").agg(F.count_if(~even).alias("odd"), *[F.coalesce(F.sum(F.when(even, F.col("f")[f] * F.col("w"))), F.lit(0.0)).alias(n) for f, n in enumerate(names)]).collect()
    totals = np.zeros((blocks, 1 + k))
    for r in parts:
        totals[r["block"]] = r[2:]
    out = np.zeros(p + 1)
    if any(r["odd"] for r in parts):
        out += _weighted_rows(z, rows.filter(_odd(z, weight)), weight)
    whole = _sum_tree(totals)
    out[0] += whole[-1][0, 0]
    rest = own.filter(even)
    if not k:  # zeros stay zeros
        met = z.entries.join(rest.select(F.col("i").alias("_i"), "w"), F.col("i") == F.col("_i"))
        found = met.groupBy("j").agg(F.sum(F.col("v") * F.col("w")).alias("s"))
    else:
        stored = z.entries.select("i", "j", "v", block.alias("block"))
        sums = rest.groupBy("block").cogroup(stored.groupBy("block")).applyInArrow(_block_sums(b, k), "j bigint, block int, s double")
        listed = sums.groupBy("j").agg(F.sum("s").alias("s"), F.sort_array(F.collect_list("block")).alias("blocks"))
        found = listed.mapInArrow(_other_blocks(whole, blocks, b), "j bigint, s double")
    here = np.zeros(p, bool)
    for j, s in found.collect():  # one number a column
        here[j] = True
        out[1 + j] += s
    if k:
        out[1:][~here] += _background(np.broadcast_to(whole[-1][0, 1:], (int((~here).sum()), k)), b[:, ~here])
    return out


def _odd(z: LowRank, weight: Column) -> Column:
    return F.exists(F.transform(_factors(z), lambda f: f * weight), lambda x: F.isnan(x) | (F.abs(x) == F.lit(np.inf)))


def _block_sums(b: np.ndarray, k: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """For a block of rows and its stored entries: each stored column's sum over all rows of the block."""

    def add(rows: pa.Table, stored: pa.Table) -> pa.Table:
        place = pc.index_in(stored.column("i"), rows.column("i").combine_chunks())
        some = pc.is_valid(place)
        stored, at = stored.filter(some), place.filter(some).to_numpy().astype(np.int64)
        if not len(at):
            return pa.table([pa.array([], pa.int64()), pa.array([], pa.int32()), pa.array([], pa.float64())], ["j", "block", "s"])
        j, v = (stored.column(c).to_numpy() for c in ("j", "v"))
        order = np.lexsort((at, j))
        j, v, at = j[order], v[order], at[order]
        w = rows.column("w").to_numpy()
        f = rows.column("f").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(w), 1 + k)[:, 1:]
        first = np.flatnonzero(np.diff(j, prepend=j[:1] - 1))
        s = np.add.reduceat(w[at] * (v + (f[at] * b[:, j].T).sum(1)), first)
        number, low, high = _gaps(j, at, len(w))
        missing = _background(_range_sums(_sum_tree(w[:, None] * f), low, high), b[:, j[first][number]])
        s += np.bincount(number, missing, minlength=len(first))
        return pa.table([pa.array(j[first]), pa.array(np.full(len(first), rows.column("block")[0].as_py(), np.int32)), pa.array(s)], ["j", "block", "s"])

    return add


def _other_blocks(whole: Sequence[np.ndarray], blocks: int, b: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Adds to each column's sum what the blocks give in which it has no entry; ``whole``: the tree of the blocks' totals."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for large in batches:
            for batch in (large.slice(at, BLOCK_ROWS) for at in range(0, large.num_rows, BLOCK_ROWS)):
                j, s, lists = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2)
                group = np.repeat(np.arange(len(j)), np.diff(lists.offsets.to_numpy()))  # no list is empty
                number, low, high = _gaps(group, lists.flatten().to_numpy().astype(np.int64), blocks)
                missing = _background(_range_sums(whole, low, high)[:, 1:], b[:, j[number]])
                with np.errstate(invalid="ignore"):
                    s = s + np.bincount(number, missing, minlength=len(j))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s)], ["j", "s"])

    return add


def _weighted_rows(z: LowRank, rows: DataFrame, weight: Column) -> np.ndarray:
    """The same sums over rows taken entry by entry."""
    p, k, b = z.ncols, len(z.factors), z.b

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        acc = np.zeros(p + 1)
        for w, factors, row, j, v in _row_blocks(batches, k):
            ends = np.searchsorted(row, np.arange(len(w) + 1))
            with np.errstate(invalid="ignore"):
                for r in range(len(w)):
                    entries = factors[r, 1:] @ b if k else np.zeros(p)
                    entries[j[ends[r] : ends[r + 1]]] += v[ends[r] : ends[r + 1]]
                    acc[0] += w[r]
                    acc[1:] += w[r] * entries
        yield pa.RecordBatch.from_arrays([pa.array(range(p + 1), pa.int64()), pa.array(acc)], ["j", "v"])

    out = np.zeros(p + 1)
    for r in _by_row(z, rows, weight).mapInArrow(partial, "j bigint, v double").groupBy("j").agg(F.sum("v")).collect():
        out[r[0]] = r[1]
    return out


#: Columns of a tile, the share of stored entries that makes a block's tile dense, dense results a task holds, and pairs it makes at once.
TILE, DENSE, MOST_TILES, MOST_PAIRS = 512, 1 / 16, 16, 2_000_000


@dataclass(frozen=True)
class GramParts:
    """The weighted Gram matrix of [1, A], A = D + R B, in parts: ``pairs`` (j, k, g) with j <= k of D, as stored pairs make them, from
    ``cells``, the stored entries of each row; ``cross``: of [1, R] and D; ``own``: of [1, R] alone; ``back``: B."""

    pairs: DataFrame
    cells: DataFrame
    cross: np.ndarray
    own: np.ndarray
    back: np.ndarray

    def rest(self, j: int, k: int) -> float:
        """What the background adds to the entry of columns j and k of A."""
        c, b = self.cross[1:], self.back
        return float(b[:, j] @ c[:, k] + c[:, j] @ b[:, k] + b[:, j] @ self.own[1:, 1:] @ b[:, k])

    def dense(self) -> np.ndarray:
        """The whole matrix on the driver, both triangles; index 0 is the intercept."""
        p = self.cross.shape[1]
        out = np.zeros((p + 1, p + 1))
        got = self.pairs.toArrow()
        j, k, g = (got.column(n).to_numpy() for n in ("j", "k", "g"))
        out[1 + j, 1 + k] = out[1 + k, 1 + j] = g
        if len(self.back):
            mixed = self.back.T @ self.cross[1:]
            out[1:, 1:] += mixed + mixed.T + self.back.T @ self.own[1:, 1:] @ self.back
        out[0, 0] = self.own[0, 0]
        out[0, 1:] = out[1:, 0] = self.cross[0] + self.own[0, 1:] @ self.back
        return np.triu(out) + np.triu(out, 1).T

    def table(self) -> DataFrame:
        """(j, k, g): all entries of A^T diag(w) A, both triangles, without the intercept, as a table.

        The result is cut into square tiles, and tasks fill those on and above the
        diagonal: a tile's entries are written at their own places and mirrored.
        Pairs are added up where they are made and sent to their tile once, 12
        bytes each. A task holds one tile, the driver vectors of p numbers.
        """
        cross, back = self.cross[1:], self.back
        p = self.cross.shape[1]
        one, other = np.vstack((back, cross, self.own[1:, 1:] @ back)), np.vstack((cross, back, back))  # the background: one^T other
        side = min(SIDE, max(LEAST_SIDE, -(-p // 16)))
        across = -(-p // side)

        def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            return _by_tile(_products(batches, p), side, across)

        def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            at, held = -1, np.zeros((0, 0))
            for batch in batches:
                place, g = batch.column(1), batch.column(2)
                cut = place.offsets.to_numpy()
                where, what = place.values.to_numpy(), g.values.to_numpy()
                for t, a, b in zip(batch.column(0).to_numpy().tolist(), cut[:-1].tolist(), cut[1:].tolist(), strict=True):
                    if t != at:
                        if at >= 0:
                            yield from finished(at, held)
                        at, held = t, np.zeros((side, side))
                    held.reshape(-1)[where[a:b]] += what[a:b]  # a list has a place once
            if at >= 0:
                yield from finished(at, held)

        def finished(tile: int, g: np.ndarray) -> Iterator[pa.RecordBatch]:
            top, left = (side * c for c in divmod(tile, across))
            g = g[: p - top, : p - left]
            right = slice(left, left + g.shape[1])
            step = max(1, BATCH_ENTRIES // side)
            for a in range(0, len(g), step):
                with np.errstate(invalid="ignore", over="ignore"):
                    g[a : a + step] += one[:, top + a : top + min(a + step, len(g))].T @ other[:, right]
            if top == left:  # both triangles are equal to the last bit
                for r in range(len(g)):
                    g[r + 1 :, r] = g[r, r + 1 :]
            yield from _lines(top, left, g, step)
            if top != left:
                yield from _lines(left, top, g.T, step)

        spark = self.pairs.sparkSession
        marks = spark.range(across * across).select(F.col("id").alias("tile"), F.array().cast("array<int>").alias("place"), F.array().cast("array<double>").alias("g"))
        every = marks.filter(F.floor(F.col("tile") / F.lit(max(across, 1))) <= F.col("tile") % F.lit(max(across, 1)))
        parts = max(spark.sparkContext.defaultParallelism, -(-p * p // TABLE_ENTRIES))
        dealt = self.cells.mapInArrow(sent, "tile bigint, place array<int>, g array<double>").unionByName(every).repartition(parts, "tile").sortWithinPartitions("tile")
        lines = dealt.mapInArrow(fill, "j bigint, start bigint, g array<double>")
        return lines.select("j", "start", F.posexplode("g").alias("n", "g")).select("j", (F.col("start") + F.col("n")).alias("k"), "g")


#: Most and, for few columns, least rows of a tile of a Gram matrix as a table; entries that a task writes, and that one of its batches holds.
SIDE, LEAST_SIDE, TABLE_ENTRIES, BATCH_ENTRIES = 2048, 64, 1 << 24, 1 << 16
#: Pairs that a task adds up before it sends them, and the most in one list.
HELD_PAIRS, LIST_PAIRS = 1 << 21, 1 << 10


def _lines(top: int, left: int, g: np.ndarray, step: int) -> Iterator[pa.RecordBatch]:
    """A tile's rows, each with its number, that of its first column, and its entries in one list."""
    for a in range(0, len(g), step):
        piece = np.ascontiguousarray(g[a : a + step])
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(piece) + 1) * piece.shape[1], pa.int32()), pa.array(piece.reshape(-1)))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(top + a, top + a + len(piece))), pa.array(np.full(len(piece), left)), lists], ["j", "start", "g"])


def _by_tile(products: Iterator[pa.RecordBatch], side: int, across: int) -> Iterator[pa.RecordBatch]:
    """Products added up by place, in lists: the tile, places in it and sums."""
    size = side * side
    places, sums, many = [], [], 0

    def added() -> tuple[np.ndarray, np.ndarray]:
        if not places:
            return np.zeros(0, np.int64), np.zeros(0)
        place, g = np.concatenate(places), np.concatenate(sums)
        by = np.argsort(place, kind="stable")
        place = place[by]
        first = np.flatnonzero(np.diff(place, prepend=-1))
        with np.errstate(invalid="ignore", over="ignore"):
            return place[first], np.add.reduceat(g[by], first) if len(first) else g

    def lists(place: np.ndarray, g: np.ndarray) -> Iterator[pa.RecordBatch]:
        tile = place // size
        first = np.flatnonzero(np.diff(tile, prepend=-1))
        count = np.diff(np.append(first, len(tile)))
        pieces = -(-count // LIST_PAIRS)
        number = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        start = np.repeat(first, pieces) + number * LIST_PAIRS
        offsets = pa.array(np.append(start, len(tile)), pa.int32())
        yield pa.RecordBatch.from_arrays([pa.array(tile[start]), pa.ListArray.from_arrays(offsets, pa.array((place % size).astype(np.int32))), pa.ListArray.from_arrays(offsets, pa.array(g))], ["tile", "place", "g"])

    for batch in products:
        j, k, g = (batch.column(c).to_numpy() for c in range(3))
        places.append((j // side * across + k // side) * size + j % side * side + k % side)
        sums.append(g)
        many += len(g)
        if many >= HELD_PAIRS:
            place, g = added()
            places, sums, many = [place], [g], len(g)
            if many > HELD_PAIRS // 2:  # few of them meet: they are sent
                yield from lists(place, g)
                places, sums, many = [], [], 0
    if many:
        yield from lists(*added())


def gram_parts(z: LowRank, rows: DataFrame, weight: Column) -> GramParts:
    """Pairs of stored entries of a row meet by tiles of columns. Nothing of size p x p is in a task or on the driver."""
    p, k = z.ncols, len(z.factors)
    f = [F.lit(1.0), *[z.factor(a) for a in range(k)]]
    own = np.array(rows.agg(*[F.coalesce(F.sum(a * weight * c), F.lit(0.0)) for a in f for c in f]).first(), float).reshape(1 + k, 1 + k)
    known = rows.select(F.col("i").alias("_i"), weight.alias("w"), *[(a * weight).alias(f"_g{n}") for n, a in enumerate(f)])
    met = z.entries.join(known, F.col("i") == F.col("_i"))
    cross = np.zeros((1 + k, p))
    for r in met.groupBy("j").agg(*[F.sum(F.col("v") * F.col(f"_g{n}")) for n in range(1 + k)]).collect():
        cross[:, r[0]] = r[1:]
    cells = met.groupBy("i").agg(F.first("w").alias("w"), F.array(F.lit(1.0)).alias("f"), F.collect_list(F.struct("j", "v")).alias("cells")).select("w", "f", "cells")

    products = cells.mapInArrow(lambda batches: _products(batches, p), "j bigint, k bigint, g double")
    return GramParts(products.groupBy("j", "k").agg(F.sum("g").alias("g")), cells, cross, own, z.b)


def _products(batches: Iterator[pa.RecordBatch], p: int) -> Iterator[pa.RecordBatch]:
    """Products of the stored pairs of rows, a place more than once."""
    tiles: dict[tuple[int, int], np.ndarray] = {}
    for w, _, row, j, v in _row_blocks(batches, 0):
        yield from _pair_products(w, row, j, v, p, tiles)
        if len(tiles) > MOST_TILES:
            yield from _tile_rows(tiles)
    yield from _tile_rows(tiles)


def _tile_rows(tiles: dict[tuple[int, int], np.ndarray]) -> Iterator[pa.RecordBatch]:
    """The dense results a task holds, as rows; it starts anew."""
    for (a, c), g in tiles.items():
        j, k = np.nonzero(np.triu(g != 0) if a == c else g != 0)
        yield pa.RecordBatch.from_arrays([pa.array(j + a * TILE), pa.array(k + c * TILE), pa.array(g[j, k])], ["j", "k", "g"])
    tiles.clear()


def _pair_products(w: np.ndarray, row: np.ndarray, j: np.ndarray, v: np.ndarray, p: int, tiles: dict[tuple[int, int], np.ndarray]) -> Iterator[pa.RecordBatch]:
    """Products of one block of rows: tiles that are dense in it are multiplied as matrices into ``tiles``; other pairs are listed and added up by place."""
    tile = j // TILE
    number, count = np.unique(tile, return_counts=True)
    full = number[count >= DENSE * len(w) * np.minimum(TILE, p - number * TILE)]
    thick = np.isin(tile, full)
    blocks = {}
    for t in full.tolist():
        mine = tile == t
        blocks[t] = np.zeros((len(w), min(TILE, p - t * TILE)))
        blocks[t][row[mine], j[mine] - t * TILE] = v[mine]
    with np.errstate(invalid="ignore", over="ignore"):
        for n, a in enumerate(full.tolist()):
            for c in full.tolist()[n:]:
                if len(tiles) > MOST_TILES and (a, c) not in tiles:
                    yield from _tile_rows(tiles)
                g = blocks[a].T @ (w[:, None] * blocks[c])
                tiles[a, c] = tiles[a, c] + g if (a, c) in tiles else g
    order = np.lexsort((thick, row))  # a row's thin entries first: each meets itself and what follows
    row, j, v, thin = row[order], j[order], v[order], np.flatnonzero(~thick[order])
    end = np.searchsorted(row, row[thin], side="right")
    upto = np.cumsum(end - thin)
    start = 0
    while start < len(thin):
        stop = max(start + 1, int(np.searchsorted(upto, (upto[start - 1] if start else 0) + MOST_PAIRS, side="right")))
        one, many = thin[start:stop], end[start:stop] - thin[start:stop]
        first = np.repeat(one, many)
        second = first + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        low, high = np.minimum(j[first], j[second]), np.maximum(j[first], j[second])
        with np.errstate(invalid="ignore", over="ignore"):
            g = v[first] * w[row[first]] * v[second]
        by = np.lexsort((high, low))
        low, high = low[by], high[by]
        cut = np.flatnonzero((np.diff(low, prepend=-1) != 0) | (np.diff(high, prepend=-1) != 0))
        yield pa.RecordBatch.from_arrays([pa.array(low[cut]), pa.array(high[cut]), pa.array(np.add.reduceat(g[by], cut))], ["j", "k", "g"])
        start = stop


def column(z: LowRank, j: int, name: str) -> DataFrame:
    """Key and column j: a background value for each row, and what is stored added to it."""
    stored = z.entries.filter(F.col("j") == j).select(F.col("i").alias("_i"), "v")
    y = F.coalesce("v", F.lit(0.0))
    for f in range(len(z.factors)):
        y = y + z.factor(f) * F.lit(float(z.b[f, j]))
    return z.rows.join(stored, F.col("i") == F.col("_i"), "left").select("i", y.alias(name))


def corrections(z: LowRank, j: int) -> tuple[float | DataFrame, DataFrame]:
    """The value of a raw zero in column j (a number, or a table of key and value if it differs by row), and what stored entries add to it."""
    stored = z.entries.filter(F.col("j") == j).select("i", F.col("v").alias("value"))
    if all(f is None for f in z.factors):
        return float(z.b[:, j].sum()) + 0.0, stored
    y = F.lit(0.0)
    for f in range(len(z.factors)):
        y = y + z.factor(f) * F.lit(float(z.b[f, j]))
    return z.rows.select("i", y.alias("value")), stored


def row_corrections(z: LowRank, key: Any) -> tuple[np.ndarray, DataFrame]:
    """The values of a row of raw zeros, and what its stored entries add to them."""
    own = z.rows.filter(F.col("i") == F.lit(key)).select(*[z.factor(f).alias(f"f{f}") for f in range(len(z.factors))], F.lit(1.0).alias("there")).first()
    if own is None:
        raise IndexError("the row is not there")
    return np.array(own[:-1], float) @ z.b if z.factors else np.zeros(z.ncols), z.entries.filter(F.col("i") == F.lit(key)).select("j", F.col("v").alias("value"))
