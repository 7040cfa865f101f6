"""Driver queries over the sample tables, one or more for each group of operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    Array, Chain, ChunkedMatrix, ColumnNormalization, ColumnParams, ColumnStatistics, Coo, NormalizedFrame, NormalizedLinear, RowNormalization, RowParams, Wide, normalize, read_chunks, read_zarr,
    standardize, take_rows, write_chunks, write_zarr,
)
from .functions.numeric import normal_range
from .operators import solvers, weighted
from .operators.frame import InMemory
from .sources.storage import shared_path
from .streaming.frozen import score_stream

Query = Callable[[SparkSession, str], DataFrame]
LINE = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
PART = ["p_size", "p_retailprice"]
V4 = [1.0, -2.0, 0.5, 3.0]
B4 = [[1.0, 0.5], [-2.0, 1.0], [0.5, -1.0], [3.0, 2.0]]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return register


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def lines(spark: SparkSession, sf: str) -> Wide:
    """lineitem has no unique key: the order key names rows, and results are aggregates or multisets."""
    return Wide(table(spark, sf, "lineitem"), "l_orderkey", LINE)


def parts(spark: SparkSession, sf: str) -> Wide:
    return Wide(table(spark, sf, "part"), "p_partkey", PART)


def vectors(spark: SparkSession, sf: str) -> Array:
    return Array(table(spark, sf, "embeddings"), "vec_id", "embedding", 64)


#: Orders whose lines one task adds up.
ORDERS = 1 << 17


def cells(spark: SparkSession, sf: str) -> Coo:
    """Orders x suppliers: quantities; supplier keys count from 0.

    Lines are dealt by order, for few of them repeat: sums and joins by order need
    no other shuffle, and tasks are of one size however many orders there are.
    Column sums read the lines as they are listed.
    """
    orders = table(spark, sf, "orders").select(F.col("o_orderkey").alias("i"))
    p = table(spark, sf, "supplier").agg(F.max("s_suppkey")).first()[0] + 1
    entries = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("i"), F.col("l_suppkey").alias("j"), F.col("l_quantity").alias("v"))
    n = orders.count()
    return Coo(entries.repartition(max(spark.sparkContext.defaultParallelism, -(-n // ORDERS)), "i"), n, p, rows=orders, listed=entries)


def out(spark: SparkSession, digits: int, name: str = "value", **vectors: object) -> DataFrame:
    """Short vectors as rows: j and one rounded column for each."""
    arrays = {k: np.asarray(v, float) for k, v in vectors.items()}
    size = len(next(iter(arrays.values())))
    rows = [(j, *(float(a[j]) for a in arrays.values())) for j in range(size)]
    df = spark.createDataFrame(rows, "j bigint" + "".join(f", {k} double" for k in arrays))
    return df.select("j", *[rnd(F.col(k), digits).alias(k) for k in arrays])


def square(spark: SparkSession, digits: int, g: np.ndarray) -> DataFrame:
    rows = [(j, k, float(g[j, k])) for j in range(len(g)) for k in range(len(g))]
    return spark.createDataFrame(rows, "j bigint, k bigint, g double").select("j", "k", rnd(F.col("g"), digits).alias("g"))


def rnd(x: Column, digits: int) -> Column:
    return F.round(x, digits) + F.lit(0.0)


def rnd_many(x: Column, digits: int) -> Column:
    """``rnd`` for billions of values: decimal numbers are made only of those near a tie or too large to tell, others take three operations on doubles."""
    up = x * F.lit(10.0**digits)
    whole = F.rint(up)
    plain = (F.abs(up) < F.lit(2.0**43)) & (F.abs(F.abs(up - whole) - F.lit(0.5)) > F.lit(2.0**-6))
    return F.when(plain, whole / F.lit(10.0**digits)).otherwise(F.round(x, digits)) + F.lit(0.0)


def rounded(df: DataFrame, digits: int, *keys: str) -> DataFrame:
    return df.select(*[F.col(k).cast("bigint") for k in keys], *[rnd(F.col(c), digits).alias(c) for c in df.columns if c not in keys])


# SQL pieces


def union(items: list[str]) -> str:
    return " UNION ALL ".join(items)


def per_column(expr: str, source: str, columns: list[str], digits: int, name: str = "value") -> str:
    """One row for each column: ``expr`` with {c}, {m} and {lo} for the column, its mean and its minimum."""
    means = ", ".join(f"avg({c}) AS m_{c}, min({c}) AS lo_{c}" for c in columns)
    rows = [f"SELECT CAST({k} AS BIGINT) AS j, round({expr.format(c=c, m=f'm_{c}', lo=f'lo_{c}')}, {digits}) + 0.0 AS {name} FROM {source}, p" for k, c in enumerate(columns)]
    return f"WITH p AS (SELECT {means} FROM {source}) " + union(rows)


def stage_sql(columns: list[str], source: str, key: str, center: str | None, scale: str | None) -> str:
    """CTEs p (parameters) and z (normalized columns) for a column recipe; {c} is the column, {m} its mean, {k} its center."""
    aggs = {"mean": "avg({c})", "min": "min({c})", "median": "quantile_cont({c}, 0.5)", None: "0.0"}
    first = ", ".join(f"avg({c}) AS m_{c}, {aggs[center].format(c=c)} AS k_{c}" for c in columns)
    second = ", ".join(f"k_{c}, {(scale or '1.0').format(c=c, m=f'm_{c}', k=f'k_{c}')} AS s0_{c}" for c in columns)
    groups = ", ".join(f"k_{c}" for c in columns)
    z = ", ".join(f"({c} - k_{c}) / (CASE WHEN s0_{c} = 0 THEN 1 ELSE s0_{c} END) AS z_{c}" for c in columns)
    return f"WITH c AS (SELECT {first} FROM {source}), p AS (SELECT {second} FROM {source}, c GROUP BY {groups}), z AS (SELECT {key}, {', '.join(columns)}, {z} FROM {source}, p)"


SD = "stddev_pop({c} - {m})"
Z_LINE = stage_sql(LINE, "lineitem", "l_orderkey", "mean", SD)
Z_PART = stage_sql(PART, "part", "p_partkey", "mean", SD)

# Column statistics (ST-01 .. ST-16, ST-20)

_STATISTICS = {
    "mean": (lambda s: s.means(), "avg({c})", 6),
    "sd": (lambda s: s.sds(), "stddev_pop({c} - {lo})", 6),
    "sd_sample": (lambda s: s.sds(1), "stddev_samp({c} - {lo})", 6),
    "min": (lambda s: s.mins(), "min({c})", 6),
    "range": (lambda s: s.ranges(), "max({c}) - min({c})", 6),
    "maxabs": (lambda s: s.maxabs(), "max(abs({c}))", 6),
    "l1": (lambda s: s.l1(), "sum(abs({c}))", 2),
    "l2": (lambda s: s.l2(), "sqrt(sum({c} * {c}))", 4),
    "l1_centered": (lambda s: s.l1(s.means()), "sum(abs({c} - {m}))", 2),
    "l2_centered": (lambda s: s.l2(s.means()), "sqrt(sum(({c} - {m}) * ({c} - {m})))", 4),
    "maxabs_centered": (lambda s: s.maxabs(s.means()), "max(abs({c} - {m}))", 6),
    "median": (lambda s: s.medians(), "quantile_cont({c}, 0.5)", 6),
    "iqr": (lambda s: s.quantile_ranges(), "quantile_cont({c} - {lo}, 0.75) - quantile_cont({c} - {lo}, 0.25)", 6),
    "iqr_unit_variance": (lambda s: s.quantile_ranges(unit_variance=True), "(quantile_cont({c} - {lo}, 0.75) - quantile_cont({c} - {lo}, 0.25)) / 1.3489795003921634", 6),
    "decile_range": (lambda s: s.quantile_ranges((0.1, 0.9)), "quantile_cont({c} - {lo}, 0.9) - quantile_cont({c} - {lo}, 0.1)", 6),
}
for _name, (_f, _expr, _digits) in _STATISTICS.items():
    query(f"col_stats_{_name}", per_column(_expr, "lineitem", LINE, _digits))(
        lambda spark, sf, f=_f, d=_digits: out(spark, d, value=f(ColumnStatistics(lines(spark, sf))))
    )
    _in_array = {"{c}": "v", "{m}": "m", "{lo}": "lo"}
    _e = _expr
    for _a, _b in _in_array.items():
        _e = _e.replace(_a, _b)
    query(
        f"array_col_stats_{_name}",
        "WITH e AS (SELECT unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) - 1 AS j FROM embeddings), p AS (SELECT j, avg(v) AS m, min(v) AS lo FROM e GROUP BY j) "
        f"SELECT CAST(e.j AS BIGINT) AS j, round({_e}, 6) + 0.0 AS value FROM e JOIN p ON e.j = p.j GROUP BY e.j",
    )(lambda spark, sf, f=_f: out(spark, 6, value=f(ColumnStatistics(vectors(spark, sf)))))

_COO = (
    "WITH m AS (SELECT o_orderkey AS i, s_suppkey AS j, coalesce(v, 0.0) AS v FROM orders CROSS JOIN supplier "
    "LEFT JOIN (SELECT l_orderkey, l_suppkey, sum(l_quantity) AS v FROM lineitem GROUP BY ALL) ON o_orderkey = l_orderkey AND s_suppkey = l_suppkey), "
    "p AS (SELECT j, avg(v) AS m, min(v) AS lo, stddev_pop(v) AS s FROM m GROUP BY j) "
)
for _name in ("mean", "sd", "min", "range", "maxabs", "l1", "l2", "l1_centered", "l2_centered", "maxabs_centered", "median", "decile_range"):
    _f, _expr, _ = _STATISTICS[_name]
    _e = _expr.replace("{c}", "v").replace("{m}", "p.m").replace("{lo}", "p.lo")
    query(f"coo_stats_{_name}", _COO + f"SELECT CAST(m.j AS BIGINT) AS j, round({_e}, 5) + 0.0 AS value FROM m JOIN p ON m.j = p.j GROUP BY m.j")(
        lambda spark, sf, f=_f: out(spark, 5, value=f(ColumnStatistics(cells(spark, sf))))
    )

# Recipes, eager output (NR-*, SK-*)

_RECIPES = {
    "standardize": (ColumnNormalization.standardize(), "mean", SD),
    "standardize_sample": (ColumnNormalization.standardize(1), "mean", "stddev_samp({c} - {m})"),
    "minmax": (ColumnNormalization.min_max(), "min", "max({c}) - min({c})"),
    "robust": (ColumnNormalization.robust(), "median", "quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)"),
    "robust_unit_variance": (ColumnNormalization.robust((0.1, 0.9), True), "median", f"(quantile_cont({{c}}, 0.9) - quantile_cont({{c}}, 0.1)) / {normal_range(0.1, 0.9)!r}"),
    "l1": (ColumnNormalization("none", "l1"), None, "sum(abs({c}))"),
    "l2_centered": (ColumnNormalization("mean", "l2"), "mean", "sqrt(sum(({c} - {k}) * ({c} - {k})))"),
    "maxabs_centered": (ColumnNormalization("median", "maxabs"), "median", "max(abs({c} - {k}))"),
    "center_only": (ColumnNormalization("mean", "none"), "mean", None),
    "scale_only": (ColumnNormalization("none", "sd"), None, SD),
}
for _name, (_recipe, _center, _scale) in _RECIPES.items():
    query(
        f"{_name}_wide",
        stage_sql(PART, "part", "p_partkey", _center, _scale) + " SELECT CAST(p_partkey AS BIGINT) AS p_partkey, " + ", ".join(f"round(z_{c}, 8) + 0.0 AS {c}" for c in PART) + " FROM z",
    )(lambda spark, sf, r=_recipe: rounded(r.fit_apply(parts(spark, sf)).to_eager(), 8, "p_partkey"))


@query(
    "standardize_customer",
    stage_sql(["c_acctbal"], "customer", "c_custkey", "mean", SD) + " SELECT CAST(c_custkey AS BIGINT) AS c_custkey, round(z_c_acctbal, 8) + 0.0 AS c_acctbal FROM z",
)
def standardize_customer(spark: SparkSession, sf: str) -> DataFrame:
    m = Wide(table(spark, sf, "customer"), "c_custkey", ["c_acctbal"])
    return rounded(ColumnNormalization().fit_apply(m).to_eager(), 8, "c_custkey")


@query("frozen_params_new_data", stage_sql(PART, "(SELECT * FROM part WHERE p_partkey % 2 = 0)", "p_partkey", "min", "max({c}) - min({c})").split(", z AS")[0]
       + " SELECT CAST(p_partkey AS BIGINT) AS p_partkey, " + ", ".join(f"round(({c} - k_{c}) / s0_{c}, 8) + 0.0 AS {c}" for c in PART) + " FROM part, p WHERE p_partkey % 2 = 1")
def frozen_params_new_data(spark: SparkSession, sf: str) -> DataFrame:
    m = parts(spark, sf)
    fitted = ColumnNormalization.min_max().fit(m.where(F.col("p_partkey") % 2 == 0))
    return rounded(fitted.transform(m.where(F.col("p_partkey") % 2 == 1)).to_eager(), 8, "p_partkey")


# Products (PR-*)

_DOT = " + ".join(f"z_{c} * ({v})" for c, v in zip(LINE, V4, strict=True))


@query("matvec_wide", Z_LINE + f" SELECT CAST(l_orderkey AS BIGINT) AS l_orderkey, round({_DOT}, 6) + 0.0 AS value FROM z")
def matvec_wide(spark: SparkSession, sf: str) -> DataFrame:
    """The flagship: standardized lineitem scores."""
    return rounded(ColumnNormalization().fit_apply(lines(spark, sf)).matvec(V4), 6, "l_orderkey")


@query("matmat_wide", Z_LINE + " SELECT CAST(l_orderkey AS BIGINT) AS l_orderkey, "
       + ", ".join("round(" + " + ".join(f"z_{c} * ({b[r]})" for c, b in zip(LINE, B4, strict=True)) + f", 6) + 0.0 AS y{r}" for r in (0, 1)) + " FROM z")
def matmat_wide(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(ColumnNormalization().fit_apply(lines(spark, sf)).matmat(B4), 6, "l_orderkey")


@query("fused_matvec", Z_PART + " SELECT CAST(p_partkey AS BIGINT) AS p_partkey, round(2 * (z_p_size - 2 * z_p_retailprice) + 0.5 * (p_partkey % 7), 6) + 0.0 AS value FROM z")
def fused_matvec(spark: SparkSession, sf: str) -> DataFrame:
    m = parts(spark, sf)
    old = m.df.select("p_partkey", (F.col("p_partkey") % 7).cast("double").alias("old"))
    return rounded(ColumnNormalization().fit_apply(m).matvec_scaled([1.0, -2.0], 2.0, old, 0.5), 6, "p_partkey")


@query("intercept_matvec", Z_PART + " SELECT CAST(p_partkey AS BIGINT) AS p_partkey, round(4 + z_p_size - 2 * z_p_retailprice, 6) + 0.0 AS value FROM z")
def intercept_matvec(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(ColumnNormalization().fit_apply(parts(spark, sf)).with_intercept().matvec([4.0, 1.0, -2.0]), 6, "p_partkey")


_PU = "CAST(p_partkey % 7 - 3 AS DOUBLE)"


@query("rmatvec_wide", Z_PART + " " + union([f"SELECT CAST({k} AS BIGINT) AS j, round(sum(z_{c} * {_PU}), 5) + 0.0 AS value FROM z" for k, c in enumerate(PART)]))
def rmatvec_wide(spark: SparkSession, sf: str) -> DataFrame:
    m = parts(spark, sf)
    u = m.df.select("p_partkey", (F.col("p_partkey") % 7 - 3).cast("double").alias("u"))
    return out(spark, 5, value=ColumnNormalization().fit_apply(m).T @ u)


@query("rmatmat_wide", Z_PART + " " + union([f"SELECT CAST({k} AS BIGINT) AS j, round(sum(z_{c} * {_PU}), 5) + 0.0 AS y0, round(sum(z_{c} * p_partkey), 2) + 0.0 AS y1 FROM z" for k, c in enumerate(PART)]))
def rmatmat_wide(spark: SparkSession, sf: str) -> DataFrame:
    z = ColumnNormalization().fit_apply(parts(spark, sf))
    got = z.rmatmat([F.col("p_partkey") % 7 - 3, "p_partkey"])
    first, second = out(spark, 5, y0=got[:, 0]), out(spark, 2, y1=got[:, 1])
    return first.join(second, "j")


@query("fused_rmatvec", Z_PART + " " + union([f"SELECT CAST({k} AS BIGINT) AS j, round(2 * sum(z_{c} * {_PU}) - {k + 1}, 5) + 0.0 AS value FROM z" for k, c in enumerate(PART)]))
def fused_rmatvec(spark: SparkSession, sf: str) -> DataFrame:
    z = ColumnNormalization().fit_apply(parts(spark, sf))
    return out(spark, 5, value=z.rmatvec_scaled(F.col("p_partkey") % 7 - 3, 2.0, [1.0, 2.0], -1.0))


@query("array_matvec", "WITH e AS (SELECT vec_id, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) - 1 AS j FROM embeddings), p AS (SELECT j, avg(v) AS m, stddev_pop(v) AS s FROM e GROUP BY j) "
       "SELECT CAST(vec_id AS BIGINT) AS vec_id, round(sum((v - m) / s * (e.j % 5 - 2)), 6) + 0.0 AS value FROM e JOIN p ON e.j = p.j GROUP BY vec_id")  # fmt: skip
def array_matvec(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(ColumnNormalization().fit_apply(vectors(spark, sf)).matvec([j % 5 - 2 for j in range(64)]), 6, "vec_id")


@query("linear_layer", Z_PART + " SELECT CAST(p_partkey AS BIGINT) AS p_partkey, round(z_p_size * 2 - z_p_retailprice + 1, 6) + 0.0 AS a, round(z_p_size * 0.5 + z_p_retailprice * 3 - 2, 6) + 0.0 AS b FROM z")
def linear_layer(spark: SparkSession, sf: str) -> DataFrame:
    m = parts(spark, sf)
    p = ColumnNormalization().fit(m)
    return rounded(NormalizedLinear([[2, -1], [0.5, 3]], [1, -2], centers=p.centers, scales=p.scales)(m, ["a", "b"]), 6, "p_partkey")


# Weighted operations (WG-*)

_WJ = [(j, k) for j in range(4) for k in range(4)]


@query("weighted_sums", Z_LINE + " " + union([f"SELECT CAST({k} AS BIGINT) AS j, round(sum(l_quantity * z_{c}), 3) + 0.0 AS value FROM z" for k, c in enumerate(LINE)]))
def weighted_sums(spark: SparkSession, sf: str) -> DataFrame:
    return out(spark, 3, value=ColumnNormalization().fit_apply(_weighted_lines(spark, sf)).weighted_sums("w"))


def _weighted_lines(spark: SparkSession, sf: str) -> Wide:
    return Wide(table(spark, sf, "lineitem").withColumn("w", F.col("l_quantity")), "l_orderkey", LINE, extra=["w"])


@query("weighted_gram", Z_LINE + " " + union([f"SELECT CAST({j} AS BIGINT) AS j, CAST({k} AS BIGINT) AS k, round(sum(z_{LINE[j]} * l_quantity * z_{LINE[k]}), 2) + 0.0 AS g FROM z" for j, k in _WJ]))
def weighted_gram(spark: SparkSession, sf: str) -> DataFrame:
    return square(spark, 2, ColumnNormalization().fit_apply(_weighted_lines(spark, sf)).gram("w"))


_Z1 = ["1.0", "z_p_size", "z_p_retailprice"]


@query("gram_intercept", Z_PART + " " + union([f"SELECT CAST({j} AS BIGINT) AS j, CAST({k} AS BIGINT) AS k, round(sum({_Z1[j]} * {_Z1[k]}), 4) + 0.0 AS g FROM z" for j in range(3) for k in range(3)]))
def gram_intercept(spark: SparkSession, sf: str) -> DataFrame:
    return square(spark, 4, ColumnNormalization().fit_apply(parts(spark, sf)).with_intercept().gram())


@query("array_gram", "WITH e AS (SELECT vec_id, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) - 1 AS j FROM embeddings), p AS (SELECT j, avg(v) AS m FROM e GROUP BY j), z AS (SELECT vec_id, e.j, v - m AS z FROM e JOIN p ON e.j = p.j) "
       "SELECT CAST(a.j AS BIGINT) AS j, CAST(b.j AS BIGINT) AS k, round(sum(a.z * b.z), 6) + 0.0 AS g FROM z a JOIN z b ON a.vec_id = b.vec_id GROUP BY a.j, b.j")  # fmt: skip
def array_gram(spark: SparkSession, sf: str) -> DataFrame:
    return square(spark, 6, ColumnNormalization("mean", "none").fit_apply(vectors(spark, sf)).gram())


# Columns, rows, vectors (CL-*, VE-*)


@query("column_reductions", Z_PART + f" SELECT round(sum(z_p_size), 6) + 0.0 AS total, round(sum(z_p_size * z_p_size), 5) + 0.0 AS norm2, round(sum(z_p_size * {_PU}), 5) + 0.0 AS dot, "
       f"round(sum(p_partkey * z_p_size * {_PU}), 1) + 0.0 AS weighted_dot, round(sum(p_partkey * z_p_size * z_p_size), 1) + 0.0 AS weighted_norm2 FROM z")  # fmt: skip
def column_reductions(spark: SparkSession, sf: str) -> DataFrame:
    c = ColumnNormalization().fit_apply(parts(spark, sf)).column_view(0)
    u = F.col("p_partkey") % 7 - 3
    row = [float(x) for x in (c.sum(), c.norm_squared(), c.dot(u), c.weighted_dot("p_partkey", u), c.weighted_norm_squared("p_partkey"))]
    df = spark.createDataFrame([tuple(row)], "total double, norm2 double, dot double, weighted_dot double, weighted_norm2 double")
    return df.select(*[rnd(F.col(n), d).alias(n) for n, d in zip(df.columns, (6, 5, 5, 1, 1), strict=True)])


@query("select_column", Z_PART + " SELECT CAST(p_partkey AS BIGINT) AS p_partkey, round(z_p_retailprice, 8) + 0.0 AS value FROM z")
def select_column(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(ColumnNormalization().fit_apply(parts(spark, sf))[:, -1], 8, "p_partkey")


@query("column_axpy", Z_PART + " SELECT CAST(p_partkey AS BIGINT) AS p_partkey, round(p_partkey % 7 + 1.5 * z_p_size, 8) + 0.0 AS value FROM z")
def column_axpy(spark: SparkSession, sf: str) -> DataFrame:
    m = parts(spark, sf)
    d = m.df.select("p_partkey", (F.col("p_partkey") % 7).cast("double").alias("d"))
    return rounded(ColumnNormalization().fit_apply(m).column_view(0).add_to(1.5, d), 8, "p_partkey")


@query("select_row", Z_PART + " SELECT CAST(0 AS BIGINT) AS j, round(z_p_size, 8) + 0.0 AS value FROM z WHERE p_partkey = 5 UNION ALL SELECT 1, round(z_p_retailprice, 8) + 0.0 FROM z WHERE p_partkey = 5")
def select_row(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(ColumnNormalization().fit_apply(parts(spark, sf)).row(5), 8, "j")


@query("vector_axpy", "SELECT CAST(p_partkey AS BIGINT) AS p_partkey, round(2 * p_size + p_retailprice, 6) + 0.0 AS b FROM part")
def vector_axpy(spark: SparkSession, sf: str) -> DataFrame:
    df = parts(spark, sf).df
    return rounded(weighted.axpy(2.0, df.select("p_partkey", F.col("p_size").alias("a")), df.select("p_partkey", F.col("p_retailprice").alias("b"))), 6, "p_partkey")


# Rows (ST-17, NR-08, NR-12)

_LIST = "list_transform(embedding, lambda x: x::DOUBLE)"
_ROWS = {
    "row_l2_array": (RowNormalization("none", "l2"), "0.0", "sqrt(list_sum(list_transform(x, lambda v: v * v)))"),
    "row_standardize_array": (RowNormalization("mean", "sd"), "list_avg(x)", "list_stddev_pop(x)"),
    "row_minmax_array": (RowNormalization.min_max(), "list_min(x)", "list_max(x) - list_min(x)"),
    "row_robust_array": (RowNormalization.robust(), "list_aggregate(x, 'quantile_cont', 0.5)", "list_aggregate(x, 'quantile_cont', 0.75) - list_aggregate(x, 'quantile_cont', 0.25)"),
    "row_maxabs_array": (RowNormalization("mean", "maxabs"), "list_avg(x)", "list_max(list_transform(list_transform(x, lambda v: v - list_avg(x)), lambda v: abs(v)))"),
}
for _name, (_recipe, _c, _s) in _ROWS.items():
    query(
        _name,
        f"WITH r AS (SELECT vec_id, {_LIST} AS x FROM embeddings), p AS (SELECT vec_id, x, {_c} AS c, {_s} AS s FROM r), e AS (SELECT vec_id, unnest(x) AS v, generate_subscripts(x, 1) - 1 AS j, c, s FROM p) "
        "SELECT CAST(vec_id AS BIGINT) AS vec_id, CAST(j AS BIGINT) AS j, round((v - c) / CASE WHEN s = 0 THEN 1 ELSE s END, 8) + 0.0 AS v FROM e",
    )(lambda spark, sf, r=_recipe: rounded(r.fit_apply(vectors(spark, sf)).matrix.long(), 8, "vec_id", "j"))


@query("row_params_frozen_wide", "WITH r AS (SELECT p_partkey, p_size::DOUBLE AS a, p_retailprice AS b, (p_size + p_retailprice) / 2 AS c, abs(p_size) + abs(p_retailprice) AS n FROM part), s AS (SELECT *, abs(a - c) + abs(b - c) AS s FROM r) "
       "SELECT CAST(p_partkey AS BIGINT) AS p_partkey, round((a - c) / CASE WHEN s = 0 THEN 1 ELSE s END, 8) + 0.0 AS p_size, round((b - c) / CASE WHEN s = 0 THEN 1 ELSE s END, 8) + 0.0 AS p_retailprice FROM s")  # fmt: skip
def row_params_frozen_wide(spark: SparkSession, sf: str) -> DataFrame:
    m = parts(spark, sf)
    return rounded(RowNormalization("mean", "l1").fit(m).apply_frozen(m).to_eager(), 8, "p_partkey")


# Coordinates (SR-14, PR, WG-04 .. 06)


@query("coo_matvec", _COO + "SELECT CAST(i AS BIGINT) AS i, round(sum((v - p.m) / CASE WHEN p.s = 0 THEN 1 ELSE p.s END * (m.j % 5 - 2)), 6) + 0.0 AS value FROM m JOIN p ON m.j = p.j GROUP BY i")
def coo_matvec(spark: SparkSession, sf: str) -> DataFrame:
    m = cells(spark, sf)
    return rounded(ColumnNormalization().fit_apply(m).matvec([j % 5 - 2 for j in range(m.ncols)]), 6, "i")


@query("coo_rmatvec", _COO + "SELECT CAST(m.j AS BIGINT) AS j, round(sum((v - p.m) / CASE WHEN p.s = 0 THEN 1 ELSE p.s END * (i % 7 - 3)), 4) + 0.0 AS value FROM m JOIN p ON m.j = p.j GROUP BY m.j")
def coo_rmatvec(spark: SparkSession, sf: str) -> DataFrame:
    return out(spark, 4, value=ColumnNormalization().fit_apply(cells(spark, sf)).rmatvec(F.col("i") % 7 - 3))


@query("coo_weighted_sums", _COO + "SELECT CAST(m.j AS BIGINT) AS j, round(sum((v - p.m) * (i % 3)), 3) + 0.0 AS value FROM m JOIN p ON m.j = p.j GROUP BY m.j")
def coo_weighted_sums(spark: SparkSession, sf: str) -> DataFrame:
    return out(spark, 3, value=ColumnNormalization("mean", "none").fit_apply(cells(spark, sf)).weighted_sums(F.col("i") % 3))


_GRAM = ", t AS (SELECT i, m.j, v - p.m AS z FROM m JOIN p ON m.j = p.j) SELECT CAST(a.j AS BIGINT) AS j, CAST(b.j AS BIGINT) AS k, round(sum({z}), 3) + 0.0 AS g FROM t a JOIN t b ON a.i = b.i GROUP BY a.j, b.j"


def _gram_table(spark: SparkSession, sf: str, weight: Column | None) -> DataFrame:
    g = ColumnNormalization("mean", "none").fit_apply(cells(spark, sf)).gram_pairs(weight).table()
    return g.select("j", "k", rnd_many(F.col("g"), 3).alias("g"))


@query("coo_gram", _COO + _GRAM.format(z="a.z * b.z"))
def coo_gram(spark: SparkSession, sf: str) -> DataFrame:
    return _gram_table(spark, sf, None)


@query("coo_row_l1", _COO + ", r AS (SELECT i, sum(abs(v)) AS s FROM m GROUP BY i) SELECT CAST(m.i AS BIGINT) AS i, round(sum(v / CASE WHEN s = 0 THEN 1 ELSE s END * (j + 1)), 8) + 0.0 AS value FROM m JOIN r ON m.i = r.i GROUP BY m.i")
def coo_row_l1(spark: SparkSession, sf: str) -> DataFrame:
    m = cells(spark, sf)
    return rounded(RowNormalization("none", "l1").fit_apply(m).matvec([j + 1 for j in range(m.ncols)]), 8, "i")


@query("coo_transposed_stats", _COO + "SELECT CAST(j AS BIGINT) AS j, round(s, 6) + 0.0 AS value FROM p")
def coo_transposed_stats(spark: SparkSession, sf: str) -> DataFrame:
    """Suppliers x orders, transposed: the columns are suppliers again."""
    entries = cells(spark, sf).df.select(F.col("j").alias("i"), F.col("i").alias("j"), "v")
    p, n = table(spark, sf, "orders").agg(F.max("o_orderkey")).first()[0] + 1, table(spark, sf, "supplier").count()
    return out(spark, 6, value=ColumnStatistics(Coo(entries, n, p, coalesced=True).transposed()).sds())


_COO_CHAIN = _COO + (
    ", r AS (SELECT i, sum(abs(v)) AS s FROM m GROUP BY i), z AS (SELECT m.i, m.j, v / CASE WHEN s = 0 THEN 1 ELSE s END AS a FROM m JOIN r ON m.i = r.i), "
    "q AS (SELECT j, avg(a) AS c, stddev_pop(a) AS d FROM z GROUP BY j), y AS (SELECT z.i, z.j, (a - c) / CASE WHEN d = 0 THEN 1 ELSE d END AS y FROM z JOIN q ON z.j = q.j) "
)


@query("coo_row_stats_transposed", "WITH m AS (SELECT s_suppkey AS i, coalesce(v, 0.0) AS v FROM orders CROSS JOIN supplier LEFT JOIN (SELECT l_orderkey, l_suppkey, sum(l_quantity) AS v FROM lineitem GROUP BY ALL) "
       "ON o_orderkey = l_orderkey AND s_suppkey = l_suppkey) SELECT CAST(i AS BIGINT) AS i, round(avg(v), 8) + 0.0 AS center, round(stddev_pop(v), 8) + 0.0 AS scale FROM m GROUP BY i")  # fmt: skip
def coo_row_stats_transposed(spark: SparkSession, sf: str) -> DataFrame:
    """Row parameters of suppliers x orders: the transpose of orders x suppliers, with zeros counted."""
    by_number = _numbered(spark, sf)
    t = RowNormalization().fit(by_number.transposed()).table
    suppliers = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("i"))
    return rounded(t.join(suppliers, "i"), 8, "i")


def _numbered(spark: SparkSession, sf: str) -> Coo:
    """Orders x suppliers with order keys as row numbers."""
    m, n = cells(spark, sf), table(spark, sf, "orders").agg(F.max("o_orderkey")).first()[0] + 1
    return Coo(m.df, n, m.ncols, coalesced=True)


_COO_ROWS = _COO + ", r AS (SELECT i, {c} AS c, {s} AS s FROM m GROUP BY i) SELECT CAST(i AS BIGINT) AS i, round(c, 8) + 0.0 AS center, round(CASE WHEN s = 0 THEN 1 ELSE s END, 8) + 0.0 AS scale FROM r"
for _name, _recipe, _c, _s in (
    ("standardize", RowNormalization(), "avg(v)", "stddev_pop(v)"),
    ("robust", RowNormalization.robust((0.05, 0.99)), "quantile_cont(v, 0.5)", "quantile_cont(v, 0.99) - quantile_cont(v, 0.05)"),
    ("minmax", RowNormalization.min_max(), "min(v)", "max(v) - min(v)"),
):
    query(f"coo_rows_{_name}", _COO_ROWS.format(c=_c, s=_s))(lambda spark, sf, r=_recipe: rounded(r.fit(cells(spark, sf)).table, 8, "i"))


@query("coo_gram_pairs", "WITH e AS (SELECT l_orderkey AS i, l_suppkey AS j, sum(l_quantity) AS v FROM lineitem GROUP BY ALL) SELECT CAST(a.j AS BIGINT) AS j, CAST(b.j AS BIGINT) AS k, round(sum(a.v * b.v * (a.i % 3)), 3) + 0.0 AS g FROM e a JOIN e b ON a.i = b.i AND a.j <= b.j GROUP BY a.j, b.j")
def coo_gram_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Stored pairs of a weighted Gram matrix as a table."""
    return rounded(NormalizedFrame(cells(spark, sf)).gram_pairs(F.col("i") % 3).pairs, 3, "j", "k")


@query("coo_row_corrections", _COO_CHAIN + "SELECT CAST(z.j AS BIGINT) AS j, round(-c / CASE WHEN d = 0 THEN 1 ELSE d END, 6) + 0.0 AS zero, round(a / CASE WHEN d = 0 THEN 1 ELSE d END, 6) + 0.0 AS added FROM z JOIN q ON z.j = q.j WHERE z.i = 5")
def coo_row_corrections(spark: SparkSession, sf: str) -> DataFrame:
    """What a row of raw zeros becomes by a chain, and what the stored entries of order 5 add."""
    zero, stored = _coo_chain(spark, sf).row_corrections(5)
    filled = out(spark, 6, zero=zero).join(stored.select("j", F.col("value").alias("added")), "j", "left")
    return filled.select("j", "zero", rnd(F.coalesce("added", F.lit(0.0)), 6).alias("added"))


@query("coo_dealt_weighted_sums", _COO + "SELECT CAST(m.j AS BIGINT) AS j, round(sum(v * (i % 3)), 3) + 0.0 AS value FROM m GROUP BY m.j")
def coo_dealt_weighted_sums(spark: SparkSession, sf: str) -> DataFrame:
    return out(spark, 3, value=NormalizedFrame(cells(spark, sf).dealt("columns")).weighted_sums(F.col("i") % 3))


def _coo_chain(spark: SparkSession, sf: str) -> NormalizedFrame:
    """Orders scaled by their L1 norms, then suppliers standardized: never filled in."""
    return RowNormalization("none", "l1").then(ColumnNormalization()).fit_apply(cells(spark, sf))


@query("coo_chain_matvec", _COO_CHAIN + "SELECT CAST(i AS BIGINT) AS i, round(sum(y * (j % 5 - 2)), 5) + 0.0 AS value FROM y GROUP BY i")
def coo_chain_matvec(spark: SparkSession, sf: str) -> DataFrame:
    z = _coo_chain(spark, sf)
    return rounded(z.matvec([j % 5 - 2 for j in range(z.ncols)]), 5, "i")


@query("coo_chain_weighted_sums", _COO_CHAIN + "SELECT CAST(j AS BIGINT) AS j, round(sum(y * (i % 3)), 3) + 0.0 AS value FROM y GROUP BY j")
def coo_chain_weighted_sums(spark: SparkSession, sf: str) -> DataFrame:
    return out(spark, 3, value=_coo_chain(spark, sf).weighted_sums(F.col("i") % 3))


@query("coo_chain_column", _COO_CHAIN + "SELECT CAST(i AS BIGINT) AS i, round(y, 6) + 0.0 AS value FROM y WHERE j = 7")
def coo_chain_column(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(_coo_chain(spark, sf)[:, 7], 6, "i")


@query("coo_column_view", _COO + "SELECT round(sum((v - p.m) / p.s * (i % 7 - 3)), 5) + 0.0 AS dot, round(sum((v - p.m) / p.s * (v - p.m) / p.s), 5) + 0.0 AS norm2 FROM m JOIN p ON m.j = p.j WHERE m.j = 3")
def coo_column_view(spark: SparkSession, sf: str) -> DataFrame:
    c = ColumnNormalization().fit_apply(cells(spark, sf)).column_view(3)
    df = spark.createDataFrame([(c.dot(F.col("i") % 7 - 3), c.norm_squared())], "dot double, norm2 double")
    return df.select(rnd(F.col("dot"), 5).alias("dot"), rnd(F.col("norm2"), 5).alias("norm2"))


@query("coo_corrections", _COO + "SELECT CAST(l_orderkey AS BIGINT) AS i, round(l.v / p.s, 6) + 0.0 AS value, round(-p.m / p.s, 6) + 0.0 AS zero FROM "
       "(SELECT l_orderkey, l_suppkey, sum(l_quantity) AS v FROM lineitem GROUP BY ALL) l JOIN p ON l.l_suppkey = p.j WHERE p.j = 3")  # fmt: skip
def coo_corrections(spark: SparkSession, sf: str) -> DataFrame:
    """What a raw zero of supplier 3 becomes, and what the stored entries add to it."""
    zero, stored = ColumnNormalization().fit_apply(cells(spark, sf)).corrections(3)
    return rounded(stored.withColumn("zero", F.lit(zero)), 6, "i")


def types(spark: SparkSession, sf: str) -> Coo:
    """Users x event types, with all repeats: sums of values."""
    kinds = F.array(*[F.lit(k) for k in ("click", "error", "purchase", "signup", "view")])
    e = table(spark, sf, "events").withColumn("j", F.array_position(kinds, F.col("event_type")).cast("long") - 1)
    users = e.select(F.col("user_id").alias("i")).distinct()
    return Coo(e.filter("j >= 0").select(F.col("user_id").alias("i"), "j", F.col("value").alias("v")), users.count(), 5, rows=users)


@query("coo_eager", "WITH k(j, t) AS (VALUES (0, 'click'), (1, 'error'), (2, 'purchase'), (3, 'signup'), (4, 'view')), m AS (SELECT u.user_id AS i, k.j, coalesce(v, 0.0) AS v FROM (SELECT DISTINCT user_id FROM events) u CROSS JOIN k "
       "LEFT JOIN (SELECT user_id, event_type, sum(value) AS v FROM events GROUP BY ALL) e ON e.user_id = u.user_id AND e.event_type = k.t), p AS (SELECT j, min(v) AS lo, max(v) - min(v) AS s FROM m GROUP BY j) "
       "SELECT CAST(i AS BIGINT) AS i, CAST(m.j AS BIGINT) AS j, round((v - lo) / CASE WHEN s = 0 THEN 1 ELSE s END, 7) + 0.0 AS v FROM m JOIN p ON m.j = p.j")  # fmt: skip
def coo_eager(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(ColumnNormalization.min_max().fit_apply(types(spark, sf)).matrix.long(), 7, "i", "j")


# Selections (SE-*)


@query("select_after_fit", Z_PART + " SELECT CAST(p_partkey AS BIGINT) AS p_partkey, round(z_p_retailprice, 8) + 0.0 AS p_retailprice FROM z WHERE p_partkey >= 100 AND p_partkey < 1000")
def select_after_fit(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(ColumnNormalization().fit_apply(parts(spark, sf)).submatrix((100, 1000), (1, 2)).to_eager(), 8, "p_partkey")


@query("select_before_fit", stage_sql(PART, "(SELECT * FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 49))", "p_partkey", "mean", SD)
       + " SELECT CAST(p_partkey AS BIGINT) AS p_partkey, " + ", ".join(f"round(z_{c}, 8) + 0.0 AS {c}" for c in PART) + " FROM z")
def select_before_fit(spark: SparkSession, sf: str) -> DataFrame:
    keys = table(spark, sf, "lineitem").filter("l_quantity > 49").select("l_partkey")
    return rounded(ColumnNormalization().fit_apply(take_rows(parts(spark, sf), keys)).to_eager(), 8, "p_partkey")


@query("submatrix_gram", Z_PART + " SELECT CAST(0 AS BIGINT) AS j, CAST(0 AS BIGINT) AS k, round(sum(z_p_size * z_p_size), 5) + 0.0 AS g FROM z WHERE p_partkey < 500")
def submatrix_gram(spark: SparkSession, sf: str) -> DataFrame:
    return square(spark, 5, ColumnNormalization().fit_apply(parts(spark, sf)).submatrix((0, 500), (0, 1)).gram())


# Chains (NR-16 .. NR-20)

@query("chain_column_row", Z_PART + ", r AS (SELECT p_partkey, z_p_size AS a, z_p_retailprice AS b, sqrt(z_p_size * z_p_size + z_p_retailprice * z_p_retailprice) AS s FROM z) "
       "SELECT CAST(p_partkey AS BIGINT) AS p_partkey, round(a / CASE WHEN s = 0 THEN 1 ELSE s END, 8) + 0.0 AS p_size, round(b / CASE WHEN s = 0 THEN 1 ELSE s END, 8) + 0.0 AS p_retailprice FROM r")  # fmt: skip
def chain_column_row(spark: SparkSession, sf: str) -> DataFrame:
    chain = ColumnNormalization().then(RowNormalization("none", "l2"))
    return rounded(chain.fit_apply(parts(spark, sf)).to_eager(), 8, "p_partkey")


_CHAIN = (
    "WITH r AS (SELECT p_partkey, p_size / n AS a, p_retailprice / n AS b FROM (SELECT p_partkey, p_size, p_retailprice, abs(p_size) + abs(p_retailprice) AS n FROM part)), "
    "c AS (SELECT avg(a) AS ma, avg(b) AS mb FROM r WHERE p_partkey % 2 = 0), p AS (SELECT ma, mb, stddev_pop(a - ma) AS sa, stddev_pop(b - mb) AS sb FROM r, c WHERE p_partkey % 2 = 0 GROUP BY ma, mb) "
    "SELECT CAST(p_partkey AS BIGINT) AS p_partkey, round((a - ma) / sa, 6) + 0.0 AS p_size, round((b - mb) / sb, 6) + 0.0 AS p_retailprice FROM r, p WHERE p_partkey % 2 = {odd}"
)


def _chain(spark: SparkSession, sf: str, odd: int) -> DataFrame:
    m = parts(spark, sf)
    fitted = RowNormalization("none", "l1").then(ColumnNormalization()).fit(m.where(F.col("p_partkey") % 2 == 0))
    rows = m.where(F.col("p_partkey") % 2 == odd)
    return rounded((fitted.for_new_samples(rows) if odd else fitted.apply_frozen(rows)).to_eager(), 6, "p_partkey")


query("chain_row_column", _CHAIN.format(odd=0))(lambda spark, sf: _chain(spark, sf, 0))
query("chain_new_samples", _CHAIN.format(odd=1))(lambda spark, sf: _chain(spark, sf, 1))


@query("chain_weighted_gram", Z_PART + ", d AS (SELECT max(abs(z_p_size)) AS sa, max(abs(z_p_retailprice)) AS sb FROM z), y AS (SELECT z_p_size / sa AS a, z_p_retailprice / sb AS b, p_partkey % 5 AS w FROM z, d) "
       + union([f"SELECT CAST({j} AS BIGINT) AS j, CAST({k} AS BIGINT) AS k, round(sum(w * {x} * {y}), 5) + 0.0 AS g FROM y" for j, x in enumerate("ab") for k, y in enumerate("ab")]))
def chain_weighted_gram(spark: SparkSession, sf: str) -> DataFrame:
    chain = Chain((ColumnNormalization(), ColumnNormalization("none", "maxabs")))
    return square(spark, 5, chain.fit_apply(parts(spark, sf)).gram(F.col("p_partkey") % 5))


# Chunks (SR-07 .. SR-10): part as a matrix of five columns, written in chunks of 64 x 2; the last column is all fill, so its chunks are absent

_PART5 = ["p_size", "p_retailprice", "p_partkey % 7", "p_size + 0.5", "7.5"]
_CHUNKS = "SELECT i, j, v FROM (" + " UNION ALL ".join(f"SELECT p_partkey AS i, {k} AS j, CAST({e} AS DOUBLE) AS v FROM part" for k, e in enumerate(_PART5)) + ")"


def chunked(spark: SparkSession, sf: str) -> ChunkedMatrix:
    """Part in a chunk table on the shared folder."""
    t = table(spark, sf, "part")
    wide = Wide(t.select("p_partkey", *[F.expr(e).cast("double").alias(f"c{k}") for k, e in enumerate(_PART5)]), "p_partkey", [f"c{k}" for k in range(5)])
    path, n = shared_path(spark, "chunks"), t.agg(F.max("p_partkey")).first()[0] + 1
    write_chunks(wide, path, n, (64, 2), fill=7.5)
    return read_chunks(spark, path, (n, 5), (64, 2), fill=7.5)


@query("chunk_scan_fill", f"SELECT CAST(i AS BIGINT) AS i, CAST(j AS BIGINT) AS j, CAST(v AS DOUBLE) AS v FROM ({_CHUNKS})")
def chunk_scan_fill(spark: SparkSession, sf: str) -> DataFrame:
    return chunked(spark, sf).entries()


@query("chunk_rectangle", f"SELECT CAST(i AS BIGINT) AS i, CAST(j AS BIGINT) AS j, CAST(v AS DOUBLE) AS v FROM ({_CHUNKS}) WHERE i >= 10 AND i < 131 AND j >= 1 AND j < 4")
def chunk_rectangle(spark: SparkSession, sf: str) -> DataFrame:
    return chunked(spark, sf).entries((10, 131), (1, 4))


@query("chunk_rows", f"SELECT CAST(i AS BIGINT) AS i, CAST(j - 1 AS BIGINT) AS j, CAST(v AS DOUBLE) AS v FROM ({_CHUNKS}) WHERE i >= 10 AND i < 131 AND j >= 1")
def chunk_rows(spark: SparkSession, sf: str) -> DataFrame:
    return chunked(spark, sf).to_array((10, 131), (1, 5)).long()


@query("chunk_block", f"SELECT CAST(i - 60 AS BIGINT) AS i, CAST(j - 1 AS BIGINT) AS j, CAST(v AS DOUBLE) AS v FROM ({_CHUNKS}) WHERE i >= 60 AND i < 70 AND j >= 1 AND j < 3")
def chunk_block(spark: SparkSession, sf: str) -> DataFrame:
    block = chunked(spark, sf).read_block((60, 70), (1, 3))
    return spark.createDataFrame([(i, j, float(v)) for (i, j), v in np.ndenumerate(block)], "i bigint, j bigint, v double")


@query("chunk_standardize", f"WITH e AS ({_CHUNKS}), p AS (SELECT j, avg(v) AS m, stddev_pop(v - 7.5) AS s FROM e GROUP BY j) SELECT CAST(i AS BIGINT) AS i, round(sum((v - m) / CASE WHEN s = 0 THEN 1 ELSE s END * (e.j + 1)), 6) + 0.0 AS value FROM e JOIN p ON e.j = p.j GROUP BY i")
def chunk_standardize(spark: SparkSession, sf: str) -> DataFrame:
    m = chunked(spark, sf)
    return rounded(NormalizedFrame(m, [ColumnNormalization().fit(m)]).matvec([1, 2, 3, 4, 5]), 6, "i")


@query("chunk_stats_median", f"SELECT CAST(j AS BIGINT) AS j, round(quantile_cont(v, 0.5), 6) + 0.0 AS value FROM ({_CHUNKS}) GROUP BY j")
def chunk_stats_median(spark: SparkSession, sf: str) -> DataFrame:
    return out(spark, 6, value=ColumnStatistics(chunked(spark, sf)).medians())


def chunk_products(spark: SparkSession, sf: str) -> DataFrame:
    """Two long vectors against blocks of a rectangle: an expression of the key and a table."""
    z = NormalizedFrame(chunked(spark, sf), []).submatrix(None, (1, 4))
    u = table(spark, sf, "part").select("p_partkey", (F.col("p_size") - 3).alias("u"))
    got = z.rmatmat([F.col("i") % 7 - 3, u])
    return out(spark, 4, y0=got[:, 0], y1=got[:, 1])


query("chunk_rmatmat", f"SELECT CAST(e.j - 1 AS BIGINT) AS j, round(sum(v * (i % 7 - 3)), 4) + 0.0 AS y0, round(sum(v * (p_size - 3)), 4) + 0.0 AS y1 FROM ({_CHUNKS}) e JOIN part ON p_partkey = i WHERE e.j BETWEEN 1 AND 3 GROUP BY e.j")(chunk_products)


def zarr(spark: SparkSession, sf: str) -> ChunkedMatrix:
    """Part as a Zarr array on the shared folder: tasks write the files of their chunks, and read those of the chunks they need."""
    t = table(spark, sf, "part")
    wide = Wide(t.select("p_partkey", *[F.expr(e).cast("double").alias(f"c{k}") for k, e in enumerate(_PART5)]), "p_partkey", [f"c{k}" for k in range(5)])
    path, n = shared_path(spark, "zarr"), t.agg(F.max("p_partkey")).first()[0] + 1
    write_zarr(wide, path, n, (max(64, n // 64), 2), fill=7.5)
    return read_zarr(spark, path)


@query("zarr_standardize", f"WITH e AS ({_CHUNKS}), p AS (SELECT j, avg(v) AS m, stddev_pop(v - 7.5) AS s FROM e GROUP BY j) SELECT CAST(i AS BIGINT) AS i, round(sum((v - m) / CASE WHEN s = 0 THEN 1 ELSE s END * (e.j + 1)), 6) + 0.0 AS value FROM e JOIN p ON e.j = p.j GROUP BY i")
def zarr_standardize(spark: SparkSession, sf: str) -> DataFrame:
    m = zarr(spark, sf)
    return rounded(NormalizedFrame(m, [ColumnNormalization().fit(m)]).matvec([1, 2, 3, 4, 5]), 6, "i")


@query("zarr_rectangle", f"SELECT CAST(i AS BIGINT) AS i, CAST(j AS BIGINT) AS j, CAST(v AS DOUBLE) AS v FROM ({_CHUNKS}) WHERE i >= 10 AND i < 131 AND j >= 1 AND j < 4")
def zarr_rectangle(spark: SparkSession, sf: str) -> DataFrame:
    return zarr(spark, sf).entries((10, 131), (1, 4))


@query("zarr_robust", f"WITH e AS ({_CHUNKS}), p AS (SELECT j, quantile_cont(v, 0.5) AS m, quantile_cont(v, 0.75) - quantile_cont(v, 0.25) AS s FROM e GROUP BY j) SELECT CAST(j AS BIGINT) AS j, round(m, 6) + 0.0 AS center, round(CASE WHEN s = 0 THEN 1 ELSE s END, 6) + 0.0 AS scale FROM p")
def zarr_robust(spark: SparkSession, sf: str) -> DataFrame:
    p = ColumnNormalization.robust().fit(zarr(spark, sf))
    return out(spark, 6, center=p.centers, scale=p.scales)


@query("explicit_params", "SELECT CAST(p_partkey AS BIGINT) AS p_partkey, round((p_size - 1.5) / -2.0, 8) + 0.0 AS p_size, round((p_retailprice - 3.0) / 4.0, 8) + 0.0 AS p_retailprice FROM part")
def explicit_params(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(ColumnParams(2, [1.5, 3.0], [-2.0, 4.0]).transform(parts(spark, sf)).to_eager(), 8, "p_partkey")


# Rectangles, transposes, batches (PR-07, PR-10, PR-14, PR-15, WG-05, WG-09)


@query("submatrix_matvec", Z_PART + " SELECT CAST(p_partkey AS BIGINT) AS p_partkey, round(2 * z_p_retailprice, 6) + 0.0 AS value FROM z WHERE p_partkey >= 100 AND p_partkey < 1000")
def submatrix_matvec(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(ColumnNormalization().fit_apply(parts(spark, sf)).submatrix((100, 1000), (1, 2)).matvec([2.0]), 6, "p_partkey")


@query("submatrix_rmatvec", Z_PART + " " + union([f"SELECT CAST({k} AS BIGINT) AS j, round(sum(z_{c} * {_PU}), 5) + 0.0 AS value FROM z WHERE p_partkey < 150" for k, c in enumerate(PART)]))
def submatrix_rmatvec(spark: SparkSession, sf: str) -> DataFrame:
    return out(spark, 5, value=ColumnNormalization().fit_apply(parts(spark, sf)).submatrix((0, 150)).rmatvec(F.col("p_partkey") % 7 - 3))


@query("submatrix_weighted_sums", Z_PART + " " + union([f"SELECT CAST({k} AS BIGINT) AS j, round(sum(z_{c} * (p_partkey % 5)), 5) + 0.0 AS value FROM z WHERE p_partkey < 150" for k, c in enumerate(PART)]))
def submatrix_weighted_sums(spark: SparkSession, sf: str) -> DataFrame:
    return out(spark, 5, value=ColumnNormalization().fit_apply(parts(spark, sf)).submatrix((0, 150)).weighted_sums(F.col("p_partkey") % 5))


@query("transposed_rmatvec", Z_PART + " SELECT CAST(p_partkey AS BIGINT) AS p_partkey, round(z_p_size - 2 * z_p_retailprice, 6) + 0.0 AS value FROM z")
def transposed_rmatvec(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(ColumnNormalization().fit_apply(parts(spark, sf)).T.rmatvec([1.0, -2.0]), 6, "p_partkey")


@query("chain_matmat", Z_PART + ", r AS (SELECT p_partkey, z_p_size AS a, z_p_retailprice AS b, sqrt(z_p_size * z_p_size + z_p_retailprice * z_p_retailprice) AS s FROM z), n AS (SELECT p_partkey, a / CASE WHEN s = 0 THEN 1 ELSE s END AS a, b / CASE WHEN s = 0 THEN 1 ELSE s END AS b FROM r) "
       "SELECT CAST(p_partkey AS BIGINT) AS p_partkey, round(a - 2 * b, 6) + 0.0 AS y0, round(0.5 * a + b, 6) + 0.0 AS y1 FROM n")  # fmt: skip
def chain_matmat(spark: SparkSession, sf: str) -> DataFrame:
    chain = ColumnNormalization().then(RowNormalization("none", "l2"))
    return rounded(chain.fit_apply(parts(spark, sf)).matmat([[1.0, 0.5], [-2.0, 1.0]]), 6, "p_partkey")


@query("coo_matmat", _COO + "SELECT CAST(i AS BIGINT) AS i, round(sum((v - p.m) * (m.j % 5 - 2)), 6) + 0.0 AS y0, round(sum((v - p.m) * (m.j % 3)), 6) + 0.0 AS y1 FROM m JOIN p ON m.j = p.j GROUP BY i")
def coo_matmat(spark: SparkSession, sf: str) -> DataFrame:
    m = cells(spark, sf)
    return rounded(ColumnNormalization("mean", "none").fit_apply(m).matmat([[j % 5 - 2, j % 3] for j in range(m.ncols)]), 6, "i")


@query("coo_weighted_gram", _COO + _GRAM.format(z="a.z * b.z * (a.i % 3)"))
def coo_weighted_gram(spark: SparkSession, sf: str) -> DataFrame:
    return _gram_table(spark, sf, F.col("i") % 3)


# Entry points, frozen parameters on disk, in-memory operands (NR-03, NR-20, NR-21, SK-02, SK-08, PR-15, PR-17, PR-18, CL-09, CL-11, ST-20)

_MINMAX = stage_sql(PART, "part", "p_partkey", "min", "max({c}) - min({c})")
_EAGER = " SELECT CAST(p_partkey AS BIGINT) AS p_partkey, " + ", ".join(f"round(z_{c}, 8) + 0.0 AS {c}" for c in PART) + " FROM z"


@query("normalize_columns", _MINMAX + _EAGER)
def normalize_columns(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(normalize(parts(spark, sf), center="min", scale="range").to_eager(), 8, "p_partkey")


@query("standardize_rows", "WITH r AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS x FROM embeddings), e AS (SELECT vec_id, unnest(x) AS v, generate_subscripts(x, 1) - 1 AS j, list_avg(x) AS c, list_stddev_pop(x) AS s FROM r) "
       "SELECT CAST(vec_id AS BIGINT) AS vec_id, round(sum((v - c) / CASE WHEN s = 0 THEN 1 ELSE s END * (j + 1)), 5) + 0.0 AS value FROM e GROUP BY vec_id")  # fmt: skip
def standardize_rows(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(standardize(vectors(spark, sf), axis=1) @ [j + 1 for j in range(64)], 5, "vec_id")


@query("standardize_three_df", stage_sql(PART, "part", "p_partkey", "mean", "sqrt(var_pop({c} - {m}) * count({c}) / (count({c}) - 3))") + _EAGER)
def standardize_three_df(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(standardize(parts(spark, sf), df=3).to_eager(), 8, "p_partkey")


@query("params_saved_and_loaded", _MINMAX + _EAGER)
def params_saved_and_loaded(spark: SparkSession, sf: str) -> DataFrame:
    path, m = shared_path(spark, "params"), parts(spark, sf)
    ColumnNormalization.min_max().fit(m).save(spark, path)
    return rounded(ColumnParams.load(spark, path).apply_frozen(m).to_eager(), 8, "p_partkey")


@query("row_params_saved_and_loaded", "WITH s AS (SELECT p_partkey, p_size::DOUBLE AS a, p_retailprice AS b, greatest(p_size, p_retailprice) - least(p_size, p_retailprice) AS s, least(p_size, p_retailprice) AS c FROM part) "
       "SELECT CAST(p_partkey AS BIGINT) AS p_partkey, round((a - c) / CASE WHEN s = 0 THEN 1 ELSE s END, 8) + 0.0 AS p_size, round((b - c) / CASE WHEN s = 0 THEN 1 ELSE s END, 8) + 0.0 AS p_retailprice FROM s")  # fmt: skip
def row_params_saved_and_loaded(spark: SparkSession, sf: str) -> DataFrame:
    path, m = shared_path(spark, "row-params"), parts(spark, sf)
    RowNormalization.min_max().fit(m).save(path)
    return rounded(RowParams.load(spark, path, "p_partkey", True, True).apply_frozen(m).to_eager(), 8, "p_partkey")


@query("written_eager", Z_PART + _EAGER)
def written_eager(spark: SparkSession, sf: str) -> DataFrame:
    path = shared_path(spark, "eager")
    standardize(parts(spark, sf)).write(path)
    return rounded(spark.read.parquet(path), 8, "p_partkey")


@query("streamed_scores", Z_PART + " SELECT CAST(p_partkey AS BIGINT) AS p_partkey, round(z_p_size - 2 * z_p_retailprice, 6) + 0.0 AS value FROM z")
def streamed_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Frozen parameters over a stream of part, with a checkpoint and a Parquet sink on the shared folder."""
    stream = spark.readStream.schema(table(spark, sf, "part").schema).option("pathGlobFilter", "part.parquet").parquet(sf)
    path = shared_path(spark, "stream")
    scored = score_stream(stream, "p_partkey", PART, ColumnNormalization().fit(parts(spark, sf)), [1.0, -2.0])
    scored.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    return rounded(spark.read.schema(scored.schema).parquet(f"{path}/out"), 6, "p_partkey")


def suppliers(spark: SparkSession, sf: str) -> Wide:
    return Wide(table(spark, sf, "supplier").select(F.col("s_suppkey").alias("i"), "s_nationkey", "s_acctbal"), "i", ["s_nationkey", "s_acctbal"])


_SUPPLIER = "WITH p AS (SELECT avg(s_nationkey) AS a, avg(s_acctbal) AS c FROM supplier), z AS (SELECT row_number() OVER (ORDER BY s_suppkey) - 1 AS r, s_suppkey AS i, s_nationkey - a AS x, s_acctbal - c AS y FROM supplier, p) "


@query("numpy_left_product", _SUPPLIER + "SELECT CAST(0 AS BIGINT) AS j, round(sum(x * (r % 3)), 4) + 0.0 AS u, round(sum(x * r), 4) + 0.0 AS w FROM z UNION ALL SELECT 1, round(sum(y * (r % 3)), 4) + 0.0, round(sum(y * r), 4) + 0.0 FROM z")
def numpy_left_product(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors in memory on the left: a value for each row."""
    z = normalize(suppliers(spark, sf), scale=False)
    at = np.arange(z.shape[0])
    return out(spark, 4, u=(at % 3.0) @ z, w=np.matmul(at.astype(float), z))


@query("solver_products", _SUPPLIER + "SELECT CAST(r AS BIGINT) AS j, round(x - 2 * y, 6) + 0.0 AS value FROM z")
def solver_products(spark: SparkSession, sf: str) -> DataFrame:
    """Products with vectors in memory on both sides, as iterative solvers ask for."""
    return out(spark, 6, value=InMemory(normalize(suppliers(spark, sf), scale=False)).matvec([1.0, -2.0]))


@query("rmatmat_tables", Z_PART + " " + union([f"SELECT CAST({k} AS BIGINT) AS j, " + ", ".join(f"round(sum(z_{c} * (p_partkey % {r + 2})), 4) + 0.0 AS y{r}" for r in range(4)) + " FROM z" for k, c in enumerate(PART)]))
def rmatmat_tables(spark: SparkSession, sf: str) -> DataFrame:
    """Four long vectors that are tables meet the matrix in one join."""
    m = parts(spark, sf)
    us = [table(spark, sf, "part").select("p_partkey", (F.col("p_partkey") % (r + 2)).cast("double").alias("u")) for r in range(4)]
    got = standardize(m).rmatmat(us)
    return out(spark, 4, **{f"y{r}": got[:, r] for r in range(4)})


@query("transposed_last_column", Z_PART + ", l AS (SELECT * FROM z WHERE p_partkey = (SELECT max(p_partkey) FROM part)) SELECT CAST(0 AS BIGINT) AS j, round(z_p_size, 8) + 0.0 AS value FROM l UNION ALL SELECT 1, round(z_p_retailprice, 8) + 0.0 FROM l")
def transposed_last_column(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(standardize(parts(spark, sf)).T[:, -1], 8, "j")


@query("params_npz", _MINMAX + _EAGER)
def params_npz(spark: SparkSession, sf: str) -> DataFrame:
    """Column parameters through a portable file of arrays."""
    path, m = f"{shared_path(spark, 'params')}/columns.npz", parts(spark, sf)
    ColumnNormalization.min_max().fit(m).save_npz(spark, path)
    return rounded(ColumnParams.load_npz(spark, path).apply_frozen(m).to_eager(), 8, "p_partkey")


@query("transposed_column", Z_PART + " SELECT CAST(0 AS BIGINT) AS j, round(z_p_size, 8) + 0.0 AS value FROM z WHERE p_partkey = 17 UNION ALL SELECT 1, round(z_p_retailprice, 8) + 0.0 FROM z WHERE p_partkey = 17")
def transposed_column(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(standardize(parts(spark, sf)).T[:, 17], 8, "j")


@query("single_entry", Z_PART + " SELECT round(z_p_retailprice, 8) + 0.0 AS value, round(z_p_retailprice, 8) + 0.0 AS again FROM z WHERE p_partkey = 17")
def single_entry(spark: SparkSession, sf: str) -> DataFrame:
    """An entry by a job, and the same from its raw value and the parameters."""
    z = standardize(parts(spark, sf))
    raw = table(spark, sf, "part").filter("p_partkey = 17").first()["p_retailprice"]
    df = spark.createDataFrame([(z.entry(17, 1), z.normalize_value(17, 1, raw))], "value double, again double")
    return df.select(rnd(F.col("value"), 8).alias("value"), rnd(F.col("again"), 8).alias("again"))


@query("nan_poisons_its_column", "WITH t AS (SELECT CAST(p_size AS DOUBLE) AS a, CASE WHEN p_partkey = 5 THEN CAST('NaN' AS DOUBLE) ELSE p_retailprice END AS b FROM part) "
       "SELECT CAST(0 AS BIGINT) AS j, bool_or(isnan(a)) AS lost FROM t UNION ALL SELECT 1, bool_or(isnan(b)) FROM t")  # fmt: skip
def nan_poisons_its_column(spark: SparkSession, sf: str) -> DataFrame:
    t = table(spark, sf, "part").withColumn("p_retailprice", F.when(F.col("p_partkey") == 5, F.lit(float("nan"))).otherwise(F.col("p_retailprice")))
    s = ColumnStatistics(Wide(t, "p_partkey", PART))
    lost = np.isnan([s.mins(), s.ranges(), s.maxabs(), s.medians(), s.quantile_ranges(), s.means(), s.sds()]).all(0)
    return spark.createDataFrame([(j, bool(x)) for j, x in enumerate(lost)], "j bigint, lost boolean")


@query("select_column_of_rectangle", Z_PART + " SELECT CAST(p_partkey AS BIGINT) AS p_partkey, round(z_p_retailprice, 8) + 0.0 AS value FROM z WHERE p_partkey >= 100 AND p_partkey < 1000")
def select_column_of_rectangle(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(standardize(parts(spark, sf)).submatrix((100, 1000))[:, 1], 8, "p_partkey")


@query("training_gradients", Z_PART + ", e AS (SELECT z.*, 0.5 * z_p_size - z_p_retailprice + 1 - p_partkey % 7 AS e FROM z) SELECT CAST(0 AS BIGINT) AS j, round(sum(e), 4) + 0.0 AS value FROM e "
       "UNION ALL SELECT 1, round(sum(e * z_p_size), 4) + 0.0 FROM e UNION ALL SELECT 2, round(sum(e * z_p_retailprice), 4) + 0.0 FROM e")  # fmt: skip
def training_gradients(spark: SparkSession, sf: str) -> DataFrame:
    """The gradient of half the squared error in a linear layer's bias and weights, for all rows as one batch."""
    m = parts(spark, sf)
    p = ColumnNormalization().fit(m)
    layer = NormalizedLinear([[0.5, -1.0]], [1.0], centers=p.centers, scales=p.scales)
    errors = layer(m, ["y"]).select("p_partkey", (F.col("y") - F.col("p_partkey") % 7).alias("e"))
    bias, weight = layer.gradients(m, [errors])
    return out(spark, 4, value=[bias[0], *weight[0]])


# Linear models (2.8)

_NORMAL = Z_PART + (
    f", s AS (SELECT count(*) AS n, sum(z_p_size * z_p_size) AS a, sum(z_p_size * z_p_retailprice) AS b, sum(z_p_retailprice * z_p_retailprice) AS d, sum(z_p_size * {_PU}) AS e0, "
    f"sum(z_p_retailprice * {_PU}) AS f0, sum(z_p_size * p_partkey) AS e1, sum(z_p_retailprice * p_partkey) AS f1 FROM z), "
    "q AS (SELECT a / n + 0.1 AS a, b / n AS b, d / n + 0.1 AS d, e0 / n AS e0, f0 / n AS f0, e1 / n AS e1, f1 / n AS f1 FROM s) "
)
_SOLVED = ("(d * e{r} - b * f{r}) / (a * d - b * b)", "(a * f{r} - b * e{r}) / (a * d - b * b)")


@query("ridge_normal_equations", _NORMAL + union([f"SELECT CAST({k} AS BIGINT) AS j, round({x.format(r=0)}, 6) + 0.0 AS y0, round({x.format(r=1)}, 6) + 0.0 AS y1 FROM q" for k, x in enumerate(_SOLVED)]))
def ridge_normal_equations(spark: SparkSession, sf: str) -> DataFrame:
    b = solvers.ridge(ColumnNormalization().fit_apply(parts(spark, sf)), [F.col("p_partkey") % 7 - 3, "p_partkey"], 0.1)
    return out(spark, 6, y0=b[:, 0], y1=b[:, 1])


@query("ridge_conjugate_gradients", _NORMAL + union([f"SELECT CAST({k} AS BIGINT) AS j, round({x.format(r=0)}, 6) + 0.0 AS value FROM q" for k, x in enumerate(_SOLVED)]))
def ridge_conjugate_gradients(spark: SparkSession, sf: str) -> DataFrame:
    return out(spark, 6, value=solvers.ridge_cg(ColumnNormalization().fit_apply(parts(spark, sf)), F.col("p_partkey") % 7 - 3, 0.1))


@query("lasso", stage_sql(["c_acctbal"], "customer", "c_custkey", "mean", SD) + ", s AS (SELECT sum(z_c_acctbal * (c_custkey % 7 - 3)) / count(*) AS b, sum(z_c_acctbal * z_c_acctbal) / count(*) AS g FROM z) "
       "SELECT CAST(0 AS BIGINT) AS j, round(sign(b) * greatest(abs(b) - 0.01, 0) / g, 6) + 0.0 AS value FROM s")  # fmt: skip
def lasso(spark: SparkSession, sf: str) -> DataFrame:
    z = standardize(Wide(table(spark, sf, "customer"), "c_custkey", ["c_acctbal"]))
    return out(spark, 6, value=solvers.lasso(z, F.col("c_custkey") % 7 - 3, 0.01))


@query("ridge_dual", _NORMAL + union([f"SELECT CAST({k} AS BIGINT) AS j, round({x.format(r=0)}, 6) + 0.0 AS value FROM q" for k, x in enumerate(_SOLVED)]))
def ridge_dual(spark: SparkSession, sf: str) -> DataFrame:
    """The same coefficients from the system of rows."""
    return out(spark, 6, value=solvers.ridge_dual(ColumnNormalization().fit_apply(parts(spark, sf)), F.col("p_partkey") % 7 - 3, 0.1))


_DESCENT = stage_sql(["c_acctbal"], "customer", "c_custkey", "mean", SD) + ", s AS (SELECT sum(z_c_acctbal * (c_custkey % 7 - 3)) / count(*) AS b, sum(c_custkey % 7 - 3) / count(*) AS m, sum(z_c_acctbal * z_c_acctbal) / count(*) AS g FROM z) "


@query("batch_descent", _DESCENT + "SELECT round(b / g, 4) + 0.0 AS slope, round(m, 4) + 0.0 AS intercept FROM s")
def batch_descent(spark: SparkSession, sf: str) -> DataFrame:
    """Gradient descent with all rows in one batch, stopped, saved, loaded and ended: the least squares line."""
    m, path = Wide(table(spark, sf, "customer"), "c_custkey", ["c_acctbal"]), shared_path(spark, "descent")
    p, y = ColumnNormalization().fit(m), F.col("c_custkey") % 7 - 3
    solvers.descend(m, p, y, 1, 12, 0.8, steps=5).save(spark, path)
    end = solvers.descend(m, p, y, 1, 12, 0.8, state=solvers.DescentState.load(spark, path))
    df = spark.createDataFrame([(end.coefficients[0], end.intercept)], "slope double, intercept double")
    return df.select(*[rnd(F.col(c), 4).alias(c) for c in df.columns])


@query("lasso_columns", stage_sql(["c_acctbal"], "customer", "c_custkey", "mean", SD) + ", s AS (SELECT sum(z_c_acctbal * (c_custkey % 7 - 3)) / count(*) AS b, sum(z_c_acctbal * z_c_acctbal) / count(*) AS g FROM z) "
       "SELECT CAST(0 AS BIGINT) AS j, round(sign(b) * greatest(abs(b) - 0.01, 0) / g, 6) + 0.0 AS value FROM s")  # fmt: skip
def lasso_columns(spark: SparkSession, sf: str) -> DataFrame:
    z = standardize(Wide(table(spark, sf, "customer"), "c_custkey", ["c_acctbal"]))
    return out(spark, 6, value=solvers.lasso_columns(z, F.col("c_custkey") % 7 - 3, 0.01))
