"""Helpers that several operators use: tables, shared folders, and gapless ranks."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.storage import shared_path


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables; all paths go through Spark's readers."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def materialize(df: DataFrame, name: str, scratch: list[str] | None = None) -> DataFrame:
    """Cut the lineage of ``df`` by a Parquet table in the shared folder.

    Unlike executor-local storage the table outlives any executor, and later
    readers get column pruning and filter pushdown. ``scratch`` collects the
    paths of tables that their reader removes.
    """
    path = shared_path(df.sparkSession, name)
    if scratch is not None:
        scratch.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a scratch table that is no longer read."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def gapless_rank(df: DataFrame, group: str, order: list[str], out: str, cell_rows: int = 20_000, least: int = 64) -> DataFrame:
    """Number the rows of each ``group`` from 0 without gaps, however large a group is.

    Rows of a group are dealt over cells by a hash of the order columns,
    ``least`` of them or so many more that a cell holds about ``cell_rows`` rows:
    the group's rows are counted first. A row's number is the count of rows in the cells before its own plus
    its place in its cell, so no task sorts a whole group: a group with a third
    of all rows spreads over all its cells. Cell counts are few beside the rows.
    Rows equal in all order columns share a cell and get different numbers in no
    stated order. Columns of ``df`` keep their names, whatever they are.
    """
    names = {n: fresh_name(f"_{n}", [*df.columns, out]) for n in ("group", "rows", "cells", "cell", "before", "place", "of", "at")}
    n = {k: F.col(v) for k, v in names.items()}
    sizes = df.groupBy(F.col(group).alias(names["group"])).agg(F.greatest(F.lit(least), F.ceil(F.count(F.lit(1)) / F.lit(cell_rows)).cast("int")).alias(names["cells"]))
    known = df.join(F.broadcast(sizes) if _few(sizes) else sizes, df[group].eqNullSafe(n["group"])).drop(names["group"])
    dealt = known.withColumn(names["cell"], F.pmod(F.xxhash64(*order), n["cells"]).cast("int")).drop(names["cells"])
    counts = dealt.groupBy(F.col(group).alias(names["of"]), n["cell"].alias(names["at"])).agg(F.count(F.lit(1)).alias(names["rows"]))
    ahead = Window.partitionBy(names["of"]).orderBy(names["at"]).rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(names["of"], names["at"], F.coalesce(F.sum(names["rows"]).over(ahead), F.lit(0)).alias(names["before"]))
    place = Window.partitionBy(group, names["cell"]).orderBy(*order)
    ranked = dealt.withColumn(names["place"], F.row_number().over(place) - 1)
    joined = ranked.join(starts, ranked[group].eqNullSafe(n["of"]) & (n["cell"] == n["at"]))
    return joined.select(*[F.col(f"`{c}`") for c in df.columns if c != out], (n["before"] + n["place"]).cast("long").alias(out))


def _few(table: DataFrame, rows: int = 100_000) -> bool:
    """Whether a table is small enough to broadcast: its rows are counted, up to the bound."""
    return table.limit(rows + 1).count() <= rows


def partition_slots(spark: SparkSession, parts: int, each: int, kind: str) -> list[int]:
    """``parts`` x ``each`` distinct numbers that hash partitioning into ``parts`` deals evenly.

    Number k goes to partition k % parts. Groups named by these numbers fill all
    partitions alike, where groups named 0, 1, ... would collide by chance.
    """
    found: list[list[int]] = [[] for _ in range(parts)]
    low, step = 0, 16 * parts * each
    while any(len(f) < each for f in found):
        hashed = spark.range(low, low + step, 1, 1).select("id", F.pmod(F.hash(F.col("id").cast(kind)), F.lit(parts)).alias("p"))
        for row in hashed.collect():
            if len(found[row["p"]]) < each:
                found[row["p"]].append(row["id"])
        low += step
    return [found[k % parts][k // parts] for k in range(parts * each)]


def pick(numbers: list[int], at: Column, kind: str) -> Column:
    """The entry of a constant list at a place counted from 0; the list is folded into one literal."""
    return F.element_at(F.split(F.lit(",".join(map(str, numbers))), ","), at.cast("int") + 1).cast(kind)


def fresh_name(name: str, taken: Iterable[str]) -> str:
    """``name``, or ``name`` with underscores after it, that no column in ``taken`` has; Spark compares without case."""
    known = {t.lower() for t in taken}
    while name.lower() in known:
        name += "_"
    return name


def utf8(col: str | Column) -> Column:
    """A text column with null read as empty."""
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))
