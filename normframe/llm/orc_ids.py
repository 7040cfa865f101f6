"""Token ids in ORC files: stripes, run-length encoded ids, row indexes, Bloom filters.

The ids of all texts are range-partitioned by document id, sorted, and written
by Spark's ORC writer: integer columns take ORC's run-length encoding, each
stripe carries row-group indexes, and the document id column a Bloom filter,
so a reader takes stripes in parallel and a lookup by id reads the footer, the
indexes and one row group.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.storage import shared_path
from .shared import materialize, read_table, utf8
from .textscan import slices
from .tokens import TOKEN_SLICE, TokenColumn, with_end

TOKENIZER = "word_bpe_49k.json"
#: Rows of an index group, and the filter's share of wrong "maybe"s.
INDEX_ROWS, FALSE_POSITIVES = 1000, 0.01


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def encode_documents(df: DataFrame, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` and ``ids``: the ids of each whole text, then ``end_id``. No shuffle."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = TokenColumn.of(tokenizer)
        for batch in batches:
            for part in slices(batch, "text", TOKEN_SLICE):
                ids, offsets = with_end(*encoder.encode(part.column(1)), end_id)
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([part.column(0), lists], ["id", "ids"])

    kind = df.schema[id_col].dataType.simpleString()
    docs = df.select(F.col(id_col).alias("id"), utf8(text_col).alias("text"))
    return docs.mapInArrow(encode, f"id {kind}, ids array<int>").withColumnRenamed("id", id_col)


def write_orc_ids(df: DataFrame, path: str, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write ``id_col``, ``ids`` of all documents to ORC files in ascending id order.

    Files are in order by the numbers in their names, rows in order within each; rows that share an
    id are ordered by a hash of their text, and so a repeated id is split over
    files too. Null ids come first; null and empty texts hold the end id alone. A text of any length is
    encoded whole, alone in its slice; an empty table gives files without rows. Other columns are not
    written, and an id column named "ids" raises, for the file has that column.
    """
    docs = df.select(id_col, utf8(text_col).alias(text_col)).withColumn("_tie", F.xxhash64(text_col))
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = docs.repartitionByRange(parts, id_col, "_tie").sortWithinPartitions(id_col, "_tie")
    (
        encode_documents(ordered, tokenizer, end_id, id_col, text_col)
        .write.option("orc.bloom.filter.columns", id_col)
        .option("orc.bloom.filter.fpp", str(FALSE_POSITIVES))
        .option("orc.create.index", "true")
        .option("orc.row.index.stride", str(INDEX_ROWS))
        .option("orc.compress", "ZSTD")
        .orc(path)
    )


def read_orc_ids(spark: SparkSession, path: str, id_col: str = "doc_id", kind: str = "bigint") -> DataFrame:
    """The rows of ``write_orc_ids``; filters on the id column prune stripes and row groups."""
    return spark.read.schema(f"{id_col} {kind}, ids array<int>").orc(path)


def file_number(name: str) -> Column:
    """The number in a file's name: names have five digits at least, so they are not in order themselves."""
    return F.regexp_extract(name, r"part-(\d+)", 1).cast("long")


def checksums(stored: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Per stored row: ``n_tokens``, ``ids_crc32`` and ``start``, the ids stored before it. Other columns are not read.

    Starts are sums within a file plus the totals of the files before; only
    counts are shuffled, and no task sees more than one file's rows.
    """

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            ids = lists.flatten().to_numpy(zero_copy_only=False).astype("<u4")
            sizes = np.diff(lists.offsets.to_numpy())
            at = np.concatenate(([0], np.cumsum(sizes)))
            crc = np.fromiter((zlib.crc32(ids[x:y]) for x, y in zip(at[:-1], at[1:], strict=True)), np.int64, len(sizes))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(3), pa.array(sizes.astype(np.int64)), pa.array(crc)],
                ["id", "file", "row", "n_tokens", "ids_crc32"],
            )

    kind = stored.schema[id_col].dataType.simpleString()
    rows = stored.select(
        F.col(id_col).alias("id"), F.col("_metadata.file_name").alias("file"), "ids", F.col("_metadata.file_block_start").alias("row")
    ).mapInArrow(digest, f"id {kind}, file string, row bigint, n_tokens bigint, ids_crc32 bigint")
    rows = materialize(rows.withColumn("seq", F.monotonically_increasing_id()), "digests")  # the files are decoded once
    in_file = Window.partitionBy("file").orderBy("row", "seq").rowsBetween(Window.unboundedPreceding, -1)
    in_order = Window.orderBy(file_number("file"), "file").rowsBetween(Window.unboundedPreceding, -1)
    files = rows.groupBy("file").agg(F.sum("n_tokens").alias("n")).select(
        F.col("file").alias("of"), F.coalesce(F.sum("n").over(in_order), F.lit(0)).alias("before")
    )
    placed = rows.withColumn("inside", F.coalesce(F.sum("n_tokens").over(in_file), F.lit(0)))
    return placed.join(files, placed["file"] == files["of"]).select(
        F.col("id").alias(id_col), (F.col("before") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32"
    )


def op5_orc_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode all documents, write them as ORC in doc_id order, and digest what is read back."""
    docs = read_table(spark, sf_dir, "documents")
    path = shared_path(spark, "orc-ids")
    write_orc_ids(docs, path, tokenizer_path(), end_id=2)
    return checksums(read_orc_ids(spark, path))
