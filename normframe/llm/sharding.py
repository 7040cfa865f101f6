"""Sharding by weighted rendezvous hashing, in DataFrame functions only.

Every (record key, shard) pair gets a keyed hash, read as a uniform number u in
(0, 1); the record goes to the shard with the smallest ``-ln(u) / weight``. The
chance of each shard is its share of the weights. A shard's score depends on
the key and on that shard's own id alone, so a new shard takes rows only into
itself and a removed one gives up only its own rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import gapless_rank, read_table, utf8


def rendezvous(keys: Sequence[str], shards: Sequence[tuple[int, float]]) -> Column:
    """The shard id of a record by its key columns.

    ``shards``: pairs of shard id and positive weight. Keys may be null; a null
    is a key value like any other. Equal keys get equal shards.
    """
    if not shards:
        raise ValueError("at least one shard is needed")
    if len({s for s, _ in shards}) != len(shards) or any(w <= 0 for _, w in shards):
        raise ValueError("shard ids must be distinct and weights positive")
    key = F.xxhash64(*[F.col(k) for k in keys])
    scores = []
    for shard, weight in shards:
        top = F.shiftrightunsigned(F.xxhash64(key, F.lit(int(shard))), 11)
        u = (top.cast("double") + F.lit(0.5)) * F.lit(2.0**-53)
        scores.append(F.struct((-F.log(u) / F.lit(float(weight))).alias("score"), F.lit(int(shard)).alias("shard")))
    best = F.least(*scores) if len(scores) > 1 else scores[0]
    return best["shard"]


def shard_rows(
    df: DataFrame,
    keys: Sequence[str],
    shards: Sequence[tuple[int, float]],
    grown: Sequence[tuple[int, float]] | None = None,
) -> DataFrame:
    """Add ``shard`` and, with a second shard list, ``grown_shard`` to every row.

    A narrow projection: no shuffle. Works on empty tables; rows that repeat a
    key go where the key goes, whatever their texts' length. Columns of ``df``
    with these two names are replaced, all others stay.
    """
    out = df.withColumn("shard", rendezvous(keys, shards))
    return out.withColumn("grown_shard", rendezvous(keys, grown)) if grown else out


def op8_rendezvous_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 24 equal shards by doc_id, and where a 25th shard would put them.

    Only doc_id, size and checksum are shuffled, for the slots; texts are not.
    Nulls: a null text has 8 bytes and the checksum of nothing; null ids are one key.
    """
    docs = read_table(spark, sf_dir, "documents").select(
        "doc_id",
        (F.octet_length(utf8("text")) + 8).cast("long").alias("size"),
        F.crc32(F.encode(utf8("text"), "UTF-8")).cast("long").alias("text_crc32"),
    )
    dealt = shard_rows(docs, ["doc_id"], [(s, 1.0) for s in range(24)], [(s, 1.0) for s in range(25)])
    placed = gapless_rank(dealt, "shard", ["doc_id", "text_crc32"], "slot")
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), F.col("shard").cast("int").alias("shard"), "slot",
        F.col("grown_shard").cast("int").alias("grown_shard"),
    )
