"""Best-fit decreasing packing of all documents, exact at any scale.

Best-fit decreasing looks at lengths only, and lengths are bounded by the
capacity. So the packing of any number of documents is computed from the
histogram of lengths: open bins with the same free room are interchangeable,
and whole runs of equal lengths go into whole runs of such bins in one step. A
segment tree over the possible free rooms, 0 to the capacity, finds the
tightest room that still fits in logarithmic time. The plan's size depends on
the capacity and not on the number of documents; rows then find their bin by
their rank among rows of the same length.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .orc_ids import tokenizer_path
from .shared import gapless_rank, materialize, read_table, utf8
from .textscan import slices
from .tokens import TOKEN_SLICE, TokenColumn, with_end

CAPACITY, END_ID = 4096, 1


class RoomTree:
    """A segment tree over free rooms 0..capacity: which rooms have open bins."""

    def __init__(self, capacity: int):
        self.size = 1 << (capacity + 1).bit_length()
        self.open = [0] * (2 * self.size)

    def add(self, room: int, bins: int) -> None:
        """Change the number of open bins with that free room."""
        at = room + self.size
        while at:
            self.open[at] += bins
            at >>= 1

    def tightest(self, need: int) -> int:
        """The smallest free room of at least ``need`` with an open bin, or -1."""
        at = need + self.size
        if self.open[at]:
            return need
        while at > 1:
            if not at & 1 and self.open[at + 1]:
                at += 1
                while at < self.size:
                    at = 2 * at if self.open[2 * at] else 2 * at + 1
                return at - self.size
            at >>= 1
        return -1


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing of ``histogram[length]`` items of each length.

    Rows (length, from_rank, to_rank, per_bin, first_bin, offset): items of that
    length with ranks in [from, to) go ``per_bin`` to a bin, into consecutive
    bins from ``first_bin``, at ``offset`` and the places after it. Length 0 is
    not allowed, and no length exceeds the capacity.
    """
    tree, rooms = RoomTree(capacity), {}
    steps: list[tuple[int, int, int, int, int, int]] = []
    next_bin = 0

    def put(room: int, first: int, bins: int) -> None:
        if bins:
            rooms.setdefault(room, []).append((first, bins))
            tree.add(room, bins)

    for length in sorted(histogram, reverse=True):
        if not 0 < length <= capacity:
            raise ValueError(f"length {length} is outside 1..{capacity}")
        rank, left = 0, histogram[length]
        while left:
            room = tree.tightest(length)
            if room < 0:  # as many new bins as the rest of this length fills
                room, first = capacity, next_bin
                bins = -(-left // (capacity // length))
                next_bin += bins
            else:
                first, bins = rooms[room].pop()
                tree.add(room, -bins)
            per_bin = room // length
            full = min(bins, left // per_bin)
            if full:
                steps.append((length, rank, rank + full * per_bin, per_bin, first, capacity - room))
                put(room - per_bin * length, first, full)
                rank, left = rank + full * per_bin, left - full * per_bin
            rest = bins - full
            if rest and left:  # the last items of this length share one bin
                steps.append((length, rank, rank + left, left, first + full, capacity - room))
                put(room - left * length, first + full, 1)
                full, rest, left = full + 1, rest - 1, 0
            put(room, first + full, rest)
    return steps


def pack_lengths(df: DataFrame, length_col: str, order: list[str], capacity: int) -> DataFrame:
    """Add ``sequence_id`` and ``offset``: best-fit decreasing over all rows of ``df``.

    ``df`` is read twice (for the histogram, then for the rows), so it should be
    a table. The driver takes one count per length, ``capacity`` at most.
    Ranks are spread over cells, so no length's rows meet in one task.
    """
    spark = df.sparkSession
    histogram = {int(n): int(c) for n, c in df.groupBy(length_col).count().collect()}
    steps = np.array(plan(histogram, capacity) or np.zeros((0, 6)), np.int64).reshape(-1, 6)
    steps = steps[np.lexsort((steps[:, 1], steps[:, 0]))]
    shared = spark.sparkContext.broadcast(steps)  # rows: bounded by the lengths and rooms, not by the data

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        keys = table[:, 0] << np.int64(44) | table[:, 1]
        for batch in batches:
            length = batch.column(batch.schema.get_field_index(length_col)).to_numpy(zero_copy_only=False)
            rank = batch.column(batch.schema.get_field_index("_rank")).to_numpy(zero_copy_only=False)
            row = table[np.searchsorted(keys, (length.astype(np.int64) << np.int64(44)) | rank, side="right") - 1]
            within = rank - row[:, 1]
            sequence = row[:, 4] + within // row[:, 3]
            offset = row[:, 5] + within % row[:, 3] * length
            columns = [c for c, n in zip(batch.columns, batch.schema.names, strict=True) if n != "_rank"]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(sequence), pa.array(offset)], names)

    kept = [f for f in df.schema.fields]
    names = [*(f.name for f in kept), "sequence_id", "offset"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept) + ", sequence_id bigint, offset bigint"
    ranked = gapless_rank(df, length_col, order, "_rank")
    return ranked.mapInArrow(place, schema)


def token_pieces(
    df: DataFrame, tokenizer: str, end_id: int = END_ID, capacity: int = CAPACITY, with_ids: bool = False,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """The pieces of all documents: id, piece, start, length, ids_crc32 and, if asked for, ids.

    Null and empty texts hold the end id alone: one piece of length 1. A
    document of more than ``capacity`` ids is cut into pieces of that length,
    the last may be shorter.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = TokenColumn.of(tokenizer)
        for batch in batches:
            for part in slices(batch, "text", TOKEN_SLICE):
                ids, offsets = with_end(*encoder.encode(part.column(1)), end_id)
                ids, sizes = ids.astype("<u4"), np.diff(offsets)
                pieces = -(-sizes // capacity)
                row = np.repeat(np.arange(len(sizes)), pieces)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                start = piece * capacity
                length = np.minimum(sizes[row] - start, capacity)
                at = offsets[row] + start
                crc = [zlib.crc32(ids[x : x + n]) for x, n in zip(at.tolist(), length.tolist(), strict=True)]
                columns = [part.column(0).take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array(crc, pa.int64())]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(np.append(at, len(ids)), pa.int32()), pa.array(ids.astype(np.int32))))
                yield pa.RecordBatch.from_arrays(columns, names)

    names = ["id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids
    kind = df.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids array<int>" * with_ids
    docs = df.select(F.col(id_col).alias("id"), utf8(text_col).alias("text"))
    return docs.mapInArrow(cut, schema).withColumnRenamed("id", id_col)


def pack_documents(
    df: DataFrame, tokenizer: str, end_id: int = END_ID, capacity: int = CAPACITY, with_ids: bool = False,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """Tokenise, cut and pack all documents into sequences of ``capacity`` ids.

    The pieces are written to the shared folder once, so texts are encoded once
    and a lost executor costs no more than its own tasks. An empty table gives
    no rows; repeated ids and texts are packed as often as they stand there. A
    text of any length is cut into pieces. Columns other than the id and the
    text are not read, whatever their names.
    """
    pieces = materialize(token_pieces(df, tokenizer, end_id, capacity, with_ids, id_col, text_col), "pieces")
    return pack_lengths(pieces, "length", [id_col, "piece", "ids_crc32"], capacity)


def packed_sequences(pieces: DataFrame) -> DataFrame:
    """The sequences themselves, from ``pack_documents(..., with_ids=True)``: sequence_id, ids."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    return pieces.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda p: p["ids"])).alias("ids"))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of 4096 ids, one row per piece."""
    docs = read_table(spark, sf_dir, "documents")
    out = pack_documents(docs, tokenizer_path(), END_ID, CAPACITY)
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
