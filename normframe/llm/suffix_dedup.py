"""Removal of repeated byte strings by deep-shallow sorting of suffixes.

Every byte covered by a string of ``length`` bytes that also starts earlier is
removed. Sorting all suffixes of a corpus would move each byte a hundred times,
so the suffixes are first cut down without losing a match:

1. Each window of ``length`` bytes picks an anchor by its content, the ``gram``
   bytes in it with the smallest hash. Equal windows have equal anchors. Anchors
   lie about (length - gram) / 2 bytes apart; their hashes are counted.
2. Windows whose anchor occurs once can't repeat. The others go, as stretches
   of text that share an anchor, to the bucket of the anchor's hash.
3. In a bucket the suffixes that start the windows are sorted: a multikey
   quicksort over words of eight bytes to a shallow depth, then a blind trie for
   each group with a longer common prefix. Equal windows end up in one class;
   all but the earliest are marked.
4. The marks return to their documents.

Texts are dealt to groups once; that exchange serves steps 1, 2 and 4.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .graph import whole_groups
from .shared import materialize, partition_slots, pick, read_table, utf8
from .textscan import SLICE_BYTES, gather_ranges, mix64, powers, text_buffer

LENGTH, GRAM = 100, 50
#: Depth of the multikey quicksort; longer common prefixes go to blind tries.
SHALLOW = 24
#: Stretches of one anchor beyond which its windows are dealt by their own hash, each on its own.
HOT = 20_000
#: Groups of documents, and parts of a bucket, in each shuffle partition.
GROUPS, PARTS = 2, 8


class Windows:
    """The windows of a group of texts, as stretches of consecutive windows with one anchor."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray, length: int, gram: int):
        self.raw, self.offsets = raw, offsets
        empty = np.zeros(0, np.int64)
        self.row = self.at = self.count = empty
        self.keys = np.zeros(0, np.uint64)
        n = len(raw) - length + 1
        if n < 1:
            return
        up, down = powers(len(raw) + 1)
        self.sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(raw * up[:-1], out=self.sums[1:], dtype=np.uint64)
        h = mix64((self.sums[gram:] - self.sums[:-gram]) * down[: len(raw) - gram + 1])
        bits = np.uint64(max(1, len(raw).bit_length()))
        low = (h >> bits << bits) | np.arange(len(h), dtype=np.uint64)  # the leftmost of equal hashes
        width, span = length - gram + 1, 1
        while 2 * span <= width:
            low = np.minimum(low[:-span], low[span:])
            span *= 2
        if span < width:
            low = np.minimum(low[: len(low) - (width - span)], low[width - span :])
        anchor = (low & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
        sizes = np.maximum(np.diff(offsets) - length + 1, 0)
        start = gather_ranges(offsets[:-1], sizes)  # windows within one text
        row = np.repeat(np.arange(len(sizes)), sizes)
        anchor = anchor[start]
        new = np.ones(len(start), bool)
        new[1:] = (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1])
        first = np.flatnonzero(new)
        self.row, self.at = row[first], start[first]
        self.count = np.diff(np.append(first, len(start)))
        self.keys = h[anchor[first]]

    def hashes(self, at: np.ndarray, size: np.ndarray | int) -> np.ndarray:
        """Hashes of the strings of that size at these places."""
        return mix64((self.sums[at + size] - self.sums[at]) * powers(len(self.raw) + 1)[1][at])


def deep_shallow_classes(text: np.ndarray, pos: np.ndarray, length: int, shallow: int = SHALLOW) -> tuple[np.ndarray, np.ndarray]:
    """Sort the strings of ``length`` bytes at ``pos``: their order, and the class of each in that order.

    Classes are numbered in order, and equal strings share one. ``text`` must
    go on for ``length`` bytes after each position.

    Shallow part: groups, at first all strings, are sorted by their next eight
    bytes and split, until they have one string or agree to the shallow depth.
    Deep part: each group grows a blind trie, one root-to-leaf path a round. The
    path is that of the group's first string; the others are compared with it
    once, and hang off the path where they leave it, by the byte there. Those
    that share that place and byte form the groups of the next round.
    """
    padded = np.concatenate((text, np.zeros(8, np.uint8)))
    word = np.zeros(len(text) + 1, np.uint64)
    for k in range(8):
        word = (word << np.uint64(8)) | padded[k : len(text) + 1 + k]
    order = np.arange(len(pos))
    group = np.zeros(len(pos), np.int64)  # by place in order
    live = np.arange(len(pos))  # places in groups of two and more that are not known to be equal

    def tail(depth: int) -> np.uint64:
        """A mask for the bytes of a word that lie within the length."""
        return np.uint64(0xFFFFFFFFFFFFFFFF << (8 * max(0, depth + 8 - length)) & 0xFFFFFFFFFFFFFFFF)

    def refine(keys: list[np.ndarray]) -> None:
        """Sort the live places within their groups by the keys, and split the groups where keys differ."""
        nonlocal group
        by = np.lexsort([*keys[::-1], group[live]])
        order[live] = order[live][by]
        split = np.zeros(len(live), bool)
        for k in keys:
            k[:] = k[by]
            split[1:] |= k[1:] != k[:-1]
        old = group[live]
        split[1:] |= old[1:] != old[:-1]
        new = np.ones(len(group), bool)
        new[1:] = group[1:] != group[:-1]
        new[live[split]] = True
        group = np.cumsum(new) - 1

    def pairs() -> np.ndarray:
        sizes = np.bincount(group)
        return live[sizes[group[live]] > 1]

    for depth in range(0, min(shallow, length), 8):
        if not len(live):
            break
        refine([word[pos[order[live]] + depth] & tail(depth)])
        live = pairs()
    depth = min(shallow, length)
    while len(live):
        g = group[live]
        leader = np.ones(len(live), bool)
        leader[1:] = g[1:] != g[:-1]
        mine = pos[order[live]]
        path = mine[leader][np.cumsum(leader) - 1]
        lcp = np.full(len(live), length, np.int64)
        same = np.arange(len(live))
        for d in range(depth, length, 8):
            x = (word[mine[same] + d] ^ word[path[same] + d]) & tail(d)
            off = x != 0
            where = same[off]
            # The first byte that differs is the highest one that is not zero.
            lead = np.zeros(len(where), np.int64)
            for k in range(1, 8):
                lead += (x[off] >> np.uint64(64 - 8 * k)) == 0
            lcp[where] = d + lead
            same = same[~off]
            if not len(same):
                break
        inner = np.minimum(lcp, length - 1)
        byte, turn = text[mine + inner].astype(np.int64), text[path + inner].astype(np.int64)
        side = np.where(lcp == length, 0, np.where(byte < turn, -1, 1))
        rank = np.where(side < 0, lcp, np.where(side > 0, -lcp, 0))
        byte[lcp == length] = 0
        done = lcp == length
        keys = [side, rank, byte]
        mark = done.copy()
        by = np.lexsort([byte, rank, side, g])
        refine(keys)
        live = live[~mark[by]]  # strings equal to their path's are a class
        live = pairs()
    return order, group


def _table(docs: pa.Table) -> tuple[pa.Table, np.ndarray, np.ndarray]:
    """A group's rows in a stable order, and their text bytes."""
    docs = docs.take(pc.sort_indices(docs, sort_keys=[("id", "ascending"), ("tie", "ascending")], null_placement="at_start"))
    return docs, *text_buffer(docs["text"])


def _row_slices(offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of rows with about SLICE_BYTES of text, one row at least."""
    at, n = 0, len(offsets) - 1
    while at < n:
        to = min(n, max(at + 1, int(np.searchsorted(offsets, offsets[at] + SLICE_BYTES, side="right")) - 1))
        yield at, to
        at = to


def _stretches(raw: np.ndarray, offsets: np.ndarray, length: int, gram: int, twice: np.ndarray, often: np.ndarray) -> tuple[np.ndarray, ...]:
    """Row, place, windows, anchor and content hash of the stretches whose anchor repeats.

    Stretches of an anchor that is there often are cut into single windows,
    which go by their own hash.
    """
    parts = []
    for x, y in _row_slices(offsets):
        found = Windows(raw[offsets[x] : offsets[y]], offsets[x : y + 1] - offsets[x], length, gram)
        keep = np.isin(found.keys, twice)
        row, at, count, keys = found.row[keep], found.at[keep], found.count[keep], found.keys[keep]
        if not len(at):
            continue
        if len(often) and (many := np.isin(keys, often)).any():
            n = np.where(many, count, 1)
            single = np.repeat(many, n)
            at = np.repeat(at, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            row, count = np.repeat(row, n), np.where(single, 1, np.repeat(count, n))
            keys = np.where(single, found.hashes(at, length), np.repeat(keys, n))
        parts.append((row + x, at + offsets[x], count, keys, found.hashes(at, count + length - 1)))
    return tuple(np.concatenate([p[k] for p in parts]) for k in range(5)) if parts else tuple(np.zeros(0, t) for t in (*[np.int64] * 3, *[np.uint64] * 2))


def _split(bucket: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """An order by bucket, the buckets, and the bounds of each in that order."""
    order = np.argsort(bucket, kind="stable")
    values, first = np.unique(bucket[order], return_index=True)
    return order, values, np.append(first, len(bucket))


def repeated_spans(df: DataFrame, length: int = LENGTH, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT, with_kept: bool = False) -> DataFrame:
    """One row per document: id, n_bytes, n_removed, n_spans, kept_sha256 and, if asked for, ``kept`` (the bytes).

    Texts are UTF-8 bytes, null is empty; matches stay within a text. A string
    is repeated if it also starts in a row with a smaller id, or earlier in the
    same text, judged on the input. Rows that share an id are ordered by a hash
    of their text, null ids come before all others. Ids of any type that Spark
    orders will do. Texts shorter than ``length`` are kept whole, an empty table
    gives no rows, and other columns are not read, whatever their names.
    """
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    if df.schema[id_col].dataType.simpleString() not in ("tinyint", "smallint", "int", "bigint"):
        ids = df.select(F.col(id_col).alias("_id")).filter("_id is not null").distinct().repartitionByRange(parts, "_id").sortWithinPartitions("_id")
        numbers = materialize(ids.select("_id", F.monotonically_increasing_id().alias("_number")), "ids")
        numbered = df.select(F.col(id_col).alias("_own"), F.col(text_col).alias("_text")).join(numbers, F.col("_own") == F.col("_id"), "left")
        found = repeated_spans(numbered.select("_number", "_text"), length, gram, "_number", "_text", hot, with_kept).withColumnRenamed("_number", "_n")
        named = found.join(numbers, F.col("_n") == F.col("_number"), "left")
        return named.select(F.col("_id").alias(id_col), *[c for c in found.columns if c != "_n"])
    groups, buckets = partition_slots(spark, parts, GROUPS, "int"), np.array(partition_slots(spark, parts, 1, "bigint"))
    kind = df.schema[id_col].dataType.simpleString()
    text = utf8(text_col)
    docs = df.select(F.col(id_col).alias("id"), text.alias("text"), F.xxhash64(text).alias("tie"))
    docs = docs.withColumn("dp", pick(groups, F.pmod(F.xxhash64("id", "tie"), F.lit(len(groups))), "int")).repartition(parts, "dp")

    def count_anchors(group: pa.Table) -> pa.Table:
        dp = group["dp"][0].as_py()
        _, raw, offsets = _table(group)
        found = [Windows(raw[offsets[x] : offsets[y]], offsets[x : y + 1] - offsets[x], length, gram).keys for x, y in _row_slices(offsets)]
        keys, n = np.unique(np.concatenate(found), return_counts=True)
        order, values, bounds = _split(keys % np.uint64(parts))
        rows = [order[x:y] for x, y in zip(bounds[:-1], bounds[1:], strict=True)]
        return pa.table(
            {
                "bucket": pa.array(buckets[values.astype(np.int64)]),
                "dp": pa.array([dp] * len(rows), pa.int32()),
                "keys": pa.array([keys[r].tobytes() for r in rows], pa.binary()),
                "n": pa.array([np.minimum(n[r], 1 << 31).astype(np.uint32).tobytes() for r in rows], pa.binary()),
            }
        )

    def find_repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, starts in whole_groups(batches, "bucket"):
            dps, blobs, counts = (batch.column(k) for k in (1, 2, 3))
            for x, y in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
                sets = [np.frombuffer(blobs[i].as_py(), np.uint64) for i in range(x, y)]
                keys, at = np.unique(np.concatenate(sets), return_inverse=True)
                n = np.bincount(at, np.concatenate([np.frombuffer(counts[i].as_py(), np.uint32) for i in range(x, y)]), len(keys))
                ends = np.cumsum([len(s) for s in sets])
                own = [n[at[e - len(s) : e]] for s, e in zip(sets, ends, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        dps.slice(x, y - x),
                        pa.array([s[c > 1].tobytes() for s, c in zip(sets, own, strict=True)], pa.binary()),
                        pa.array([s[c > hot].tobytes() for s, c in zip(sets, own, strict=True)], pa.binary()),
                    ],
                    ["dp", "twice", "often"],
                )

    def cut_stretches(group: pa.Table, answers: pa.Table) -> pa.Table:
        dp = group["dp"][0].as_py()
        docs, raw, offsets = _table(group)
        twice, often = (np.frombuffer(b"".join(answers[c].to_pylist()), np.uint64) for c in ("twice", "often"))
        row, at, count, keys, content = _stretches(raw, offsets, length, gram, twice, often)
        size = count + length - 1
        fields = ("docs", "rows", "starts", "sizes", "text")
        out: dict[str, list] = {c: [] for c in ("bucket", "dp", *fields, "marks")}
        if len(at):
            # Of equal stretches in this group only the first leaves it.
            _, first, same = np.unique(content, return_index=True, return_inverse=True)
            lead = first[same]
            later = np.flatnonzero((lead != np.arange(len(at))) & (size == size[lead]) & (keys == keys[lead]))
            pairs = zip(at[later].tolist(), at[lead[later]].tolist(), size[later].tolist(), strict=True)
            later = later[np.array([raw[x : x + n].tobytes() == raw[y : y + n].tobytes() for x, y, n in pairs], bool)]
            if len(later):
                start = at[later] - offsets[row[later]]
                out["bucket"].append(int(buckets[groups.index(dp) % parts]))
                out["marks"].append(np.column_stack((row[later], start, start + count[later] - 1)).astype(np.int32).tobytes())
                for c in fields:
                    out[c].append([b""] * PARTS)
            left = np.ones(len(at), bool)
            left[later] = False
            row, at, size, keys = row[left], at[left], size[left], keys[left]
            ids = docs["id"].cast(pa.int64()).fill_null(-(1 << 63)).to_numpy()
            order, values, bounds = _split(keys % np.uint64(parts * PARTS))
            cells = {int(v): order[x:y] for v, x, y in zip(values, bounds[:-1], bounds[1:], strict=True)}
            for bucket in sorted({v // PARTS for v in cells}):
                own = [cells.get(PARTS * bucket + k, np.zeros(0, np.int64)) for k in range(PARTS)]
                out["bucket"].append(int(buckets[bucket]))
                out["marks"].append(b"")
                out["docs"].append([ids[row[r]].tobytes() for r in own])
                out["rows"].append([row[r].astype(np.int32).tobytes() for r in own])
                out["starts"].append([(at[r] - offsets[row[r]]).astype(np.int32).tobytes() for r in own])
                out["sizes"].append([size[r].astype(np.int32).tobytes() for r in own])
                out["text"].append([raw[gather_ranges(at[r], size[r])].tobytes() for r in own])
        out["dp"] = [dp] * len(out["bucket"])
        kinds = [pa.int64(), pa.int32(), *[pa.list_(pa.binary())] * 5, pa.binary()]
        return pa.table({c: pa.array(v, k) for (c, v), k in zip(out.items(), kinds, strict=True)})

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, starts in whole_groups(batches, "bucket"):
            for x, y in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
                own = batch.slice(x, y - x)
                dps = own.column(1).to_numpy()
                marks: dict[int, list[bytes]] = {}
                for dp, b in zip(dps.tolist(), own.column(7).to_pylist(), strict=True):
                    if b:
                        marks.setdefault(dp, []).append(b)
                columns = [own.column(k) for k in range(2, 7)]
                for part in range(PARTS):
                    cells = [[c[i][part].as_py() for i in range(len(c))] for c in columns]
                    ids, rows, at, sizes = (np.frombuffer(b"".join(c), t).astype(np.int64) for c, t in zip(cells, (np.int64, np.int32, np.int32, np.int32), strict=False))
                    if len(ids):
                        dp = np.repeat(dps, [len(b) // 8 for b in cells[0]]).astype(np.int64)
                        text = np.frombuffer(b"".join(cells[4]), np.uint8)
                        for d, found in _later(ids, dp, rows, at, sizes, text, length):
                            marks.setdefault(d, []).append(found.tobytes())
                if marks:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(list(marks), pa.int32()), pa.array([b"".join(m) for m in marks.values()], pa.binary())], ["dp", "marks"]
                    )

    def digest(group: pa.Table, marks: pa.Table) -> pa.Table:
        docs, raw, offsets = _table(group)
        found = np.frombuffer(b"".join(marks["marks"].to_pylist()), np.int32).reshape(-1, 3).astype(np.int64)
        found = found[np.argsort(found[:, 0], kind="stable")]
        n_removed, n_spans, kept = [], [], []
        for x, y in _row_slices(offsets):
            own = found[slice(*np.searchsorted(found[:, 0], (x, y)))]
            bounds = offsets[x : y + 1] - offsets[x]
            cover = np.zeros(bounds[-1] + 1, np.int64)
            np.add.at(cover, bounds[own[:, 0] - x] + own[:, 1], 1)
            np.add.at(cover, bounds[own[:, 0] - x] + own[:, 2] + length, -1)
            gone = np.cumsum(cover)[:-1] > 0
            starts = gone.copy()
            starts[1:] &= ~gone[:-1]
            inner = bounds[(bounds > 0) & (bounds < len(gone))]
            starts[inner] = gone[inner]
            for flags, into in ((gone, n_removed), (starts, n_spans)):
                into.append(np.diff(np.concatenate(([0], np.cumsum(flags)))[bounds]))
            text = raw[offsets[x] : offsets[y]]
            kept += [text[a:b][~gone[a:b]].tobytes() for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
        out = {
            "id": docs["id"], "n_bytes": pa.array(np.diff(offsets)), "n_removed": pa.array(np.concatenate(n_removed)), "n_spans": pa.array(np.concatenate(n_spans)),
            "kept_sha256": pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string()),
        }
        return pa.table(out | ({"kept": pa.array(kept, pa.binary())} if with_kept else {}))

    dealt = docs.groupBy("dp")
    anchors = dealt.applyInArrow(count_anchors, "bucket bigint, dp int, keys binary, n binary")
    repeated = anchors.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(find_repeated, "dp int, twice binary, often binary")
    stretches = dealt.cogroup(repeated.groupBy("dp")).applyInArrow(
        cut_stretches, "bucket bigint, dp int, docs array<binary>, rows array<binary>, starts array<binary>, sizes array<binary>, text array<binary>, marks binary"
    )
    marks = stretches.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(mark, "dp int, marks binary")
    schema = f"id {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string" + ", kept binary" * with_kept
    return dealt.cogroup(marks.groupBy("dp")).applyInArrow(digest, schema).withColumnRenamed("id", id_col)


def _later(ids: np.ndarray, dp: np.ndarray, rows: np.ndarray, at: np.ndarray, sizes: np.ndarray, text: np.ndarray, length: int) -> Iterator[tuple[int, np.ndarray]]:
    """For each group of documents the runs (row, first start, last start) of windows that also start earlier."""
    base = np.cumsum(sizes) - sizes
    count = sizes - length + 1
    pos = gather_ranges(base, count)
    stretch = np.repeat(np.arange(len(ids)), count)
    start = at[stretch] + pos - base[stretch]
    place = np.empty(len(ids), np.int64)  # of the stretch by document; windows follow in order within it
    place[np.lexsort((at, rows, dp, ids))] = np.arange(len(ids))
    order, group = deep_shallow_classes(text, pos, length)
    when = place[stretch[order]] << np.int64(32) | start[order]
    first = np.ones(len(group), bool)
    first[1:] = group[1:] != group[:-1]
    low = np.minimum.reduceat(when, np.flatnonzero(first))
    late = np.zeros(len(pos), bool)
    late[order] = when != low[group]
    # Runs of marked windows within a stretch.
    edge = np.ones(len(pos), bool)
    edge[1:] = (stretch[1:] != stretch[:-1]) | ~late[:-1]
    begin = np.flatnonzero(late & edge)
    stop = np.ones(len(pos), bool)
    stop[:-1] = (stretch[1:] != stretch[:-1]) | ~late[1:]
    end = np.flatnonzero(late & stop)
    triples = np.column_stack((rows[stretch[begin]], start[begin], start[end])).astype(np.int32)
    owner, values, bounds = _split(dp[stretch[begin]])
    for v, x, y in zip(values.tolist(), bounds[:-1], bounds[1:], strict=True):
        yield v, triples[owner[x:y]]


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without repeated strings of 100 bytes."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return repeated_spans(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
