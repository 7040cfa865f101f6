"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

The patterns are all windows of ten consecutive item words. Texts and patterns
are sequences of word numbers, and the search runs over those: a shift table
keyed by blocks of two words says how far a cursor may jump without missing a
pattern, suffix-hash buckets select the patterns that may end where the shift
is 0, a prefix hash thins them, and a direct comparison of the words' bytes
confirms each occurrence. Cursors over equal stretches of text advance in
lockstep, so each step is a NumPy operation.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import fresh_name, materialize, read_table, utf8
from .textscan import ALNUM, gather_ranges, slices, words

WINDOW = 10
#: Bytes of item text whose tables one pass over the documents carries: some 1.5 million windows, of 40 bytes each.
BLOCK_BYTES = 8 << 20
#: Words of text that one cursor searches.
STRETCH = 512


class Patterns:
    """Windows of equal length with their shift table and suffix buckets."""

    def __init__(self, windows: np.ndarray, items: np.ndarray):
        """``windows``: word numbers, one row for each window of each item; ``items``: the item of each."""
        self.length = windows.shape[1]
        self.windows, pattern = np.unique(windows, axis=0, return_inverse=True)
        pairs = np.unique(np.column_stack((pattern.ravel(), items)), axis=0)
        self.owners, self.first = pairs[:, 1], np.searchsorted(pairs[:, 0], np.arange(len(self.windows) + 1))
        windows = self.windows
        self.block = min(2, self.length)
        self.bits = max(10, int(4 * windows.size).bit_length())
        last = self.length - self.block
        self.shift = np.full(1 << self.bits, last + 1, np.int64)
        for at in range(last + 1):  # the block that starts there may end that far before a pattern's end
            np.minimum.at(self.shift, self.key(windows[:, at : at + self.block].T), last - at)
        suffix = self.key(windows[:, last:].T)
        self.order = np.argsort(suffix, kind="stable")
        self.suffix = suffix[self.order]
        self.prefix = self.key(windows[:, : self.block].T)

    def key(self, blocks: Iterable[np.ndarray]) -> np.ndarray:
        """The hash of blocks, given as one array for each of their words."""
        acc = np.uint64(0)
        for ids in blocks:
            acc = (acc ^ ids.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        return (acc >> np.uint64(64 - self.bits)).astype(np.int64)

    def search(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of windows and positions of their first words, wherever the ids agree."""
        n, m = len(ids), self.length
        if n < m:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.arange(m - 1, n, STRETCH)
        end = np.minimum(at + STRETCH, n)
        stops = []
        while len(at):
            jump = self.shift[self.key([ids[at - k] for k in range(self.block - 1, -1, -1)])]
            stops.append(at[jump == 0])
            at = at + np.maximum(jump, 1)
            on = at < end
            at, end = at[on], end[on]
        ends = np.concatenate(stops)
        suffix = self.key([ids[ends - k] for k in range(self.block - 1, -1, -1)])
        low = np.searchsorted(self.suffix, suffix, side="left")
        counts = np.searchsorted(self.suffix, suffix, side="right") - low
        starts = np.repeat(ends, counts) - (m - 1)
        pattern = self.order[gather_ranges(low, counts)]
        fits = self.prefix[pattern] == self.key([ids[starts + k] for k in range(self.block)])
        starts, pattern = starts[fits], pattern[fits]
        for k in range(m):
            same = self.windows[pattern, k] == ids[starts + k]
            starts, pattern = starts[same], pattern[same]
        return pattern, starts


class Benchmark:
    """The vocabulary and the patterns of a block of items."""

    def __init__(self, items: list[tuple[object, str | None]], window: int):
        self.items = [item for item, _ in items]
        found = words(pa.array([text or "" for _, text in items], pa.string()), ALNUM)
        self.hashes, first, number = np.unique(found.hashes(), return_index=True, return_inverse=True)
        self.words = [found.word(i) for i in first]
        # Words that share a hash, if any, are told apart by their bytes.
        self.clashing: dict[bytes, int] = {}
        self.doubtful = np.zeros(len(self.hashes), bool)
        for i, n in enumerate(number.tolist()):
            if (word := found.word(i)) != self.words[n]:
                self.doubtful[n] = True
                if word not in self.clashing:
                    self.clashing[word] = len(self.words)
                    self.words.append(word)
                number[i] = self.clashing[word]
        ids = (number + 1).astype(np.int32)
        sizes = np.minimum(found.counts, window)
        self.patterns = []
        for size in np.unique(sizes[sizes > 0]).tolist():
            own = np.flatnonzero(sizes == size)
            many = found.counts[own] - size + 1
            at = gather_ranges(found.first[own], many)
            self.patterns.append(Patterns(np.column_stack([ids[at + k] for k in range(size)]), np.repeat(own, many)))

    def scan(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, list[set[int]]]:
        """Words and hit flags of texts: word counts, one flag per word, and the items met in each text."""
        found = words(column, ALNUM)
        met: list[set[int]] = [set() for _ in range(found.n_docs)]
        cover = np.zeros(len(found.starts) + 1, np.int64)
        if len(self.hashes) and len(found.starts):
            hashes = found.hashes()
            at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
            known = self.hashes[at] == hashes
            ids = np.where(known, at + 1, 0).astype(np.int32)
            for i in np.flatnonzero(known & self.doubtful[at]).tolist():
                ids[i] = self.clashing.get(found.word(i), at[i]) + 1
            for group in self.patterns:
                pattern, start = group.search(ids)
                one = found.doc[start] == found.doc[start + group.length - 1]
                pattern, start = pattern[one], start[one]
                span = np.unique(gather_ranges(start, np.full(len(start), group.length)))
                wrong = {int(i) for i in span if found.word(i) != self.words[ids[i] - 1]}
                for p, s in zip(pattern.tolist(), start.tolist(), strict=True):
                    if wrong and wrong.intersection(range(s, s + group.length)):
                        continue
                    cover[s] += 1
                    cover[s + group.length] -= 1
                    met[int(found.doc[s])].update(group.owners[group.first[p] : group.first[p + 1]].tolist())
        return found.counts, np.cumsum(cover)[:-1] > 0, met


def blocks(benchmark: DataFrame, id_col: str, text_col: str, limit: int) -> Iterator[list[tuple[object, str | None]]]:
    """The items in blocks of about ``limit`` text bytes; at most two are on the driver."""
    block, size = [], 0
    for row in benchmark.select(id_col, text_col).toLocalIterator():
        block.append((row[0], row[1]))
        size += len(row[1] or "")
        if size >= limit:
            yield block
            block, size = [], 0
    if block:
        yield block


def find_leaks(
    docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text",
    window: int = WINDOW, block_bytes: int = BLOCK_BYTES, prefix: str = "leak_",
) -> DataFrame:
    """All columns of ``docs`` and, for each row, ``n_words``, ``hits`` and ``items`` (with the prefix).

    ``hits``: the runs of hit words as pairs (first word, word after the last);
    ``items``: the ids, as sorted strings, of items with a window in the text.
    Documents are not shuffled: the items' tables are broadcast, in blocks of
    bounded size. With more than one block the rows are written once, further
    passes read only the texts and write what they find. Null and empty texts, and items without
    words, have no words and match nothing; repeated rows are searched each; a text of any length is
    searched whole, in a slice of its own; an empty table gives one;
    an empty benchmark leaves all rows clean. Columns of ``docs`` that have the
    names of new ones are replaced; another prefix keeps them.
    """
    spark = docs.sparkSession
    names = tuple(prefix + n for n in ("n_words", "hits", "items"))
    docs = docs.drop(*names)
    parts = blocks(benchmark, item_id, item_text, block_bytes)
    first, second = next(parts, []), next(parts, None)
    if second is None:
        return _pass(docs, spark.sparkContext.broadcast(Benchmark(first, window)), text_col, names)
    row = fresh_name("_row", [*docs.columns, *names])
    base = materialize(_pass(docs.withColumn(row, F.monotonically_increasing_id()), spark.sparkContext.broadcast(Benchmark(first, window)), text_col, names), "leaks")
    more: DataFrame | None = None
    while second is not None:
        shared = spark.sparkContext.broadcast(Benchmark(second, window))
        met = _pass(base.select(row, text_col), shared, text_col, names).filter(F.size(names[2]) > 0).select(row, names[1], names[2])
        met = materialize(met, "more-leaks")
        shared.unpersist()
        more = met if more is None else more.union(met)
        second = next(parts, None)
    lists = [F.flatten(F.collect_list(n)).alias(f"_{n}") for n in names[1:]]
    grouped = more.groupBy(F.col(row).alias(f"{row}_of")).agg(*lists)
    joined = base.join(grouped, F.col(row) == F.col(f"{row}_of"), "left")
    both = [F.concat(n, F.coalesce(f"_{n}", F.array().cast(base.schema[n].dataType))) for n in names[1:]]
    return joined.select(*docs.columns, names[0], _joined_runs(F.array_sort(both[0])).alias(names[1]), F.array_sort(F.array_distinct(both[1])).alias(names[2]))


def _joined_runs(runs: Column) -> Column:
    """Sorted pairs (first, after the last) with those that touch or overlap made one."""

    def add(done: Column, run: Column) -> Column:
        last = F.element_at(done, -1)
        wider = F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.array(last[0], F.greatest(last[1], run[1]))))
        return F.when((F.size(done) > 0) & (F.try_element_at(F.try_element_at(done, F.lit(-1)), F.lit(2)) >= run[0]), wider).otherwise(F.concat(done, F.array(run)))

    return F.aggregate(runs, F.array().cast("array<array<bigint>>"), add)


def _pass(docs: DataFrame, shared, text_col: str, names: tuple[str, ...]) -> DataFrame:
    """``docs`` with word counts, hits and items of one block. A narrow step."""
    kept = [f for f in docs.schema.fields if f.name not in names]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables: Benchmark = shared.value
        for batch in batches:
            for part in slices(batch, text_col):
                counts, hit, met = tables.scan(part.column(part.schema.get_field_index(text_col)))
                bounds = np.concatenate(([0], np.cumsum(counts)))
                runs, found = [], [sorted({str(tables.items[i]) for i in ids}) for ids in met]
                for i in range(part.num_rows):
                    flags = hit[bounds[i] : bounds[i + 1]]
                    change = np.flatnonzero(np.diff(flags.astype(np.int8), prepend=0, append=0)) if flags.any() else np.zeros(0, np.int64)
                    runs.append(change.reshape(-1, 2).tolist())
                columns = [part.column(part.schema.get_field_index(f.name)) for f in kept]
                columns += [pa.array(counts), pa.array(runs, pa.list_(pa.list_(pa.int64()))), pa.array(found, pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays(columns, [*(f.name for f in kept), *names])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    return docs.mapInArrow(scan, f"{schema}, {names[0]} bigint, {names[1]} array<array<bigint>>, {names[2]} array<string>")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` without any hit word, with the columns of ``docs``, whatever their names."""
    prefix = "leak_"
    while any(c.lower().startswith(prefix) for c in docs.columns):
        prefix += "_"
    return find_leaks(docs, benchmark, prefix=prefix, **options).filter(F.size(prefix + "hits") == 0).select(*docs.columns)


def op10_wu_manber_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hit words and items of every document, on whole texts of both tables."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", utf8("text").alias("text"))
    found = find_leaks(docs, read_table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("leak_hits", F.lit(0).cast("long"), lambda acc, run: acc + run[1] - run[0])
    return found.select(
        "doc_id",
        F.col("leak_n_words").alias("n_words"),
        n_hit.alias("n_hit"),
        F.size("leak_items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "leak_items"), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )
