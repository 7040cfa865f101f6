"""Runs of words that repeat with a period, found by a sparse dynamic program over diagonals.

A run of period q is a diagonal of matches: each of its words equals the word q
before it. A word's earlier occurrences name the lags at which it matches; a
lag that matched at the word before has its match length incremented, and a lag
that no occurrence carries on has ended: if long enough, its run is emitted at
once, and only live lags are kept.

So that a frequent word does not meet all its occurrences, lags are taken by
doubling ranges. For lags from B to 2B - 1 the program steps by blocks of B
words: a run has four periods, so its diagonal holds two whole blocks, and a
block has few occurrences in so short a window, but for those within a run
found before, whose multiples of the period need no diagonal. Work is in
proportion to n log n for any text, with one word repeated throughout too. The
ends of a diagonal are settled word by word, and every match is confirmed on
the words themselves.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import fresh_name, read_table, utf8
from .textscan import SPACED, Words, gather_ranges, mix64, slices, text_buffer

#: A run has so many words, and so many periods, at least.
LEAST_WORDS, LEAST_PERIODS = 6, 4

RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


class Runs:
    """The runs of one sequence of word numbers, as far as they are known."""

    def __init__(self, words: np.ndarray):
        self.words = words
        self.period: dict[tuple[int, int], int] = {}  # by start and end
        self._cover()

    def _cover(self) -> None:
        spans = sorted(self.period)
        self.starts = np.array([s for s, _ in spans], np.int64)
        self.reach = np.maximum.accumulate(np.array([e for _, e in spans], np.int64)) if spans else self.starts

    def inside(self, first: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Whether words ``first`` to ``end`` are all in one run of those covered."""
        if not len(self.starts):
            return np.zeros(len(first), bool)
        at = np.searchsorted(self.starts, first, side="right") - 1
        return (at >= 0) & (self.reach[np.maximum(at, 0)] >= end)

    def find(self) -> None:
        """All runs, by doubling ranges of the period."""
        width, at, name = 1, np.arange(len(self.words)), self.words
        while len(at) and LEAST_PERIODS * width <= len(self.words):
            order = np.argsort(name, kind="stable")  # by name, then by place
            same = np.concatenate(([False], name[order[1:]] == name[order[:-1]], [False]))
            order = order[same[1:] | same[:-1]]  # a block that stands once is in no run
            self._scan(name[order], at[order], width)
            order.sort()
            at, name = at[order], name[order]
            second = np.searchsorted(at, at + width)
            pair = np.flatnonzero(at[np.minimum(second, len(at) - 1)] == at + width) if len(at) else order
            name = mix64(name[pair].astype(np.uint64) * np.uint64(0xA24BAED4963EE407) + name[second[pair]].astype(np.uint64))
            at, width = at[pair], 2 * width

    def _scan(self, name: np.ndarray, at: np.ndarray, width: int) -> None:
        """Runs with a period from ``width`` to twice that: the diagonals of blocks that start at multiples of it."""
        now = np.flatnonzero(at % width == 0)
        now = now[~self.inside(at[now] - 2 * width + 1, at[now] + width)]
        blocks, lags, back = [], [], 1
        while len(now):
            now = now[now >= back]
            lag = at[now] - at[now - back]
            near = (name[now - back] == name[now]) & (lag > 0) & (lag < 2 * width)
            now, lag = now[near], lag[near]
            new = (lag >= width) & ~self.inside(at[now] - lag, at[now] + width)
            blocks.append(at[now[new]] // width)
            lags.append(lag[new])
            back += 1
        if not blocks:
            return
        block, lag = np.concatenate(blocks), np.concatenate(lags)
        order = np.lexsort((lag, block))
        for q, first, last in _ended(block[order].tolist(), lag[order].tolist()):
            if last - first >= (LEAST_WORDS - 1 if width == 1 else 2):
                self._emit(q, first * width, last * width)
        self._cover()

    def _emit(self, q: int, first: int, end: int) -> None:
        """Lengthen a diagonal of lag ``q`` by words, and keep its run if it is one."""
        w = self.words
        while end < len(w) and w[end] == w[end - q]:
            end += 1
        while first > q and w[first - 1] == w[first - 1 - q]:
            first -= 1
        breaks = np.flatnonzero(w[first:end] != w[first - q : end - q])  # of names, not of words: none but by a collision of hashes
        for a, b in zip([first, *(first + breaks + 1).tolist()], [*(first + breaks).tolist(), end], strict=True):
            if b - a + q >= max(LEAST_WORDS, LEAST_PERIODS * q):
                self.period.setdefault((a - q, b), q)


def _ended(blocks: list[int], lags: list[int]) -> Iterator[tuple[int, int, int]]:
    """Lag, first block and end of each diagonal, as soon as it ends; the pairs come by block."""
    active: dict[int, int] = {}
    grown: dict[int, int] = {}
    last = -1
    for block, lag in zip([*blocks, -1], [*lags, 0], strict=True):
        if block != last:
            yield from ((q, last - n, last) for q, n in active.items())  # not carried on by the last block
            active, grown = grown, {}
            if block != last + 1:
                yield from ((q, last + 1 - n, last + 1) for q, n in active.items())
                active = {}
            last = block
        grown[lag] = active.pop(lag, 0) + 1


def runs_of(words: np.ndarray) -> np.ndarray:
    """Start, length and period of all runs of a sequence of numbers, by start, then period."""
    found = Runs(words)
    found.find()
    rows = sorted((s, e - s, q) for (s, e), q in found.period.items())
    rows.sort(key=lambda r: (r[0], r[2]))
    return np.array(rows, np.int64).reshape(-1, 3)


class _Slice:
    """The words of a slice of texts, each numbered within its own text, and their runs."""

    def __init__(self, column: pa.Array):
        self.raw, offsets = text_buffer(column)
        self.found = found = Words(self.raw, offsets, SPACED)
        lengths = found.ends - found.starts
        bounds = np.concatenate(([0], np.cumsum(lengths)))
        spelled = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(lengths), [None, pa.py_buffer(bounds), pa.py_buffer(self.raw[gather_ranges(found.starts, lengths)])])
        coded = spelled.dictionary_encode()
        number = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        self.runs = runs_of(number * found.n_docs + found.doc)  # words of different texts differ
        self.doc = found.doc[self.runs[:, 0]] if len(self.runs) else np.zeros(0, np.int64)

    def run_column(self) -> pa.ListArray:
        start = self.runs[:, 0] - self.found.first[self.doc]
        items = pa.StructArray.from_arrays([pa.array(start), pa.array(self.runs[:, 1]), pa.array(self.runs[:, 2])], fields=list(RUN))
        ends = np.searchsorted(self.doc, np.arange(self.found.n_docs + 1))
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), items)

    def collapsed(self) -> pa.LargeStringArray:
        """Each text's words, joined by spaces, without those behind the first period of a run."""
        found, n = self.found, len(self.found.starts)
        drops = np.zeros(n + 1, np.int64)
        np.add.at(drops, self.runs[:, 0] + self.runs[:, 2], 1)
        np.add.at(drops, self.runs[:, 0] + self.runs[:, 1], -1)
        kept = np.flatnonzero(np.cumsum(drops[:-1]) == 0)
        lengths = found.ends[kept] - found.starts[kept] + 1
        at = gather_ranges(found.starts[kept], lengths)
        closing = np.cumsum(lengths) - 1
        data = self.raw[np.minimum(at, len(self.raw) - 1)] if len(at) else self.raw[:0].copy()
        data[closing] = 0x20
        firsts = np.searchsorted(found.doc[kept], np.arange(found.n_docs + 1))
        ends = np.concatenate(([0], closing + 1))[firsts]  # of each text, with a space behind its last word
        last = np.zeros(len(data), bool)
        last[ends[1:][np.diff(ends) > 0] - 1] = True
        bounds = ends - np.concatenate(([0], np.cumsum(np.diff(ends) > 0)))
        return pa.LargeStringArray.from_buffers(found.n_docs, pa.py_buffer(bounds), pa.py_buffer(data[~last]))


def periodic_runs(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: ``id_col``, ``n_words``, ``runs`` (start, length and smallest period of each, in words, by start and period) and ``collapsed``.

    Words are what ASCII white space parts. A run has six words and four periods
    at least, and no neighbouring word carries its period on. ``collapsed`` is
    the text without the words behind the first period of any run, words joined
    by single spaces.

    No shuffle: a task takes a slice of texts at a time, or one long text alone,
    in memory in proportion to it. Null and empty texts have no words, no runs
    and an empty collapsed text; rows with equal or null ids are rows like any
    other; an empty table gives an empty one. Other columns are not returned. An
    output column whose name is ``id_col`` gets an underscore.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                done = _Slice(part.column(1))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(done.found.counts), done.run_column(), done.collapsed().cast(pa.string())], ["id", "n_words", "runs", "collapsed"]
                )

    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(F.col(id_col).alias("id"), utf8(text_col).alias("text"))
    found = rows.mapInArrow(scan, f"id {kind}, n_words bigint, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string")
    return found.select(F.col("id").alias(id_col), *[F.col(c).alias(fresh_name(c, [id_col])) for c in ("n_words", "runs", "collapsed")])


def cyclic_order(doc_id: int, n: int) -> np.ndarray | None:
    """The word numbers that the query's tenth of the documents repeats, or None for the others."""
    h = zlib.crc32(str(doc_id).encode())
    g = h // 10
    if h % 10 or not n:
        return None
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    i = np.arange(n)
    return np.where(i < a, i, a + (i - a) % p)


def with_cycles(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``text``; the documents that ``cyclic_order`` names have their words in that order, joined by spaces. A null id has none."""
    cut = re.compile(rb"[^\x20\x09-\x0D]+").findall

    def reorder(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1)
            chosen = [k for k, i in enumerate(ids) if i is not None and zlib.crc32(str(i).encode()) % 10 == 0]
            changed = []
            for k in chosen:
                words = cut((texts[k].as_py() or "").encode())
                order = cyclic_order(ids[k], len(words))
                changed.append(b" ".join([words[i] for i in order]).decode() if order is not None else "")
            if chosen:
                mask = np.zeros(len(ids), bool)
                mask[chosen] = True
                texts = pc.replace_with_mask(texts, pa.array(mask), pa.array(changed, texts.type))
            yield pa.RecordBatch.from_arrays([batch.column(0), texts], ["doc_id", "text"])

    return docs.select("doc_id", utf8("text").alias("text")).mapInArrow(reorder, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, text string")


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The runs of all documents, a tenth of which are made cyclic: count, longest run, and digests of the runs and of what is kept."""
    found = periodic_runs(with_cycles(read_table(spark, sf_dir, "documents")))
    ordered = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("negative"), r["start"].alias("start"), r["period"].alias("period"))))
    line = F.transform("runs", lambda r: F.concat_ws(",", *[r[c].cast("string") for c in ("start", "length", "period")]))
    listed = F.when(F.size("runs") > 0, F.concat(F.array_join(line, "\n"), F.lit("\n"))).otherwise("")
    return found.withColumn("best", ordered).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("best.start").alias("start"),
        (-F.col("best.negative")).alias("length"),
        F.col("best.period").alias("period"),
        F.expr("(-best.negative * 1000) div best.period").alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
