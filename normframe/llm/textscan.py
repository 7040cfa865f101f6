"""Vectorised scans over the bytes of Arrow string columns.

Texts are taken as one byte buffer with offsets, as Arrow holds them, and cut
into word spans and 64-bit word hashes with NumPy: no step runs per word in
Python. Slices of bounded size keep the temporary arrays small.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that one NumPy pass handles (a longer text is handled alone).
SLICE_BYTES = 2 << 20

_BASE = 0x9E3779B97F4A7C55  # odd, so powers have inverses modulo 2**64
_powers: tuple[np.ndarray, np.ndarray] = (np.ones(1, np.uint64), np.ones(1, np.uint64))


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (xor-shift and multiply)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the hash base and of its inverse, modulo 2**64."""
    global _powers
    if len(_powers[0]) < n:
        size = max(n, SLICE_BYTES + 1)
        out = []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            p = np.full(size, np.uint64(base), np.uint64)
            p[0] = 1
            out.append(np.multiply.accumulate(p))
        _powers = (out[0], out[1])
    return _powers[0][:n], _powers[1][:n]


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (n + 1, from 0) of a string column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offs, data = column.buffers()
    offsets = np.frombuffer(offs, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive slices of a batch with at most ``limit`` bytes of text, one row at least."""
    n = batch.num_rows
    if n == 0:
        return
    _, offsets = text_buffer(batch.column(batch.schema.get_field_index(column)))
    at = 0
    while at < n:
        to = int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1
        to = min(max(to, at + 1), n)
        yield batch.slice(at, to - at)
        at = to


def byte_table(keep: bytes | range | set[int]) -> np.ndarray:
    """A 256-entry table that lower-cases A-Z and maps bytes outside ``keep`` to 0."""
    table = np.zeros(256, np.uint8)
    for b in range(256):
        low = b + 32 if 65 <= b <= 90 else b
        if low in keep:
            table[b] = low
    return table


#: Words between ASCII white space, A-Z lower-cased. A zero byte within a word
#: would read as a separator in the table, so it is mapped to 32, which no word holds.
SPACED = byte_table(set(range(256)) - {0x20, *range(0x09, 0x0E)})
SPACED[0] = 32
#: Words of ASCII letters, digits and every byte from 0x80 up, A-Z lower-cased.
ALNUM = byte_table({*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)})


class Words:
    """The words of a slice of texts: spans, document numbers and 64-bit hashes."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray, table: np.ndarray):
        self.offsets = offsets
        self.n_docs = len(offsets) - 1
        self.bytes = low = table[raw]
        word = low != 0
        edge = np.zeros(len(low) + 1, bool)
        edge[offsets] = True
        first = word.copy()
        first[1:] &= ~word[:-1] | edge[1:-1]
        last = word.copy()
        last[:-1] &= ~word[1:] | edge[1:-1]
        self.starts = np.flatnonzero(first)
        self.ends = np.flatnonzero(last) + 1
        self.doc = np.searchsorted(offsets, self.starts, side="right") - 1
        self.counts = np.bincount(self.doc, minlength=self.n_docs).astype(np.int64)
        #: Word numbers at which documents start, n_docs + 1 of them.
        self.first = np.concatenate(([0], np.cumsum(self.counts)))

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word's (lower-cased) bytes."""
        if not len(self.starts):
            return np.zeros(0, np.uint64)
        up, down = powers(len(self.bytes) + 1)
        sums = np.zeros(len(self.bytes) + 1, np.uint64)
        np.cumsum(self.bytes * up[:-1], out=sums[1:], dtype=np.uint64)
        h = (sums[self.ends] - sums[self.starts]) * down[self.starts]
        return mix64(h + (self.ends - self.starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))

    def word(self, i: int) -> bytes:
        return self.bytes[self.starts[i] : self.ends[i]].tobytes()


def words(column: pa.Array, table: np.ndarray) -> Words:
    return Words(*text_buffer(column), table)


def shingles(found: Words, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the word n-grams of each document and their document numbers.

    A document with fewer words than ``width``, but not none, has one: its
    whole word sequence. Repeats are kept.
    """
    h = found.hashes()
    step = np.uint64(0xA24BAED4963EE407)
    if len(h) >= width:
        acc = h[: len(h) - width + 1].copy()
        for k in range(1, width):
            acc *= step
            acc += h[k : len(h) - width + 1 + k]
        whole = found.doc[: len(acc)] == found.doc[width - 1 :]
        hashed, doc = mix64(acc[whole]), found.doc[: len(acc)][whole]
    else:
        hashed, doc = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    short = np.flatnonzero((found.counts > 0) & (found.counts < width))
    if len(short):
        extra = []
        for d in short:
            acc = np.uint64(found.counts[d])
            with np.errstate(over="ignore"):
                for x in h[found.first[d] : found.first[d + 1]]:
                    acc = acc * step + x
            extra.append(acc)
        hashed = np.concatenate((hashed, mix64(np.array(extra, np.uint64) ^ np.uint64(0x5851F42D4C957F2D))))
        doc = np.concatenate((doc, short))
        order = np.argsort(doc, kind="stable")
        hashed, doc = hashed[order], doc[order]
    return hashed, doc


def gather_ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The indices start, start + 1, ... of several ranges, one after the other."""
    total = int(lengths.sum())
    if total == 0:
        return np.zeros(0, np.int64)
    before = np.cumsum(lengths) - lengths
    return np.repeat(starts - before, lengths) + np.arange(total)
