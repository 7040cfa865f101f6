"""Token ids of whole texts by a public tokenizer, each distinct piece encoded once.

The tokenizer's normaliser works character by character and its splitter drops
white space, so the ids of a text are the ids of its pieces one after the
other. NumPy cuts a slice of texts into pieces (letter runs, single digits,
other runs); the tokenizers library encodes each distinct piece once, and
NumPy gathers the ids of all pieces. A word with any character for which
lower-casing, normalisation or the contraction rules need more than that stays
whole and goes through the full tokenizer. Files with another kind of splitter
are applied to whole texts.
"""

from __future__ import annotations

import itertools
import json
import os
import re
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .textscan import gather_ranges, text_buffer

#: Bytes of text encoded at a time, and pieces kept per generation of a worker's cache.
TOKEN_SLICE = 4 << 20
CACHE_PIECES = 250_000

SPACE, LETTER, DIGIT, OTHER, ODD = range(5)

_encoders: dict[str, TokenColumn] = {}


def _classes() -> np.ndarray:
    kind = np.full(256, ODD, np.uint8)
    kind[0x21:0x7F] = OTHER
    kind[[0x20, *range(0x09, 0x0E)]] = SPACE
    kind[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = LETTER
    kind[0x30:0x3A] = DIGIT
    kind[[ord("'"), ord("<")]] = ODD  # contractions; special tokens
    return kind


_KIND = _classes()


class TokenColumn:
    """Encodes Arrow string columns with one tokenizer file."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.full = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            self.by_piece = _drops_white_space(json.load(f))
        self.plain = None
        if self.by_piece:  # the same model without the steps that pieces have behind them
            self.plain = Tokenizer.from_file(path)
            self.plain.normalizer = normalizers.Sequence([])
            self.plain.pre_tokenizer = pre_tokenizers.Sequence(
                [pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)]
            )
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    @classmethod
    def of(cls, path: str) -> TokenColumn:
        """The worker's encoder of that file."""
        if path not in _encoders:
            _encoders[path] = cls(path)
        return _encoders[path]

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts (int64) and n + 1 offsets; nulls are empty texts."""
        if not self.by_piece:
            lists = [e.ids for e in self.full.encode_batch_fast(column.fill_null("").to_pylist(), add_special_tokens=False)]
            lengths = np.fromiter(map(len, lists), np.int64, len(lists))
            flat = np.fromiter(itertools.chain.from_iterable(lists), np.int64, int(lengths.sum()))
            return flat, np.concatenate(([0], np.cumsum(lengths)))
        raw, offsets = text_buffer(column)
        pieces, first = _pieces(raw, offsets)
        coded = pieces.dictionary_encode()
        ids = self._ids(_strings(coded.dictionary))
        table = np.frombuffer(b"".join(ids), np.uint32)
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        begins = np.cumsum(sizes) - sizes
        which = coded.indices.to_numpy(zero_copy_only=False)
        lengths = sizes[which]
        flat = table[gather_ranges(begins[which], lengths)].astype(np.int64)
        return flat, np.concatenate(([0], np.cumsum(lengths)))[first]

    def _ids(self, pieces: list[str]) -> list[bytes]:
        """Ids of distinct pieces as unsigned 32-bit numbers; two cache generations keep frequent pieces."""
        new, old = self.new, self.old
        missing = []
        for p in pieces:
            if p not in new:
                if p in old:
                    new[p] = old[p]
                else:
                    missing.append(p)
        plain = [p for p in missing if _is_plain(p)]
        if len(plain) < len(missing):
            odd = [p for p in missing if not _is_plain(p)]
            for p, e in zip(odd, self.full.encode_batch_fast(odd, add_special_tokens=False), strict=True):
                new[p] = array("I", e.ids).tobytes()
        for at in range(0, len(plain), 1024):
            group = plain[at : at + 1024]
            e = self.plain.encode(" ".join(group), add_special_tokens=False)
            ids = np.array(e.ids, np.uint32)
            cuts = np.flatnonzero(np.diff(np.array(e.word_ids), prepend=-1, append=len(group))).tolist()
            data = ids.tobytes()
            for p, x, y in zip(group, cuts[:-1], cuts[1:], strict=True):
                new[p] = data[4 * x : 4 * y]
        out = [new[p] for p in pieces]
        if len(new) > CACHE_PIECES:
            self.old, self.new = new, {}
        return out


def _strings(column: pa.Array) -> list[str]:
    """The values of a column whose texts hold no line feed; much faster than to_pylist."""
    if not len(column):
        return []
    whole = pa.ListArray.from_arrays(pa.array([0, len(column)], pa.int32()), column.cast(pa.string()))
    return pc.binary_join(whole, "\n")[0].as_py().split("\n")


#: ASCII without the odd characters, and the lower-case letters U+00DF-U+00FF.
_is_plain = re.compile(r"[!-&(-;=-~\xdf-\xf6\xf8-\xff]*").fullmatch


def _pieces(raw: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The pieces of all texts, and for each text (and the end) the number of its first piece.

    Letters are ASCII and the two-byte letters of Latin-1; both are lower-cased.
    """
    n = len(raw)
    kind = _KIND[raw]
    low = raw.copy()
    low[(raw >= 0x41) & (raw <= 0x5A)] += 32
    lead = np.flatnonzero(raw[:-1] == 0xC3) if n else np.zeros(0, np.int64)
    if len(lead):
        tail = raw[lead + 1]
        lead, tail = lead[(tail != 0x97) & (tail != 0xB7)], tail[(tail != 0x97) & (tail != 0xB7)]
        kind[lead] = LETTER
        kind[lead + 1] = LETTER
        low[lead[tail < 0x9F] + 1] += 32
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    change = edge[:-1].copy()
    change[1:] |= (kind[1:] != kind[:-1]) | (kind[1:] == DIGIT)
    odd = np.flatnonzero(kind == ODD)
    if len(odd):  # a word with an odd byte is one piece, as it stands
        space = kind == SPACE
        word_edge = edge[:-1] | space
        word_edge[1:] |= space[:-1]
        starts = np.flatnonzero(word_edge)
        numbers = np.unique(np.searchsorted(starts, odd, side="right") - 1)
        begins = starts[numbers]
        ends = np.append(starts, n)[numbers + 1]
        inside = gather_ranges(begins, ends - begins)
        change[inside] = False
        change[begins] = True
        low[inside] = raw[inside]
    keep = kind != SPACE
    change &= keep
    # After white space a new piece starts even if the kinds agree.
    change[1:] |= keep[1:] & ~keep[:-1]
    starts = np.flatnonzero(change)
    kept = np.concatenate(([0], np.cumsum(keep)))
    bounds = np.append(kept[starts], kept[-1]).astype(np.int64)
    data = low[keep]
    pieces = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(bounds), pa.py_buffer(data))
    return pieces, np.searchsorted(starts, offsets, side="left")


def _drops_white_space(spec: dict) -> bool:
    """Whether the file's steps are the ones that pieces stand for: NFC, lower case, byte-level runs."""
    norm = spec.get("normalizer") or {}
    kinds = [n["type"] for n in norm.get("normalizers", [norm]) if n]
    steps = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or []
    plain = all(t["content"].startswith("<") and not any(c.isspace() for c in t["content"]) and not t["lstrip"] and not t["rstrip"] for t in spec.get("added_tokens", []))
    return (
        plain
        and kinds == ["NFC", "Replace", "Lowercase"]
        and [s["type"] for s in steps] == ["Split", "ByteLevel"]
        and steps[0]["pattern"].get("Regex") == r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
        and steps[0]["behavior"] == "Removed"
        and steps[0]["invert"] is True
        and not steps[1]["add_prefix_space"]
        and not steps[1].get("use_regex", True)
    )


def with_end(flat: np.ndarray, offsets: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """Append ``end_id`` to every list of ids."""
    n = len(offsets) - 1
    out = np.full(len(flat) + n, end_id, flat.dtype)
    out[np.arange(len(flat)) + np.repeat(np.arange(n), np.diff(offsets))] = flat
    return out, offsets + np.arange(n + 1)
