"""Byte-level BPE as a transducer over bytes, and streaming decoding by a UTF-8 automaton.

Whether tokens follow each other in an encoding depends on neighbours alone: a
list of tokens is the encoding of its bytes if and only if every two neighbours
are the encoding of theirs. So every prefix of a text has one encoding, and its
last token is the only token ending there that is compatible with the last
token of the prefix before it.

The vocabulary is a trie, in which a token may begin behind every byte. That
automaton is determinised as texts need it: a state is the set of places in the
trie that are open, and knows the tokens that end with the byte just read.
The transducer keeps the last token of each prefix that an open place begins
behind; merges come in as the relation of compatible neighbours, which is also
worked out when it is first asked for. A token is emitted when all prefixes that
are still open have it in common, which looks ahead by a few bytes, not by the text.

Decoding runs tokens through a second automaton, over the bytes of UTF-8; its
moves by whole tokens are kept, and a character's bytes may lie in several tokens.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .orc_ids import tokenizer_path
from .shared import fresh_name, read_table, utf8
from .textscan import slices

VOCABULARY = "byte_bpe_50k.tiktoken"
#: Bytes of text encoded at a time; states, pairs of tokens and distinct pieces that a worker keeps before it starts them anew; the longest piece that is kept.
BPE_SLICE, MOST_STATES, MOST_PAIRS, MOST_PIECES, KEPT_BYTES = 4 << 20, 200_000, 500_000, 250_000, 64
#: Bytes of a piece after which the tokens that are certain are emitted.
WINDOW = 4096

_coders: dict[str, ByteBpe] = {}
_decoders: dict[str, Decoder] = {}


def split_pattern() -> str:
    """The pattern whose matches are encoded one by one."""
    import public_tokenizers

    return public_tokenizers.PATTERN


def read_ranks(path: str) -> dict[bytes, int]:
    """The tokens of a vocabulary file and their ranks, which are their ids."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


class State(dict):
    """A set of open places in the trie; maps bytes to the next state, made when first asked for."""

    __slots__ = ("ends", "nodes", "owner")

    def __init__(self, owner: Transducer, nodes: tuple[int, ...]):
        self.owner = owner
        #: Tokens that end here and their lengths, the longest first.
        self.ends = [(owner.token_at[n], owner.depth[n]) for n in nodes if owner.token_at[n] >= 0 and owner.reachable(owner.token_at[n])]
        self.nodes = tuple(n for n in nodes if owner.children[n])

    def __missing__(self, byte: int) -> State:
        after = self[byte] = self.owner.after(self.nodes, byte)
        return after


class Transducer:
    """The merges of one vocabulary, compiled as far as texts have needed them."""

    def __init__(self, ranks: dict[bytes, int]):
        missing = [b for b in range(256) if bytes([b]) not in ranks]
        if missing:
            raise ValueError(f"the vocabulary has no token for bytes {missing}")
        self.ranks = ranks
        self.spelling = {i: t for t, i in ranks.items()}
        self.size = max(self.spelling) + 1
        self.children: list[dict[int, int]] = [{}]
        self.token_at, self.depth = [-1], [0]
        for token, rank in ranks.items():
            node = 0
            for b in token:
                if b not in self.children[node]:
                    self.children[node][b] = len(self.children)
                    self.children.append({})
                    self.token_at.append(-1)
                    self.depth.append(self.depth[node] + 1)
                node = self.children[node][b]
            self.token_at[node] = rank
        self.pairs: dict[int, bool] = {}
        self.states: dict[tuple[int, ...], State] = {}
        self.start = State(self, (0,))

    def merged(self, text: bytes) -> list[int]:
        """The definition: merge the neighbours of lowest rank, the first of equal ones, until none is left. For a few bytes at a time."""
        none, rank = self.size, self.ranks.get
        parts = [text[k : k + 1] for k in range(len(text))]
        joined = [rank(a + b, none) for a, b in zip(parts, parts[1:])]
        while joined and (best := min(joined)) < none:
            k = joined.index(best)
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
            del joined[k]
            if k:
                joined[k - 1] = rank(parts[k - 1] + parts[k], none)
            if k < len(joined):
                joined[k] = rank(parts[k] + parts[k + 1], none)
        return [self.ranks[p] for p in parts]

    def reachable(self, token: int) -> bool:
        """Whether merging a token's bytes gives the token; others can't come out of merges."""
        return self.merged(self.spelling[token]) == [token]

    def compatible(self, left: int, right: int) -> bool:
        """Whether the two tokens are the encoding of their bytes; -1 stands for the beginning of a piece."""
        if len(self.pairs) >= MOST_PAIRS:
            self.pairs.clear()
        text = b"" if left < 0 else self.spelling[left] + self.spelling[right]
        ok = self.pairs[left * self.size + right] = not text or (text not in self.ranks and self.merged(text) == [left, right])
        return ok

    def after(self, nodes: tuple[int, ...], byte: int) -> State:
        """The state behind a byte: each open place moves or closes, and a token may begin with the byte."""
        children = self.children
        moved = [children[n][byte] for n in nodes if byte in children[n]]
        key = tuple(moved if 0 in nodes else [*moved, children[0][byte]])  # from the longest to the shortest
        state = self.states.get(key)
        if state is None:
            if len(self.states) >= MOST_STATES:  # the walk that is under way goes on from the state in its hand
                for s in self.states.values():
                    s.clear()
                self.states.clear()
                self.start.clear()
            state = self.states[key] = State(self, key)
        return state

    def emit(self, data: bytes) -> Iterator[list[int]]:
        """The ids of one piece, in parts, as soon as they are certain."""
        state, last, pairs, size = self.start, [-1], self.pairs, self.size
        for low in range(0, len(data), WINDOW):
            for b in data[low : low + WINDOW]:
                state = state[b]
                for token, length in state.ends:
                    left = last[-length]
                    ok = pairs.get(left * size + token)
                    if self.compatible(left, token) if ok is None else ok:
                        last.append(token)
                        break
            if low + WINDOW < len(data):
                ids, last = self._certain(state, last)
                yield ids
        yield self._back(last, len(last) - 1)

    def _back(self, last: list[int], at: int) -> list[int]:
        """The tokens that end at a place, read from the last one back."""
        out = []
        while at:
            out.append(last[at])
            at -= len(self.spelling[last[at]])
        return out[::-1]

    def _certain(self, state: State, last: list[int]) -> tuple[list[int], list[int]]:
        """The tokens that all open prefixes have in common, and the last tokens from there on."""
        n = len(last) - 1
        places = {n - self.depth[k] for k in state.nodes} | {n}
        while len(places) > 1:
            latest = max(places)
            places.remove(latest)
            places.add(latest - len(self.spelling[last[latest]]))
        common = places.pop()
        return self._back(last, common), last[common:]

    def encode(self, data: bytes) -> list[int]:
        return [i for ids in self.emit(data) for i in ids]


class ByteBpe(dict):
    """Encoder of one vocabulary file; maps pieces to their ids as packed bytes."""

    def __init__(self, path: str):
        import regex

        self.ranks = read_ranks(path)
        self.transducer = Transducer(self.ranks)
        self.cut = regex.compile(split_pattern()).findall

    @classmethod
    def of(cls, path: str) -> ByteBpe:
        """The worker's encoder of that file."""
        if path not in _coders:
            _coders[path] = cls(path)
        return _coders[path]

    def __missing__(self, piece: str) -> bytes:
        data = piece.encode()
        whole = self.ranks.get(data)  # a piece that is a token is that token
        packed = array("I", self.transducer.encode(data) if whole is None else [whole]).tobytes()
        if len(data) <= KEPT_BYTES:
            if len(self) >= MOST_PIECES:
                self.clear()
            self[piece] = packed
        return packed

    def encode(self, text: str) -> bytes:
        """The ids of a whole text as little-endian unsigned 32-bit numbers."""
        return b"".join(map(self.__getitem__, self.cut(text)))


#: Lead bytes of UTF-8, the bytes that may follow first, and how many follow.
SEQUENCES = (
    (0x00, 0x7F, 0, 0, 0),
    (0xC2, 0xDF, 0x80, 0xBF, 1),
    (0xE0, 0xE0, 0xA0, 0xBF, 2),
    (0xE1, 0xEC, 0x80, 0xBF, 2),
    (0xED, 0xED, 0x80, 0x9F, 2),
    (0xEE, 0xEF, 0x80, 0xBF, 2),
    (0xF0, 0xF0, 0x90, 0xBF, 3),
    (0xF1, 0xF3, 0x80, 0xBF, 3),
    (0xF4, 0xF4, 0x80, 0x8F, 3),
)


def _utf8_moves() -> list[list[int]]:
    """Rows of states, columns of bytes: the next state, or -1. State 0 is between characters; states 1 to 3 await as many more bytes; others limit the next byte."""
    moves = [[-1] * 256 for _ in range(4)]
    for left in (1, 2, 3):
        moves[left][0x80:0xC0] = [left - 1] * 64
    for low, high, first, last, more in SEQUENCES:
        state = more
        if more and (first, last) != (0x80, 0xBF):
            state = len(moves)
            moves.append([-1] * 256)
            moves[state][first : last + 1] = [more - 1] * (last + 1 - first)
        moves[0][low : high + 1] = [state] * (high + 1 - low)
    return moves


UTF8_MOVES = _utf8_moves()


class Pending(dict):
    """The bytes of an unfinished character; maps tokens to the text they complete and to what is then pending."""

    def __init__(self, decoder: Decoder, state: int, data: bytes):
        self.decoder, self.state, self.data = decoder, state, data

    def __missing__(self, token: int) -> tuple[str, Pending]:
        move = self[token] = self.decoder.step(self, self.decoder.spelling[token])
        return move


class Decoder:
    """Ids to text, with no more state between ids than an unfinished character. Wrong bytes become U+FFFD, one for each longest beginning of a character."""

    def __init__(self, spelling: dict[int, bytes]):
        self.spelling = spelling
        self.pending: dict[bytes, Pending] = {}
        self.start = self._pending(0, b"")

    @classmethod
    def of(cls, path: str) -> Decoder:
        """The worker's decoder of that file."""
        if path not in _decoders:
            _decoders[path] = cls({i: t for t, i in read_ranks(path).items()})
        return _decoders[path]

    def _pending(self, state: int, data: bytes) -> Pending:
        if data not in self.pending:
            self.pending[data] = Pending(self, state, data)
        return self.pending[data]

    def step(self, at: Pending, data: bytes) -> tuple[str, Pending]:
        """The text that ``data`` completes, and what is pending behind it."""
        out, state, held = [], at.state, bytearray(at.data)
        for b in data:
            after = UTF8_MOVES[state][b]
            if after < 0 and state:  # the character breaks off, and the byte may begin another
                out.append("�")
                held.clear()
                after = UTF8_MOVES[0][b]
            if after < 0:
                out.append("�")
                after = 0
            else:
                held.append(b)
                if not after:
                    out.append(held.decode())
                    held.clear()
            state = after
        return "".join(out), self._pending(state, bytes(held))

    def stream(self, ids: Iterable[int]) -> Iterator[str]:
        """The text completed by each id in turn, and at the end U+FFFD for an unfinished character."""
        row = self.start
        for i in ids:
            text, row = row[i]
            yield text
        if row.data:
            yield "�"


def encode_bpe(df: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` and ``ids``: the ids of each whole text, packed as little-endian unsigned 32-bit numbers.

    Each match of the split pattern is encoded by itself, without special
    tokens. No shuffle; a worker keeps a bounded number of states, pairs and short
    pieces, and makes them again when they are asked for again. Very long texts take
    time in proportion to their length, without white space too. Null and empty texts have no
    ids; equal and null row ids are rows like any other; an empty table gives an
    empty one; other columns are not returned. If ``id_col`` is "ids", the ids' column gets an underscore.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = ByteBpe.of(vocabulary)
        for batch in batches:
            for part in slices(batch, "text", BPE_SLICE):
                packed = [coder.encode(t) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(packed, pa.binary())], ["id", "ids"])

    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(F.col(id_col).alias("id"), utf8(text_col).alias("text"))
    return rows.mapInArrow(encode, f"id {kind}, ids binary").select(F.col("id").alias(id_col), F.col("ids").alias(fresh_name("ids", [id_col])))


def decode_bpe(df: DataFrame, vocabulary: str, ids_col: str = "ids", text_col: str = "text") -> DataFrame:
    """All columns, and the text of the packed ids of each row as ``text_col`` (which replaces a column of that name).

    Null and empty ids are an empty text. Bytes that are no UTF-8 become U+FFFD.
    An id that the vocabulary lacks, or a number of bytes that is no multiple of four, raises.
    """
    kept = [c for c in df.columns if c.lower() != text_col.lower()]

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder.of(vocabulary)
        for batch in batches:
            texts = ["".join(decoder.stream(np.frombuffer(packed or b"", "<u4").tolist())) for packed in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(texts, pa.string())], [*names[1:-1], text])

    ids, text = fresh_name("_ids", kept), fresh_name("_text", kept)
    names = [ids, *kept, text]
    schema = ", ".join([*(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in kept), f"`{text}` string"])
    return df.select(F.col(f"`{ids_col}`").alias(ids), *[F.col(f"`{c}`") for c in kept]).mapInArrow(decode, schema).withColumnRenamed(text, text_col)


def op12_byte_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ids of all documents by the vocabulary of ranks, digested, and the digest of the text they decode to."""
    path = tokenizer_path(VOCABULARY)
    coded = encode_bpe(read_table(spark, sf_dir, "documents"), path)
    return decode_bpe(coded, path).select(
        "doc_id",
        F.expr("octet_length(ids) div 4").cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"),
    )
