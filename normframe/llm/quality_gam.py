"""Text quality by a generalised additive model with pairwise interactions.

Cyclic boosting visits one feature at a time and fits a shallow tree to the
current gradients; the trees of a feature add up to one lookup table over its
bins. The feature pairs with most left to explain get two-dimensional tables in
the same manner. Scoring a text is a bin search for each feature and a sum of
table entries, vectorised over texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import read_table, utf8
from .textscan import SPACED, Words, shingles, slices, text_buffer

#: At most that many labelled rows train the model (those with the smallest hash of their id).
SAMPLE_ROWS = 20_000
#: A document is kept from this score on.
CUT = 0.3

FEATURES = (
    "log_bytes", "log_words", "word_length", "letters", "upper", "digits", "sentence_marks", "symbols", "exclamations", "non_ascii", "line_feeds",
    "marked_words", "symbol_words", "capital_words", "distinct_words", "top_word", "distinct_shingles", "long_words",
)

_LETTER, _UPPER, _DIGIT, _MARK, _SYMBOL, _BANG, _HIGH, _FEED = range(8)


def _byte_kinds() -> np.ndarray:
    kinds = np.zeros((8, 256), bool)
    kinds[_UPPER, 65:91] = True
    kinds[_LETTER, 97:123] = kinds[_LETTER, 65:91] = kinds[_LETTER, 128:] = True
    kinds[_DIGIT, 48:58] = True
    kinds[_MARK, [ord(c) for c in ".,;:?'\"()-"]] = True
    kinds[_SYMBOL, [ord(c) for c in "#$%&*+/<=>@[\\]^_`{|}~"]] = True
    kinds[_BANG, ord("!")] = True
    kinds[_HIGH, 128:] = True
    kinds[_FEED, 10] = True
    return kinds


_KINDS = _byte_kinds()


def features(column: pa.Array) -> np.ndarray:
    """One row of FEATURES for each text of a slice; null and empty texts give zeros."""
    raw, offsets = text_buffer(column)
    n = len(offsets) - 1
    size = np.diff(offsets).astype(float)
    doc = np.repeat(np.arange(n), np.diff(offsets))
    counts = np.bincount(doc * 256 + raw, minlength=n * 256).reshape(n, 256)
    kinds = counts @ _KINDS.T.astype(np.int64)
    found = Words(raw, offsets, SPACED)
    n_words = found.counts.astype(float)
    per_byte, per_word = np.maximum(size, 1), np.maximum(n_words, 1)

    def share(flags: np.ndarray) -> np.ndarray:
        return np.bincount(found.doc[flags], minlength=n) / per_word

    first, last = raw[found.starts], raw[found.ends - 1]
    length = found.ends - found.starts
    hashes = found.hashes()
    order = np.lexsort((hashes, found.doc))
    new = np.ones(len(order), bool)
    new[1:] = (hashes[order][1:] != hashes[order][:-1]) | (found.doc[order][1:] != found.doc[order][:-1])
    runs = np.flatnonzero(new)
    top = np.zeros(n)
    np.maximum.at(top, found.doc[order][runs], np.diff(np.append(runs, len(order))))
    sh, sh_doc = shingles(found)
    sh_order = np.lexsort((sh, sh_doc))
    sh_new = np.ones(len(sh), bool)
    sh_new[1:] = (sh[sh_order][1:] != sh[sh_order][:-1]) | (sh_doc[sh_order][1:] != sh_doc[sh_order][:-1])
    sh_all = np.maximum(np.bincount(sh_doc, minlength=n), 1)
    columns = [
        np.log1p(size), np.log1p(n_words), np.bincount(found.doc, length, minlength=n) / per_word,
        *(kinds[:, k] / per_byte for k in (_LETTER, _UPPER, _DIGIT, _MARK, _SYMBOL, _BANG, _HIGH, _FEED)),
        share(_KINDS[_MARK, last] | _KINDS[_BANG, last]), share(_KINDS[_SYMBOL, first] | _KINDS[_SYMBOL, last]), share(_KINDS[_UPPER, first]),
        np.bincount(found.doc[order][runs], minlength=n) / per_word, top / per_word, np.bincount(sh_doc[sh_order][sh_new], minlength=n) / sh_all, share(length > 12),
    ]
    return np.column_stack(columns) * (size > 0)[:, None]


@dataclass
class Gam:
    """Lookup tables: ``main[f]`` over the bins of feature f, ``pair[k]`` over coarse bins of two features."""

    edges: list[np.ndarray]
    coarse: list[np.ndarray]
    bias: float
    main: np.ndarray
    pairs: list[tuple[int, int]]
    pair: np.ndarray

    def scores(self, x: np.ndarray) -> np.ndarray:
        """The probability of label 1 for each row of features."""
        total = np.full(len(x), self.bias)
        for f, edges in enumerate(self.edges):
            total += self.main[f][np.searchsorted(edges, x[:, f], side="right")]
        wide = [np.searchsorted(e, x[:, f], side="right") for f, e in enumerate(self.coarse)]
        for k, (f, g) in enumerate(self.pairs):
            total += self.pair[k][wide[f], wide[g]]
        return 1 / (1 + np.exp(-np.clip(total, -40, 40)))


def _edges(values: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(values, np.linspace(0, 1, bins + 1)[1:-1]))


def _tree(g: np.ndarray, h: np.ndarray, leaves: int, ridge: float) -> np.ndarray:
    """A tree over ordered bins, grown by best gain: its step for each bin."""
    cg, ch = np.concatenate(([0], np.cumsum(g))), np.concatenate(([0], np.cumsum(h)))

    def best(a: int, b: int) -> tuple[float, int]:
        if b - a < 2:
            return 0.0, a
        left_g, left_h = cg[a + 1 : b] - cg[a], ch[a + 1 : b] - ch[a]
        right_g, right_h = cg[b] - cg[a + 1 : b], ch[b] - ch[a + 1 : b]
        gain = left_g**2 / (left_h + ridge) + right_g**2 / (right_h + ridge) - (cg[b] - cg[a]) ** 2 / (ch[b] - ch[a] + ridge)
        k = int(np.argmax(gain))
        return float(gain[k]), a + 1 + k

    parts = [(0, len(g))]
    while len(parts) < leaves:
        found = [(best(*p), p) for p in parts]
        (gain, cut), (a, b) = max(found)
        if gain <= 1e-12:
            break
        parts.remove((a, b))
        parts += [(a, cut), (cut, b)]
    step = np.zeros(len(g))
    for a, b in parts:
        step[a:b] = (cg[b] - cg[a]) / (ch[b] - ch[a] + ridge)
    return step


def _quadrants(g: np.ndarray, h: np.ndarray, ridge: float) -> tuple[float, np.ndarray]:
    """The best tree that cuts both features of a pair once: gain, and step for each cell."""
    cg, ch = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    a_g, a_h = cg[:-1, :-1], ch[:-1, :-1]
    b_g, b_h = cg[:-1, -1:] - a_g, ch[:-1, -1:] - a_h
    c_g, c_h = cg[-1:, :-1] - a_g, ch[-1:, :-1] - a_h
    parts = [(a_g, a_h), (b_g, b_h), (c_g, c_h), (cg[-1, -1] - a_g - b_g - c_g, ch[-1, -1] - a_h - b_h - c_h)]
    gain = sum(x**2 / (y + ridge) for x, y in parts)
    step = np.zeros_like(g)
    if not np.size(gain):
        return 0.0, step
    i, j = np.unravel_index(int(np.argmax(gain)), gain.shape)
    for (x, y), rows, cols in zip(parts, (slice(0, i + 1), slice(0, i + 1), slice(i + 1, None), slice(i + 1, None)), (slice(0, j + 1), slice(j + 1, None)) * 2, strict=True):
        step[rows, cols] = x[i, j] / (y[i, j] + ridge)
    return float(gain[i, j]), step


def fit(
    x: np.ndarray, y: np.ndarray, bins: int = 32, wide_bins: int = 8, rounds: int = 120, pair_rounds: int = 40, n_pairs: int = 8, rate: float = 0.15,
    leaves: int = 3, ridge: float = 1.0,
) -> Gam:
    """Learn the tables from features and 0/1 labels. Without two classes the score is the (smoothed) share of ones."""
    n_features = x.shape[1]
    share = (y.sum() + 0.5) / (len(y) + 1)
    edges = [_edges(x[:, f], bins) if len(x) else np.zeros(0) for f in range(n_features)]
    coarse = [_edges(x[:, f], wide_bins) if len(x) else np.zeros(0) for f in range(n_features)]
    model = Gam(edges, coarse, float(np.log(share / (1 - share))), np.zeros((n_features, bins + 1)), [], np.zeros((0, wide_bins + 1, wide_bins + 1)))
    if len(np.unique(y)) < 2:
        return model
    at = [np.searchsorted(edges[f], x[:, f], side="right") for f in range(n_features)]
    total = np.full(len(x), model.bias)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-total))
        return y - p, p * (1 - p)

    for _ in range(rounds):
        for f in range(n_features):
            size = len(edges[f]) + 1
            g, h = slopes()
            step = rate * _tree(np.bincount(at[f], g, size), np.bincount(at[f], h, size), leaves, ridge)
            model.main[f, :size] += step
            total += step[at[f]]
    wide = [np.searchsorted(coarse[f], x[:, f], side="right") for f in range(n_features)]
    width = wide_bins + 1

    def grid(f: int, g: int, values: np.ndarray) -> np.ndarray:
        return np.bincount(wide[f] * width + wide[g], values, width * width).reshape(width, width)

    g, h = slopes()
    gains = [(_quadrants(grid(a, b, g), grid(a, b, h), ridge)[0], a, b) for a in range(n_features) for b in range(a + 1, n_features)]
    model.pairs = [(a, b) for _, a, b in sorted(gains, reverse=True)[:n_pairs]]
    model.pair = np.zeros((len(model.pairs), width, width))
    for _ in range(pair_rounds):
        for k, (a, b) in enumerate(model.pairs):
            g, h = slopes()
            step = rate * _quadrants(grid(a, b, g), grid(a, b, h), ridge)[1]
            model.pair[k] += step
            total += step[wide[a], wide[b]]
    return model


def with_features(df: DataFrame, text_col: str, out: str) -> DataFrame:
    """Add the features of the whole text as an array column."""
    kept = [f for f in df.schema.fields if f.name not in (text_col, out)]

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text_col):
                x = features(part.column(part.schema.get_field_index(text_col)))
                lists = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([*(part.column(part.schema.get_field_index(f.name)) for f in kept), lists], [*(f.name for f in kept), out])

    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in kept) + f"`{out}` array<double>"
    return df.select(*[f.name for f in kept], text_col).mapInArrow(compute, schema)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample_rows: int = SAMPLE_ROWS) -> Gam:
    """A model of ``label_col`` from a bounded sample of labelled documents.

    The sample is the ``sample_rows`` labels with the smallest hash of their
    id; so it is the same wherever and in whatever order rows are read. Null
    labels and ids take no part. Of documents that share an id one is taken,
    the one with the smallest hash of its text, so no id can exceed the bound.
    No labelled row, or labels of one class, give the (smoothed) share of ones as the score of every text.
    """
    chosen = (
        labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull())
        .select(F.col(id_col).alias("_id"), F.col(label_col).cast("double").alias("_label"))
        .orderBy(F.xxhash64("_id"), "_id", "_label")
        .limit(sample_rows)
    )
    # The sample's bound is a parameter, so it may be broadcast.
    sample = docs.select(F.col(id_col).alias("_key"), utf8(text_col).alias("_text")).join(F.broadcast(chosen), F.col("_key") == F.col("_id"))
    found = with_features(sample.select("_key", "_label", F.xxhash64("_text").alias("_tie"), "_text"), "_text", "_x")
    rows = found.groupBy("_key", "_label").agg(F.min_by("_x", "_tie").alias("_x")).collect()
    rows.sort(key=lambda r: (r["_key"], r["_label"]))
    x = np.array([r["_x"] for r in rows], float).reshape(-1, len(FEATURES))
    return fit(x, np.array([r["_label"] for r in rows], float))


def score(df: DataFrame, model: Gam, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """Add ``score_col``, the model's probability of label 1, to every row.

    Texts are scored whole, null and empty ones too; a repeated row is scored
    each time, and a column that has the name ``score_col`` is replaced.
    An empty table gives one; repeated rows and ties have equal scores.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)
    kept = [f for f in df.schema.fields if f.name != score_col]

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text_col):
                got = shared.value.scores(features(part.column(part.schema.get_field_index(text_col))))
                yield pa.RecordBatch.from_arrays([*(part.column(part.schema.get_field_index(f.name)) for f in kept), pa.array(got)], [*(f.name for f in kept), score_col])

    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in kept) + f"`{score_col}` double"
    return df.select(*[f.name for f in kept]).mapInArrow(apply, schema)


def held_out(id_col: str = "doc_id"):
    """Whether a document is kept from training: crc32 of its id as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(F.encode(F.col(id_col).cast("string"), "UTF-8")) % 5 == 0, F.lit(False))


def quality_model(docs: DataFrame, labels: DataFrame) -> Gam:
    """The model of ``labels.quality``, learnt from rows that are not held out."""
    return train(docs, labels.filter(~held_out()))


def op7_gam_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of all documents."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score(docs, quality_model(docs, read_table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
