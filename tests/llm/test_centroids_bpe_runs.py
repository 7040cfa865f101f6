"""Centroid clusters, byte-level BPE and periodic runs against second computations."""

import base64
import codecs
import hashlib
import random
import re
import zlib
from pathlib import Path

import duckdb
import numpy as np
import pytest

from normframe.llm import byte_bpe, centroids, periodic_runs
from normframe.llm import queries as registered
from normframe.llm.orc_ids import tokenizer_path

SF = Path("/root/testdata/sf0.001")
VOCABULARIES = ["byte_bpe_50k.tiktoken", "byte_bpe_multi_50k.tiktoken"]


def sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


# op11


def lloyd(rows, k, rounds, seed, dims, steps):
    """Every distance from its components, in Python's integers."""
    kept = [(i, [int(np.floor(steps * float(x))) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and np.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, sha(f"{seed}:{r[0]}"), r[1]))
    at = [v for _, v in order[:k]]

    def assign():
        apart = [[sum((a - b) ** 2 for a, b in zip(v, c)) for c in at] for _, v in kept]
        return [(d.index(min(d)), min(d)) for d in apart]

    for _ in range(rounds):
        mine = assign()
        for c in range(len(at)):
            members = [v for (_, v), (m, _) in zip(kept, mine) if m == c]
            if members:
                at[c] = [sum(x) // len(members) for x in zip(*members)]
    return sorted((str(i), *m) for (i, _), m in zip(kept, assign())), at


def vectors(n, dims, seed=0):
    rng = np.random.default_rng(seed)
    rows = [(int(i), [float(x) for x in rng.normal(size=dims).round(2)]) for i in range(n)]
    bad = [(n, None), (n + 1, []), (n + 2, [1.0] * (dims - 1)), (n + 3, [None, *[1.0] * (dims - 1)]), (n + 4, [float("nan"), *[1.0] * (dims - 1)]), (n + 5, [float("inf")] * dims)]
    same = [(3, [0.5] * dims), (3, [0.25] * dims), (None, [0.5] * dims), *[(1000 + k, [-0.5] * dims) for k in range(n // 2)]]  # a third of all rows are one vector
    return rows + bad + same


@pytest.mark.parametrize("k,rounds", [(7, 5), (1, 3), (500, 2), (7, 0)])
def test_clusters_equal_plain_rounds(table, k, rounds):
    rows = vectors(60, 5)
    docs = table([(i, v, "x") for i, v in rows], "vec_id long, embedding array<double>, cluster string")
    found = centroids.cluster_vectors(docs, k, rounds, 2, 5, 256)
    want, at = lloyd(rows, k, rounds, 2, 5, 256)
    got = found.rows.collect()
    assert sorted((str(r["id"]), r["cluster"], r["distance"]) for r in got) == want
    assert found.centroids.tolist() == at
    assert all(r["dots"] == [sum(a * b for a, b in zip(r["point"], c)) for c in at] for r in got)
    assert sum(found.inertia().values()) == sum(d for _, _, d in want)


def test_products_follow_changed_components_only():
    rng = np.random.default_rng(1)
    points, old = rng.integers(-99, 99, (50, 8)), rng.integers(-99, 99, (4, 8))
    new = old.copy()
    new[1, 3] += 5
    new[2] = -old[2]
    assert (centroids.moved(points, points @ old.T, old, new) == points @ new.T).all()
    hidden = points.copy()
    hidden[:, [0, 1, 2, 4, 5, 6, 7]] = 10**6  # components without a change are not read
    one = old.copy()
    one[0, 3] += 7
    assert (centroids.moved(hidden, points @ old.T, old, one) == points @ one.T).all()


def test_ties_go_to_the_smaller_number():
    points = np.array([[0, 0], [4, 0]])
    at = np.array([[2, 0], [-2, 0], [2, 0]])
    cluster, apart = centroids.nearest(points, points @ at.T, at)
    assert cluster.tolist() == [0, 0] and apart.tolist() == [4, 4]


def test_no_vectors_and_too_large_ones(table):
    empty = centroids.cluster_vectors(table([(1, None)], "vec_id long, embedding array<float>"), 3, 2, 2, 4)
    assert empty.rows.count() == 0 and empty.inertia() == {}
    with pytest.raises(Exception, match="not below"):
        centroids.cluster_vectors(table([(1, [1e30, 0.0])], "vec_id long, embedding array<double>"), 3, 2, 2, 2)


@pytest.mark.skipif(not SF.exists(), reason="needs the sample tables")
def test_op11_query_equals_sql(spark):
    db = duckdb.connect()
    db.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
    want = db.execute(registered.oracle_sql()["op11_centroid_clusters"]).df()
    got = registered.queries()["op11_centroid_clusters"](spark, str(SF)).toPandas()
    columns = sorted(want.columns)
    order = lambda d: d[columns].sort_values(columns).reset_index(drop=True)
    assert order(got).equals(order(want).astype(got[columns].dtypes.to_dict()))


# op12


def reference(name):
    import public_tokenizers
    import tiktoken

    with open(tokenizer_path(name), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


TEXTS = [
    "Hello, World! it's 42 dogs", None, "", "  É À ñé ß ÿ × ÷ naïve  \n\n x", "x́y ẛ̣ ΑΣ", "<|endoftext|>foo", "a\x00b\x0bc nb\x85x\x1c\x1d", "日本 语 Ã 🙂👩‍👩‍👧", "don't'll 'S ’s",
    "word " * 9000, "q" * 30_000 + "z", " ", "\t \n", "!!!???...", "٣٤٥ ⅷ ①",
]


@pytest.mark.parametrize("name", VOCABULARIES)
def test_transducer_equals_the_library(name):
    enc, coder = reference(name), byte_bpe.ByteBpe(tokenizer_path(name))
    rng = random.Random(4)
    tokens = list(coder.ranks)
    soup = ["".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(0xA0, 0x250), rng.randrange(0x3040, 0x3100), rng.randrange(0x1F600, 0x1F640)])) for _ in range(rng.randrange(40))) for _ in range(300)]
    for text in [t or "" for t in TEXTS] + soup:
        assert np.frombuffer(coder.encode(text), "<u4").tolist() == enc.encode_ordinary(text), text
    for _ in range(2000):  # any bytes, at the borders of tokens
        data = b"".join(rng.choice(tokens) for _ in range(rng.randrange(1, 6)))
        if data not in coder.ranks:
            assert coder.transducer.encode(data) == coder.transducer.merged(data) == enc._encode_single_piece(data)


def test_tokens_come_before_the_text_ends(monkeypatch):
    monkeypatch.setattr(byte_bpe, "WINDOW", 16)
    t = byte_bpe.ByteBpe(tokenizer_path(VOCABULARIES[0])).transducer
    data = b"".join(random.Random(1).choice([b"stream", b"ing", b"token", b"zq", b"aaaa"]) for _ in range(500))
    parts = list(t.emit(data))
    assert [i for p in parts for i in p] == t.merged(data)
    read = 0
    for k, ids in enumerate(parts[:-1]):
        read += sum(len(t.spelling[i]) for i in ids)
        assert 16 * (k + 1) - read < 64  # what is held back is a few tokens


def test_states_are_made_anew(monkeypatch):
    whole = byte_bpe.ByteBpe(tokenizer_path(VOCABULARIES[0]))
    text = " ".join("".join(random.Random(k).choices("abcdefgh", k=9)) for k in range(400))
    want = whole.encode(text)
    for limit, value in (("MOST_STATES", 20), ("MOST_PAIRS", 10), ("MOST_PIECES", 5)):
        monkeypatch.setattr(byte_bpe, limit, value)
    small = byte_bpe.ByteBpe(tokenizer_path(VOCABULARIES[0]))
    assert small.encode(text) == want
    assert len(small.transducer.states) <= 20 and len(small) <= 5 and len(small.transducer.pairs) <= 10


def test_utf8_automaton_equals_the_codec():
    rng = random.Random(2)
    spelling = {i: bytes([i]) for i in range(256)}
    more = [b"\xf0\x9f", b"\x98\x80", b"\xe3\x81\x82x", b"\xc3", b"\xed\xa0", b"ab\xe2\x82"]
    spelling |= {256 + k: b for k, b in enumerate(more)}
    decoder = byte_bpe.Decoder(spelling)
    for _ in range(3000):
        ids = [rng.choice([rng.randrange(256), rng.randrange(0x80, 0xF8), 256 + rng.randrange(len(more))]) for _ in range(rng.randrange(1, 9))]
        data = b"".join(spelling[i] for i in ids)
        parts = list(decoder.stream(ids))
        assert "".join(parts) == data.decode("utf-8", "replace")
        step = codecs.getincrementaldecoder("utf-8")("replace")
        theirs = [step.decode(spelling[i]) for i in ids]
        assert all("".join(parts[:k]).startswith("".join(theirs[:k])) for k in range(len(ids)))  # never later than the codec
    split = [0xF0, 0x9F, 0x98, 0x80, 0x61, 256, 257]
    assert list(decoder.stream(split)) == ["", "", "", "\U0001f600", "a", "", "\U0001f600"]


def test_bpe_tables(table):
    enc = reference(VOCABULARIES[0])
    path = tokenizer_path(VOCABULARIES[0])
    rows = [(k, t, "e", "x") for k, t in enumerate(TEXTS)] + [(None, "null id", "e", None), (3, "again", "e", "x")]
    coded = byte_bpe.encode_bpe(table(rows, "doc_id long, text string, ids string, lang string"), path)
    assert coded.columns == ["doc_id", "ids"]
    got = byte_bpe.decode_bpe(coded, path).collect()
    want = sorted((str(i), enc.encode_ordinary(t or ""), t or "") for i, t, _, _ in rows)
    assert sorted((str(r["doc_id"]), np.frombuffer(r["ids"], "<u4").tolist(), r["text"]) for r in got) == want
    assert byte_bpe.encode_bpe(table([(1, "a")], "ids long, text string"), path, "ids").columns == ["ids", "ids_"]
    assert byte_bpe.decode_bpe(table([], "ids binary, text string, _ids int"), path).collect() == []
    assert byte_bpe.decode_bpe(table([(None, "old")], "ids binary, Text string"), path).collect() == [(None, "")]


@pytest.mark.skipif(not SF.exists(), reason="needs the sample tables")
def test_op12_query(spark):
    enc = reference(VOCABULARIES[0])
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = registered.queries()["op12_byte_bpe_round_trip"](spark, str(SF)).collect()
    assert len(got) == len(docs)
    for r in got:
        ids = enc.encode_ordinary(docs[r["doc_id"]])
        assert tuple(r) == (r["doc_id"], len(ids), sha(np.array(ids, "<u4").tobytes()), sha(docs[r["doc_id"]]))


# op13


def brute_runs(w):
    """Every lag over the whole sequence; the smallest period of a stretch counts."""
    found = {}
    for q in range(1, len(w) // 4 + 1):
        j = q
        while j < len(w):
            first = j
            while j < len(w) and w[j] == w[j - q]:
                j += 1
            if j - first + q >= max(6, 4 * q):
                found.setdefault((first - q, j), q)
            j += j == first
    return sorted(((s, e - s, q) for (s, e), q in found.items()), key=lambda r: (r[0], r[2]))


def nested(rng, letters, depth):
    """A sequence with repeats within repeats."""
    if not depth or rng.random() < 0.3:
        return [rng.randrange(letters) for _ in range(rng.randrange(1, 12))]
    x = nested(rng, letters, depth - 1)
    return x * rng.randrange(1, 7) + x[: rng.randrange(len(x) + 1)] if rng.random() < 0.6 else x + nested(rng, letters, depth - 1)


def test_runs_equal_brute_force():
    rng = random.Random(5)
    for _ in range(400):
        letters = rng.choice([1, 2, 2, 3, 4, 10])
        w = [x for _ in range(rng.randrange(1, 5)) for x in nested(rng, letters, 4)][:1200]
        assert [tuple(r) for r in periodic_runs.runs_of(np.array(w, np.int64)).tolist()] == brute_runs(w), w


@pytest.mark.parametrize("n", [0, 1, 5, 6, 7])
def test_short_sequences(n):
    assert periodic_runs.runs_of(np.zeros(n, np.int64)).tolist() == ([[0, n, 1]] if n >= 6 else [])


def test_long_sequences_stay_cheap():
    """One word, or one line, throughout: all pairs of occurrences would be 10^10."""
    n = 200_000
    assert periodic_runs.runs_of(np.zeros(n, np.int64)).tolist() == [[0, n, 1]]
    assert periodic_runs.runs_of(np.tile(np.arange(9), n // 9)).tolist() == [[0, n // 9 * 9, 9]]
    line = np.concatenate([np.concatenate([np.arange(20), [1000 + k]]) for k in range(10_000)])  # often, but with no period
    assert periodic_runs.runs_of(line).tolist() == []


def test_a_diagonal_ends_when_its_lag_is_not_carried_on():
    assert list(periodic_runs._ended([1, 2, 2, 3, 7], [4, 4, 5, 5, 4])) == [(4, 1, 3), (5, 2, 4), (4, 7, 8)]


def collapsed(words, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def cut(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


RUN_TEXTS = [
    "a b a b a b a b c", "  x\ty\n" * 9, "Ab ab " * 4 + "ab", None, "", " \n", "é è é è é è é è", "one two three", "w " * 70_000, "a\x00b " * 6, "a\x1cb " * 7, "a b " * 6,
    "the end " + "of the line " * 12 + "no no no no no no no", "b a b a b a b a b",
]


def test_run_tables(table):
    rows = [(k, t, "e", 1) for k, t in enumerate(RUN_TEXTS)] + [(None, "n " * 8, "e", None), (2, "again " * 6, "e", 2)]
    got = periodic_runs.periodic_runs(table(rows, "doc_id long, text string, runs string, n_words int")).collect()
    want = []
    for i, t, _, _ in rows:
        words = cut(t)
        runs = [(0, len(words), 1)] if len(words) > 10_000 else brute_runs(words)
        want.append((str(i), len(words), runs, collapsed(words, runs)))
    assert sorted((str(r["doc_id"]), r["n_words"], [tuple(x) for x in r["runs"]], r["collapsed"]) for r in got) == sorted(want)
    assert periodic_runs.periodic_runs(table([], "runs long, text string"), "runs").columns == ["runs", "n_words", "runs_", "collapsed"]


@pytest.mark.skipif(not SF.exists(), reason="needs the sample tables")
def test_op13_query_equals_brute_force(spark):
    docs = {r["doc_id"]: cut(r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = registered.queries()["op13_periodic_runs"](spark, str(SF)).collect()
    assert len(got) == len(docs)
    cyclic = 0
    for r in got:
        w = docs[r["doc_id"]]
        h = zlib.crc32(str(r["doc_id"]).encode())
        if h % 10 == 0 and w:
            a = (h // 10) % len(w)
            p = 1 + (len(w) - a) // (3 + (h // 10) % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(len(w))]
            cyclic += 1
        runs = brute_runs(w)
        best = min(runs, key=lambda x: (-x[1], x[0], x[2]), default=(None, None, None))
        milli = best[1] * 1000 // best[2] if runs else None
        lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
        assert tuple(r) == (r["doc_id"], len(runs), *best, milli, sha(lines), sha(collapsed(w, runs)))
    assert cyclic > 5


def test_op13_columns(spark):
    kinds = dict(registered.queries()["op13_periodic_runs"](spark, str(SF)).dtypes)
    assert kinds == {"doc_id": "bigint", "n_runs": "bigint", "start": "bigint", "length": "bigint", "period": "bigint", "exponent_milli": "bigint", "runs_sha256": "string", "collapsed_sha256": "string"}
