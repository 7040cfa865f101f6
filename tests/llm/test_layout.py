"""Tokens, packing, ORC files, sharding, neighbours and the pipeline."""

import math
import zlib
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest

from normframe.llm import ann, orc_ids, packing, sharding
from normframe.llm import queries as registered
from normframe.llm.shared import gapless_rank, partition_slots
from normframe.sources.storage import shared_path
from normframe.llm.tokens import TokenColumn

PATH = orc_ids.tokenizer_path()
EMBEDDINGS = Path("/root/testdata/sf0.1/embeddings.parquet")
TEXTS = [
    "Hello, World! it's 42 dogs", None, "", "  É À ñé ß ÿ × ÷ naïve ", "x́y ẛ̣", "ΑΣ ΣΑΣ", "<|endoftext|>foo<|startoftext|> bar", "a\x00b\x0bc nb\x85x", "日本 语 Ã", "don't'll 'S ’s",
    "word " * 9000, "A1b22 c!!..?a ab|cd <x>", " ",
]


@pytest.fixture(scope="module")
def ids():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def crc(x):
    return zlib.crc32(np.array(x, "<u4").tobytes())


def test_token_column(ids):
    encoder = TokenColumn(PATH)
    assert encoder.by_piece
    for _ in range(2):
        flat, at = encoder.encode(pa.array(TEXTS, pa.string()))
        assert [flat[x:y].tolist() for x, y in zip(at[:-1], at[1:])] == [ids(t) for t in TEXTS]


def test_whole_text_tokenizer():
    from tokenizers import Tokenizer

    path = orc_ids.tokenizer_path("byte_bpe_50k.json")
    encoder, plain = TokenColumn(path), Tokenizer.from_file(path)
    assert not encoder.by_piece
    flat, at = encoder.encode(pa.array(TEXTS, pa.string()))
    assert [flat[x:y].tolist() for x, y in zip(at[:-1], at[1:])] == [plain.encode(t or "", add_special_tokens=False).ids for t in TEXTS]


# op5


def test_orc_round_trip(spark, table, ids):
    rows = [(k * 7 % 13, t, "e") for k, t in enumerate(TEXTS)] + [(None, "null id", "e"), (3, "again", "e")]
    path = shared_path(spark, "test-orc")
    orc_ids.write_orc_ids(table(rows, "doc_id long, text string, ids string"), path, PATH, 2)
    stored = orc_ids.read_orc_ids(spark, path)
    got = sorted(orc_ids.checksums(stored).collect(), key=lambda r: r["start"])
    order = [r["doc_id"] for r in got]
    assert order == sorted(order, key=lambda k: (k is not None, k))
    assert [r["start"] for r in got] == np.concatenate(([0], np.cumsum([r["n_tokens"] for r in got])[:-1])).tolist()
    want = sorted((str(k), len(ids(t)) + 1, crc([*ids(t), 2])) for k, t, _ in rows)
    assert sorted((str(r["doc_id"]), r["n_tokens"], r["ids_crc32"]) for r in got) == want
    files = [r[0] for r in stored.selectExpr("_metadata.file_path").distinct().collect()]
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    reader = jvm.org.apache.orc.OrcFile.createReader(jvm.org.apache.hadoop.fs.Path(files[0]), jvm.org.apache.orc.OrcFile.readerOptions(conf))
    assert reader.getRowIndexStride() == orc_ids.INDEX_ROWS
    footer = reader.getStripes().get(0)
    assert footer.getIndexLength() > 0
    streams = reader.rows().readStripeFooter(footer).getStreamsList()
    assert "BLOOM_FILTER_UTF8" in {str(streams.get(k).getKind()) for k in range(streams.size())}
    assert [r["ids"] for r in stored.filter("doc_id = 7").collect()] == [[*ids(TEXTS[1]), 2]]


def test_orc_lookups_prune_row_groups(spark, table):
    path = shared_path(spark, "test-orc")
    rows = spark.range(5000).selectExpr("id * 3 AS doc_id", "'a b' AS text").coalesce(1)
    orc_ids.encode_documents(rows, PATH, 2).coalesce(1).write.option("orc.bloom.filter.columns", "doc_id").option("orc.row.index.stride", "1000").orc(path)
    for value, most in ((6000, 1000), (6001, 0)):  # one row group; the filter knows that the other is not there
        plan = orc_ids.read_orc_ids(spark, path).filter(f"doc_id = {value}")._jdf.queryExecution().executedPlan()
        assert len(plan.executeCollect()) == (value == 6000)
        assert plan.collectLeaves().apply(0).metrics().apply("numOutputRows").value() <= most


def test_files_are_in_the_order_of_their_numbers(spark):
    stored = spark.createDataFrame([(f"part-{n}-x.orc", n) for n in (99999, 100000, 100001)], "file string, n int")
    assert [r["n"] for r in stored.orderBy(orc_ids.file_number("file")).collect()] == [99999, 100000, 100001]


def test_orc_of_nothing(spark, table):
    path = shared_path(spark, "test-orc")
    orc_ids.write_orc_ids(table([], "doc_id long, text string"), path, PATH, 2)
    assert orc_ids.checksums(orc_ids.read_orc_ids(spark, path)).count() == 0


# op4


def bfd(lengths, capacity):
    bins = []
    for n in sorted(lengths, reverse=True):
        fit = [r for r in bins if r >= n]
        if fit:
            bins.remove(min(fit))
            bins.append(min(fit) - n)
        else:
            bins.append(capacity - n)
    return sorted(bins)


@pytest.mark.parametrize("seed", range(8))
def test_plan_is_best_fit_decreasing(seed):
    r = np.random.default_rng(seed)
    capacity = int(r.integers(5, 60))
    lengths = r.integers(1, capacity + 1, int(r.integers(0, 400)))
    histogram = {int(n): int(c) for n, c in zip(*np.unique(lengths, return_counts=True))}
    rooms, seen = {}, {}
    for length, low, high, per_bin, first, offset in packing.plan(histogram, capacity):
        for rank in range(low, high):
            b, at = first + (rank - low) // per_bin, offset + (rank - low) % per_bin * length
            rooms.setdefault(b, []).append((at, length))
            assert rank == seen.get(length, 0)
            seen[length] = rank + 1
    assert seen == histogram
    for items in rooms.values():
        assert [a for a, _ in sorted(items)] == np.concatenate(([0], np.cumsum([n for _, n in sorted(items)])[:-1])).tolist()
    assert sorted(capacity - sum(n for _, n in items) for items in rooms.values()) == bfd(lengths.tolist(), capacity)


def test_tree():
    tree = packing.RoomTree(10)
    assert tree.tightest(0) == -1
    for room in (10, 3, 7):
        tree.add(room, 1)
    assert [tree.tightest(n) for n in (0, 3, 4, 8)] == [3, 3, 7, 10]
    tree.add(10, -1)
    assert tree.tightest(8) == -1
    with pytest.raises(ValueError):
        packing.plan({11: 1}, 10)


def test_pack_documents(table, ids):
    rows = [(k, t, 0) for k, t in enumerate(TEXTS * 3)] + [(5, TEXTS[0], 0)]
    got = packing.pack_documents(table(rows, "doc_id long, text string, length int"), PATH, 1, 64, with_ids=True)
    pieces = got.collect()
    by_doc = {}
    for r in sorted(pieces, key=lambda r: (r["doc_id"], r["piece"])):
        assert r["start"] == 64 * r["piece"] and r["length"] == len(r["ids"]) <= 64 and r["ids_crc32"] == crc(r["ids"])
        if r["doc_id"] != 5:
            by_doc.setdefault(r["doc_id"], []).extend(r["ids"])
    assert by_doc == {k: [*ids(t), 1] for k, t, _ in rows if k != 5}
    full = {r["sequence_id"]: r["ids"] for r in packing.packed_sequences(got).collect()}
    for r in pieces:
        assert full[r["sequence_id"]][r["offset"] : r["offset"] + r["length"]] == r["ids"]
    assert sorted(64 - len(x) for x in full.values()) == bfd([r["length"] for r in pieces], 64)
    assert packing.pack_documents(table([], "doc_id long, text string"), PATH).count() == 0


# op8


def test_rendezvous(spark):
    docs = spark.range(20_000).withColumnRenamed("id", "doc_id")
    shards = [(s, 1.0) for s in range(24)]
    rows = sharding.shard_rows(docs, ["doc_id"], shards, [*shards, (24, 1.0)]).collect()
    sizes = np.bincount([r["shard"] for r in rows], minlength=24)
    assert sizes.min() > 700 and sizes.max() < 970
    moved = [r for r in rows if r["shard"] != r["grown_shard"]]
    assert all(r["grown_shard"] == 24 for r in moved) and 0.03 < len(moved) / len(rows) < 0.05
    heavy = sharding.shard_rows(docs, ["doc_id"], [(0, 1.0), (1, 3.0)]).filter("shard = 1").count()
    assert abs(heavy / 20_000 - 0.75) < 0.02
    for bad in ([], [(0, 1.0), (0, 1.0)], [(0, 0.0)]):
        with pytest.raises(ValueError):
            sharding.rendezvous(["doc_id"], bad)
    plan = sharding.shard_rows(docs, ["doc_id"], shards)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan


def test_sharding_query(spark, tmp_path):
    rows = [(k % 40, t) for k, t in enumerate(TEXTS * 10)] + [(None, "x"), (None, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = sharding.op8_rendezvous_sharding(spark, str(tmp_path)).collect()
    assert sorted((str(r["doc_id"]), r["size"], r["text_crc32"]) for r in got) == sorted((str(k), 8 + len((t or "").encode()), zlib.crc32((t or "").encode())) for k, t in rows)
    for s in {r["shard"] for r in got}:
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sum(r["shard"] == s for r in got)))


def test_ranks_and_slots(spark, table):
    got = gapless_rank(table([(k % 2 or None, k // 3) for k in range(100)], "g int, x int"), "g", ["x"], "n", 8).collect()
    for g in (1, None):
        assert sorted(r["n"] for r in got if r["g"] == g) == list(range(50))
    clash = table([(1, 2, 3, 4, 5)], "g int, _cell int, _group int, _before int, _place int")
    assert [tuple(r) for r in gapless_rank(clash, "g", ["_cell"], "n").collect()] == [(1, 2, 3, 4, 5, 0)]
    slots = partition_slots(spark, 7, 3, "int")
    df = spark.createDataFrame([(s,) for s in slots], "k int").repartition(7, "k").selectExpr("spark_partition_id() AS p")
    assert sorted(r["count"] for r in df.groupBy("p").count().collect()) == [3] * 7


# op6


def neighbours_by_force(rows, asked, k):
    good = {i: np.array(v, float) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and any(v)}
    out = {}
    for q in asked:
        if q in good:
            d = sorted((math.sqrt(((good[q] - x) ** 2).sum()), i) for i, x in good.items() if i != q)
            out[q] = d[:k]
    return out


def test_neighbours(spark):
    r = np.random.default_rng(2)
    centers = r.normal(size=(40, 16))
    rows = [(k, [float(x) for x in np.float32(centers[k % 40] + 0.3 * r.normal(size=16))]) for k in range(3000)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = ann.neighbours(df, df.filter("vec_id % 50 = 0")).collect()
    want = neighbours_by_force(rows, range(0, 3000, 50), 10)
    found = {}
    for x in got:
        found.setdefault(x["query_id"], []).append((x["rank"], x["score"], x["vec_id"]))
    share = []
    for q, near in want.items():
        ranked = sorted(found[q])
        assert [x[0] for x in ranked] == list(range(1, 14)) and ranked == sorted(ranked, key=lambda x: (x[1], x[2]))
        share.append(len({x[2] for x in ranked} & {i for _, i in near}) / 10)
        exact = {i: d for d, i in neighbours_by_force(rows, [q], 3000)[q]}
        assert all(abs(exact[i] - s) < 1e-9 for _, s, i in ranked)
    assert np.mean(share) >= 0.9


def test_neighbours_edges(spark, monkeypatch):
    monkeypatch.setattr(ann, "CROWDED", 3)
    rows = [(k, [1.0, 2.0]) for k in range(0, 40)] + [(100 + k, [float(k), 1.0]) for k in range(8)] + [(200, None), (201, [0.0, 0.0]), (202, [1.0, math.nan]), (203, [1.0, None]), (None, [1.0, 1.0]), (204, [1.0]), (5, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = ann.neighbours(df, df.filter("vec_id in (0, 5, 39, 103, 200, 201, 202, 204)"), k=12).collect()
    want = neighbours_by_force([x for x in rows if x[0] != 204], [0, 5, 39, 103], 12)  # 204 is alone in its dimension
    have = {}
    for x in sorted(got, key=lambda x: x["rank"]):
        have.setdefault(x["query_id"], []).append((x["score"], x["vec_id"]))
    assert {q: [i for _, i in v] for q, v in have.items()} == {q: [i for _, i in v] for q, v in want.items()}
    few = spark.createDataFrame(rows[40:43], "vec_id long, embedding array<double>")
    assert ann.neighbours(few, few).count() == 6  # all others, if fewer than k
    assert ann.neighbours(df.filter("vec_id < 0"), df.filter("vec_id < 0")).count() == 0


@pytest.mark.parametrize("sf,share", [("0.01", 0.93), ("0.1", 0.9)])
def test_perturbed_buckets_are_visited(sf, share):
    """The index chosen for the sample tables: several buckets of each table, the recall asked for, and the share of all vectors met."""
    import pyarrow.parquet as pq

    path = EMBEDDINGS.parents[1] / f"sf{sf}" / "embeddings.parquet"
    if not path.exists():
        pytest.skip("needs the sample tables")
    x = np.array(pq.read_table(path)["embedding"].to_pylist(), float)
    far = ((x[:100, None] - x[None]) ** 2).sum(2)
    near = [x[np.argsort(d, kind="stable")[1:11]] for d in far]
    index = ann.fit(x[:4000], len(x), near=near)
    assert index.probes >= ann.LEAST_PROBES > 1 and np.isfinite(index.limit) and index.limit > 0
    assert index.met < share
    buckets, met = index.buckets(x), np.zeros((100, len(x)), bool)
    for t in range(ann.TABLES):
        keys = index.probed(x[:100], t)
        assert all(len(set(k)) > 1 for k in keys.tolist())
        met |= (keys[:, :, None] == buckets[None, None, :, t]).any(1)
    recall = np.mean([met[q, np.argsort(far[q], kind="stable")[1:11]].mean() for q in range(100)])
    assert recall >= 0.9 and met.mean() < share


@pytest.mark.skipif(not EMBEDDINGS.exists(), reason="needs the sample tables")
def test_recall_on_all_sample_vectors(spark):
    rows = spark.read.parquet(str(EMBEDDINGS)).select("vec_id", "embedding")
    x = {r[0]: np.array(r[1], float) for r in rows.collect()}
    ids = np.array(sorted(x))
    data = np.array([x[i] for i in ids])
    got = {}
    for r in registered.queries()["op6_multiprobe_neighbours"](spark, str(EMBEDDINGS.parent)).collect():
        got.setdefault(r["query_id"], {})[r["vec_id"]] = r["score"]
    share = []
    for q in ids[ids % 100 == 0]:
        d = np.sqrt(((data - x[q]) ** 2).sum(1))
        d[ids == q] = np.inf
        near = ids[np.lexsort((ids, d))[:10]]
        share.append(len(set(near.tolist()) & set(got[q])) / 10)
        assert all(abs(d[np.searchsorted(ids, i)] - s) < 1e-12 for i, s in got[q].items())
    assert len(got) == len(share) and np.mean(share) >= 0.9


@pytest.mark.parametrize("offset", [0.0, 1e7, 1e120])
def test_selection_keeps_true_neighbours_far_from_the_origin(offset):
    r = np.random.default_rng(4)
    q, x = r.normal(size=(22, 16)) + offset, r.normal(size=(900, 16)) + offset
    found = ann._best(pa.array(range(22)), q, pa.array(range(900)), x, 10).to_pandas()
    exact = np.sqrt(((q[:, None] - x[None]) ** 2).sum(2))
    for k in range(22):
        near = set(np.argsort(exact[k], kind="stable")[:10].tolist())
        assert near <= set(found.loc[found["q"] == k, "rep"])


def test_exact_scan_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(ann, "SCAN_QUERIES", 7)
    monkeypatch.setattr(ann, "SCAN_ENTRIES", 50)
    r = np.random.default_rng(5)
    rows = [(k, r.normal(size=4).tolist()) for k in range(300)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    entries = ann._entries(df, "vec_id", "embedding", 6, "<f8")
    got = ann._scanned(entries, entries.filter("rep % 10 = 0").select("rep", "vector"), 300, 6, "bigint", "<f8").collect()
    want = neighbours_by_force(rows, range(0, 300, 10), 5)
    assert {(x["q"], x["rep"]) for x in got if x["q"] != x["rep"]} == {(q, i) for q, near in want.items() for _, i in near}


def test_probe_order():
    moves = ann.likely_moves(4, 40)
    assert moves[0] == () and moves[1] == (0,) and len(set(moves)) == len(moves)
    index = ann.fit(np.random.default_rng(0).normal(size=(500, 8)), 500)
    x = np.random.default_rng(1).normal(size=(5, 8))
    assert (index.probed(x, 0, 1)[:, 0] == index.buckets(x)[:, 0]).all()
    assert all(len(set(row)) == len(row) for row in index.probed(x, 0, 30).tolist())


# The pipeline


def test_pipeline_stages(spark, table):
    pipeline = pytest.importorskip("corpus_pipeline")
    from test_texts import PRIVATE, cut, prose

    assert [n for n, _ in pipeline.STAGES] == ["quality classifier", "near-duplicate removal", "benchmark decontamination", "personal data surrogates", "best-fit packing"]
    folder = shared_path(spark, "tables")
    good = [(k, prose(60, k).capitalize() + ".") for k in range(60)]
    bad = [(100 + k, " ".join(w + "%%%" for w in prose(60, 900 + k).split())) for k in range(60)]
    item = prose(30, 4000)
    extra = [(300, good[3][1]), (301, good[4][1] + " " + item), (302, prose(50, 7) + " " + PRIVATE[0][1])]
    docs = [(k, t, "en", "s", len(t)) for k, t in good + bad + extra]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame([(k, int(k < 100), 0) for k, _ in good + bad], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    out = pipeline.run(spark, folder).collect()
    ids = {r["doc_id"] for r in out}
    assert ids == {k for k, _ in good} | {302}
    assert all(r["length"] <= 4096 for r in out) and cut("x")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in pipeline.STAGES[:-1]:
        kept = stage(spark, docs, folder)
        assert kept.columns == docs.columns
    clash = docs.withColumn("_quality", docs["doc_id"]).withColumn("leak_hits", docs["doc_id"]).withColumn("_gone", docs["doc_id"])
    for _, stage in pipeline.STAGES[:-1]:
        rows = stage(spark, clash, folder).collect()
        assert rows and all(r["_quality"] == r["leak_hits"] == r["_gone"] == r["doc_id"] for r in rows)
    clean = {r["doc_id"]: r["text"] for r in pipeline.hide_persons(spark, docs, folder).collect()}
    assert "555-7713" not in clean[302] and clean[0] == good[0][1]


def test_registered():
    names = list(registered.queries())
    assert [int(n[2:].split("_")[0]) for n in names] == list(range(1, 14))
    assert set(registered.oracle_sql()) <= set(names)
