"""Chunked matrices: what a rectangle opens, products by blocks, and written arrays."""

import json

import numpy as np
import pytest

import normframe as nf
from normframe.sources import zarr

X = np.random.default_rng(3).normal(size=(37, 11)).round(3)
X[5:9, 2:6] = 0.5


def values(df):
    return df.orderBy("i").drop("i").toPandas().to_numpy()


def opened(reader):
    """The files that a data source's reader would open, and those it finds."""
    return [reader.how.name(i, j) for p in reader.partitions() for i in range(*p.rows) for j in range(*p.cols)]


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    """One matrix in all its chunked forms, by name."""
    root = tmp_path_factory.mktemp("chunked")
    dense = nf.from_numpy(spark, X)
    nf.write_zarr(dense, str(root / "z"), 37, (5, 3), fill=0.5)
    nf.write_chunks(dense, str(root / "c"), 37, (5, 3), fill=0.5)
    one = nf.from_numpy(spark, X)
    nf.write_zarr(one, str(root / "wide"), 37, (8, 11), size="float64")
    return root, {
        "zarr": lambda: nf.read_zarr(spark, str(root / "z")), "one across": lambda: nf.read_zarr(spark, str(root / "wide")), "table": lambda: nf.read_chunks(spark, str(root / "c"), (37, 11), (5, 3), 0.5),
    }


FORMS = ["zarr", "one across", "table"]


@pytest.mark.parametrize("form", FORMS)
def test_values_and_statistics(stored, form):
    m = stored[1][form]()
    np.testing.assert_array_equal(m.read_block((0, 37), (0, 11)), X)
    np.testing.assert_array_equal(m.read_block((3, 12), (2, 7)), X[3:12, 2:7])
    s = nf.ColumnStatistics(m)
    np.testing.assert_allclose(s.means(), X.mean(0))
    np.testing.assert_allclose(s.sds(), X.std(0))
    np.testing.assert_array_equal(s.mins(), X.min(0))
    np.testing.assert_allclose(s.medians(), np.median(X, 0))
    got = m.entries((4, 6), (9, 11)).collect()
    assert sorted((r["i"], r["j"], r["v"]) for r in got) == [(i, j, X[i, j]) for i in (4, 5) for j in (9, 10)]


@pytest.mark.parametrize("form", FORMS)
def test_products_by_blocks(spark, stored, form):
    m = stored[1][form]()
    z = nf.standardize(m)
    a = (X - X.mean(0)) / X.std(0)
    b = np.random.default_rng(0).normal(size=(11, 3))
    u = spark.createDataFrame([(i, float(i % 5 - 2)) for i in range(37)], "k bigint, u double")
    assert z.chunked
    np.testing.assert_allclose(values(z.matmat(b)), a @ b, atol=1e-10)
    np.testing.assert_allclose(values(z.with_intercept().matmat(np.vstack((b[:1], b)))), b[:1] + a @ b, atol=1e-10)
    want = np.column_stack([np.arange(37) % 5 - 2.0, np.arange(37.0)])
    from pyspark.sql import functions as F

    np.testing.assert_allclose(z.rmatmat([u, F.col("i")]), a.T @ want, atol=1e-9)
    np.testing.assert_allclose(z.with_intercept().rmatvec(u), np.concatenate(([want[:, 0].sum()], a.T @ want[:, 0])), atol=1e-9)
    np.testing.assert_allclose(want[:, 0] @ z, a.T @ want[:, 0], atol=1e-9)
    cut = z.submatrix((4, 22), (2, 9))
    assert cut.chunked
    np.testing.assert_allclose(values(cut @ np.ones(7)), a[4:22, 2:9].sum(1, keepdims=True), atol=1e-10)
    np.testing.assert_allclose(cut.rmatvec(F.col("i")), a[4:22, 2:9].T @ np.arange(4.0, 22), atol=1e-9)
    np.testing.assert_allclose(cut.toarray(), a[4:22, 2:9], atol=1e-12)
    np.testing.assert_allclose(z.submatrix((30, 99)).toarray(), a[30:], atol=1e-12)
    assert z.submatrix((5, 5)).matvec(np.ones(11)).count() == 0 and z.submatrix(None, (3, 3)).rmatvec(u).shape == (0,)
    np.testing.assert_allclose(z.gram(), a.T @ a, atol=1e-9)
    two = nf.ColumnNormalization().then(nf.ColumnNormalization("min", "maxabs")).fit_apply(m)
    low = a - a.min(0)
    np.testing.assert_allclose(values(two @ b[:, 0]), (low / np.abs(low).max(0)) @ b[:, :1], atol=1e-10)
    rows = nf.RowNormalization("none", "l2").fit_apply(m)
    assert not rows.chunked
    np.testing.assert_allclose(rows.toarray(), X / np.linalg.norm(X, axis=1, keepdims=True), atol=1e-12)


def test_vectors_that_do_not_fit_raise(spark, stored):
    z = nf.standardize(stored[1]["zarr"]())
    for keys in (range(36), range(38)):
        with pytest.raises(Exception, match="lacks the key|has a key"):
            z.rmatvec(spark.createDataFrame([(k, 1.0) for k in keys], "k bigint, u double"))
    with pytest.raises(ValueError, match="for 37 rows"):
        np.ones(36) @ z


def test_products_move_no_rows(stored):
    z = nf.standardize(stored[1]["zarr"]())
    plan = z.matvec(np.ones(11))._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "Join" not in plan and plan.count("Exchange") == 1  # partial results by chunk row
    wide = nf.standardize(stored[1]["one across"]())
    assert "Exchange" not in wide.matvec(np.ones(11))._jdf.queryExecution().executedPlan().toString()


def test_a_rectangle_opens_its_own_file(spark, tmp_path):
    """One of 400 chunks: one file is opened; with the other files gone, it is still read."""
    x = np.arange(40.0 * 60).reshape(40, 60) + 1
    nf.write_zarr(nf.from_numpy(spark, x), str(tmp_path / "a"), 40, (2, 3))
    files = sorted((tmp_path / "a" / "c").rglob("*"))
    assert sum(f.is_file() for f in files) == 400
    m = nf.read_zarr(spark, str(tmp_path / "a"))
    how, uri = zarr._format(spark, str(tmp_path / "a")), zarr.qualified(spark, str(tmp_path / "a"))
    assert opened(zarr.ZarrReader(uri, how, (3, 4), (5, 6))) == ["c/3/5"]
    for f in files:
        if f.is_file() and str(f).rsplit("/c/", 1)[1] != "3/5":
            f.write_bytes(b"not a chunk")  # opening any other would fail
    np.testing.assert_array_equal(m.read_block((6, 8), (15, 18)), x[6:8, 15:18])
    np.testing.assert_array_equal(nf.NormalizedFrame(m, []).submatrix((6, 8), (16, 17)).toarray(), x[6:8, 16:17])
    with pytest.raises(Exception, match="incorrect header|rror -3"):
        m.read_block((6, 9), (15, 18))


def test_filters_reach_the_reader(spark, tmp_path):
    x = np.arange(24.0).reshape(6, 4) + 1
    nf.write_zarr(nf.from_numpy(spark, x), str(tmp_path / "a"), 6, (2, 2))
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        chunks = nf.read_zarr(spark, str(tmp_path / "a")).chunks
        near = chunks.filter("ci >= 1 and ci < 2 and cj = 1 and size(values) = 4")
        for other in ("0/0", "0/1", "1/0", "2/0", "2/1"):
            (tmp_path / "a" / "c" / other).write_bytes(b"not a chunk")
        assert [(r["ci"], r["cj"], r["values"]) for r in near.collect()] == [(1, 1, x[2:4, 2:].ravel().tolist())]
        assert chunks.filter("ci > 2 and ci <= 0").collect() == []
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_partitions_hold_many_small_files(spark, stored, monkeypatch):
    how = zarr._format(spark, str(stored[0] / "z"))
    whole = lambda: zarr.ZarrReader("file:/x", how, (0, 8), (0, 4)).partitions()
    files = sorted(f"c/{i}/{j}" for i in range(8) for j in range(4))
    for chunks, tasks in ((100, [((0, 8), (0, 4))]), (9, [((i, i + 2), (0, 4)) for i in (0, 2, 4, 6)]), (2, [((i, i + 1), (j, j + 2)) for i in range(8) for j in (0, 2)])):
        monkeypatch.setattr(zarr, "TASK_BYTES", chunks * 8 * 15)
        assert [(p.rows, p.cols) for p in whole()] == tasks and sorted(opened(zarr.ZarrReader("file:/x", how, (0, 8), (0, 4)))) == files
    monkeypatch.setattr(zarr, "TASK_BYTES", 1)
    monkeypatch.setattr(zarr, "MOST_TASKS", 8)
    assert len(whole()) == 8
    assert zarr.ZarrReader("file:/x", how, (0, 0), (0, 0)).partitions() == []


def test_stores_that_only_spark_reads(spark, stored, monkeypatch):
    monkeypatch.setattr(zarr, "_where", lambda uri: (_ for _ in ()).throw(zarr.pa.ArrowInvalid("no such store")))
    m = nf.read_zarr(spark, str(stored[0] / "z"))
    assert not m.complete
    np.testing.assert_array_equal(m.read_block((0, 37), (0, 11)), X)
    np.testing.assert_array_equal(m.read_block((5, 9), (3, 6)), X[5:9, 3:6])  # in part a chunk that is absent
    monkeypatch.setattr(zarr, "NAMED_FILES", 1)
    np.testing.assert_array_equal(m.read_block((5, 9), (2, 6)), X[5:9, 2:6])


@pytest.mark.parametrize("fill,size", [(0.0, "float64"), (float("nan"), "float32"), (float("inf"), "float64")])
def test_written_arrays(spark, tmp_path, fill, size):
    x = np.full((9, 5), fill)
    x[3, 1:4] = 2.5
    nf.write_zarr(nf.from_numpy(spark, x), str(tmp_path / "a"), 9, (2, 2), fill=fill, size=size)
    meta = json.loads((tmp_path / "a" / "zarr.json").read_text())
    assert meta["shape"] == [9, 5] and meta["data_type"] == size
    assert sorted(str(f).rsplit("/c/", 1)[1] for f in (tmp_path / "a" / "c").rglob("*") if f.is_file()) == ["1/0", "1/1"]  # chunks of fill are left out, no drafts stay
    np.testing.assert_array_equal(nf.read_zarr(spark, str(tmp_path / "a")).read_block((0, 9), (0, 5)), x)


def test_chunk_rows_are_cut_as_wholes(spark, tmp_path):
    from normframe.sources.chunks import to_chunks

    plan = to_chunks(nf.from_numpy(spark, X), (5, 3))._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and plan.count("Exchange") == 1
    some = nf.from_numpy(spark, X)
    some.df = some.df.filter("i % 3 = 0")  # rows that are not there are fill
    nf.write_chunks(some, str(tmp_path / "c"), 37, (5, 3), fill=-1.0)
    want = np.where((np.arange(37) % 3 == 0)[:, None], X, -1.0)
    np.testing.assert_array_equal(nf.read_chunks(spark, str(tmp_path / "c"), (37, 11), (5, 3), -1.0).read_block((0, 37), (0, 11)), want)
