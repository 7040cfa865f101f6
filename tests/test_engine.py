"""The engine against NumPy, over centers, scales, layouts and axes."""

import gzip
import json
import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import normframe as nf
from normframe.functions.numeric import normal_range
from normframe.operators import weighted
from normframe.operators.frame import InMemory
from normframe.plans import selection
from normframe.streaming.frozen import normalize_stream, score_stream

X = np.array([[0, -6, 5, 0], [2, 0, 5, 0], [0, 3, 5, 0], [9, 0, 5, 0]], float)
V = np.array([0.5, -2, 1, 3])
U = np.array([1, -0.25, 2, 0])
NEW = np.array([[10, -8, 8, 1], [-1, 1, 4, 0]], float)
CENTERS = [True, False, "none", "mean", "min", "median"]
SCALES = [
    dict(scale=True), dict(scale=False), dict(scale="sd", df=1), dict(scale="range"), dict(scale="maxabs"), dict(scale="l1"), dict(scale="l2"),
    dict(scale="quantile_range"), dict(scale="quantile_range", quantile_range=(0.1, 0.9), unit_variance=True),
]


def reference(x, axis, center=True, scale=True, df=0, quantile_range=(0.25, 0.75), unit_variance=False):
    center = {True: "mean", False: "none"}.get(center, center)
    scale = {True: "sd", False: "none"}.get(scale, scale)
    c = {"none": lambda: None, "mean": lambda: x.mean(axis), "min": lambda: x.min(axis), "median": lambda: np.median(x, axis)}[center]()
    wide = lambda a: a if axis == 0 else a[:, None]
    moved = x if c is None else x - wide(c)
    n = x.shape[axis]
    if scale == "none":
        s = None
    elif scale == "sd":
        s = np.sqrt(((x - wide(x.mean(axis))) ** 2).sum(axis) / (n - df)) if n > df else np.full(x.shape[1 - axis], np.nan)
    elif scale == "range":
        s = x.max(axis) - x.min(axis)
    elif scale == "quantile_range":
        q = np.quantile(x, quantile_range, axis=axis)
        s = (q[1] - q[0]) / (normal_range(*quantile_range) if unit_variance else 1)
    else:
        s = {"maxabs": lambda: np.abs(moved).max(axis), "l1": lambda: np.abs(moved).sum(axis), "l2": lambda: np.sqrt((moved**2).sum(axis))}[scale]()
    if s is not None:
        s = np.where(s == 0, 1, s)
        moved = moved / wide(s)
    return moved, c, s


def layouts(spark, x):
    array = nf.from_numpy(spark, x)
    i, j = np.nonzero(x)
    # Every entry in two halves, and one cell that cancels out.
    coo = nf.from_coo(spark, [*i, *i, 3, 3], [*j, *j, 1, 1], [*(x[i, j] / 2), *(x[i, j] / 2), 5.0, -5.0], x.shape)
    return {"wide": array.to_wide(), "array": array, "coo": coo}


@pytest.fixture(scope="module")
def made(spark):
    out = layouts(spark, X)
    for m in out.values():
        m.df = m.df.cache()
    return out


def long(spark, u):
    return spark.createDataFrame([(k, float(x)) for k, x in enumerate(u)], "i bigint, u double")


def values(df):
    rows = sorted(df.collect(), key=lambda r: r[0])
    return np.array([list(r)[1:] for r in rows], float).squeeze()


@pytest.mark.parametrize("layout", ["wide", "array", "coo"])
@pytest.mark.parametrize("axis", [0, 1])
def test_all_recipes(spark, made, layout, axis):
    if layout != "wide":
        cases = [(c, s) for k, c in enumerate(CENTERS[2:]) for m, s in enumerate(SCALES) if (k + m) % 2 == 0]
    else:
        cases = [(c, s) for c in CENTERS[1:] for s in SCALES if c is not False or s == SCALES[0]]
    for center, scale in cases:
        want, c, s = reference(X, axis, center, **scale)
        z = nf.normalize(made[layout], axis=axis, center=center, **scale)
        np.testing.assert_allclose(z.toarray(), want, rtol=1e-12, atol=1e-12, err_msg=f"{center} {scale}")
        if axis == 0:
            for have, expect in ((z.centers, c), (z.scales, s)):
                assert (have is None) == (expect is None)
                if have is not None:
                    np.testing.assert_allclose(have, expect, atol=1e-12)


@pytest.mark.parametrize("layout", ["wide", "array", "coo"])
@pytest.mark.parametrize("axis", [0, 1])
def test_products(spark, made, layout, axis):
    z = nf.standardize(made[layout], axis=axis)
    a = reference(X, axis)[0]
    close = lambda x, y: np.testing.assert_allclose(x, y, atol=1e-10)
    u = long(spark, U)
    close(values(z @ V), a @ V)
    close(z.rmatvec(u), a.T @ U)
    close(z.T @ u, a.T @ U)
    assert z.T.T is z and z.T is z.T
    b = np.column_stack((V, V * 2, [1, 0, 0, 1]))
    close(values(z @ b), a @ b)
    close(z.rmatmat([u, "i"]), a.T @ np.column_stack((U, np.arange(4))))
    assert abs(float(U @ values(z @ V)) - float(z.rmatvec(u) @ V)) < 1e-10
    close(values(z.matvec_scaled(V, 2, u, -1)), 2 * a @ V - U)
    close(values(z.matvec_scaled(V, 0, u, 3)), 3 * U)
    close(values(z.matvec_scaled(V, 1, long(spark, [math.nan] * 4), 0)), a @ V)
    close(z.rmatvec_scaled(u, 2, V, 0.5), 2 * a.T @ U + V / 2)
    one = z.with_intercept()
    a1 = np.column_stack((np.ones(4), a))
    close(values(one @ [2, *V]), a1 @ [2, *V])
    close(one.rmatvec(u), a1.T @ U)
    w = long(spark, [1, 0, -0.5, 2])
    wv = np.array([1, 0, -0.5, 2])
    close(z.weighted_sums(w), wv @ a)
    close(one.weighted_sums(w), wv @ a1)
    close(z.gram(w), a.T @ (wv[:, None] * a))
    close(one.gram(), a1.T @ a1)


@pytest.mark.parametrize("layout", ["wide", "array", "coo"])
def test_columns_rows_and_selections(spark, made, layout):
    z = nf.standardize(made[layout])
    a = reference(X, 0)[0]
    np.testing.assert_allclose(values(z[:, -3]), a[:, 1], atol=1e-12)
    c = z.column_view(0)
    u, w = long(spark, U), long(spark, [1, 2, 0, 3])
    wv = np.array([1, 2, 0, 3])
    for have, want in (
        (c.sum(), a[:, 0].sum()), (c.norm_squared(), (a[:, 0] ** 2).sum()), (c.dot(u), a[:, 0] @ U), (c.weighted_dot(w, u), (wv * a[:, 0]) @ U),
        (c.weighted_norm_squared(w), wv @ a[:, 0] ** 2), (c.get(2), a[2, 0]), (z.entry(3, 0), a[3, 0]),
    ):
        assert abs(have - want) < 1e-12
    np.testing.assert_allclose(values(c.add_to(2, u)), U + 2 * a[:, 0], atol=1e-12)
    np.testing.assert_allclose(values(z.row(1)), a[1], atol=1e-12)
    np.testing.assert_allclose(z.submatrix((1, 3), (1, 4)).toarray(), a[1:3, 1:4], atol=1e-12)
    np.testing.assert_allclose(z.submatrix((1, 4)).submatrix(None, (0, 2)).gram(), a[1:4, :2].T @ a[1:4, :2], atol=1e-10)
    before = nf.standardize(nf.take_rows(made[layout], [0, 1, 3]))
    np.testing.assert_allclose(before.toarray(), reference(X[[0, 1, 3]], 0)[0], atol=1e-12)
    with pytest.raises(ValueError):
        nf.take_rows(made[layout], [1, 1])
    with pytest.raises(IndexError):
        z.column(4)
    if layout == "coo":
        back, stored = z.corrections(0)
        assert abs(back - a[0, 0]) < 1e-12
        np.testing.assert_allclose(values(stored), X[[1, 3], 0] / z.scales[0])


def test_parameters_transfer(spark, made, tmp_path):
    p = nf.ColumnNormalization("median", "range").fit(made["wide"])
    p.save(spark, str(tmp_path / "p"))
    q = nf.ColumnParams.load(spark, str(tmp_path / "p"))
    assert q == p
    half = nf.ColumnParams(2, None, [2.0, math.inf])
    half.save(spark, str(tmp_path / "h"))
    assert nf.ColumnParams.load(spark, str(tmp_path / "h")) == half
    new = nf.from_numpy(spark, NEW)
    _, c, s = reference(X, 0, "median", "range")
    np.testing.assert_allclose(q.transform(new).toarray(), (NEW - c) / s)
    rows = nf.RowNormalization("min", "l1").fit(made["array"])
    np.testing.assert_allclose(rows.apply_frozen(made["array"]).toarray(), reference(X, 1, "min", "l1")[0])
    rows.save(str(tmp_path / "r"))
    again = nf.RowParams.load(spark, str(tmp_path / "r"), "i", True, True)
    np.testing.assert_allclose(again.apply_frozen(made["wide"]).toarray(), reference(X, 1, "min", "l1")[0])
    own = nf.RowParams.of(spark, [0, 1], [1.0, 2.0], None)
    np.testing.assert_allclose(own.apply_frozen(new).toarray(), NEW - [[1], [2]])
    for bad in (lambda: nf.ColumnParams(2, [1.0]), lambda: nf.ColumnParams(1, None, [-0.0]), lambda: nf.ColumnParams(-1), lambda: q.transform(nf.from_numpy(spark, NEW[:, :2]))):
        with pytest.raises(ValueError):
            bad()
    assert nf.ColumnParams(1, None, [math.nan]).scales[0] != 0


@pytest.mark.parametrize("layout", ["wide", "array", "coo"])
def test_chains(spark, layout):
    train = np.array([[1, 3, 8], [-2, 5, 3], [6, 4, 0]], float)
    valid = np.array([[10, 1, 5], [-8, 20, 0]], float)
    chain = nf.RowNormalization.min_max().then(nf.ColumnNormalization.standardize()).then(nf.RowNormalization("mean", "l1"))
    a1 = reference(train, 1, "min", "range")[0]
    a2, c, s = reference(a1, 0)
    want = reference(a2, 1, "mean", "l1")[0]
    data = nf.from_numpy(spark, train)
    data = {"wide": data.to_wide(), "array": data, "coo": data.to_coo()}[layout]
    fitted = chain.fit(data)
    np.testing.assert_allclose(fitted.apply_frozen(data).toarray(), want, atol=1e-12)
    np.testing.assert_allclose(chain.fit_apply(data).toarray(), want, atol=1e-12)
    new = fitted.for_new_samples(nf.from_numpy(spark, valid))
    expect = reference((reference(valid, 1, "min", "range")[0] - c) / s, 1, "mean", "l1")[0]
    np.testing.assert_allclose(new.toarray(), expect, atol=1e-12)
    np.testing.assert_allclose(values(new @ [0.5, -2, 1]), expect @ [0.5, -2, 1], atol=1e-12)
    with pytest.raises(ValueError):
        fitted.for_new_samples(nf.from_numpy(spark, valid[:, :2]))


def test_hard_numbers(spark):
    big = nf.from_numpy(spark, [[1e12 + 1], [1e12 + 2], [1e12 + 3]])
    for m in (big, big.to_wide(), big.to_coo()):
        s = nf.ColumnStatistics(m)
        for df in (0, 1, 2):
            assert abs(s.sds(df)[0] - math.sqrt(2 / (3 - df))) < 1e-10
        assert math.isnan(s.sds(3)[0])
        assert s.quantile_ranges()[0] == 1.0
    nan = nf.from_numpy(spark, [[1.0, math.nan, math.inf], [2.0, 3.0, 1.0], [0.0, 1.0, 2.0]])
    for m in (nan, nan.to_wide(), nan.to_coo(True)):
        s = nf.ColumnStatistics(m)
        for f in (s.mins, s.ranges, s.maxabs, s.medians, s.l1, s.l2, s.means):
            got = f()
            assert math.isnan(got[1]) and not math.isnan(got[0])
        assert s.maxabs()[2] == math.inf
    row = nf.normalize(nan, axis=1, center="min", scale="range").toarray()
    assert np.isnan(row[0]).all() and not np.isnan(row[1:]).any()
    assert nf.normalize(nf.from_numpy(spark, [[3.0, 4.0], [0.0, 0.0]]), axis=1, center=False, scale="l2").toarray().tolist() == [[0.6, 0.8], [0, 0]]


def test_fixed_statistics(spark):
    x = np.array([[1, 0, 5], [3, 0, 5], [0, 0, 5]], float)
    for m in layouts_plain(spark, x):
        s = nf.ColumnStatistics(m)
        c = s.means()
        for have, want in (
            (c, [4 / 3, 0, 5]), (s.sds(), [math.sqrt(14 / 9), 0, 0]), (s.sds(1), [math.sqrt(7 / 3), 0, 0]), (s.mins(), [0, 0, 5]), (s.ranges(), [3, 0, 0]),
            (s.l1(), [4, 0, 15]), (s.l2(), [math.sqrt(10), 0, math.sqrt(75)]), (s.maxabs(), [3, 0, 5]), (s.l1(c), [10 / 3, 0, 0]),
            (s.l2(c), [math.sqrt(14 / 3), 0, 0]), (s.maxabs(c), [5 / 3, 0, 0]), (s.medians(), [1, 0, 5]),
        ):
            np.testing.assert_allclose(have, want, atol=1e-12)
        assert nf.standardize(m).scales[1] == 1


def layouts_plain(spark, x):
    array = nf.from_numpy(spark, x)
    return array.to_wide(), array, array.to_coo()


def test_empty(spark):
    rows = nf.from_numpy(spark, np.zeros((1, 3))).where(F.col("i") < 0)
    for m in (rows, rows.to_wide(), nf.from_coo(spark, [], [], [], (0, 3))):
        s = nf.ColumnStatistics(m)
        for f in (s.means, s.sds, s.mins, s.ranges, s.medians, s.quantile_ranges):
            assert np.isnan(f()).all()
        assert not s.l1().any() and not s.l2().any() and not s.maxabs().any()
        with pytest.raises(ValueError):
            nf.standardize(m)
        p = nf.ColumnNormalization("none", "l2").fit(m, allow_empty=True)
        assert p.scales == (1.0, 1.0, 1.0)
        assert np.isnan(nf.ColumnNormalization().fit(m, allow_empty=True).centers).all()


def test_nulls_and_lengths(spark):
    df = spark.createDataFrame([(1, 1.0, None), (2, 2.0, 3.0)], "k bigint, a double, b double")
    with pytest.raises(Exception, match="NULL in matrix column b"):
        nf.ColumnStatistics(nf.Wide(df, "k", ["a", "b"])).means()
    assert np.isnan(nf.ColumnStatistics(nf.Wide(df, "k", ["a", "b"], nulls="nan")).means()[1])
    bad = spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], "k bigint, x array<double>")
    with pytest.raises(Exception, match="does not hold 2 values"):
        nf.Array(bad, "k", "x", 2).df.collect()


@pytest.mark.parametrize(
    "options",
    [dict(center="max"), dict(scale="var"), dict(df=-1), dict(quantile_range=(0.5, 0.5)), dict(quantile_range=(0, 1), scale="quantile_range", unit_variance=True), dict(unit_variance=True), dict(quantile_range=(1,))],
)
def test_wrong_options(options):
    with pytest.raises(ValueError):
        nf.ColumnNormalization(**options)


def test_wrong_types(spark):
    m = nf.from_numpy(spark, X)
    for call in (lambda: nf.ColumnNormalization(center=3), lambda: nf.ColumnNormalization(unit_variance=1), lambda: nf.normalize(m, axis=True), lambda: nf.standardize(m, center="mean"), lambda: nf.from_numpy(spark, [["a"]]), lambda: np.asarray(nf.standardize(m))):
        with pytest.raises(TypeError):
            call()
    with pytest.raises(ValueError):
        nf.normalize(m, axis=2)
    assert abs(normal_range(0.25, 0.75) - 1.3489795003921634) < 1e-12


def test_wide_gram_by_blocks(spark, monkeypatch):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(60, 20)) + 1e3  # an ulp of the mean, times the sum of weights, stays below the tolerance
    m = nf.from_numpy(spark, x)
    want = reference(x, 0)[0]
    np.testing.assert_allclose(nf.standardize(m.to_wide()).gram(), want.T @ want, rtol=1e-9, atol=1e-7)
    monkeypatch.setattr(weighted, "EXPRESSION_SUMS", 3)
    np.testing.assert_allclose(nf.standardize(m.to_wide()).weighted_sums("i"), np.arange(60) @ want, rtol=1e-8, atol=1e-7)


def test_long_vectors(spark):
    a, b = long(spark, [1, 2, 3]), long(spark, [4, 5, 6])
    assert weighted.dot(a, b) == 32
    assert weighted.l2_norm(b) == math.sqrt(77)
    assert values(weighted.axpy(2, a, b)).tolist() == [6, 9, 12]
    assert values(weighted.scale(-1, a)).tolist() == [-1, -2, -3]


def test_chunks(spark, tmp_path):
    x = np.array([[1, 2, 3], [4, 5, 6], [1.5, 1.5, 9]])
    nf.write_chunks(nf.from_numpy(spark, x), str(tmp_path / "c"), 3, (2, 2), fill=1.5)
    m = nf.read_chunks(spark, str(tmp_path / "c"), (3, 3), (2, 2), fill=1.5)
    assert m.read_block((0, 3), (0, 3)).tolist() == x.tolist()
    assert m.read_block((1, 3), (1, 2)).tolist() == x[1:3, 1:2].tolist()
    one = nf.ChunkedMatrix(spark.createDataFrame([(0, 0, [1.0, 2.0, 3.0, 4.0])], "ci bigint, cj bigint, values array<double>"), (3, 3), (2, 2), 7.0)
    full = np.full((3, 3), 7.0)
    full[:2, :2] = [[1, 2], [3, 4]]
    for source, dense in ((m, x), (one, full)):
        z = nf.standardize(source)
        np.testing.assert_allclose(z.toarray(), reference(dense, 0)[0], atol=1e-12)
        np.testing.assert_allclose(values(z @ [1, 2, 3]), reference(dense, 0)[0] @ [1, 2, 3], atol=1e-12)
        np.testing.assert_allclose(nf.ColumnStatistics(source).medians(), np.median(dense, 0))
        np.testing.assert_allclose(z.submatrix((1, 3), (0, 2)).toarray(), reference(dense, 0)[0][1:3, :2], atol=1e-12)


def test_zarr(spark, tmp_path):
    x = np.arange(12, dtype="<f4").reshape(4, 3)
    two = tmp_path / "two"
    two.mkdir()
    (two / ".zarray").write_text(json.dumps({"zarr_format": 2, "shape": [4, 3], "chunks": [2, 2], "dtype": "<f4", "compressor": {"id": "zlib", "level": 1}, "fill_value": "NaN", "order": "C", "filters": None}))
    for ci, cj in ((0, 0), (0, 1), (1, 0)):
        block = np.full((2, 2), -1, "<f4")
        part = x[2 * ci : 2 * ci + 2, 2 * cj : 2 * cj + 2]
        block[: part.shape[0], : part.shape[1]] = part
        (two / f"{ci}.{cj}").write_bytes(zlib.compress(block.tobytes()))
    got = nf.read_zarr(spark, str(two)).read_block((0, 4), (0, 3))
    want = x.astype(float)
    want[2:, 2] = np.nan
    np.testing.assert_array_equal(got, want)
    three = tmp_path / "three"
    (three / "c" / "0").mkdir(parents=True)
    codecs = [{"name": "bytes", "configuration": {"endian": "big"}}]
    (three / "zarr.json").write_text(json.dumps({"zarr_format": 3, "node_type": "array", "shape": [2, 2], "data_type": "float64", "chunk_grid": {"name": "regular", "configuration": {"chunk_shape": [2, 2]}}, "chunk_key_encoding": {"name": "default", "configuration": {"separator": "/"}}, "fill_value": 0, "codecs": codecs}))
    (three / "c" / "0" / "0").write_bytes(np.array([[1, 2], [3, 4]], ">f8").tobytes())
    assert nf.read_zarr(spark, str(three)).read_block((0, 2), (0, 2)).tolist() == [[1, 2], [3, 4]]


def test_zarr_shards(spark, tmp_path):
    x = np.arange(48, dtype="<f8").reshape(8, 6)
    codecs = [{"name": "bytes", "configuration": {"endian": "little"}}, {"name": "gzip"}, {"name": "crc32c"}]
    for where in ("start", "end"):
        root = tmp_path / where
        sharding = {"name": "sharding_indexed", "configuration": {"chunk_shape": [2, 3], "codecs": codecs, "index_location": where, "index_codecs": [{"name": "bytes", "configuration": {"endian": "little"}}, {"name": "crc32c"}]}}
        meta = {"zarr_format": 3, "node_type": "array", "shape": [7, 6], "data_type": "float64", "chunk_grid": {"name": "regular", "configuration": {"chunk_shape": [4, 6]}}, "chunk_key_encoding": {"name": "default", "configuration": {"separator": "."}}, "fill_value": "0x7ff0000000000000", "codecs": [sharding]}
        root.mkdir()
        (root / "zarr.json").write_text(json.dumps(meta))
        for s in range(2):
            blobs = [gzip.compress(x[4 * s + 2 * a : 4 * s + 2 * a + 2, 3 * b : 3 * b + 3].tobytes()) + b"sums" for a in range(2) for b in range(2)]
            at, index, body = 68 if where == "start" else 0, [], b""
            for k, blob in enumerate(blobs):
                if (s, k) == (0, 3):  # a chunk that is not there
                    index += [(1 << 64) - 1] * 2
                    continue
                index += [at + len(body), len(blob)]
                body += blob
            table = np.array(index, "<u8").tobytes() + b"sums"
            (root / f"c.{s}.0").write_bytes(table + body if where == "start" else body + table)
        want = x[:7].copy()
        want[2:4, 3:] = np.inf
        m = nf.read_zarr(spark, str(root))
        assert m.chunk == (2, 3)
        np.testing.assert_array_equal(m.read_block((0, 7), (0, 6)), want)
        np.testing.assert_array_equal(m.to_array((1, 6), (2, 5)).to_wide().df.drop("i").toPandas().to_numpy().sum(), want[1:6, 2:5].sum())


@pytest.mark.parametrize("change", [{"dtype": "<i4"}, {"filters": [{"id": "delta"}]}, {"compressor": {"id": "blosc"}}, {"shape": [4]}])
def test_zarr_that_is_not_supported(spark, tmp_path, change):
    meta = {"zarr_format": 2, "shape": [4, 3], "chunks": [2, 2], "dtype": "<f4", "compressor": None, "fill_value": 0, "order": "C", "filters": None}
    (tmp_path / ".zarray").write_text(json.dumps(meta | change))
    with pytest.raises(ValueError):
        nf.read_zarr(spark, str(tmp_path))
    with pytest.raises(ValueError, match="no array metadata"):
        nf.read_zarr(spark, str(tmp_path / "none"))


def test_rectangles_prune_chunk_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("normframe.sources.chunks.FOLDER_BYTES", 1)
    nf.write_chunks(nf.from_numpy(spark, np.arange(60.0).reshape(20, 3) + 1), str(tmp_path / "c"), 20, (4, 2))
    assert len(list((tmp_path / "c").glob("band=*"))) == 5
    m = nf.read_chunks(spark, str(tmp_path / "c"), (20, 3), (4, 2))
    plan = m.rectangle((4, 8), (0, 2)).chunks._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(band" in plan and "PushedFilters: [IsNotNull(ci)" in plan
    assert m.read_block((4, 8), (0, 2)).tolist() == (np.arange(60.0).reshape(20, 3) + 1)[4:8, :2].tolist()


@pytest.mark.parametrize("layout", ["wide", "array", "coo"])
@pytest.mark.parametrize("keys", [[0, 1, 2], [0, 1, 2, 3, 3], [0, 1, 2, 3, 4], [0, 1, 2, 9]])
def test_long_vectors_that_do_not_fit_raise(spark, made, layout, keys):
    u = spark.createDataFrame([(k, 1.0) for k in keys], "i bigint, u double")
    z = nf.standardize(made[layout])
    params = nf.RowParams.of(spark, keys, [1.0] * len(keys))
    for call in (lambda: z.rmatvec(u), lambda: z.gram(u), lambda: z.weighted_sums(u), lambda: z.column_view(0).dot(u), lambda: z.matvec_scaled(V, 1, u, 1).collect(), lambda: params.apply_frozen(made[layout]).toarray(), lambda: weighted.dot(long(spark, U), u)):
        with pytest.raises(Exception, match="the (vector|table of row parameters) (lacks the key|repeats the key|has a key)"):
            call()


def test_coordinates_stay_sparse(spark, made):
    coo, new = made["coo"], np.array([2.0, -1, 4, 0.5])
    chains = [
        [nf.ColumnNormalization(), nf.ColumnNormalization("min", "maxabs")], [nf.RowNormalization("none", "l2"), nf.ColumnNormalization()],
        [nf.RowNormalization("median", "range")], [nf.RowNormalization("mean", "sd"), nf.ColumnNormalization("none", "l1")],
    ]
    for chain in chains:
        frames = [nf.Chain(tuple(chain)).fit_apply(m) for m in (coo, made["array"])]
        z, dense = frames
        a = dense.toarray()
        assert z.sparse is not None and dense.sparse is None
        u = long(spark, U)
        np.testing.assert_allclose(values(z @ np.column_stack((V, new))), a @ np.column_stack((V, new)), atol=1e-10)
        np.testing.assert_allclose(z.rmatvec(u), a.T @ U, atol=1e-10)
        np.testing.assert_allclose(z.with_intercept().gram(long(spark, [1, 0, -0.5, 2])), np.column_stack((np.ones(4), a)).T @ np.diag([1, 0, -0.5, 2]) @ np.column_stack((np.ones(4), a)), atol=1e-10)
        np.testing.assert_allclose(values(z[:, 1]), a[:, 1], atol=1e-12)
        zero, stored = z.corrections(1)
        background = np.full(4, zero) if isinstance(zero, float) else values(zero)
        np.testing.assert_allclose(background + np.array([{r["i"]: r["value"] for r in stored.collect()}.get(k, 0.0) for k in range(4)]), a[:, 1], atol=1e-12)
        np.testing.assert_allclose(z.toarray(), a, atol=1e-12)
        plan = z.matvec(V)._jdf.queryExecution().analyzed().toString()
        assert "fill(" not in plan  # rows are not filled
    z = nf.ColumnNormalization().fit_apply(coo)
    wild = long(spark, [math.inf, 0, 0, 0])
    with np.errstate(invalid="ignore"):
        want = np.array([math.inf, 0, 0, 0]) @ np.where(z.toarray() == 0, 1e-300, z.toarray())
    got = z.weighted_sums(wild)  # a sign for each column, and no NaN where the entry is not zero
    assert (got[:2] == want[:2]).all()
    full = nf.ColumnNormalization().then(nf.RowNormalization("none", "l2")).fit_apply(coo)
    assert full.sparse is None and np.allclose(full.toarray(), reference(reference(X, 0)[0], 1, "none", "l2")[0])


def test_exact_quantiles_in_bounded_memory(spark, monkeypatch):
    monkeypatch.setattr(selection, "MOST_BITS", 7)
    r = np.random.default_rng(6)
    x = np.column_stack((r.normal(size=900), np.round(r.normal(size=900)), np.where(r.random(900) < 0.7, 0, r.normal(size=900)), r.normal(size=900) * 10.0 ** r.integers(-200, 200, 900)))
    x[:3, 0] = np.inf, -np.inf, 0.0
    qs = (0.0, 0.013, 0.25, 0.5, 0.75, 1.0)
    want = np.quantile(x[:, 1:], qs, axis=0).T
    array = nf.from_numpy(spark, x).to_wide().to_array()
    for m in (array, array.to_wide(), array.to_coo()):
        m.df = m.df.cache()
        got = m.quantiles(qs)
        np.testing.assert_allclose(got[1:], want, rtol=1e-12)
        assert got[0][0] == -np.inf and got[0][-1] == np.inf and abs(got[0][3] - np.median(x[:, 0])) < 1e-12
        robust = nf.ColumnNormalization.robust().fit(m)
        spread = np.quantile(x, 0.75, axis=0) - np.quantile(x, 0.25, axis=0)
        np.testing.assert_allclose(robust.scales, np.where(spread == 0, 1, spread), rtol=1e-9)


def test_numpy_operands(spark, made):
    a = reference(X, 0)[0]
    for layout in ("wide", "array", "coo"):
        z = nf.standardize(made[layout])
        np.testing.assert_allclose(U @ z, U @ a, atol=1e-12)
        np.testing.assert_allclose(np.matmul(np.vstack((U, V)), z), np.vstack((U, V)) @ a, atol=1e-12)
        np.testing.assert_allclose(z.T @ U, a.T @ U, atol=1e-12)
        np.testing.assert_allclose(values(np.matmul(z, V)), a @ V, atol=1e-12)
        np.testing.assert_allclose(z.T.toarray(), a.T, atol=1e-12)
        np.testing.assert_allclose(values(z.T[:, 2]), a[2], atol=1e-12)
        np.testing.assert_allclose(z.T.centers, z.centers)
        both = InMemory(z)
        np.testing.assert_allclose(both.rmatmat(np.column_stack((U, V))), a.T @ np.column_stack((U, V)), atol=1e-12)
        np.testing.assert_allclose(both.matvec(V), a @ V, atol=1e-12)
        assert abs(z.normalize_value(1, 1, -6.0) - (-6.0 - z.centers[1]) / z.scales[1]) < 1e-12
        with pytest.raises(ValueError):
            U[:3] @ z
        with pytest.raises(TypeError):
            np.exp(z)


def test_linear_layer_learns(spark, made):
    m, params = made["wide"], nf.ColumnNormalization().fit(made["wide"])
    a = reference(X, 0)[0]
    layer, y = nf.NormalizedLinear(np.zeros((1, 4)), [0.0], centers=params.centers, scales=params.scales), np.array([1.0, 2, -1, 3])
    errors = layer(m, ["y"]).select("i", (F.col("y") - F.element_at(F.array(*map(F.lit, y)), F.col("i").cast("int") + 1)).alias("e"))
    new = layer.step(m, [errors], 0.1)
    np.testing.assert_allclose(new.weight, 0.1 * (y @ a)[None], atol=1e-12)
    np.testing.assert_allclose(new.bias, [0.1 * y.sum()], atol=1e-12)


def test_linear_layer_and_custom_recipe(spark):
    w, b = np.array([[1, 2, 0, -1], [0.5, 0, 1, 2]]), np.array([3.0, -1])
    c, s = np.array([1.0, 2, 3, 4]), np.array([2.0, 1, 4, 0.5])
    for m in layouts_plain(spark, X):
        np.testing.assert_allclose(values(nf.NormalizedLinear(w, b, centers=c, scales=s)(m)), ((X - c) / s) @ w.T + b, atol=1e-12)

    class Half:
        def fit(self, matrix):
            return nf.ColumnParams(matrix.ncols, None, [2.0] * matrix.ncols)

    chain = nf.Chain((Half(),)).then(nf.ColumnNormalization("mean", "none"))
    np.testing.assert_allclose(chain.fit_apply(nf.from_numpy(spark, X)).toarray(), X / 2 - (X / 2).mean(0))


def test_stream(spark, tmp_path):
    m = nf.from_numpy(spark, X).to_wide()
    p = nf.ColumnNormalization().fit(m)
    m.df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(m.df.schema).parquet(str(tmp_path / "in"))
    for k, out in enumerate((normalize_stream(stream, "i", m.columns, p), score_stream(stream, "i", m.columns, p, V))):
        q = out.writeStream.format("memory").queryName(f"stream{k}").trigger(availableNow=True).start()
        q.awaitTermination(60)
        got = values(spark.table(f"stream{k}"))
        want = reference(X, 0)[0]
        np.testing.assert_allclose(got, want if k == 0 else want @ V, atol=1e-12)


def test_raw_data_stays_and_plans_stay_narrow(spark, tmp_path):
    nf.from_numpy(spark, X).to_wide(["a", "b", "c", "d"]).df.write.parquet(str(tmp_path / "t"))
    z = nf.standardize(nf.Wide(spark.read.parquet(str(tmp_path / "t")), "i", ["a", "b", "c", "d"], nulls="trust"))
    plan = z.matvec(V).filter("i < 2")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "LessThan(i,2)" in plan
    narrow = z.submatrix(None, (1, 2)).to_eager()._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<i:bigint,b:double>" in narrow


def test_parameters_in_a_portable_file(spark, tmp_path):
    for p in (nf.ColumnParams(3, [1.0, 2, 3], None), nf.ColumnParams(2, None, [0.5, -2]), nf.ColumnParams(1)):
        path = str(tmp_path / f"{p.ncols}.npz")
        p.save_npz(spark, path)
        assert nf.ColumnParams.load_npz(spark, path) == p
        with np.load(path, allow_pickle=False) as f:
            assert set(f.files) == {"ncols", *(n for n in ("centers", "scales") if getattr(p, n) is not None)}
    with pytest.raises(FileNotFoundError):
        nf.ColumnParams.load_npz(spark, str(tmp_path / "none.npz"))


def test_scipy_operator(spark, made, monkeypatch):
    """SciPy is not installed: a stand-in module takes what the adapter hands over."""
    import sys
    import types

    linalg = types.ModuleType("scipy.sparse.linalg")
    linalg.LinearOperator = lambda shape, **parts: types.SimpleNamespace(shape=shape, **parts)
    for name, module in (("scipy", types.ModuleType("scipy")), ("scipy.sparse", types.ModuleType("scipy.sparse")), ("scipy.sparse.linalg", linalg)):
        monkeypatch.setitem(sys.modules, name, module)
    a = reference(X, 0)[0]
    op = nf.standardize(made["wide"]).aslinearoperator()
    assert op.shape == a.shape and op.dtype == np.float64
    np.testing.assert_allclose(op.matvec(V), a @ V, atol=1e-10)
    np.testing.assert_allclose(op.rmatvec(np.array(U)), a.T @ U, atol=1e-10)
    np.testing.assert_allclose(op.matmat(np.eye(len(V))), a, atol=1e-10)
    np.testing.assert_allclose(op.rmatmat(np.eye(len(U))), a.T, atol=1e-10)
