"""Row statistics, Gram matrices and weighted sums of coordinates from what is stored."""

import itertools

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import normframe as nf
from normframe.operators import sparse

X = np.where(np.random.default_rng(8).random((12, 9)) < 0.5, 0.0, np.random.default_rng(9).normal(size=(12, 9)).round(2))
X[3] = 0  # a row without entries
X[4] = np.arange(9.0) - 4  # a full one, with a stored zero
X[5, :] = -np.abs(X[5])


def coo(spark, x):
    i, j = np.nonzero(x)
    return nf.from_coo(spark, np.append(i, 4), np.append(j, 4), np.append(x[i, j], 0.0), x.shape)


def table(params):
    rows = sorted(params.table.collect())
    return [[r["center"] for r in rows], [r["scale"] for r in rows]]


CENTERS = ["none", "mean", "min", "median"]
SCALES = [("none", {}), ("sd", {}), ("sd", {"df": 1}), ("range", {}), ("quantile_range", {"quantile_range": (0.1, 0.85)}), ("quantile_range", {"unit_variance": True}), ("maxabs", {}), ("l1", {}), ("l2", {})]


@pytest.mark.parametrize("center", CENTERS)
def test_every_row_recipe_without_filling(spark, center, monkeypatch):
    m, dense = coo(spark, X), nf.from_numpy(spark, X)
    m.df = m.df.cache()
    for scale, options in SCALES:
        recipe = nf.RowNormalization(center, scale, **options)
        got, want = table(recipe.fit(m)), table(recipe.fit(dense))
        for a, b in zip(got, want):
            assert (a == b == [None] * 12) or np.allclose(a, b, atol=1e-12), (center, scale)
    monkeypatch.setattr(sparse, "LONG_ROW", 4)
    recipe = nf.RowNormalization.robust((0.2, 0.7))
    np.testing.assert_allclose(table(recipe.fit(m)), table(recipe.fit(dense)), atol=1e-12)


def test_a_nan_poisons_its_row_alone(spark):
    x = X.copy()
    x[2, 1] = np.nan
    for recipe in (nf.RowNormalization(), nf.RowNormalization.min_max(), nf.RowNormalization.robust(), nf.RowNormalization("median", "maxabs")):
        got, want = table(recipe.fit(coo(spark, x))), table(recipe.fit(nf.from_numpy(spark, x)))
        np.testing.assert_allclose(got, want, atol=1e-12)
        assert np.isnan(got).any(0).tolist() == [k == 2 for k in range(12)]


def test_offsets_do_not_erase_deviations(spark):
    x = 1e12 + np.arange(1.0, 4)[None, :]
    m = nf.from_coo(spark, [0, 0, 0], [0, 1, 2], x[0], (1, 3))
    assert abs(table(nf.RowNormalization().fit(m))[1][0] - x.std()) < 1e-10


def test_a_million_columns(spark):
    """Ten entries a row: no array of p zeros is in any plan, nor p x p numbers in any task."""
    r = np.random.default_rng(1)
    n, p = 40, 1_000_000
    i, j = np.repeat(np.arange(n), 10), r.integers(0, p, 10 * n)
    v = r.normal(size=10 * n)
    m = nf.from_coo(spark, i, j, v, (n, p))
    m.df = m.df.cache()
    for recipe in (nf.RowNormalization(), nf.RowNormalization.robust(), nf.RowNormalization("min", "l1"), nf.RowNormalization("none", "maxabs")):
        params = recipe.fit(m)
        plan = params.table._jdf.queryExecution().analyzed().toString()
        assert "array_repeat" not in plan
        center, scale = table(params)
        own = v[:10]
        if recipe.scale == "sd":
            mean = own.sum() / p
            np.testing.assert_allclose(scale[0], np.sqrt((((own - mean) ** 2).sum() + (p - 10) * mean**2) / p), rtol=1e-9)
        if recipe.center == "median":
            assert center == [0.0] * n and scale == [1.0] * n
    z = nf.NormalizedFrame(m)
    pairs = z.gram_pairs().pairs.collect()
    want = {}
    for row in range(n):
        own = {}
        for a, b in zip(j[10 * row : 10 * row + 10].tolist(), v[10 * row : 10 * row + 10].tolist()):
            own[a] = own.get(a, 0.0) + b
        for a, b in itertools.product(own, own):
            if a <= b:
                want[a, b] = want.get((a, b), 0.0) + own[a] * own[b]
    assert {(r["j"], r["k"]) for r in pairs} == set(want)
    assert all(abs(r["g"] - want[r["j"], r["k"]]) < 1e-12 for r in pairs)


def test_transposed_row_fits(spark):
    m = coo(spark, X).transposed()
    for recipe in (nf.RowNormalization(), nf.RowNormalization.robust(), nf.RowNormalization("min", "l2")):
        np.testing.assert_allclose(table(recipe.fit(m)), table(recipe.fit(nf.from_numpy(spark, X.T))), atol=1e-12)


WEIGHTS = [np.arange(12) % 5 - 1.5, np.array([1e16, -1e16, 1, 2, 3, 4, 5, 6, 1e16, -1e16, 7, 8]), np.array([1, 2, 3, 4, np.inf, 6, 7, 8, 9, 10, 11, 12.0]), np.array([1, np.nan, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12.0])]


@pytest.mark.parametrize("rows", [3, 1 << 14])
@pytest.mark.parametrize("k", range(4))
def test_weighted_sums_by_range_sums(spark, monkeypatch, rows, k):
    monkeypatch.setattr(sparse, "SUM_ROWS", rows)
    x = X.copy()
    x[:, 7] = 0  # a column without entries
    w = WEIGHTS[k]
    u = spark.createDataFrame([(i, float(v)) for i, v in enumerate(w)], "i bigint, u double")
    for stages in ([nf.ColumnNormalization("mean", "none")], [nf.RowNormalization("mean", "l2"), nf.ColumnNormalization("min", "maxabs")], [nf.RowNormalization("none", "l1")]):
        z, dense = (nf.Chain(tuple(stages)).fit_apply(m) for m in (coo(spark, x), nf.from_numpy(spark, x)))
        assert z.sparse is not None
        with np.errstate(invalid="ignore"):
            want = (w[:, None] * np.column_stack((np.ones(12), dense.toarray()))).sum(0)
        got = z.with_intercept().weighted_sums(u)
        assert (np.isnan(got) == np.isnan(want)).all()
        scale = np.nansum(np.abs(w[np.isfinite(w)])) * 1e-14
        np.testing.assert_allclose(got, want, atol=max(1e-10, scale))


def test_cancelling_weights_leave_small_ones(spark):
    """Rows that a column lacks: 1e16 and -1e16 cancel, and what is left is exact; total minus stored would lose it."""
    x = np.zeros((6, 2))
    x[0, 0], x[5, 1] = 1e16, 4.0
    w = np.array([1.0, 1, 2, 3, 4, 5])
    z = nf.NormalizedFrame(coo_plain(spark, x), [nf.ColumnParams(2, [-1.0, 0.0], None)])
    u = spark.createDataFrame([(i, float(v)) for i, v in enumerate(w)], "i bigint, u double")
    assert z.weighted_sums(u).tolist() == [1e16 + 1 + 15, 20.0]


def coo_plain(spark, x):
    i, j = np.nonzero(x)
    return nf.from_coo(spark, i, j, x[i, j], x.shape)


@pytest.mark.parametrize("tile,dense,pairs", [(512, 1 / 16, 2_000_000), (4, 0.5, 3), (2, 2.0, 1), (3, 0.0, 5)])
def test_gram_by_tiles_and_pairs(spark, monkeypatch, tile, dense, pairs):
    for name, value in (("TILE", tile), ("DENSE", dense), ("MOST_PAIRS", pairs), ("MOST_TILES", 1), ("BLOCK_ROWS", 5)):
        monkeypatch.setattr(sparse, name, value)
    w = WEIGHTS[0]
    u = spark.createDataFrame([(i, float(v)) for i, v in enumerate(w)], "i bigint, u double")
    for stages in ([], [nf.RowNormalization("none", "l2"), nf.ColumnNormalization()]):
        z = nf.NormalizedFrame(coo(spark, X)) if not stages else nf.Chain(tuple(stages)).fit_apply(coo(spark, X))
        a = X if not stages else nf.Chain(tuple(stages)).fit_apply(nf.from_numpy(spark, X)).toarray()
        a1 = np.column_stack((np.ones(12), a))
        np.testing.assert_allclose(z.with_intercept().gram(u), a1.T @ (w[:, None] * a1), atol=1e-10)
        parts = z.gram_pairs(u)
        stored = {(r["j"], r["k"]): r["g"] for r in parts.pairs.collect()}
        for j, k in ((0, 0), (2, 5), (7, 8)):
            np.testing.assert_allclose(stored.get((j, k), 0.0) + parts.rest(j, k), (w * a[:, j]) @ a[:, k], atol=1e-10)


def test_range_sums():
    r = np.random.default_rng(0)
    for n in (1, 2, 7, 16, 33):
        x = r.integers(-9, 9, (n, 3)).astype(float)
        low = r.integers(0, n + 1, 50)
        high = np.minimum(n, low + r.integers(0, n + 1, 50))
        want = [x[a:b].sum(0) for a, b in zip(low, high)]
        np.testing.assert_array_equal(sparse._range_sums(sparse._sum_tree(x), low, high), want)


def test_row_corrections(spark):
    z, dense = (nf.RowNormalization("none", "l2").then(nf.ColumnNormalization()).fit_apply(m) for m in (coo(spark, X), nf.from_numpy(spark, X)))
    a = dense.toarray()
    for i in (0, 3, 4):
        zero, stored = z.row_corrections(i)
        full = zero.copy()
        for r in stored.collect():
            full[r["j"]] += r["value"]
        np.testing.assert_allclose(full, a[i], atol=1e-12)
    with pytest.raises(IndexError):
        z.row_corrections(99)


def test_index_rules(spark):
    for m in (coo_plain(spark, X), nf.from_numpy(spark, X)):
        z = nf.NormalizedFrame(m)
        row = lambda k: [r["value"] for r in z.T[:, k].orderBy("j").collect()]
        assert row(-1) == X[11].tolist() and row(-12) == X[0].tolist() and row(4) == X[4].tolist()
        for bad in (12, -13):
            with pytest.raises(IndexError):
                z.T[:, bad]
        for flag in (True, np.False_):
            with pytest.raises(TypeError):
                z.T[:, flag]
            with pytest.raises(TypeError):
                z[:, flag]
        with pytest.raises(IndexError):
            z[:, 9]


def test_one_join_for_all_vectors(spark):
    """16 tables: stacked, grouped by key once, met once."""
    m = nf.from_numpy(spark, X)
    us = [spark.createDataFrame([(i, float(i * r)) for i in range(12)], "i bigint, u double") for r in range(16)]
    z = nf.NormalizedFrame(m)
    df, _ = z._with(m.df, us)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Join") == 1
    np.testing.assert_allclose(z.rmatmat(us), X.T @ np.outer(np.arange(12), np.arange(16.0)), atol=1e-9)
    with pytest.raises(Exception, match="lacks the key"):
        z.rmatmat([us[0], us[1].filter("i < 11")])


def test_frozen_rows_do_not_move_the_matrix(spark):
    m = nf.from_numpy(spark, X)
    params = nf.RowParams.of(spark, range(12), [1.0] * 12)
    plan = params.apply_frozen(m).matrix.df._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


@pytest.mark.parametrize("entries,rows", [(1 << 20, 4096), (250, 5)])
def test_wide_operands_by_blocks(spark, monkeypatch, entries, rows):
    monkeypatch.setattr(sparse, "PANEL_ENTRIES", entries)
    monkeypatch.setattr(sparse, "PANEL_ROWS", rows)
    b = np.random.default_rng(4).normal(size=(9, 100))
    for stages in ([], [nf.RowNormalization("none", "l2"), nf.ColumnNormalization()]):
        z, dense = (nf.Chain(tuple(stages)).fit_apply(m) if stages else nf.NormalizedFrame(m) for m in (coo(spark, X), nf.from_numpy(spark, X)))
        got = z.matmat(b).orderBy("i").toPandas()
        assert got["i"].tolist() == list(range(12)) and len(got.columns) == 101
        np.testing.assert_allclose(got.drop(columns="i").to_numpy(), dense.toarray() @ b, atol=1e-10)


def test_gram_by_panels(spark, monkeypatch):
    from normframe.operators import weighted

    monkeypatch.setattr(weighted, "PANEL", 4)
    a = np.column_stack((np.ones(12), X))
    got = nf.NormalizedFrame(nf.from_numpy(spark, X)).with_intercept().gram("i")
    np.testing.assert_allclose(got, a.T @ (np.arange(12.0)[:, None] * a), atol=1e-10)


@pytest.mark.parametrize("nan", [False, True])
def test_chains_of_row_scales_are_fitted_without_filling(spark, monkeypatch, nan):
    """A column stage behind row scales reads stored entries alone; a NaN poisons its whole row, zeros too, and so every column."""
    from normframe.sources.layouts import Coo

    x = X.copy()
    if nan:
        x[2, 1] = np.nan
    first, second = nf.RowNormalization("none", "l1"), nf.ColumnNormalization()
    want = nf.Chain((first, second)).fit(nf.from_numpy(spark, x)).stages[1][1]
    with monkeypatch.context() as without:
        without.setattr(Coo, "to_array", lambda *a: pytest.fail("rows were filled"))
        fits = [nf.Chain(stages).fit(coo(spark, x)).stages[1][1] for stages in ((first, second), (first.fit(coo(spark, x)), second))]
    for got in fits:
        np.testing.assert_allclose([got.centers, got.scales], [want.centers, want.scales], atol=1e-12)
    view = nf.NormalizedFrame(coo(spark, x), [nf.RowNormalization("none", "l1")])
    np.testing.assert_allclose(view.toarray(), nf.NormalizedFrame(nf.from_numpy(spark, x), [nf.RowNormalization("none", "l1")]).toarray(), atol=1e-12)
    assert view.matrix.long().count() == x.size


@pytest.mark.parametrize("batch", [1 << 16, 4])
def test_gram_as_a_table(spark, monkeypatch, batch):
    """Every entry of both triangles, without the matrix on the driver."""
    monkeypatch.setattr(sparse, "BATCH_ENTRIES", batch)
    x = X.copy()
    x[:, 7] = 0  # a column without entries
    for stages in ([], [nf.RowNormalization("mean", "l2"), nf.ColumnNormalization("mean", "none")]):
        z, dense = (nf.Chain(tuple(stages)).fit_apply(m) if stages else nf.NormalizedFrame(m) for m in (coo(spark, x), nf.from_numpy(spark, x)))
        parts = z.gram_pairs(F.col("i") % 3)
        monkeypatch.setattr(sparse.GramParts, "dense", lambda self: pytest.fail("the matrix is on the driver"))
        got = parts.table().collect()
        assert len(got) == 81 and len({(r["j"], r["k"]) for r in got}) == 81
        g = np.zeros((9, 9))
        for r in got:
            g[r["j"], r["k"]] = r["g"]
        a = dense.toarray()
        np.testing.assert_allclose(g, a.T @ ((np.arange(12.0) % 3)[:, None] * a), atol=1e-10)
        assert (g == g.T).all()


@pytest.mark.parametrize("side,held,listed", [(2, 3, 2), (4, 1, 1), (5, 1 << 21, 1 << 10)])
def test_gram_as_a_table_by_tiles(spark, monkeypatch, side, held, listed):
    """Tiles of several sizes, pairs sent in pieces; pairs of columns go through one shuffle, once, and not mirrored."""
    for name, value in (("SIDE", side), ("LEAST_SIDE", side), ("HELD_PAIRS", held), ("LIST_PAIRS", listed), ("BATCH_ENTRIES", 4), ("TABLE_ENTRIES", 20), ("BLOCK_ROWS", 5)):
        monkeypatch.setattr(sparse, name, value)
    x = X.copy()
    x[:, 7] = 0  # a column without entries
    for stages in ([], [nf.RowNormalization("mean", "l2"), nf.ColumnNormalization("mean", "none")]):
        z, dense = (nf.Chain(tuple(stages)).fit_apply(m) if stages else nf.NormalizedFrame(m) for m in (coo(spark, x), nf.from_numpy(spark, x)))
        parts = z.gram_pairs(F.col("i") % 3)
        found = parts.table()
        exchanges = [df._jdf.queryExecution().executedPlan().toString().count("Exchange") for df in (found, parts.pairs)]
        assert exchanges[0] == exchanges[1]
        got = found.collect()
        assert sorted((r["j"], r["k"]) for r in got) == list(itertools.product(range(9), range(9)))
        g = np.zeros((9, 9))
        for r in got:
            g[r["j"], r["k"]] = r["g"]
        a = dense.toarray()
        np.testing.assert_allclose(g, a.T @ ((np.arange(12.0) % 3)[:, None] * a), atol=1e-10)
        assert (g == g.T).all()


def test_pairs_are_added_up_before_they_are_sent():
    """A place is sent once by a task that holds its pairs, in 12 bytes, and in lists of one tile and bounded length."""
    r = np.random.default_rng(3)
    j = r.integers(0, 40, 5000)
    k = r.integers(j, 40)
    g = r.integers(1, 9, 5000).astype(float)
    want = np.zeros((48, 48))
    np.add.at(want, (j, k), g)
    made = [pa.RecordBatch.from_arrays([pa.array(x[a : a + 700]) for x in (j, k, g)], ["j", "k", "g"]) for a in range(0, 5000, 700)]
    got, seen = np.zeros((48, 48)), 0
    for batch in sparse._by_tile(iter(made), 16, 3):
        assert [str(c.type) for c in batch.columns] == ["int64", "list<item: int32>", "list<item: double>"]
        for tile, places, sums in zip(*(c.to_pylist() for c in batch.columns)):
            assert 0 < len(places) == len(sums) <= sparse.LIST_PAIRS
            at = np.array(places)
            got[tile // 3 * 16 + at // 16, tile % 3 * 16 + at % 16] += sums
            seen += len(places)
    assert (got == want).all() and seen == (want > 0).sum()


def test_column_sums_read_entries_as_they_are_listed(spark):
    """No dealing, and repeated entries are added up all the same."""
    listed = spark.createDataFrame([(0, 1, 2.0), (1, 1, 3.0), (0, 1, 4.0), (2, 0, float("nan"))], "i bigint, j bigint, v double")
    m = nf.Coo(listed.repartition(3, "i"), 4, 3, listed=listed)
    want = nf.ColumnNormalization("mean", "none").fit(nf.Coo(listed, 4, 3)).centers
    m.df = None
    got = nf.ColumnNormalization("mean", "none").fit(m).centers
    np.testing.assert_array_equal(got, want)
    np.testing.assert_array_equal(got, [np.nan, 2.25, 0.0])
    with pytest.raises(Exception, match="NULL in matrix column v"):
        nf.ColumnNormalization("mean", "none").fit(nf.Coo(listed, 4, 3, listed=listed.withColumn("v", F.lit(None).cast("double"))))


def test_weighted_sums_bring_one_number_a_column_to_the_driver(spark, monkeypatch):
    """300 columns in up to 12 blocks each: what is collected has no lists of blocks."""
    from pyspark.sql.classic.dataframe import DataFrame

    monkeypatch.setattr(sparse, "SUM_ROWS", 10)
    x = np.where(np.random.default_rng(3).random((120, 300)) < 0.2, 0.0, 1.5)
    x[:, 7] = 0
    m, params = coo_plain(spark, x), nf.ColumnParams(300, [0.5] * 300, None)
    seen, collect = [], DataFrame.collect
    monkeypatch.setattr(DataFrame, "collect", lambda self: seen.append([f.dataType.typeName() for f in self.schema]) or collect(self))
    got = nf.NormalizedFrame(m, [params]).weighted_sums(F.col("i") % 3)
    np.testing.assert_allclose(got, (np.arange(120) % 3) @ (x - 0.5), atol=1e-10)
    assert seen and not any("array" in kinds for kinds in seen)
