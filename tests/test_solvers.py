"""Linear models against NumPy and their optimality conditions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import normframe as nf
from normframe.operators import solvers
from normframe.operators.solvers import DescentState, descend, gram_matvec, lasso, lasso_columns, ridge, ridge_cg, ridge_dual

rng = np.random.default_rng(205)
X = rng.normal(size=(40, 5)) * [1, 2, 0.5, 3, 1] + 4
X[:, 4] = 2.0  # a constant column
Y = np.sin(0.13 * np.arange(40)) + 0.5 * np.cos(0.037 * np.arange(40))
A = (X - X.mean(0)) / np.where(X.std(0) == 0, 1, X.std(0))


@pytest.fixture(scope="module", params=["wide", "array", "coo"])
def z(spark, request):
    m = nf.from_numpy(spark, X)
    return nf.standardize({"wide": m.to_wide, "array": m.to_array, "coo": m.to_coo}[request.param]())


def test_linear_models(spark, z):
    y = spark.createDataFrame([(k, float(v)) for k, v in enumerate(Y)], "i bigint, y double")
    want = np.linalg.solve(A.T @ A / 40 + 0.1 * np.eye(5), A.T @ np.column_stack((Y, np.arange(40))) / 40)
    np.testing.assert_allclose(ridge(z, [y, "i"], 0.1), want, atol=1e-9)
    np.testing.assert_allclose(ridge_cg(z, y, 0.1), want[:, 0], atol=1e-8)
    np.testing.assert_allclose(gram_matvec(z, np.arange(5.0)), A.T @ A @ np.arange(5.0), atol=1e-9)
    b = lasso(z, y, 0.05)
    slope = A.T @ (Y - A @ b) / 40
    assert (b == 0).any() and (b != 0).any()
    np.testing.assert_allclose(slope[b != 0], 0.05 * np.sign(b[b != 0]), atol=1e-8)
    assert (np.abs(slope[b == 0]) <= 0.05 + 1e-8).all()


def test_limits(spark):
    m = nf.from_numpy(spark, X)
    with pytest.raises(ValueError):
        ridge(nf.standardize(m), ["i"], -1)
    empty = nf.NormalizedFrame(m.where(F.col("i") < 0))
    for fit in (lambda: ridge(empty, ["i"], 1), lambda: ridge_cg(empty, "i", 1), lambda: lasso(empty, "i", 1)):
        with pytest.raises(ValueError):
            fit()
    plan = nf.standardize(m.to_wide())
    assert "Exchange hashpartitioning" not in plan.matvec(np.ones(5))._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("layout", ["to_wide", "to_array"])
def test_dual_ridge_with_more_columns_than_rows(spark, layout):
    x = np.random.default_rng(2).normal(size=(12, 30)) * 3 + 1
    a = (x - x.mean(0)) / x.std(0)
    y = np.arange(12) % 5 - 2.0
    z = nf.standardize(getattr(nf.from_numpy(spark, x), layout)())
    want = np.linalg.solve(a.T @ a / 12 + 0.3 * np.eye(30), a.T @ y / 12)
    np.testing.assert_allclose(ridge_dual(z, F.col("i") % 5 - 2, 0.3), want, atol=1e-8)
    table = spark.createDataFrame([(k, float(v)) for k, v in enumerate(y)], "i bigint, y double")
    np.testing.assert_allclose(ridge_dual(z, table, 0.3), want, atol=1e-8)
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("normframe_")]  # scratch goes
    with pytest.raises(ArithmeticError):
        ridge_dual(z, table, 0.3, max_iterations=1)
    with pytest.raises(ValueError):
        ridge_dual(z, table, 0.0)


def test_buckets_are_joined_in_place(spark):
    from normframe.sources.storage import Buckets

    a, b = (Buckets(spark.range(1000).withColumn(n, F.rand(1)), "id", 4) for n in "xy")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        met = a.df.join(b.df, "id")
        assert "Exchange" not in met._jdf.queryExecution().executedPlan().toString() and met.count() == 1000
        c = Buckets(met, "id", 4, dealt=True)
        assert c.df.count() == 1000 and "Exchange" not in c.df.join(a.df.drop("x"), "id")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        for t in (a, b, c):
            t.drop()


def test_batches_are_the_same_wherever_rows_are(spark):
    m = nf.from_numpy(spark, X)
    params = nf.ColumnNormalization().fit(m)
    y = spark.createDataFrame([(k, float(v)) for k, v in enumerate(Y)], "i bigint, y double")
    whole = descend(m, params, y, 3, 4, 0.1, 0.01)
    other = nf.Array.of(m.df.repartition(7), m.key, m.column, m.ncols)
    state = descend(other, params, y, 3, 4, 0.1, 0.01, steps=5)
    assert (state.epoch, state.batch) == (1, 2)
    on = descend(other.to_wide(), params, y, 3, 4, 0.1, 0.01, state=state)
    np.testing.assert_allclose(on.coefficients, whole.coefficients, atol=1e-12)
    assert abs(on.intercept - whole.intercept) < 1e-12 and on.epoch == 4
    # the same steps in NumPy
    keys = spark.range(40)
    b, c = np.zeros(5), 0.0
    for epoch in range(4):
        where = np.array([r[0] for r in keys.select(solvers.batch_of(F.col("id"), epoch, 3)).collect()])
        for k in range(3):
            mine = where == k
            error = A[mine] @ b + c - Y[mine]
            b, c = b - 0.1 * (A[mine].T @ error / mine.sum() + 0.01 * b), c - 0.1 * error.mean()
    np.testing.assert_allclose(whole.coefficients, b, atol=1e-10)
    assert abs(whole.intercept - c) < 1e-10
    far = descend(m, params, y, 1, 150, 0.5)
    assert np.abs(A.T @ (A @ far.coefficients + far.intercept - Y)).max() < 0.1


def test_state_is_saved(spark, tmp_path):
    state = DescentState((1.0, -2.5), 0.25, 3, 1)
    state.save(spark, str(tmp_path / "s"))
    assert DescentState.load(spark, str(tmp_path / "s")) == state


def test_lasso_by_columns(spark, z, monkeypatch):
    monkeypatch.setattr(solvers, "COLUMN_BLOCK", 2)
    y = spark.createDataFrame([(k, float(v)) for k, v in enumerate(Y)], "i bigint, y double")
    b = lasso_columns(z, y, 0.05, 1e-9)
    np.testing.assert_allclose(b, lasso(z, y, 0.05), atol=1e-7)
