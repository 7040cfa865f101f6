"""The registered queries against their SQL on the smallest tables, and the entry module without the optional parts."""

import subprocess
import sys
from pathlib import Path

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from normframe import queries as engine

ROOT = Path(__file__).resolve().parents[1]
SF = Path("/root/testdata/sf0.001")
# One query of each group; the driver compares all of them at its own size.
SAMPLE = [
    "col_stats_iqr_unit_variance", "coo_stats_median", "robust_wide", "matvec_wide", "rmatmat_wide", "fused_matvec", "weighted_gram", "array_matvec", "row_robust_array",
    "coo_gram", "select_before_fit", "chain_new_samples", "chain_weighted_gram", "chunk_rectangle", "column_reductions",
    "submatrix_matvec", "submatrix_rmatvec", "submatrix_weighted_sums", "transposed_rmatvec", "chain_matmat", "coo_matmat", "coo_weighted_gram", "ridge_normal_equations",
    "ridge_conjugate_gradients", "coo_chain_matvec", "coo_transposed_stats", "coo_corrections", "coo_eager", "chunk_rows", "chunk_block", "zarr_standardize", "params_saved_and_loaded",
    "streamed_scores", "numpy_left_product", "solver_products", "single_entry", "nan_poisons_its_column", "training_gradients", "lasso",
    "chunk_rmatmat", "zarr_rectangle", "zarr_robust", "coo_row_stats_transposed", "coo_rows_robust", "coo_gram_pairs", "coo_row_corrections", "rmatmat_tables", "transposed_last_column", "params_npz",
    "ridge_dual", "batch_descent", "lasso_columns", "coo_chain_weighted_sums",
]


@pytest.mark.skipif(not SF.exists(), reason="needs the sample tables")
@pytest.mark.parametrize("name", SAMPLE)
def test_query_matches_sql(spark, name):
    db = duckdb.connect()
    for t in SF.glob("*.parquet"):
        db.execute(f"CREATE VIEW {t.stem} AS SELECT * FROM '{t}'")
    got = engine.QUERIES[name](spark, str(SF)).toPandas()
    want = db.execute(engine.SQL[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    order = lambda d: d[columns].sort_values(columns).reset_index(drop=True)
    assert order(got).equals(order(want).astype(got[columns].dtypes.to_dict()))


@pytest.mark.parametrize("digits", [3, 8])
def test_rounding_of_many_values(spark, digits):
    """The same doubles as plain rounding: ties, their neighbours, large numbers, and what is no number."""
    r = np.random.default_rng(4)
    ties = (r.integers(-(10**6), 10**6, 4000) + 0.5) / 10.0**digits
    x = np.concatenate((ties, np.nextafter(ties, np.inf), np.nextafter(ties, -np.inf), r.normal(size=4000) * 10.0 ** r.integers(-9, 18, 4000), [np.nan, np.inf, -np.inf, -0.0, 5e-324, 1e308]))
    df = spark.createDataFrame([(float(v),) for v in x], "x double")
    got = df.select(engine.rnd(F.col("x"), digits).alias("a"), engine.rnd_many(F.col("x"), digits).alias("b")).toPandas().to_numpy()
    np.testing.assert_array_equal(got[:, 0], got[:, 1])
    assert len(got) == len(x) and not np.signbit(got[got == 0]).any()


def test_every_engine_query_has_sql():
    assert set(engine.QUERIES) == set(engine.SQL)


def test_entry_works_without_training_operators(tmp_path):
    for name in ("__spark_entry__.py", "normframe"):
        (tmp_path / name).symlink_to(ROOT / name)
    code = (
        "import sys\n"
        "class Gone:\n"
        "    def find_spec(self, name, *a):\n"
        "        if name.startswith('normframe.llm') or name == 'corpus_pipeline':\n"
        "            raise ModuleNotFoundError(name)\n"
        "sys.meta_path.insert(0, Gone())\n"
        "import __spark_entry__ as e\n"
        "assert len(e.queries()) > 50 and not any(n.startswith('op') for n in e.queries()) and e.oracle_sql()\n"
    )
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True)


@pytest.mark.skipif(not SF.exists(), reason="needs the sample tables")
def test_lines_are_dealt_by_order_and_added_up_once(spark, monkeypatch):
    """Tasks of one size, whatever the number of orders; one shuffle, and no second sum of what is added up."""
    monkeypatch.setattr(engine, "ORDERS", 100)
    m = engine.cells(spark, str(SF))
    plan = m.df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and f", {-(-m.count() // 100)})" in plan
    seen, statistics = [], engine.ColumnStatistics
    monkeypatch.setattr(engine, "ColumnStatistics", lambda m: seen.append(m) or statistics(m))
    engine.coo_transposed_stats(spark, str(SF))
    assert seen[0].df._jdf.queryExecution().executedPlan().toString().count("HashAggregate(") == 2
