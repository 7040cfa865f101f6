"""Ridge and lasso on standardized columns: python examples/linear_models.py FOLDER_WITH_LINEITEM"""

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import SparkSession

import normframe as nf
from normframe.operators.solvers import lasso, ridge, ridge_cg

spark = SparkSession.builder.getOrCreate()
rows = spark.read.parquet(f"{sys.argv[1]}/lineitem.parquet")
z = nf.standardize(nf.Wide(rows, "l_orderkey", ["l_quantity", "l_discount", "l_tax"], extra=["l_extendedprice"]))
print("ridge", ridge(z, ["l_extendedprice"], 0.1)[:, 0])
print("ridge by conjugate gradients", ridge_cg(z, "l_extendedprice", 0.1))
print("lasso", lasso(z, "l_extendedprice", 100.0))
