"""Lazily normalized matrices over DataFrames.

Parameters are fitted once, with Spark aggregations; the raw data stays as it
is, and products, weighted sums, Gram matrices, selections and chains are lazy
plans over it.
"""

from .api import normalize, standardize
from .operators.frame import NormalizedFrame, take_rows
from .operators.scoring import NormalizedLinear
from .plans.fitting import ColumnStatistics
from .plans.recipes import Chain, ColumnNormalization, ColumnParams, FittedChain, RowNormalization, RowParams
from .sources.chunks import ChunkedMatrix, read_chunks, write_chunks
from .sources.layouts import Array, Coo, Wide, from_coo, from_numpy
from .sources.zarr import read_zarr, write_zarr

__all__ = [
    "Array", "Chain", "ChunkedMatrix", "ColumnNormalization", "ColumnParams", "ColumnStatistics", "Coo", "FittedChain", "NormalizedFrame", "NormalizedLinear",
    "RowNormalization", "RowParams", "Wide", "from_coo", "from_numpy", "normalize", "read_chunks", "read_zarr", "standardize", "take_rows", "write_chunks", "write_zarr",
]
