"""Normalization and scoring of streams with frozen column parameters: stateless projections."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

import numpy as np
from pyspark.sql import DataFrame

from ..operators.frame import NormalizedFrame
from ..plans.recipes import ColumnParams
from ..sources.layouts import Wide


def normalize_stream(stream: DataFrame, key: str, columns: Sequence[str], params: ColumnParams, nulls: str = "nan", extra: Sequence[str] = ()) -> DataFrame:
    """The stream's rows with normalized columns. Also takes a batch DataFrame, with equal results."""
    return NormalizedFrame(Wide(stream, key, columns, nulls, extra), [params]).to_eager()


def score_stream(stream: DataFrame, key: str, columns: Sequence[str], params: ColumnParams, v: Any, nulls: str = "nan") -> DataFrame:
    """key and the product of each normalized row with ``v``."""
    return NormalizedFrame(Wide(stream, key, columns, nulls), [params]).matvec(np.asarray(v, float))
