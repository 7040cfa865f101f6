"""A linear layer over normalized features, evaluated on raw rows."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

import numpy as np
from pyspark.sql import DataFrame

from ..plans.recipes import ColumnParams
from ..sources.layouts import Matrix
from .frame import NormalizedFrame


class NormalizedLinear:
    """k outputs W z + b of normalized rows z, for a batch of raw rows of any layout, in one scan."""

    def __init__(self, weight: Any, bias: Any = None, *, centers: Any = None, scales: Any = None):
        self.weight = np.asarray(weight, float)
        if self.weight.ndim != 2:
            raise ValueError("weight has one row for each output")
        self.bias = None if bias is None else np.asarray(bias, float)
        if self.bias is not None and self.bias.shape != self.weight.shape[:1]:
            raise ValueError("bias has one value for each output")
        self.params = ColumnParams(self.weight.shape[1], centers, scales)

    def __call__(self, rows: Matrix, names: Sequence[str] | None = None) -> DataFrame:
        if rows.ncols != self.weight.shape[1]:
            raise ValueError(f"the layer takes {self.weight.shape[1]} features")
        frame = NormalizedFrame(rows, [self.params])
        if self.bias is None:
            return frame.matmat(self.weight.T, names)
        return frame.with_intercept().matmat(np.vstack([self.bias, self.weight.T]), names)

    def gradients(self, rows: Matrix, errors: Sequence[Any]) -> tuple[np.ndarray, np.ndarray]:
        """Gradients of bias and weight for a batch: ``errors`` are the loss's derivatives by each output, as long vectors. One scan; raw rows are not changed."""
        if len(errors) != len(self.weight):
            raise ValueError("one error vector for each output")
        got = NormalizedFrame(rows, [self.params]).with_intercept().rmatmat(list(errors))
        return got[0], got[1:].T

    def step(self, rows: Matrix, errors: Sequence[Any], rate: float) -> NormalizedLinear:
        """The layer after a step of gradient descent."""
        bias, weight = self.gradients(rows, errors)
        moved = None if self.bias is None else self.bias - rate * bias
        return NormalizedLinear(self.weight - rate * weight, moved, centers=self.params.centers, scales=self.params.scales)
