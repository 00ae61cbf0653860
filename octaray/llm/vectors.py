"""Shared vector helpers."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def is_usable(vector: str) -> Column:
    """The vector is neither null, empty nor zero and holds no null or non-finite component."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    held = F.col(vector).isNotNull() & (F.size(vector) > 0)
    return F.coalesce(F.when(held, ~bad & F.exists(vector, lambda x: x != 0)), F.lit(False))


def usable(df: DataFrame, vector: str) -> DataFrame:
    return df.filter(is_usable(vector))


def matrix(column: pd.Series, dtype=np.float64) -> np.ndarray:
    return np.array(column.tolist(), dtype=dtype).reshape(len(column), -1)


def unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1, first by their largest component so that squares neither overflow nor vanish."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))
