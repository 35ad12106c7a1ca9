"""Vector columns: which rows take part, and exact measures in double precision."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def usable(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """Rows whose vector is not null, not zero, and has only finite components; and of these, those
    of the commonest length (the smaller one of two equally common)."""
    v = F.col(column)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    ok = vectors.filter(v.isNotNull() & F.coalesce(finite, F.lit(False)) & F.exists(v, lambda x: x != 0))
    size = ok.groupBy(F.size(v).alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").first()
    return ok.filter(F.size(v) == (size.d if size else 0))


def matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64) if len(column) else np.zeros((0, 1))


def dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row-wise inner products; equal rows give equal results wherever they stand."""
    return (a * b).sum(axis=1)
