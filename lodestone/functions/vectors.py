"""Vector functions on arrays of numbers."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType

BUCKETS = 64


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def normalise(v: Column, floor: float = 1e-12) -> Column:
    size = F.greatest(F.sqrt(dot(v, v)), F.lit(floor))
    return F.transform(v, lambda x: x.cast("double") / size)


def fit_width(v: Column, width: int) -> Column:
    """Cut or padded with zeros to `width`."""
    return F.slice(F.concat(v.cast("array<double>"), F.array_repeat(F.lit(0.0), width)), 1, width)


def clip01(x: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), x))


def _counts(text: str | None) -> np.ndarray:
    points = np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    return np.bincount(points % BUCKETS, minlength=BUCKETS).astype(np.int64)


@F.pandas_udf(ArrayType(LongType()))
def character_counts(texts: pd.Series) -> pd.Series:
    """How often each remainder of code points by BUCKETS occurs in the whole text."""
    return pd.Series([_counts(t) for t in texts])


@F.pandas_udf(ArrayType(DoubleType()))
def character_vector(texts: pd.Series) -> pd.Series:
    """The counts at length 1; zeros for null and empty texts."""
    return pd.Series([n / max(np.sqrt(float((n * n).sum())), 1e-12) for n in map(_counts, texts)])


@F.pandas_udf(ArrayType(ArrayType(DoubleType())))
def character_vectors(lists: pd.Series) -> pd.Series:
    """The vectors of each text of a list."""
    return pd.Series([[n / max(np.sqrt(float((n * n).sum())), 1e-12) for n in map(_counts, texts)] for texts in lists])
