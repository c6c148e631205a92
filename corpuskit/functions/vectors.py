"""Arrow-batched vector kernels (numpy inside tasks).

No ``from __future__ import annotations``: pandas UDF hints must be real types.
"""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, FloatType


@F.pandas_udf(BinaryType())
def to_half(vectors: pd.Series) -> pd.Series:
    """Components rounded to IEEE half precision, two little-endian bytes each; beyond its range they are infinite."""
    with np.errstate(over="ignore"):
        return vectors.map(lambda v: None if v is None else np.array([np.nan if x is None else x for x in v], dtype=np.float64).astype("<f2").tobytes())


@F.pandas_udf(ArrayType(FloatType()))
def from_half(stored: pd.Series) -> pd.Series:
    return stored.map(lambda b: None if b is None else np.frombuffer(b, dtype="<f2").astype(np.float32))
