"""Vectors as bytes, as other stores keep them: 32-bit floats, little-endian."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, FloatType


@F.pandas_udf(ArrayType(FloatType()))
def from_bytes(raw: pd.Series) -> pd.Series:
    """Null for null, and for a number of bytes that isn't a whole number of floats."""
    return raw.map(lambda b: None if b is None or len(b) % 4 else np.frombuffer(bytes(b), "<f4").tolist())


@F.pandas_udf(BinaryType())
def to_bytes(vector: pd.Series) -> pd.Series:
    """Null components become NaN."""
    return vector.map(lambda v: None if v is None else np.array(v, "<f4").tobytes())
