"""Vector expressions on array<float>, computed in doubles inside the JVM."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column, floor: float = 1e-10) -> Column:
    return dot(a, b) / F.greatest(norm(a) * norm(b), F.lit(floor))


def literal(v: list[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in v])


def has_dims(v: Column, dims: int) -> Column:
    """True for a vector of this length, and for none."""
    return v.isNull() | (F.size(v) == dims)


def from_blob(blobs: Column) -> Column:
    """Vectors of little-endian 32-bit floats, a trailing piece of one left out."""

    def read(s: pd.Series) -> pd.Series:
        return s.map(lambda b: None if b is None else np.frombuffer(bytes(b)[: len(b) // 4 * 4], "<f4"))

    return F.pandas_udf(read, "array<float>")(blobs)


def to_blob(vectors: Column) -> Column:
    def write(s: pd.Series) -> pd.Series:
        return s.map(lambda v: None if v is None else np.asarray(v, "<f4").tobytes())

    return F.pandas_udf(write, "binary")(vectors)
