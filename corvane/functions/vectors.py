"""Vector functions over ``array<float>`` columns, in double precision."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """The inner product."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    """The Euclidean length."""
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """M1: cosine similarity; null for a zero vector or unequal lengths."""
    return F.when((F.size(a) == F.size(b)) & (norm(a) > 0) & (norm(b) > 0), dot(a, b) / (norm(a) * norm(b)))


def similarity_half(a: Column, b: Column) -> Column:
    """``1 - distance / 2``, the distance being ``1 - cosine``."""
    return 1 - (1 - cosine(a, b)) / 2


def l2_normalise(a: Column) -> Column:
    """M2: the vector of unit length; a zero vector stays."""
    return F.when(norm(a) > 0, F.transform(a, lambda x: x.cast("double") / norm(a))).otherwise(F.transform(a, lambda x: x.cast("double")))


def hash_embedding(text: Column, dim: int = 512) -> Column:
    """M3: a deterministic vector of a text: bytes of its sha256 as ``v / 255 - 0.5``, padded with 0, of unit length."""
    h = F.sha2(F.encode(text, "utf-8"), 256)
    n = min(32, dim)
    head = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.conv(F.substring(h, i * 2 + 1, F.lit(2)), 16, 10).cast("double") / 255.0 - 0.5)
    return l2_normalise(F.concat(head, F.array_repeat(F.lit(0.0), dim - n)))


def int8_quantise(a: Column) -> Column:
    """M4: ``struct<scale, values>`` with scale = largest / 127, halves rounded to even, clipped to 127."""
    top = F.array_max(F.transform(a, lambda x: F.abs(x.cast("double"))))
    scale = F.when(F.coalesce(top, F.lit(0.0)) > 0, top / 127.0).otherwise(F.lit(1.0))
    whole = F.transform(a, lambda x: F.greatest(F.lit(-127), F.least(F.lit(127), F.bround(x.cast("double") / scale, 0).cast("int"))))
    return F.when(a.isNotNull(), F.struct(scale.alias("scale"), whole.alias("values")))


def int8_restore(quantised: Column) -> Column:
    """M4: the vector that an int8 form stands for."""
    return F.transform(quantised["values"], lambda x: x * quantised["scale"])


def bfloat16_bits(a: Column) -> Column:
    """M5: the upper 16 bits of each float, as ints. Spark has no function for a float's bits: an Arrow batch each time."""

    def upper(vectors: pd.Series) -> pd.Series:
        return vectors.map(lambda v: None if v is None else (np.asarray(v, dtype=np.float32).view(np.uint32) >> 16).astype(np.int32))

    return F.pandas_udf(upper, "array<int>")(a)


def bfloat16_restore(bits: Column) -> Column:
    """M5: the floats that 16 bits each stand for."""

    def widen(vectors: pd.Series) -> pd.Series:
        return vectors.map(lambda v: None if v is None else (np.asarray(v, dtype=np.uint32) << 16).astype(np.uint32).view(np.float32))

    return F.pandas_udf(widen, "array<float>")(bits)
