"""Vector expressions over ``array<float>`` columns, evaluated in double."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F


def doubles(vector: Column) -> Column:
    return vector.cast("array<double>")


def dot(left: Column, right: Column) -> Column:
    """Sum of products of two ``array<double>`` columns."""
    return F.aggregate(F.zip_with(left, right, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


def norm(vector: Column) -> Column:
    return F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, v: s + v * v))


def cosine(left: Column, right: Column, left_norm: Column | None = None,
           right_norm: Column | None = None) -> Column:
    """Cosine similarity; 0 for empty, unequal-length, zero or missing vectors.

    Pass the norms when they were computed once per row before a join, so the
    per-pair work is a single dot product.
    """
    left, right = doubles(left), doubles(right)
    scale = (norm(left) if left_norm is None else left_norm) * (
        norm(right) if right_norm is None else right_norm)
    comparable = (F.size(left) == F.size(right)) & (F.size(left) > 0) & (scale > 0)
    return F.when(comparable, dot(left, right) / scale).otherwise(F.lit(0.0))


def decode_int8(encoded: Column) -> Column:
    """Unit-length float vector from base64 text of signed bytes.

    Expressions only: a text of any length is held by its task once, and no batch of vectors is.
    """
    # each byte as a Latin-1 character, so its code is the byte without sign
    raw = F.unbase64(encoded)
    signed = F.transform(F.split(F.decode(raw, "ISO-8859-1"), ""), lambda c: (
        (F.ascii(c) + 128) % 256 - 128).cast("double"))
    vector = F.when(F.octet_length(raw) > 0, signed).otherwise(F.array().cast("array<double>"))

    def unit(v: Column) -> Column:
        length = F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x, F.sqrt)
        return F.element_at(held(F.when(length > 0, length).otherwise(1.0), lambda n: F.transform(
            v, lambda x: (x / n).cast("float"))), 1)

    def held(value: Column, then: Callable[[Column], Column]) -> Column:
        """As an element: a value used twice, or within a lambda, would be computed that often."""
        return F.transform(F.array(value), then)

    return F.when(raw.isNotNull(), F.element_at(held(vector, unit), 1))


def hashing_embedding(tokens: Column, dim: int = 64) -> Column:
    """Deterministic stand-in for an embedding service: signed token hashing.

    Each token adds +1 or -1 to one of ``dim`` positions; the result has unit
    length.  Tokens are folded into one counter map per position in a single
    pass over the array.
    """
    hashed = F.transform(tokens, lambda t: F.xxhash64(t))
    positions = F.transform(hashed, lambda h: F.pmod(h, F.lit(dim)).cast("int"))
    signs = F.transform(
        hashed, lambda h: F.when(F.shiftrightunsigned(h, 63) == 0, 1.0).otherwise(-1.0))

    @F.pandas_udf("array<float>")
    def fold(where: pd.Series, sign: pd.Series) -> pd.Series:
        out = []
        for slots, values in zip(where, sign):
            vector = np.bincount(
                np.asarray(slots, dtype=np.int64), weights=np.asarray(values, dtype=np.float64),
                minlength=dim) if len(slots) else np.zeros(dim)
            length = np.sqrt((vector * vector).sum())
            out.append((vector / length if length else vector).astype(np.float32))
        return pd.Series(out)

    return fold(positions, signs)
