"""Vector expressions over array<float>; sums are in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Dot product over the shorter length; 0 for an empty vector (VEC-02)."""
    n = F.least(F.size(a), F.size(b))
    terms = F.zip_with(F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(terms, F.lit(0.0), lambda s, x: s + x)


def normalized(v: Column) -> Column:
    """Divided by the length, at least 1e-9 (VEC-06)."""
    length = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.element_at(F.transform(F.array(F.greatest(length, F.lit(1e-9))), lambda n: F.transform(v, lambda x: x.cast("double") / n)), 1)


def resized(v: Column, dim: int) -> Column:
    """Cut or padded with zeros to a dimension (VEC-08)."""
    return F.concat(F.slice(v, 1, dim), F.array_repeat(F.lit(0.0).cast("float"), F.greatest(F.lit(dim) - F.size(v), F.lit(0))))


def mean_pooled(tokens: Column, mask: Column) -> Column:
    """Normalised mean of the token vectors whose mask is 1; no such token: zeros (VEC-07)."""
    kept = F.filter(F.arrays_zip(tokens.alias("v"), mask.alias("m")), lambda t: t["m"] == 1)
    vectors = F.transform(kept, lambda t: F.transform(t["v"], lambda x: x.cast("double")))
    zero = F.transform(F.get(tokens, F.lit(0)), lambda x: F.lit(0.0))
    total = F.aggregate(vectors, zero, lambda s, v: F.zip_with(s, v, lambda a, b: a + b))
    n = F.greatest(F.size(kept), F.lit(1))
    return normalized(F.transform(total, lambda x: x / n))


def model_inputs(ids: Column, max_len: int = 512, cls: int = 101, sep: int = 102, pad: int = 0) -> tuple[Column, Column]:
    """Ids cut to max_len - 2, framed and padded, and the attention mask (VEC-11)."""
    framed = F.concat(F.array(F.lit(cls)), F.slice(ids, 1, max_len - 2), F.array(F.lit(sep)))
    fill = F.greatest(F.lit(max_len) - F.size(framed), F.lit(0))
    return F.concat(framed, F.array_repeat(F.lit(pad), fill)), F.concat(F.array_repeat(F.lit(1), F.size(framed)), F.array_repeat(F.lit(0), fill))
