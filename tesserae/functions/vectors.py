"""Vector and bit-signature functions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

PLANES, BUCKETS, SEED = 256, 256, 42
_M = 0xFFFFFFFF


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def cosine(a: Column, b: Column) -> Column:
    """0 where a vector is zero."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm).otherwise(0.0)


def quantised(v: Column) -> Column:
    """Affine bytes: round half up of (x - min) * 255 / (max - min), less 128."""
    span = F.array_max(v).cast("double") - F.array_min(v).cast("double")
    scale = F.lit(255.0) / F.when(span == 0, 1.0).otherwise(span)
    return F.transform(v, lambda x: (F.floor((x.cast("double") - F.array_min(v).cast("double")) * scale + 0.5) - 128).cast("int"))


def restored(q: Column, low: Column, high: Column) -> Column:
    span = F.when(high == low, 1.0).otherwise(high - low)
    return F.transform(q, lambda x: (x + 128) * span / 255 + low)


def uniform_stream(seed: int):
    """The public 32-bit generator "mulberry32", which fixes the planes."""
    state = seed & _M
    while True:
        state = state + 0x6D2B79F5 & _M
        t = (state ^ state >> 15) * (1 | state) & _M
        t = (t + ((t ^ t >> 7) * (61 | t) & _M) & _M) ^ t
        yield ((t ^ t >> 14) & _M) / 2**32


def planes(n: int = PLANES, buckets: int = BUCKETS, seed: int = SEED) -> list[list[int]]:
    """Random signs, plane by plane."""
    draw = uniform_stream(seed)
    return [[-1 if next(draw) < 0.5 else 1 for _ in range(buckets)] for _ in range(n)]


def string_hash(token: str) -> int:
    h = 0
    for c in token:
        h = h * 31 + ord(c) & _M
    return h & 0x7FFFFFFF


def hamming_similarity(a: Column, b: Column) -> Column:
    """1 - differing bits / 256 of signatures kept as arrays of 64-bit words."""
    return 1 - F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, v: s + v) / PLANES


def signature(text: Column) -> Column:
    """256-bit signature of the text's tokens as four 64-bit words (Arrow batches; the planes are fixed)."""
    import re

    import numpy as np

    signs = np.array(planes(), np.int32)
    word = re.compile(r"[a-z][a-z0-9_-]{1,}")

    @F.pandas_udf("array<bigint>")
    def sign(texts: pd.Series) -> pd.Series:
        out = []
        for t in texts:
            counts = np.zeros(BUCKETS, np.int32)
            for w in word.findall((t or "").lower()):
                counts[string_hash(w) % BUCKETS] += 1
            bits = signs @ counts > 0
            out.append(np.packbits(bits, bitorder="little").view("<i8").tolist())
        return pd.Series(out)

    return sign(text)
