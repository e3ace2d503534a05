"""Embeddings from a caller's provider, in Arrow batches, results kept with their row."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Takes texts, gives (index, vector) pairs in any order; what is missing stays null.
Provider = Callable[[list[str]], list[tuple[int, list[float]]]]


def embedded(text: Column, provider: Provider, batch: int = 64) -> Column:
    @F.pandas_udf("array<float>")
    def embed(texts: pd.Series) -> pd.Series:
        out: list[list[float] | None] = [None] * len(texts)
        for start in range(0, len(texts), batch):
            part = ["" if t is None else t for t in texts.iloc[start : start + batch]]
            for i, vector in provider(part):
                if 0 <= i < len(part):
                    out[start + i] = vector
        return pd.Series(out)

    return embed(text)
