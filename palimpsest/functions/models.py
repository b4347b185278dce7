"""Models as pluggable functions. No weights are shipped: the two here are stand-ins, deterministic and without training.

A scorer is a function of the columns (query text, content) that gives a logit; an embedder is a function of a text
column that gives array<float>. Real ones are iterator pandas functions that load their model once for each worker.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

Scorer = Callable[[Column, Column], Column]
Embedder = Callable[[Column], Column]


def lexical_scorer(text: Column, content: Column) -> Column:
    """Stand-in of a cross-encoder: a logit from -2 to 2 by the share of the query's words that are in the content."""
    words = lambda c: F.array_distinct(F.filter(F.split(F.lower(c), r"\s+"), lambda w: w != ""))
    asked = words(text)
    return 4 * F.size(F.array_intersect(asked, words(content))) / F.greatest(F.size(asked), F.lit(1)) - 2


def hashed_embedder(dims: int = 64, n: int = 3) -> Embedder:
    """Stand-in of an embedding model: counts of hashed n-grams of characters, at length 1; zeros for a text shorter than n."""

    def embed(text: Column) -> Column:
        low = F.coalesce(F.lower(text), F.lit(""))
        grams = F.when(F.length(low) >= n, F.transform(F.sequence(F.lit(1), F.length(low) - n + 1), lambda i: F.pmod(F.xxhash64(F.substring(low, i, F.lit(n))), F.lit(dims))))
        grams = F.coalesce(grams, F.array().cast("array<bigint>"))
        counts = F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda d: F.size(F.filter(grams, lambda g: g == d)).cast("double"))
        size = F.sqrt(F.aggregate(counts, F.lit(0.0), lambda s, x: s + x * x))
        return F.transform(counts, lambda x: F.when(size > 0, x / size).otherwise(0.0).cast("float"))

    return embed


def model_scorer(load: Callable[[], Callable[[list[str], list[str]], list[float]]], batch: int = 20) -> Scorer:
    """A scorer around a real model: load() runs once for each worker, its result takes `batch` pairs at a time. A batch that fails scores 0."""

    @F.pandas_udf("double")
    def score(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        model = load()
        for texts, contents in parts:
            out: list[float] = []
            for a in range(0, len(texts), batch):
                some = [list(s[a : a + batch].fillna("")) for s in (texts, contents)]
                try:
                    out += model(*some)
                except (ValueError, RuntimeError):
                    out += [0.0] * len(some[0])
            yield pd.Series(out, dtype="float64")

    return score
