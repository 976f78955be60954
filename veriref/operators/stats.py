"""Statistics that built-in aggregates don't have."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.types import DoubleType, StructField, StructType

RESAMPLES, SEED = 10_000, 42


def bootstrap_interval(counts: DataFrame, resamples: int = RESAMPLES, seed: int = SEED) -> DataFrame:
    """Of rows with n and k (hits), and any other columns: rate and its 2.5 and 97.5 percentiles beside them. Resampling n zeros and ones is a binomial draw, so only counts travel."""
    names = counts.columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for own in batches:
            hits = own["k"].fillna(0)
            low, high = [], []
            for n, k in zip(own["n"], hits, strict=True):
                rates = np.random.default_rng(seed).binomial(n, k / n, resamples) / n if n else np.zeros(1)
                ends = np.percentile(rates, [2.5, 97.5])
                low.append(ends[0])
                high.append(ends[1])
            yield own.assign(k=hits, rate=[k / n if n else 0.0 for n, k in zip(own["n"], hits, strict=True)], ci_low=low, ci_high=high)[[*names, "rate", "ci_low", "ci_high"]]

    return counts.mapInPandas(run, StructType([*counts.schema.fields, *(StructField(x, DoubleType()) for x in ("rate", "ci_low", "ci_high"))]))
