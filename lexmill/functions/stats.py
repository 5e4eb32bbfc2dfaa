"""Seeds, canonical bytes and bootstrap bounds: what has to match other programs bit by bit runs in Arrow batches."""

from __future__ import annotations

import hashlib
import json

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

RESAMPLES, ALPHA = 10_000, 0.001


def seed_of(*parts: str) -> int:
    """An unsigned 64-bit seed from strings."""
    return int.from_bytes(hashlib.blake2b("".join(parts).encode(), digest_size=8).digest(), "big")


@F.pandas_udf(T.DecimalType(20, 0))
def seed_udf(text: pd.Series) -> pd.Series:
    from decimal import Decimal

    return text.map(lambda t: None if t is None else Decimal(seed_of(t)))


def canonical_json(value) -> str:
    """Sorted keys, no spaces, ASCII."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=True)


@F.pandas_udf(T.StringType())
def canonical_udf(text: pd.Series) -> pd.Series:
    """The canonical form of JSON texts; null for what is no JSON."""

    def one(t):
        try:
            return None if t is None else canonical_json(json.loads(t))
        except ValueError:
            return None

    return text.map(one)


def lower_bound(diffs: np.ndarray, seed: int, resamples: int = RESAMPLES, alpha: float = ALPHA) -> float:
    """The alpha quantile of resampled means; a block of resamples at a time bounds memory."""
    if not len(diffs):
        raise ValueError("no differences")
    rng = np.random.Generator(np.random.PCG64(seed))
    means = np.empty(resamples)
    step = max(1, 2_000_000 // len(diffs))
    for low in range(0, resamples, step):
        n = min(step, resamples - low)
        means[low : low + n] = diffs[rng.integers(0, len(diffs), size=(n, len(diffs)))].mean(axis=1)
    return float(np.quantile(means, alpha))


def bootstrap_of_counts(values: list[float], counts: list[int], seed: int, resamples: int = RESAMPLES, alpha: float = ALPHA) -> float:
    """A7 from how often each value stands there: resampled counts are multinomial, so a group of any size costs its different values."""
    values, counts = np.array(values, float), np.array(counts, np.int64)
    n = int(counts.sum())
    if not n:
        raise ValueError("no differences")
    drawn = np.random.Generator(np.random.PCG64(seed)).multinomial(n, counts / n, size=resamples)
    return float(np.quantile(drawn @ values / n, alpha))


def bound_of_counts(seed: int):
    """bootstrap_of_counts over two array columns."""

    @F.pandas_udf(T.DoubleType())
    def bound(values: pd.Series, counts: pd.Series) -> pd.Series:
        return pd.Series([bootstrap_of_counts(list(v), list(n), seed) for v, n in zip(values, counts)])

    return bound
