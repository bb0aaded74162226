"""What policy optimisation needs of rollouts: rewards with a penalty for leaving the reference model, advantages, and their whitening."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def penalised_rewards(logp: Column, reference: Column, score: Column, beta: float = 0.1) -> Column:
    """Per token minus ``beta`` times the log-ratio of policy and reference; the last one also gets the rollout's score. Empty for no token."""
    penalty = F.zip_with(logp, reference, lambda a, b: (b - a) * beta)
    last = F.size(logp) - 1
    return F.transform(penalty, lambda x, i: F.when(i == last, x + score).otherwise(x))


def advantages(rewards: Column, values: Column, discount: float = 1.0, decay: float = 0.95) -> Column:
    """Generalised advantage estimates: the discounted sum, from the end, of each token's reward plus the next value less its own."""

    def fold(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for all_rewards, all_values in batches:
            out = []
            for r, v in zip(all_rewards, all_values, strict=True):
                if r is None or v is None:
                    out.append(None)
                    continue
                r, v = np.asarray(r, float), np.asarray(v, float)
                if len(r) != len(v):
                    raise ValueError(f"{len(r)} rewards and {len(v)} values")
                delta = r + discount * np.append(v[1:], 0.0)[: len(v)] - v
                out.append(list(accumulate(delta[::-1].tolist(), lambda a, d: d + discount * decay * a))[::-1])
            yield pd.Series(out, dtype=object)

    fold.__annotations__ = {"batches": Iterator[tuple[pd.Series, pd.Series]], "return": Iterator[pd.Series]}
    return F.pandas_udf(fold, "array<double>")(rewards, values)


def whitened(rows: DataFrame, column: str, shift_mean: bool = True) -> DataFrame:
    """``rows`` with the arrays of ``column`` scaled by the mean and variance over all tokens of all rows; null arrays stay null.

    Two passes: only sums within rows are added up, none of the arrays is taken apart, and three numbers come to the driver.
    """
    total = lambda f: F.sum(F.aggregate(F.transform(column, f), F.lit(0.0), lambda a, x: a + x))
    n, s = rows.agg(F.sum(F.size(column).cast("long")).alias("n"), total(lambda x: x).alias("s")).first()
    if not n:
        return rows
    mean = s / n
    var = rows.agg(total(lambda x: (x - mean) * (x - mean))).first()[0] / max(n - 1, 1)
    scale = 1.0 / float(np.sqrt(var + 1e-8))
    back = 0.0 if shift_mean else mean
    return rows.withColumn(column, F.transform(column, lambda x: (x - mean) * scale + back))
