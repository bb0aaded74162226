"""A linear reward model, fitted to pairs of a chosen and a rejected answer.

The reward is w . x; a pair's loss is -log sigmoid(w . (chosen - rejected)). Gradient descent: a step is one distributed sum of losses and gradients, added up
in numpy within each task, so that a row per task and coordinate is shuffled. Only the weights come to the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..store import Store

WEIGHTS = "reward-weights"


def differences(pairs: DataFrame, chosen: str = "chosen", rejected: str = "rejected") -> DataFrame:
    """(d): chosen less rejected features; pairs with a null, or of unequal lengths, tell nothing and are left out."""
    d = F.zip_with(F.col(chosen).cast("array<double>"), F.col(rejected).cast("array<double>"), lambda a, b: a - b)
    whole = (F.size(chosen) == F.size(rejected)) & F.forall(d, lambda x: x.isNotNull())
    return pairs.where(F.col(chosen).isNotNull() & F.col(rejected).isNotNull()).where(whole).select(d.alias("d"))


def _sums(w: np.ndarray):
    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, loss, grad = 0, 0.0, np.zeros(len(w))
        for batch in batches:
            if len(batch):
                d = np.stack(batch["d"].to_numpy())
                m = d @ w
                n, loss = n + len(d), loss + float(np.logaddexp(0, -m).sum())
                grad -= d.T @ np.exp(-np.logaddexp(0, m))
        yield pd.DataFrame({"at": np.arange(-2, len(w)), "value": [float(n), loss, *grad.tolist()]})

    return sums


def step_sums(d: DataFrame, w: np.ndarray) -> tuple[int, float, np.ndarray]:
    """(pairs, sum of losses, sum of gradients) at ``w``."""
    rows = d.mapInPandas(_sums(w), "at long, value double").groupBy("at").agg(F.sum("value").alias("value")).collect()  # a row per coordinate
    by = {r.at: r.value for r in rows}
    return int(by.get(-2, 0)), by.get(-1, 0.0), np.array([by.get(i, 0.0) for i in range(len(w))])


def fit(pairs: DataFrame, *, steps: int = 200, rate: float = 0.5, l2: float = 0.0, settled: float = 1e-6, store: Store | None = None, every: int = 20) -> tuple[np.ndarray, int, float]:
    """(weights, steps taken, mean loss before the last step). Ends when no weight moves by more than ``settled``.

    With ``store`` the weights are kept every ``every`` steps, and a fit that was cut off goes on from the newest ones. Without pairs, no weights.
    """
    d = differences(pairs).checkpoint()
    size = d.select(F.max(F.size("d"))).first()[0]
    if size is None:
        return np.zeros(0), 0, 0.0
    w, first = np.zeros(size), 0
    if store and (kept := store.facts(WEIGHTS)):
        first = int(kept["step"])
        for r in store.get(WEIGHTS).collect():
            w[r.at] = r.weight
    mean = 0.0
    for step in range(first + 1, steps + 1):
        n, loss, grad = step_sums(d, w)
        move = rate * (grad / n + l2 * w)
        w, mean, end = w - move, loss / n, bool(np.abs(move).max() <= settled)
        if store and (end or step % every == 0 or step == steps):
            store.put(d.sparkSession.createDataFrame(list(enumerate(w.tolist())), "at int, weight double"), WEIGHTS, step=str(step))
        first = step
        if end:
            break
    return w, first, mean


def reward(features: Column, w: np.ndarray) -> Column:
    """The reward of a row's features."""
    terms = F.zip_with(features, F.array(*[F.lit(float(x)) for x in w]), lambda a, b: a * b)
    return F.aggregate(terms, F.lit(0.0), lambda a, x: a + x)
