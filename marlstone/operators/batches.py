"""Batches of sequences under a budget of tokens, padding included."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .order import numbered


def padded_length(length: Column, budget: int, least: int = 8) -> Column:
    """The length that a sequence is padded to: the next power of two, ``least`` or more, the budget at most; null if it is longer than the budget."""
    bits = F.length(F.bin(F.greatest(length, F.lit(least)) - 1))
    power = F.call_function("shiftleft", F.lit(1).cast("long"), bits)
    return F.when(length <= budget, F.least(power, F.lit(budget))).cast("long")


def batch_plan(rows: DataFrame, length: str, order: str, budget: int, least: int = 8) -> DataFrame:
    """``rows`` with ``padded``, ``batch_id`` and ``place`` in the batch.

    Sequences are sorted by length (then by ``order``) within each range of lengths that are padded alike; as many as the budget allows follow each other in a
    batch, so a batch holds one range and, padded, never more than ``budget`` tokens. Batch ids run from 0 through all ranges. Places come from ranges of the
    order, and ids from the ranges' counts (a number for each power of two), so no task sees all rows. A sequence longer than the budget has no batch: cut it first.
    """
    sized = rows.withColumn("padded", padded_length(F.col(length), budget, least))
    counts = sorted((r.padded, r["count"]) for r in sized.where(F.col("padded").isNotNull()).groupBy("padded").count().collect())
    first, at = F.lit(None).cast("long"), 0
    for padded, n in counts:
        first = F.when(F.col("padded") == padded, F.lit(at)).otherwise(first)
        at += -(-n // (budget // padded))
    placed = numbered(sized, "padded", length, order, name="_n")
    each = F.floor(F.lit(budget) / F.col("padded"))
    return placed.select(*sized.columns, (first + F.floor(F.col("_n") / each)).cast("long").alias("batch_id"), F.when(F.col("padded").isNotNull(), F.col("_n") % each).cast("long").alias("place"))
