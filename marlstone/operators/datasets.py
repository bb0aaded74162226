"""Fine-tuning, preference and reward datasets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import arrays, prompts


def hash_split(rows: DataFrame, key: str, share: float = 0.1, seed: int = 42) -> DataFrame:
    """``fold``: val for a seeded share of the keys, else train. The same key always falls the same way."""
    text = F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string"))
    part = F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long") % 10_000
    return rows.withColumn("fold", F.when(part < round(share * 10_000), "val").otherwise("train"))


def shuffled(rows: DataFrame, key: str, seed: int = 0) -> DataFrame:
    """A seeded, repeatable order."""
    return rows.orderBy(F.xxhash64(F.col(key), F.lit(seed)), key)


def first_rows(rows: DataFrame, k: int, *order: str | Column) -> DataFrame:
    """The first ``k`` rows in an explicit order; all of them if k is not positive."""
    return rows.orderBy(*order).limit(k) if k > 0 else rows


def instruction_tokens(rows: DataFrame, ids: Column | None = None, cutoff: int = 256, tokenize=arrays.whitespace_ids) -> DataFrame:
    """input_ids, labels (prompt ignored) and attention_mask of instruction, input and output."""
    prompt = prompts.instruct(F.col("instruction"), F.col("input"))
    out = rows.withColumn("_p", F.size(tokenize(prompt))).withColumn("_ids", tokenize(F.concat(prompt, F.col("output"))))
    padded = out.withColumn("input_ids", arrays.pad(F.col("_ids"), cutoff)).withColumn("attention_mask", arrays.attention(F.col("_ids"), cutoff))
    return padded.withColumn("labels", arrays.mask_prompt(F.col("input_ids"), F.col("_p"))).drop("_p", "_ids")


def pair_tokens(rows: DataFrame, max_length: int = 0, tokenize=arrays.whitespace_ids) -> DataFrame:
    """Token ids of question and each completion; with ``max_length``, only pairs where both are short enough."""
    ids = lambda c: tokenize(prompts.question_answer(F.col("user_input"), F.col(c)))
    out = rows.withColumn("input_ids_j", ids("completion_a")).withColumn("input_ids_k", ids("completion_b"))
    if max_length:
        out = out.where((F.size("input_ids_j") <= max_length) & (F.size("input_ids_k") <= max_length))
    return out


def collate_pairs(rows: DataFrame, multiple: int = 8, key: str | None = None) -> DataFrame:
    """Batches of ``pair_tokens``: both sides padded to the batch's longest, rounded up, with attention masks.

    ``key`` names the batch of a row; without it every row is one.
    """
    out = rows
    for side in ("j", "k"):
        ids = F.col(f"input_ids_{side}")
        longest = F.size(ids) if key is None else F.max(F.size(ids)).over(Window.partitionBy(key))
        size = arrays.round_up(longest, multiple)
        out = out.withColumn(f"_n_{side}", size)
        out = out.withColumn(f"attention_mask_{side}", arrays.attention(ids, F.col(f"_n_{side}"))).withColumn(f"input_ids_{side}", arrays.pad(ids, F.col(f"_n_{side}")))
    return out.drop("_n_j", "_n_k")


def rl_queries(rows: DataFrame, max_length: int = 512, tokenize=arrays.whitespace_ids) -> DataFrame:
    """The dataset of reinforcement learning: query and its token ids, those of fewer than ``max_length`` tokens."""
    out = rows.withColumn("query", prompts.question_answer(F.col("user_input")))
    return out.withColumn("input_ids", tokenize(F.col("query"))).where(F.size("input_ids") < max_length)


def response_lengths(rows: DataFrame, key: str, low: int = 32, high: int = 128, seed: int = 0) -> DataFrame:
    """``response_length``: a seeded length from ``low`` up to, not including, ``high`` for each generation."""
    text = F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string"))
    lot = F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long")
    return rows.withColumn("response_length", (lot % (high - low) + low).cast("int"))


def fit_prompt(posts: DataFrame, limit: int, size: Column, key: list[str], order: str) -> DataFrame:
    """The posts of each key, from the first, whose running size stays within ``limit``."""
    lane = Window.partitionBy(*key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return posts.withColumn("_up", F.sum(size).over(lane)).where(F.col("_up") <= limit).drop("_up")
