"""Token arrays: cut, pad, mask."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

IGNORED = -100


def pad(ids: Column, length: int | Column, value: int = 0) -> Column:
    """``ids`` cut or padded on the right to ``length``."""
    n = F.lit(length) if isinstance(length, int) else length
    return F.slice(F.concat(ids, F.array_repeat(F.lit(value), n)), F.lit(1), n)


def attention(ids: Column, length: int | Column) -> Column:
    """One for each token kept by ``pad``, zero for the padding."""
    n = F.lit(length) if isinstance(length, int) else length
    kept = F.least(F.size(ids), n)
    return F.concat(F.array_repeat(F.lit(1), kept), F.array_repeat(F.lit(0), n - kept))


def mask_prompt(ids: Column, prompt_size: Column) -> Column:
    """Labels: the first ``prompt_size`` tokens are ignored by the loss."""
    n = F.least(F.greatest(prompt_size, F.lit(0)), F.size(ids))
    return F.concat(F.array_repeat(F.lit(IGNORED), n), F.slice(ids, n + 1, F.size(ids)))


def round_up(n: Column, multiple: int = 8) -> Column:
    return (F.ceil(n / multiple) * multiple).cast("int")


def whitespace_ids(text: Column, vocabulary: int = 32_000) -> Column:
    """An offline tokenizer: a hashed id for each word between white space."""
    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    return F.transform(words, lambda w: F.pmod(F.crc32(w.cast("binary")), F.lit(vocabulary)).cast("int"))
