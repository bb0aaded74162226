"""Answers of models that are asked once per prompt, in this run and in later ones."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..providers import ERROR
from ..store import Store

ANSWERS = "answers"
#: Turns a column of prompts into one of answers.
Provider = Callable[[Column], Column]


def address(asker: str, prompt: Column) -> Column:
    """The content address of an answer: who is asked, with all settings, and what."""
    return F.sha2(F.concat(F.lit(f"{len(asker)}:{asker}"), prompt), 256)


def unanswered(rows: DataFrame, prompt: str, store: Store, asker: str) -> DataFrame:
    """(key, prompt): every distinct prompt that the store has no answer to."""
    wanted = rows.where(F.col(prompt).isNotNull()).select(address(asker, F.col(prompt)).alias("_key"), F.col(prompt).alias("_prompt"))
    wanted = wanted.groupBy("_key").agg(F.first("_prompt").alias("_prompt"))
    known = store.every(ANSWERS)
    return wanted if known is None else wanted.join(known.select("_key"), "_key", "left_anti")


def ask(rows: DataFrame, prompt: str, provider: Provider, store: Store, asker: str, answer: str = "answer") -> DataFrame:
    """``rows`` with the answers to their prompts, null where the prompt is.

    ``asker`` names the provider, its model and its settings; another name is another cache. Each distinct prompt that is not in the store is asked
    once, whatever the number of its rows. A failed answer (null or the fixed error text) is returned and not kept, so that the next run asks again.
    """
    known = store.every(ANSWERS)
    asked = unanswered(rows, prompt, store, asker).select("_key", provider(F.col("_prompt")).alias("_answer")).checkpoint()  # a model is asked once
    good = asked.where(F.col("_answer").isNotNull() & (F.col("_answer") != ERROR))
    if not good.isEmpty():
        store.put(good, ANSWERS)
    told = asked if known is None else known.select("_key", "_answer").unionByName(asked)
    keyed = rows.withColumn("_key", address(asker, F.col(prompt)))
    return keyed.join(told, "_key", "left").withColumn(answer, F.col("_answer")).select(*(c for c in rows.columns if c != answer), answer)


def answered(rows: DataFrame, prompt: str, provider: Provider, answer: str, cache: Store | None = None, asker: str = "") -> DataFrame:
    """``rows`` with the answers to ``prompt``: asked in place, row by row, or through ``ask`` if there is a ``cache``."""
    return rows.withColumn(answer, provider(F.col(prompt))) if cache is None else ask(rows, prompt, provider, cache, asker, answer)
