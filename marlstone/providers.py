"""Answer providers: deterministic defaults as column expressions, and adapters for real models.

The defaults run inside the JVM. A real model is a Python callable from prompts to answers; ``batched``
makes a provider of it that loads the model once per Python worker, sends prompts in Arrow batches, retries with
growing pauses and gives a fixed text where it keeps failing.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .functions.text import NEGATIVE, POSITIVE

ERROR = "Inference Error"
#: Words of the lexicon predictor.
GOOD = ("rise", "gain", "beat", "growth", "strong", "profit")
BAD = ("fall", "loss", "miss", "weak", "cut", "lawsuit")


def lexicon(prompt: Column) -> Column:
    """Positive if the prompt holds more kinds of good words than of bad ones; its length decides ties."""
    score = lambda words: sum((F.when(F.lower(prompt).contains(w), 1).otherwise(0) for w in words), F.lit(0))
    good, bad = score(GOOD), score(BAD)
    up = (good > bad) | ((good == bad) & (F.length(prompt) % 2 == 0))
    return F.concat(F.when(up, POSITIVE).otherwise(NEGATIVE), F.lit("\nExplanation: word counts."))


def sketch(prompt: Column) -> Column:
    """A company profile that names the length of its prompt."""
    return F.concat(F.lit("Description: "), F.length(prompt).cast("string"), F.lit(" characters"))


def guess(messages: Column) -> Column:
    """A forecast of the user's message in the asked format, by the lexicon."""
    up = F.when(lexicon(F.element_at(messages, -1)["content"]).startswith(POSITIVE), "up").otherwise("down")
    return F.concat(F.lit("Summary: -, Keywords: -, Stock Return: 1% ("), up, F.lit(")"))


def reflection(prompt: Column) -> Column:
    """A note that names the length of what it was shown."""
    return F.concat(F.lit("Weigh the facts anew; the trial had "), F.length(prompt).cast("string"), F.lit(" characters."))


def hashed_score(text: Column) -> Column:
    """A reward between 0 and 1 from a checksum."""
    return (F.crc32(text.cast("binary")) % 10_000) / 10_000.0


def batched(load: Callable[[], Callable[[list[str]], list[str]]], *, batch: int = 16, tries: int = 6, pause: float = 1.0, most: float = 60.0, skip_empty: bool = False) -> Callable[[Column], Column]:
    """A provider from a model; ``load`` runs once per Python worker and partition. With ``skip_empty``, empty prompts are not asked; their answer is null."""

    def answers(prompts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()

        def ask(texts: list[str]) -> list[str]:
            wait = pause
            for left in reversed(range(tries)):
                try:
                    return list(model(texts))
                except Exception:  # whatever a model raises
                    if left:
                        time.sleep(wait)
                        wait = min(most, wait * 2)
            return [ERROR] * len(texts)

        for series in prompts:
            texts = series.fillna("").tolist()
            asked = [bool(t.strip()) or not skip_empty for t in texts]
            full = [t for t, a in zip(texts, asked, strict=True) if a]
            said = iter([x for i in range(0, len(full), batch) for x in ask(full[i : i + batch])])
            yield pd.Series([next(said) if a else None for a in asked], dtype=object)

    answers.__annotations__ = {"prompts": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(answers, "string").asNondeterministic()


def chat(load: Callable[[], Callable[[list[list[dict[str, str]]]], list[str]]], **settings) -> Callable[[Column], Column]:
    """A provider over chat messages (``prompts.messages``) from a model that takes lists of role and content."""

    def of_text() -> Callable[[list[str]], list[str]]:
        model = load()
        return lambda texts: model([json.loads(t) for t in texts])

    ask = batched(of_text, **settings)
    return lambda messages: ask(F.to_json(messages))


def scorer(load: Callable[[], Callable[[list[str]], list[float]]]) -> Callable[[Column], Column]:
    """A reward provider from a scoring model."""

    def scores(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for series in texts:
            yield pd.Series(model(series.fillna("").tolist()), dtype="float64")

    scores.__annotations__ = {"texts": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(scores, "double").asNondeterministic()


def tokenizer(load: Callable[[], Callable[[str], list[int]]]) -> Callable[[Column], Column]:
    """Token ids from a tokenizing callable."""

    def ids(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = load()
        for series in texts:
            yield pd.Series([encode(x or "") for x in series])

    ids.__annotations__ = {"texts": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(ids, "array<int>")
