"""The zero-shot baseline: a company profile, a forecast from it and the recent news, its direction, and the tally."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import prompts
from ..functions.text import direction, fill
from ..store import Store
from .answers import answered, ask
from .asof import as_of
from .metrics import binary_metrics

Provider = Callable[[Column], Column]


def profiles(tickers: DataFrame, provider: Provider, cache: Store | None = None, asker: str = "profile") -> DataFrame:
    """(ticker, profile): one description per distinct ticker. ``cache``: see ``answers.ask``."""
    asked = tickers.select("ticker").distinct().withColumn("_p", fill(prompts.COMPANY, {"ticker": F.col("ticker")}))
    return answered(asked, "_p", provider, "profile", cache, asker).select("ticker", "profile")


def with_examples(samples: DataFrame, at: str = "end_date") -> DataFrame:
    """``samples`` with ``example``: the news and the outcome of the ticker's last sample before, whose outcome was known by then; null for the first."""
    shown = fill(prompts.EXAMPLE, {"summary": F.col("summary"), "target": F.col("target")})
    return as_of(samples, samples.select("ticker", at, shown.alias("example")), "ticker", at, "example")


def user_message(with_example: Column | None = None) -> Column:
    """The user's message of a forecast; with an example that is not null, the one that shows it."""
    values = {"company_description": F.coalesce("profile", F.lit("")), "summary": F.col("summary")}
    plain = fill(prompts.FORECAST_USER, values)
    if with_example is None:
        return plain
    return F.when(with_example.isNull(), plain).otherwise(fill(prompts.FORECAST_USER_SHOTS, values | {"few_shot_learning_examples": with_example}))


def forecasts(samples: DataFrame, described: DataFrame, provider: Provider, example: str | None = None, cache: Store | None = None, asker: str = "forecast") -> DataFrame:
    """``samples`` (ticker, summary, target, ...) with messages, response and prediction; ``example`` names a column of ``with_examples``.

    A sample without a summary is skipped; a null answer counts as Unknown.
    """
    user = user_message(None if example is None else F.col(example))
    asked = samples.where(F.trim("summary") != "").join(described, "ticker", "left").withColumn("messages", prompts.messages(F.lit(prompts.FORECAST_SYSTEM), user))
    if cache is None:
        told = asked.withColumn("response", provider(F.col("messages")))
    else:  # addressed by the messages' text
        of_text = lambda c: provider(F.from_json(c, asked.schema["messages"].dataType))
        told = ask(asked.withColumn("_m", F.to_json("messages")), "_m", of_text, cache, asker, "response").drop("_m")
    return told.withColumn("prediction", direction(F.coalesce("response", F.lit(""))))


def evaluate(samples: DataFrame, profiler: Provider, forecaster: Provider, by: list[str] | None = None, cache: Store | None = None, asker: str = "") -> DataFrame:
    """Metrics of the whole loop; the answers are written by ``checkpoint()`` so that a model is asked once, or kept in ``cache`` for later runs too."""
    described = profiles(samples, profiler, cache, f"profile {asker}").checkpoint()
    return binary_metrics(forecasts(samples, described, forecaster, None, cache, f"forecast {asker}").checkpoint(), "prediction", "target", by)
