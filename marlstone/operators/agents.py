"""Prediction agents: trials with reflection, their datasets, best of N.

State is a DataFrame with a row per sample. The driver loops over trials only; each trial's state is written
by ``checkpoint()`` into the shared folder, so that a provider, which may answer differently when asked
again, is asked once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import prompts
from ..functions.text import ANSWER_MARK, after_last, fill, prediction, remove_fewshot, remove_reflections, same
from ..store import Store
from .answers import answered

#: A provider turns a DataFrame with the prompt (and all of the state's columns) into a column of answers.
Provider = Callable[[Column], Column]


def initial(samples: DataFrame) -> DataFrame:
    """State before the first trial, from sample_id, ticker, summary, target."""
    return samples.select(
        "sample_id",
        "ticker",
        "summary",
        "target",
        F.lit(None).cast("string").alias("prediction"),
        F.lit("").alias("scratchpad"),
        F.lit("").alias("response"),
        F.lit(False).alias("finished"),
        F.array().cast("array<string>").alias("reflections"),
        F.lit(-1).alias("trial"),
    )


def agent_prompt(with_reflections: bool = True) -> Column:
    shown = prompts.reflections_text(F.col("reflections")) if with_reflections else None
    return prompts.predict_prompt(F.col("ticker"), F.col("summary"), shown)


def predict(state: DataFrame, provider: Provider, trial: int, cache: Store | None = None, asker: str = "predict") -> DataFrame:
    """One run: a fresh scratchpad with the facts and the answer, and the answer's first word. ``cache``: see ``answers.ask``."""
    asked = answered(state.withColumn("trial", F.lit(trial)).withColumn("_prompt", agent_prompt()), "_prompt", provider, "_answer", cache, asker)
    pad = F.concat(fill(prompts.FACTS_BLOCK, {"summary": F.col("summary")}), F.col("_answer"))
    done = asked.withColumn("scratchpad", pad).withColumn("prediction", prediction(F.col("scratchpad")))
    return done.withColumn("response", after_last(F.col("scratchpad"), ANSWER_MARK)).withColumn("finished", F.lit(True)).drop("_prompt", "_answer")


def reflect(state: DataFrame, provider: Provider, cache: Store | None = None, asker: str = "reflect") -> DataFrame:
    """Append one reflection on the old scratchpad."""
    asked = state.withColumn("_prompt", fill(prompts.REFLECT, {"ticker": F.col("ticker"), "scratchpad": F.col("scratchpad")}))
    return answered(asked, "_prompt", provider, "_note", cache, asker).withColumn("reflections", F.concat("reflections", F.array("_note"))).drop("_prompt", "_note")


def is_correct() -> Column:
    return same(F.col("prediction"), F.col("target"))


def _mark(samples: DataFrame) -> str:
    """What the samples hold, in any order."""
    n, mix = samples.agg(F.count("*"), F.sum(F.xxhash64("sample_id", "ticker", "summary", "target").cast("decimal(38,0)"))).first()
    return f"{n}:{mix}"


def run_trials(samples: DataFrame, predictor: Provider, reflector: Provider, reflect_trials: int = 2, store: Store | None = None, cache: Store | None = None, asker: str = "") -> DataFrame:
    """All states: a row per sample and trial, first trial for all, later ones for those still wrong.

    With ``store``, every trial's state is a table ``trial-<n>`` there. A run that was cut off goes on after the last complete trial when it is started
    again, with more trials too, and asks no model about a complete one. Stored trials of other samples are an error.
    With ``cache``, answers are kept across runs (``answers.ask``); ``asker`` then names the models and their settings.
    """
    mark = _mark(samples) if store else ""

    def settled(trial: int, make: Callable[[], DataFrame]) -> DataFrame:
        if store is None:
            return make().checkpoint()
        facts = store.facts(f"trial-{trial}")
        if facts is None:
            return store.put(make(), f"trial-{trial}", samples=mark)
        if facts["samples"] != mark:
            raise ValueError(f"{store.path} holds trials of other samples")
        return store.get(f"trial-{trial}")

    state = settled(0, lambda: predict(initial(samples), predictor, 0, cache, f"predict {asker}"))
    history = state
    for trial in range(1, reflect_trials + 1):
        wrong = state.where(F.col("finished") & ~is_correct())
        state = settled(trial, lambda wrong=wrong, trial=trial: predict(reflect(wrong, reflector, cache, f"reflect {asker}"), predictor, trial, cache, f"predict {asker}"))
        history = history.unionByName(state)
    return history


def latest(history: DataFrame) -> DataFrame:
    """The last state of each sample."""
    lane = Window.partitionBy("sample_id").orderBy(F.desc("trial"))
    return history.withColumn("_n", F.row_number().over(lane)).where("_n = 1").drop("_n")


def sft_rows(history: DataFrame) -> DataFrame:
    """Fine-tuning rows: prompt and answer of what was right at the first trial."""
    right = history.where((F.col("trial") == 0) & is_correct())
    return right.select(agent_prompt().alias("instruction"), F.lit("").alias("input"), F.col("response").alias("output"), "sample_id")


def preference_rows(history: DataFrame, keep_colon: bool = False) -> DataFrame:
    """Preference rows: the wrong answer before (a) and the right one after it (b).

    ``completion_a`` is the wrong one; ``chosen`` and ``rejected`` say so.
    """
    lane = Window.partitionBy("sample_id").orderBy("trial")
    rows = history.withColumn("_right", is_correct()).withColumn("_was", F.lag("response").over(lane)).withColumn("_was_right", F.lag("_right").over(lane))
    turned = rows.where(F.col("_right") & ~F.col("_was_right"))
    return turned.select(
        "sample_id",
        remove_reflections(agent_prompt(), keep_colon).alias("user_input"),
        F.col("_was").alias("completion_a"),
        F.col("response").alias("completion_b"),
        F.col("response").alias("chosen"),
        F.col("_was").alias("rejected"),
    )


def result_rows(state: DataFrame) -> DataFrame:
    """Prompt without examples, response, target."""
    return state.select(remove_fewshot(agent_prompt()).alias("Prompt"), F.col("response").alias("Response"), F.col("target").alias("Target"))


def fan_out(rows: DataFrame, n: int) -> DataFrame:
    """Each row ``n`` times, numbered by ``cand``."""
    return rows.withColumn("cand", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))


def best_of(candidates: DataFrame, key: str, score: str, answer: str) -> DataFrame:
    """The answer with the highest score per key; ties go to the first candidate."""
    best = F.max_by(F.struct("cand", answer, score), F.struct(F.col(score), -F.col("cand")))
    return candidates.groupBy(key).agg(best.alias("_b")).select(key, "_b.cand", f"_b.{answer}", f"_b.{score}")


def n_shots(rows: DataFrame, generate: Provider, reward: Provider, n: int = 4, key: str = "sample_id", prompt: str = "prompt") -> DataFrame:
    """Best of ``n`` answers by the reward of prompt and answer together."""
    said = fan_out(rows, n).withColumn("answer", generate(F.concat(F.col(prompt), F.lit("\x1f"), F.col("cand").cast("string"))))
    scored = said.withColumn("score", reward(F.concat(F.col(prompt), F.col("answer"))))
    return best_of(scored, key, "score", "answer")


def log_entries(state: DataFrame) -> DataFrame:
    """(trial, sample_id, right, finished, entry): the log as a row per agent, for trials of any size."""
    entry = F.concat(remove_fewshot(agent_prompt()), F.lit("\nCorrect answer: "), F.col("target"))
    return state.select("trial", "sample_id", is_correct().alias("right"), "finished", entry.alias("entry"))


def log_text(state: DataFrame) -> DataFrame:
    """One log text per trial: counts, then the agents' entries; the text of a trial must fit in one row (else ``log_entries``)."""
    marked = log_entries(state).select("trial", "sample_id", F.col("right").alias("_right"), F.col("entry").alias("_entry"), "finished")
    return marked.groupBy("trial").agg(
        F.concat(
            F.lit("Correct: "), F.count_if("_right").cast("string"), F.lit(", Incorrect: "), F.count_if(F.col("finished") & ~F.col("_right")).cast("string"),
            F.lit("\n"), F.expr("coalesce(listagg(_entry, '\\n\\n') WITHIN GROUP (ORDER BY sample_id), '')"),
        ).alias("log")
    )
