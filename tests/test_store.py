"""Versioned tables, resumable trials and cached answers."""

import pytest
from pyspark.sql import functions as F

from marlstone.operators import agents, answers
from marlstone.providers import ERROR
from marlstone.store import Store


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_versions(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    assert store.get("t") is None and store.every("t") is None and store.facts("t") is None and store.versions("t") == []
    one = spark.createDataFrame([(1, "a"), (2, None)], "k long, v string")
    two = spark.createDataFrame([(2, "b"), (3, "c"), (3, "d")], "k long, v string")
    assert rows(store.put(one, "t", why="first")) == rows(one)
    store.put(two, "t", why="second")
    assert store.versions("t") == [1, 2] and store.facts("t") == {"why": "second"}
    assert rows(store.get("t")) == rows(two) and rows(store.get("t", 1)) == rows(one) and store.get("t", 3) is None
    assert store.every("t").count() == 5 and store.get("other") is None
    want = [(1, "a"), (2, "b"), (3, "d")]
    assert rows(store.newest("t", "k")) == want
    # A folder without a manifest line is not seen: a write that was cut off.
    one.write.parquet(f"{tmp_path}/t/cut-off")
    assert store.versions("t") == [1, 2] and store.every("t").count() == 5


def test_compaction_after_many_appends(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    for i in range(6):
        store.put(spark.createDataFrame([(k, i) for k in range(i, 8, 2)], "k long, v long"), "t")
    before = rows(store.newest("t", "k"))
    assert rows(store.compact("t", "k")) == before == rows(store.newest("t", "k")) and store.every("t").count() == len(before)
    store.put(spark.createDataFrame([(0, 9)], "k long, v long"), "t")
    assert dict(rows(store.newest("t", "k")))[0] == 9 and store.every("t").count() == len(before) + 1
    assert store.compact("none", "k") is None


def test_a_new_column_is_null_in_older_versions(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    store.put(spark.createDataFrame([(1,)], "k long"), "t")
    store.put(spark.createDataFrame([(2, "x")], "k long, v string"), "t")
    assert rows(store.every("t").select("k", "v")) == [(1, None), (2, "x")]


SAMPLES = [(i, "T", f"facts {i}", "Positive" if i % 3 else "Negative") for i in range(12)]


def test_trials_go_on_after_the_last_complete_one(spark, tmp_path):
    samples = spark.createDataFrame(SAMPLES, "sample_id long, ticker string, summary string, target string")
    asked = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def count(prompt):
        asked.add(1)
        return ("Positive" if len(prompt) % 2 else "Negative") + "\nExplanation: x"

    note = lambda p: F.concat(F.lit("note "), F.length(p).cast("string"))
    columns = ["sample_id", "trial", "prediction", "reflections", "response"]
    whole = rows(agents.run_trials(samples, count, note, 2).select(columns))
    store = Store(spark, str(tmp_path))
    agents.run_trials(samples, count, note, 0, store)
    agents.run_trials(samples, count, note, 1, store)
    n = asked.value
    assert rows(agents.run_trials(samples, count, note, 2, store).select(columns)) == whole
    assert asked.value - n == sum(1 for r in whole if r[1] == 2)
    n = asked.value
    assert rows(agents.run_trials(samples, count, note, 2, store).select(columns)) == whole and asked.value == n
    with pytest.raises(ValueError, match="other samples"):
        agents.run_trials(samples.where("sample_id < 5"), count, note, 2, store)


def test_each_prompt_is_asked_once(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    asked = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def model(prompt):
        asked.add(1)
        return ERROR if prompt == "bad" else None if prompt == "none" else prompt.upper()

    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, None), (5, "bad"), (6, "none"), (7, "")], "id long, prompt string")
    want = [(1, "a", "A"), (2, "a", "A"), (3, "b", "B"), (4, None, None), (5, "bad", ERROR), (6, "none", None), (7, "", "")]
    assert rows(answers.ask(df, "prompt", model, store, "m")) == want and asked.value == 5
    assert rows(answers.ask(df, "prompt", model, store, "m")) == want and asked.value == 7  # what failed is asked again
    assert rows(answers.ask(df.where("id < 4"), "prompt", model, store, "m, other settings"))[0] == (1, "a", "A") and asked.value == 9
    assert answers.unanswered(df, "prompt", store, "m").count() == 2
    assert answers.ask(df.limit(0), "prompt", model, store, "m").count() == 0


def counted(spark, make):
    """A provider that counts what it is asked."""
    asked = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def model(prompt):
        asked.add(1)
        return make(str(prompt))

    return model, asked


def test_no_program_asks_twice(spark, tmp_path):
    """Summaries, profiles, forecasts, predictions and reflections come from the cache in a second run, with the same results."""
    import datetime

    from marlstone.operators import forecast
    from marlstone.operators import samples as s

    cache = Store(spark, f"{tmp_path}/cache")
    day = datetime.date(2022, 1, 3)
    rows = spark.createDataFrame([(t, f"facts {i} {'x' * i}", "Positive" if i % 2 else "Negative") for i, t in enumerate("AABBBC")], "ticker string, summary string, target string")
    posts = spark.createDataFrame([("A", day, 0, "one"), ("A", day, 1, "two"), ("B", day, 0, " ")], "ticker string, date date, line_no int, text string")
    samples = rows.withColumn("sample_id", F.monotonically_increasing_id()).checkpoint()
    rows_of = lambda df: sorted(map(tuple, df.collect()), key=repr)
    model, asked = counted(spark, lambda p: ("Positive" if len(p) % 3 else "Negative") + "\nExplanation: Stock Return: 1% (up)")

    def run():
        return (
            rows_of(s.model_summaries(posts, model, cache=cache).select("ticker", "summary")),
            rows_of(forecast.evaluate(rows, model, lambda m: model(F.to_json(m)), cache=cache, asker="m")),
            rows_of(agents.run_trials(samples, model, model, 2, cache=cache, asker="m").select("sample_id", "trial", "response", "reflections")),
        )

    first, n = run(), asked.value
    assert n > 10 and run() == first and asked.value == n
    assert first[0] == [("A", first[0][0][1]), ("B", None)]
