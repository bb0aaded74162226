import pytest
from pyspark.sql import functions as F

from marlstone import providers, sinks
from marlstone.functions import arrays, prompts
from marlstone.operators import agents, datasets, metrics


@pytest.fixture(scope="module")
def history(spark):
    rows = [(i, "T", f"fact {'x' * i}", "Positive" if i % 3 else "Negative") for i in range(30)]
    samples = spark.createDataFrame(rows, "sample_id long, ticker string, summary string, target string")
    answer = lambda p: F.concat(F.when(F.crc32(p.cast("binary")) % 2 == 0, "positive").otherwise("Negative"), F.lit("\nwhy"))
    return agents.run_trials(samples, answer, providers.reflection, 2)


def test_only_wrong_samples_are_tried_again(history):
    rows = {}
    for r in history.collect():
        rows.setdefault(r.sample_id, []).append((r.trial, r.prediction.lower() == r.target.lower(), len(r.reflections)))
    for states in rows.values():
        states.sort()
        assert [t for t, _, _ in states] == list(range(len(states))) and [n for _, _, n in states] == list(range(len(states)))
        assert not any(ok for _, ok, _ in states[:-1]) and (states[-1][1] or len(states) == 3)
    counts = {r.trial: (r.correct, r.incorrect) for r in metrics.trial_summary(history).collect()}
    assert sum(counts[0]) == 30 and sum(counts[1]) == counts[0][1]


def test_datasets(history, tmp_path, spark):
    sft, pairs = agents.sft_rows(history), agents.preference_rows(history)
    first = history.where("trial = 0").where(agents.is_correct()).count()
    assert sft.count() == first
    later = history.where("trial > 0").where(agents.is_correct()).count()
    got = pairs.collect()
    assert len(got) == later > 0 and all(r.completion_a == r.rejected and r.completion_b == r.chosen for r in got)
    assert all("attempted" not in r.user_input and "\n\nFactsfact" in r.user_input for r in got)
    sinks.write_sft(sft, f"{tmp_path}/sft")
    assert spark.read.json(f"{tmp_path}/sft").count() == first
    assert sinks.write_preferences(pairs, f"{tmp_path}/pairs") and not sinks.write_preferences(pairs.limit(0), f"{tmp_path}/none")
    sinks.write_results(agents.result_rows(agents.latest(history)), f"{tmp_path}/results")
    back = spark.read.option("multiLine", True).option("escape", '"').csv(f"{tmp_path}/results", header=True)
    assert back.count() == 30 and back.where(F.col("Response").contains("\nwhy")).count() == 30


def test_best_of_n_prefers_the_first_of_equals(spark):
    rows = spark.createDataFrame([(1, 0, "a", 1.0), (1, 1, "b", 2.0), (1, 2, "c", 2.0)], "k int, cand int, answer string, score double")
    assert agents.best_of(rows, "k", "score", "answer").first().answer == "b"
    assert agents.fan_out(rows, 4).count() == 12


def test_model_adapters(spark):
    rows = spark.createDataFrame([("a",), ("bb",), (None,)], "p string")
    upper = providers.batched(lambda: lambda ts: [t.upper() for t in ts])
    assert sorted(r[0] for r in rows.select(upper(F.col("p"))).collect()) == ["", "A", "BB"]

    def broken(_):
        raise RuntimeError

    assert {r[0] for r in rows.select(providers.batched(lambda: broken, tries=2, pause=0.01)(F.col("p"))).collect()} == {providers.ERROR}
    assert sorted(r[0] for r in rows.select(providers.scorer(lambda: lambda ts: [float(len(t)) for t in ts])(F.col("p"))).collect()) == [0, 1, 2]
    assert sorted(r[0] for r in rows.select(providers.tokenizer(lambda: lambda t: [len(t)])(F.col("p"))).collect()) == [[0], [1], [2]]


def test_chat_models_and_empty_prompts(spark):
    rows = spark.createDataFrame([("a",), ("",), (None,), ("b",)], "p string")
    counted = providers.batched(lambda: lambda ts: [f"{len(ts)}:{t}" for t in ts], skip_empty=True)
    assert sorted(str(r[0]) for r in rows.repartition(1).select(counted(F.col("p"))).collect()) == ["2:a", "2:b", "None", "None"]
    model = providers.chat(lambda: lambda chats: ["/".join(f"{m['role']}={m['content']}" for m in c) for c in chats])
    got = rows.where("p = 'a'").select(model(prompts.messages(F.lit("be brief"), F.col("p")))).first()[0]
    assert got == "system=be brief/user=a"


def test_token_arrays(spark):
    rows = spark.createDataFrame([([1, 2, 3],), ([],), ([1] * 9,)], "ids array<int>")
    out = rows.select(arrays.pad(F.col("ids"), 5), arrays.attention(F.col("ids"), 5), arrays.mask_prompt(F.col("ids"), F.lit(2)), arrays.round_up(F.size("ids"))).collect()
    assert [list(r) for r in out] == [
        [[1, 2, 3, 0, 0], [1, 1, 1, 0, 0], [-100, -100, 3], 8],
        [[0] * 5, [0] * 5, [], 0],
        [[1] * 5, [1] * 5, [-100] * 2 + [1] * 7, 16],
    ]
    sft = spark.createDataFrame([("do", "", "done"), ("do", "with", "done")], "instruction string, input string, output string")
    got = datasets.instruction_tokens(sft, cutoff=32).collect()
    assert all(len(r.input_ids) == len(r.labels) == len(r.attention_mask) == 32 for r in got)
    assert ["### Input:" in r[0] for r in sft.select(prompts.instruct(F.col("instruction"), F.col("input"))).collect()] == [False, True]


def test_splits(spark):
    rows = spark.range(5000).withColumnRenamed("id", "k")
    a = datasets.hash_split(rows, "k")
    assert abs(a.where("fold = 'val'").count() - 500) < 100
    assert a.exceptAll(datasets.hash_split(rows.repartition(7), "k")).count() == 0
    assert datasets.first_rows(rows, 3, "k").count() == 3 and datasets.first_rows(rows, 0, "k").count() == 5000
    assert datasets.shuffled(rows, "k").first() != rows.first()
