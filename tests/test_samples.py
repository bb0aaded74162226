import datetime as dt

from pyspark.sql import functions as F

from marlstone.operators import samples


def day(n):
    return dt.date(2022, 1, 1) + dt.timedelta(days=n)


def test_labels(spark):
    rows = spark.createDataFrame([(0.1,), (0.0,), (-1.0,), (float("nan"),), (None,)], "x double")
    assert [r[0] for r in rows.select(samples.label(F.col("x"))).collect()] == ["Positive"] + ["Negative"] * 4


def test_split(spark):
    bars = spark.createDataFrame([("A", day(i), 0.1) for i in range(35)] + [("B", day(0), 0.1)], "ticker string, date date, pct_change double")
    got = {(r.ticker, r.idx): r.split for r in samples.temporal_split(bars).collect()}
    assert [got["A", i] for i in range(35)] == ["train"] * 28 + ["test"] * 7 and got["B", 0] == "train"
    got = {r.idx: r.split for r in samples.temporal_split(bars, train_rows=14).where("ticker = 'A'").collect()}
    assert [got[i] for i in range(35)] == ["train"] * 14 + [None] * 14 + ["test"] * 7


def test_windows_exclude_the_day_itself(spark):
    days = spark.createDataFrame([("A", day(5), "Positive"), ("A", day(20), "Negative")], "ticker string, date date, target string")
    told = [("A", day(5), "same day"), ("A", day(4), "four "), ("A", day(0), "zero"), ("A", day(2), "no facts"), ("A", day(3), None), ("B", day(4), "other")]
    rows = samples.sample_windows(days, spark.createDataFrame(told, "ticker string, day date, summary string")).collect()
    assert [(r.end_date, r.summary, r.n_days) for r in rows] == [(day(5), "2022-01-01\nzero\n\n2022-01-05\nfour", 2)]


def test_order_does_not_depend_on_partitions(spark):
    posts = spark.createDataFrame([("A", day(0), i, f"t{i}") for i in range(50)], "ticker string, date date, line_no int, text string")
    want = [f"t{i}" for i in range(50)]
    for n in (1, 7):
        assert samples.posts_by_day(posts.repartition(n)).first().tweets == want
        assert samples.extractive_summaries(posts.repartition(n)).first().summary == "t0\nt1\nt2"


def test_merge_keeps_what_is_stored(spark):
    wanted = spark.createDataFrame([("A", day(0)), ("A", day(1))], "ticker string, day date")
    stored = spark.createDataFrame([("A", day(0), None)], "ticker string, day date, summary string")
    out = {r.day: (r.summary, r.is_new) for r in samples.merge_summaries(wanted, stored, F.lit(None).cast("string")).collect()}
    assert out == {day(0): (None, False), day(1): (None, True)}
    assert samples.merge_summaries(wanted, stored, F.lit(None).cast("string"), keep_empty=False).count() == 1


def test_days_are_folded_text_by_text_in_line_order(spark):
    import hashlib

    from marlstone.operators import samples

    texts = ["it's\n", 'a "b"', None, "é\\", "", "z" * 5_000]
    rows = [("A", "2022-01-01", i, t) for i, t in enumerate(texts)] + [("B", "2022-01-01", 0, None)]
    posts = spark.createDataFrame(rows[::-1], "ticker string, date string, line_no int, text string").withColumn("date", F.to_date("date")).repartition(3)
    got = lambda fold, schema: {r.ticker: tuple(r)[2:] for r in samples.fold_days(posts, fold, schema).collect()}
    md5 = lambda t: hashlib.md5(t.encode()).hexdigest()
    some = [t for t in texts if t is not None]
    assert got(samples.list_digest, "m string") == {"A": (md5(repr(texts)),), "B": (md5("[None]"),)}
    assert got(samples.joined_digest, "m string, n long") == {"A": (md5("\n".join(some)), len("\n".join(some))), "B": (None, None)}
    assert got(samples.array_digest, "n long, chars long, m string") == {"A": (6, sum(map(len, some)), md5(texts[0])), "B": (1, None, None)}
    held = []
    samples.list_digest(held.append(len(held)) or t for t in ["x"] * 9)
    assert len(held) == 9  # texts are asked for one by one, never as a list


def test_a_days_list_is_never_one_row(spark, sf):
    from marlstone.plans.layouts import QUERIES

    plan = QUERIES["python_list_prompts"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan and "listagg" not in plan


def test_days_of_posts_are_never_one_row_and_travel_compressed(spark, sf):
    from marlstone.plans.queries import QUERIES

    for name in ("daily_posts_array", "daily_posts_concat"):
        plan = QUERIES[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
        assert "collect_list" not in plan and "listagg" not in plan and "MapInArrow" in plan, name


def test_summaries_for_the_store_are_made_once(spark, sf, monkeypatch):
    from marlstone.plans.queries import QUERIES

    seen, make = spark.sparkContext.accumulator(0), samples.extractive_summaries

    def counting(posts):
        def pass_on(batches):
            for b in batches:
                seen.add(b.num_rows)
                yield b

        return make(posts.mapInArrow(pass_on, posts.schema))

    monkeypatch.setattr(samples, "extractive_summaries", counting)
    QUERIES["summary_store_roundtrip"](spark, sf).collect()
    assert seen.value == spark.read.parquet(f"{sf}/events.parquet").count()


def test_a_text_that_a_day_repeats_travels_once_to_its_prompt(spark, sf):
    from marlstone.functions.text import unpack
    from marlstone.plans.queries import QUERIES

    texts = ["b", None, "é\n", "b", "", "a", "b", None, "é\n"]
    rows = [("A", day(0), 9 - i, t) for i, t in enumerate(texts)] + [("A", day(1), 0, "b"), ("B", day(0), 0, None), ("C", day(0), 5, ""), ("C", day(0), None, "z")]
    posts = spark.createDataFrame(rows, "ticker string, date date, line_no int, text string")
    once = samples.distinct_texts(posts.coalesce(1)).collect()
    assert {(r.ticker, r.day, unpack(r.text)): sorted(r.lines)[:3] for r in once if r.ticker == "A"} == {
        ("A", day(0), "b"): [3, 6, 9], ("A", day(0), None): [2, 8], ("A", day(0), "é\n"): [1, 7], ("A", day(0), ""): [5], ("A", day(0), "a"): [4], ("A", day(1), "b"): [0],
    }
    assert len(once) == 9
    want = {("A", day(0)): "\n".join(t for t in texts[::-1] if t is not None), ("A", day(1)): "b", ("B", day(0)): None, ("C", day(0)): "z\n"}
    for n in (1, 5):
        assert {(r.ticker, r.day): r.text for r in samples.joined_days(posts.repartition(n)).collect()} == want
    assert samples.distinct_texts(posts.coalesce(1), held_bytes=0).count() >= 9
    told = {(r.ticker, r.day): r.prompt for r in samples.model_summaries(posts, lambda p: p, template="{ticker}:{tweets}{examples}", examples="").collect()}
    assert told == {k: v and f"{k[0]}:{v}" for k, v in want.items()}
    plan = QUERIES["daily_summary_prompts"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan and "listagg" not in plan and "MapInArrow" in plan
