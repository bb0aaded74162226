import json

from pyspark.sql import functions as F

from marlstone import cli, sinks
from marlstone.operators import samples
from marlstone.operators.metrics import binary_metrics
from marlstone.sources import files
from marlstone.streaming import posts as streaming


def write(tmp_path):
    price, posts = tmp_path / "price", tmp_path / "tweet"
    price.mkdir()
    days = [f"2022-01-{d:02d}" for d in range(30, 0, -1)]  # newest first
    for t in ("AA", "BB"):
        (price / f"{t}.txt").write_text("".join(f"{d}\t{(-1) ** i * 0.5}\t1\t2\t3\t4\t9.0\n" for i, d in enumerate(days)))
        (posts / t).mkdir(parents=True)
        for d in days[::2]:
            lines = [{"id": f"{d}-{i}", "author_id": "1", "created_at": f"{d}T10:00:00.000Z", "text": f"{t} {d}\npost {i}"} for i in range(5)]
            (posts / t / d).write_text("\n".join(map(json.dumps, lines)) + "\n")
    return str(price), str(posts)


def test_readers_and_samples(spark, tmp_path):
    price, posts = write(tmp_path)
    rows = files.read_prices(spark, price)
    assert rows.count() == 60 and [r.ticker for r in files.tickers(spark, price).collect()] == ["AA", "BB"]
    first = rows.where("ticker = 'AA' AND date = '2022-01-30'").first()
    assert (first.pct_change, first.volume) == (0.5, 9.0)
    told = files.read_posts(spark, posts)
    assert told.count() == 2 * 15 * 5 and told.where(F.col("text").contains("\n")).count() == 150
    assert [r.line_no for r in told.where("ticker = 'AA' AND date = '2022-01-30'").orderBy("line_no").collect()] == list(range(5))
    out = cli.build_samples(spark, price, posts)
    one = out.where("ticker = 'AA' AND end_date = '2022-01-30'").first()
    assert one.summary.startswith("2022-01-26\nAA 2022-01-26\npost 0\nAA 2022-01-26\npost 1") and "2022-01-30" not in one.summary and one.split == "test"
    assert cli.build_samples(spark, price, posts, train_rows=14).where("split IS NULL").count() > 0


def test_days_without_posts_give_empty_metrics(spark, tmp_path):
    price, _ = write(tmp_path)
    none = spark.createDataFrame([], "ticker string, day date, summary string")
    days = samples.labelled(files.read_prices(spark, price))
    out = samples.sample_windows(days, none)
    m = binary_metrics(out.withColumn("prediction", F.lit("Positive")), "prediction", "target").first()
    assert (m.total, m.accuracy, m.mcc) == (0, 0.0, 0.0)


def test_summary_store(spark, tmp_path):
    rows = spark.createDataFrame([("A", "2022-01-01", ["x"], "p", "s", "m", "k"), ("A", "2022-01-02", [], "p", None, "m", "k")], "ticker string, date string, tweet_data array<string>, prompt string, summary string, model string, method string")
    sinks.write_summaries(rows, f"{tmp_path}/store")
    (tmp_path / "store" / "model=m" / "method=k" / "ticker=A" / "bad.json").write_text('{broken\n{"date": "no date", "summary": "x"}\n')
    got = files.read_summaries(spark, f"{tmp_path}/store").orderBy("date").collect()
    assert [(r.ticker, str(r.date), r.tweet_data, r.prompt, r.summary, r.model, r.method) for r in got] == [
        ("A", "2022-01-01", ["x"], "p", "s", "m", "k"),
        ("A", "2022-01-02", [], "p", None, "m", "k"),
    ]
    sinks.write_summaries(rows.where("date = '2022-01-02'").withColumn("summary", F.lit("late")), f"{tmp_path}/store")
    known = files.read_summaries(spark, f"{tmp_path}/store").select("ticker", F.col("date").alias("day"), "summary")
    wanted = spark.sql("SELECT 'A' AS ticker, explode(sequence(date'2022-01-01', date'2022-01-03')) AS day")
    merged = {r.day.day: (r.summary, r.is_new) for r in samples.merge_summaries(wanted, known, F.lit("made")).collect()}
    assert merged == {1: ("s", False), 2: ("late", False), 3: ("made", True)}
    assert files.dataset_paths("CMIN", "/b/") == ("/b/CMIN/price/preprocessed", "/b/CMIN/tweet/raw")


def test_pairs_of_arrays_and_resume_point(spark, tmp_path):
    pair = {"user_input": "u", "completion_a": "a", "completion_b": "b\n"}
    (tmp_path / "array.json").write_text(json.dumps([pair, pair], indent=1))
    assert [r.asDict() for r in files.read_preferences(spark, f"{tmp_path}/array.json", array=True).collect()] == [pair, pair]
    for n in (2, 10, 9):
        (tmp_path / "run" / f"checkpoint-{n}").mkdir(parents=True)
        (tmp_path / "run" / f"checkpoint-{n}" / "trainer_state.json").write_text(json.dumps({"global_step": n, "max_steps": 20}, indent=1))
    assert files.resume_point(spark, f"{tmp_path}/run").collect() == [("checkpoint-10", 10, 20)]
    (tmp_path / "none").mkdir()
    assert files.resume_point(spark, f"{tmp_path}/none").count() == 0


def test_metrics_json(spark, tmp_path):
    m = binary_metrics(spark.createDataFrame([("Positive", "Positive"), ("Negative", "Positive")], "prediction string, label string"))
    sinks.write_metrics(m, str(tmp_path), "org/model", "set")
    got = spark.read.json(f"{tmp_path}/org/model").first()
    assert got.confusion_matrix.matrix == [[0, 0], [1, 1]] and got.accuracy == 0.5 and got.dataset_name == "set"


def test_streaming_windows(spark, tmp_path):
    rows = [(t, f"2022-01-{d:02d} 12:00:00") for t in "ab" for d in range(1, 11) for _ in range(d)]
    df = spark.createDataFrame(rows, "ticker string, at string").select("ticker", F.col("at").cast("timestamp").alias("created_at"))
    df.repartition(3).write.parquet(f"{tmp_path}/in")
    stream = streaming.read_stream(spark, f"{tmp_path}/in", df.schema)
    streaming.start(streaming.daily_counts(stream), f"{tmp_path}/out", f"{tmp_path}/marks").awaitTermination()
    got = {(r.ticker, r.day.day): r.n for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got == {(t, d): d for t in "ab" for d in range(1, 9)}  # the last days are not past the watermark


def test_command_line(spark, tmp_path):
    price, posts = write(tmp_path)
    for task in ("samples", "train", "evaluate", "forecast"):
        cli.main([task, "--price_dir", price, "--tweet_dir", posts, "--save_dir", f"{tmp_path}/{task}", *(["--store", f"{tmp_path}/kept"] if task in ("train", "forecast") else [])])
    assert spark.read.csv(f"{tmp_path}/samples/samples", header=True, multiLine=True, escape='"').count() > 20
    assert spark.read.json(f"{tmp_path}/train/sft").columns == ["input", "instruction", "output"]
    assert (tmp_path / "samples" / "marlstone.log").exists()
    told = spark.read.json(f"{tmp_path}/forecast/lexicon").first()
    assert told.total_samples == 12
    got = spark.read.json(f"{tmp_path}/evaluate/lexicon").first()
    assert got.total_samples == spark.read.csv(f"{tmp_path}/evaluate/answers", header=True, multiLine=True, escape='"').count() == 12


def test_command_line_of_the_graph(spark, tmp_path):
    (tmp_path / "entity2id.txt").write_text("Acme\t1\tCOMP\t0\nBolt Stock\t2\tCOMP\t0\n")
    (tmp_path / "relation2id.txt").write_text("owns\t0\n")
    (tmp_path / "time2id.txt").write_text("id,week\n1,2020-01-05\n")
    for x in ("train", "valid", "test"):
        (tmp_path / f"{x}.txt").write_text("1\t0\t2\t1\tx\n")
    (tmp_path / "map.csv").write_text("ticker,entity\nA,Acme\nB,Bolt Stock\n")
    cli.main(["graph", "--root", str(tmp_path), "--mapping", f"{tmp_path}/map.csv", "--save_dir", f"{tmp_path}/out"])
    cli.main(["profile", "--root", str(tmp_path), "--save_dir", f"{tmp_path}/out"])
    assert spark.read.csv(f"{tmp_path}/out/relationships", header=True).count() == 3
    assert spark.read.csv(f"{tmp_path}/out/stats", header=True).first().n_entities == "2"
    assert spark.read.csv(f"{tmp_path}/out/keywords", header=True).count() == 1


def test_the_last_write_counts_and_compaction_changes_nothing(spark, tmp_path):
    from marlstone import sinks

    spark.conf.get("spark.checkpoint.dir")
    row = lambda day, summary, ticker="AA": (ticker, day, ["x"], "p", summary, "m", "n")
    schema = "ticker string, date string, tweet_data array<string>, prompt string, summary string, model string, method string"
    write = lambda rows, seq: sinks.write_summaries(spark.createDataFrame(rows, schema), f"{tmp_path}/s", sequence=seq)
    write([row("2022-01-01", "zzz"), row("2022-01-02", "b"), row("2022-01-01", "only", "BB")], 2)
    write([row("2022-01-01", "aaa"), row("2022-01-02", None)], 5)  # later, though its text is less
    write([row("2022-01-01", "old"), row("2022-01-03", None)], 1)
    want = [("AA", "2022-01-01", "aaa"), ("AA", "2022-01-02", "b"), ("AA", "2022-01-03", None), ("BB", "2022-01-01", "only")]
    got = lambda: sorted((r.ticker, str(r.date), r.summary) for r in files.read_summaries(spark, f"{tmp_path}/s").collect())
    assert got() == want
    untouched = sorted(p.name for p in tmp_path.rglob("ticker=BB/part-*"))
    assert sinks.compact_summaries(spark, f"{tmp_path}/s") == 1 and got() == want
    assert files.read_raw_summaries(spark, f"{tmp_path}/s").count() == 4 and sorted(p.name for p in tmp_path.rglob("ticker=BB/part-*")) == untouched
    assert sinks.compact_summaries(spark, f"{tmp_path}/s") == 0


def test_last_entity_in_the_order_of_files(spark, tmp_path):
    """Spark packs large files first; what counts is the order of names."""
    (tmp_path / "a.txt").write_text("X\t1\tCOMP\t0\n")
    (tmp_path / "b.txt").write_text("X\t2\tCOMP\t0\n" + "".join(f"Y{i}\t{i}\tCOMP\t0\n" for i in range(5_000)))
    (tmp_path / "c.txt").write_text("X\t3\tPERSON\t1\n")
    rows = files.read_entities(spark, str(tmp_path))
    assert [(r.id, r.type_name) for r in rows.where("entity = 'X'").collect()] == [("3", "PERSON")] and rows.count() == 5_001


def test_layouts_of_other_programs(spark, tmp_path):
    import pytest

    from marlstone import sinks

    bars = spark.createDataFrame([("A/B", "2022-01-02", 0.5), ("A/B", "2022-01-01", None), ("C+ D", "2022-01-01", 1.0)], "ticker string, date string, pct_change double").withColumn("date", F.to_date("date"))
    assert sinks.write_price_files(bars.where("ticker = 'C+ D'"), f"{tmp_path}/p") == 1
    assert [p.name for p in (tmp_path / "p").glob("*.txt")] == ["C+ D.txt"] and (tmp_path / "p" / "C+ D.txt").read_text().startswith("2022-01-01\t1.0\t0")
    assert [r.ticker for r in files.read_prices(spark, f"{tmp_path}/p", only_txt=True).collect()] == ["C+ D"] == [r.ticker for r in files.tickers(spark, f"{tmp_path}/p").collect()]
    posts = spark.createDataFrame([("C+ D", "2022-01-01", i, str(i), "u", f"text {i}\n\"x\"") for i in range(9)], "ticker string, date string, line_no int, id string, author_id string, text string")
    posts = posts.withColumn("date", F.to_date("date")).withColumn("created_at", F.to_timestamp(F.lit("2022-01-01 10:00:00")))
    assert sinks.write_post_files(posts.repartition(4), f"{tmp_path}/t") == 1
    read = files.read_posts(spark, f"{tmp_path}/t").orderBy("line_no").collect()
    assert [(r.ticker, r.line_no, r.text) for r in read] == [("C+ D", i, f'text {i}\n"x"') for i in range(9)]
    bars.select("ticker", F.lit("v").alias("value")).repartition(3).write.partitionBy("ticker").text(f"{tmp_path}/q")
    with pytest.raises(ValueError, match="two files"):
        sinks.name_files(spark, f"{tmp_path}/q", lambda k: "one.txt")


def test_posts_are_read_by_lines_and_numbered_over_the_blocks_of_a_file(spark, tmp_path):
    (tmp_path / "AA").mkdir()
    post = lambda i: f'{{"id": "{i}", "created_at": "2022-01-01T10:00:00.000Z", "text": "{"word " * (i % 50)}"}}'
    lines = [post(i) if i % 7 else "" for i in range(2_000)]
    ends = ["\n", "\r\n", "\r"]
    (tmp_path / "AA" / "2022-01-01").write_bytes("".join(x + ends[i // 700] for i, x in enumerate(lines)).encode())
    (tmp_path / "AA" / "2022-01-02").write_bytes((post(5) + "\n" + post(6)).encode())
    kept = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20k")
    try:
        read = files.read_posts(spark, str(tmp_path))
        assert read.rdd.getNumPartitions() > 5  # one day's file is no single row
        got = sorted((str(r.date), r.line_no, int(r.id)) for r in read.collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", kept)
    assert got == [("2022-01-01", i, i) for i in range(2_000) if i % 7] + [("2022-01-02", 0, 5), ("2022-01-02", 1, 6)]


def test_a_day_is_written_line_by_line_in_order(spark, tmp_path):
    from marlstone import sinks

    posts = spark.range(3_000).select(F.lit("A").alias("ticker"), F.to_date(F.lit("2022-01-01")).alias("date"), (2_999 - F.col("id")).alias("line_no"), "id", F.lit("u").alias("author_id"), F.to_timestamp(F.lit("2022-01-01 10:00:00")).alias("created_at"), F.concat(F.lit("text\n"), "id").alias("text"))
    sinks.write_post_folders(posts.repartition(4), f"{tmp_path}/f", compression="gzip")
    assert sinks.write_post_files(posts.repartition(4), f"{tmp_path}/n", compression="gzip") == 1 and (tmp_path / "n" / "A" / "2022-01-01.gz").exists()
    for folder in ("f", "n"):
        read = files.read_posts(spark, f"{tmp_path}/{folder}").collect()
        assert sorted((r.line_no, int(r.id), r.text, r.ticker, str(r.date)) for r in read) == [(i, 2_999 - i, f"text\n{2_999 - i}", "A", "2022-01-01") for i in range(3_000)]


def _shuffled(spark, run) -> int:
    """Bytes that ``run`` shuffles."""
    store, none = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._gateway.new_array(spark._jvm.double, 0)

    def total():
        stages = store.stageList(None, False, False, none, None)
        return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))

    before = total()
    run()
    return total() - before


def _long_posts(spark, n: int = 3_000):
    text = F.concat_ws(" ", *(F.sha2(F.concat("id", F.lit(f"-{i}")).cast("binary"), 256) for i in range(8)))
    ticker = F.when(F.col("id") % 3 == 0, "C+ D/%41").when(F.col("id") % 3 == 1, "007")
    posts = spark.range(n).select(ticker.alias("ticker"), F.to_date(F.lit("2022-01-01")).alias("date"), (n - 1 - F.col("id")).alias("line_no"), "id", F.lit("u").alias("author_id"), F.to_timestamp(F.lit("2022-01-01 10:00:00")).alias("created_at"), text.alias("text"))
    return posts.repartition(4).checkpoint()


def test_post_folders_are_written_and_read_without_a_shuffle_of_texts(spark, tmp_path):
    from marlstone import sinks

    posts, conf = _long_posts(spark), "spark.sql.maxConcurrentOutputFileWriters"
    kept = spark.conf.get(conf)
    assert _shuffled(spark, lambda: sinks.write_post_folders(posts, f"{tmp_path}/f", compression="gzip")) == 0
    assert spark.conf.get(conf) == kept
    assert len(list((tmp_path / "f" / "ticker=007" / "date=2022-01-01").glob("part-*.gz"))) == 4
    read = files.read_post_folders(spark, f"{tmp_path}/f").select("ticker", "date", "line_no", F.col("id").cast("long").alias("id"), "text")
    want = posts.select("ticker", "date", "line_no", "id", "text")
    assert read.count() == 3_000 and read.exceptAll(want).isEmpty()
    with sinks._open_files(spark, 1):  # more folders than open files
        posts.select("ticker", "date", F.lit("{}").alias("value")).write.partitionBy("ticker", "date").text(f"{tmp_path}/s")
    assert spark.read.text(f"{tmp_path}/s").count() == 3_000
    sinks.write_post_folders(posts.limit(0), f"{tmp_path}/none")
    assert files.read_post_folders(spark, f"{tmp_path}/none").count() == 0


def test_a_day_travels_tight_and_is_read_from_the_blocks_of_a_bzip2_file(spark, sf, tmp_path):
    from marlstone import sinks
    from marlstone.functions.text import loosen, pack, tight, tighten
    from marlstone.sources import testdata as data

    for x in (None, "", "a", "é" * 500, "word " * 5_000, "퟿\x00\n"):
        assert loosen(tighten(x)) == x
    texts = [r.text for r in data.table(spark, sf, "documents").select("text").collect() if r.text]
    assert sum(len(tighten(x)) for x in texts) < 0.95 * sum(len(pack(x)) for x in texts)
    small, plain = data.posts(spark, sf, small=True), data.posts(spark, sf)
    assert sinks.write_post_files(small, f"{tmp_path}/s", compression="bzip2") == sinks.write_post_files(plain, f"{tmp_path}/p", compression="gzip")
    cols = ["ticker", "date", "line_no", "id", "author_id", "created_at", "text"]
    read = lambda name: files.read_posts(spark, f"{tmp_path}/{name}").select(*cols)
    assert read("s").count() == plain.count() and read("s").exceptAll(read("p")).isEmpty()
    posts = _long_posts(spark, 9_000).withColumn("ticker", F.substring(F.concat_ws("", F.lit("A"), "ticker"), 1, 1)).withColumn("text", F.when(F.col("id") % 9 > 0, F.col("text")))
    sinks.write_post_files(posts.withColumn("text", tight(F.col("text"))), f"{tmp_path}/b", compression="bzip2")
    kept = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200k")
    try:
        scan = files.scan_posts(spark, f"{tmp_path}/b")
        assert scan.select("place._block").distinct().count() > 3
        want = [(8_999 - r.line_no, r.text) for r in posts.orderBy("line_no").collect()]
        assert [(int(r.id), r.text) for r in scan.orderBy("place").collect()] == want
        got = files.read_posts(spark, f"{tmp_path}/b").orderBy("line_no").collect()
        assert [(int(r.id), r.text) for r in got] == want and [r.line_no for r in got] == list(range(9_000))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", kept)
