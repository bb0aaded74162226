"""Queries over files in the layouts that other programs use, over models behind adapters, and over what is streamed; with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import providers, sinks
from ..functions import prompts
from ..operators import datasets, forecast, graph, samples
from ..sources import files
from ..sources import testdata as data
from ..store import Store
from ..streaming import posts as streaming
from .oracles import ORACLES as BASE
from .oracles import _filled, _sql
from .queries import QUERIES as BASE_QUERIES
from .queries import _md5
from .shared import checkpoint_folder, shared_folder

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return add


def _price_folder(spark, sf) -> str:
    """Prices in the folder that the registry names."""
    files.register("by-ticker", "by-ticker/prices", "by-ticker/posts")
    path, _ = files.dataset_paths("by-ticker", shared_folder(spark, "datasets"))
    sinks.write_price_files(data.bars(spark, sf).withColumn("volume", F.col("cents")), path)
    return path


@query(BASE["price_files"])
def price_txt_files(spark, sf):
    """Prices from a folder with a file ``<ticker>.txt`` each."""
    rows = files.read_prices(spark, _price_folder(spark, sf), only_txt=True)
    return rows.select("ticker", "date", F.round("pct_change", 9).alias("pct_change"), F.col("volume").cast("long").alias("volume"))


@query(_sql("SELECT DISTINCT ticker FROM bars", "bars"))
def ticker_listing(spark, sf):
    return files.tickers(spark, _price_folder(spark, sf))


@query(BASE["post_files"])
def post_day_files(spark, sf):
    """Posts from files ``<ticker>/<day>`` of JSON lines, numbered from 0 in a file's order; only a text's digest goes to the numbering."""
    path = shared_folder(spark, "post-days")
    sinks.write_post_files(data.posts(spark, sf, small=True), path, compression="bzip2")
    told = files.scan_posts(spark, path).select("ticker", "date", "place", F.col("id").cast("long").alias("id"), _md5(F.col("text")).alias("text_md5"))
    line = F.row_number().over(Window.partitionBy("ticker", "date").orderBy("place")) - 1
    return told.select("ticker", "date", line.cast("long").alias("line_no"), "id", "text_md5")


@query(BASE["sample_windows"])
def samples_csv(spark, sf):
    """Samples written as CSV, whose texts hold line ends, and read back."""
    rows = samples.sample_windows(samples.labelled(data.bars(spark, sf)).select("ticker", "date", "target"), samples.extractive_summaries(data.posts(spark, sf)))
    path = shared_folder(spark, "samples")
    sinks.write_samples_csv(rows, path)
    read = spark.read.schema("ticker string, end_date date, summary string, target string, n_days long").csv(path, header=True, multiLine=True, escape='"')
    return read.select("ticker", "end_date", "target", "n_days", _md5(F.col("summary")).alias("summary_md5"), F.length("summary").cast("long").alias("summary_chars"))


@query(BASE["kg_relationships"])
def relationship_csv(spark, sf):
    rows = BASE_QUERIES["kg_relationships"](spark, sf)
    path = shared_folder(spark, "relationships")
    sinks.write_relationships(rows, path)
    return spark.read.schema(rows.schema).csv(path, header=True, multiLine=True, escape='"')


@query(
    _sql(
        """SELECT count(*) AS n_quads, count(DISTINCT relation) AS n_relations, (SELECT count(*) FROM (SELECT subject FROM t UNION SELECT object FROM t)) AS n_entities FROM t""",
        "entities", "relations", "quads",
        more="""t AS (SELECT coalesce(s.entity, q.subj_id) AS subject, coalesce(r.relation, q.rel_id) AS relation, coalesce(o.entity, q.obj_id) AS object
          FROM quads q LEFT JOIN entities s ON s.id = q.subj_id LEFT JOIN entities o ON o.id = q.obj_id LEFT JOIN relations r ON r.id = q.rel_id WHERE q.source_file = 'F')""",
    )
)
def kg_train_profile(spark, sf):
    """The profile of the training quads alone, from files; quads of unknown weeks stay."""
    path = shared_folder(spark, "train-graph")
    lines = lambda rows, *cols: rows.select(F.concat_ws("\t", *cols).alias("value"))
    lines(data.kg_entities(spark, sf), "entity", "id", "type_name", F.lit("0")).write.text(f"{path}/entities")
    lines(data.kg_relations(spark), "relation", "id").write.text(f"{path}/relations")
    quads = data.kg_quads(spark, sf).where("source_file = 'F'")
    lines(quads, "subj_id", "rel_id", "obj_id", F.date_format("date_wk", "yyMMdd"), F.lit("0")).write.text(f"{path}/train")
    quads.select(F.date_format("date_wk", "yyMMdd").alias("id"), F.date_format("date_wk", "yyyy-MM-dd").alias("week")).where(F.month("date_wk") > 1).distinct().write.csv(f"{path}/times", header=True)
    times = files.read_times(spark, f"{path}/times").select("time_id", F.to_date("date_wk").alias("date_wk"))
    read = files.read_quads(spark, [f"{path}/train"]).join(times, "time_id", "left")
    entities = graph.first_names(files.read_entities(spark, f"{path}/entities"))
    return graph.dataset_stats(graph.decode(read, entities, files.read_relations(spark, f"{path}/relations")))


@query("SELECT 'checkpoint-' || max(n_nationkey) * 50 AS checkpoint, CAST(max(n_nationkey) * 50 AS BIGINT) AS step, CAST(2000 AS BIGINT) AS max_steps FROM nation")
def resume_state(spark, sf):
    """Where a training run goes on: the newest of its ``checkpoint-N`` folders."""
    step = F.col("n_nationkey").cast("long") * 50
    path = shared_folder(spark, "trainer")
    state = F.to_json(F.struct(step.alias("global_step"), F.lit(2000).alias("max_steps"))).alias("value")
    data.table(spark, sf, "nation").select(step.alias("step"), state).repartition("step").write.partitionBy("step").text(path)
    sinks.name_files(spark, path, lambda k: f"checkpoint-{k['step']}/trainer_state.json")
    return files.resume_point(spark, path)


@query("SELECT doc_id, lang FROM documents")
def shuffled_rows(spark, sf):
    return datasets.shuffled(data.table(spark, sf, "documents").select("doc_id", "lang"), "doc_id", 7)


def _load_scorer():
    return lambda texts: [len(t) % 97 / 97 for t in texts]


@query("""SELECT doc_id, round(coalesce(length("text"), 0) % 97 / 97.0::DOUBLE, 9) AS score FROM documents""")
def scored_texts(spark, sf):
    """A reward model behind its adapter, with a model that counts characters."""
    return data.table(spark, sf, "documents").select("doc_id", F.round(providers.scorer(_load_scorer)(F.col("text")), 9).alias("score"))


def _load_tokenizer():
    return lambda t: [len(w) for w in t.split(" ") if w]


@query(
    """SELECT doc_id, CAST(len(ids) AS BIGINT) AS n, CAST(coalesce(list_sum(ids), 0) AS BIGINT) AS total FROM (
      SELECT doc_id, list_transform(list_filter(string_split(coalesce("text", ''), ' '), lambda w: w <> ''), lambda w: length(w)) AS ids FROM documents)"""
)
def tokenized_texts(spark, sf):
    """A tokenizer behind its adapter, with one that gives words' lengths."""
    ids = providers.tokenizer(_load_tokenizer)(F.col("text"))
    rows = data.table(spark, sf, "documents").select("doc_id", ids.alias("ids"))
    return rows.select("doc_id", F.size("ids").cast("long").alias("n"), F.aggregate("ids", F.lit(0).cast("long"), lambda a, x: a + x).alias("total"))


def _load_model():
    calls = []

    def model(texts):
        calls.append(1)
        if len(calls) == 1:
            raise TimeoutError("the first call fails")
        return [f"{len(t)} characters" for t in texts]

    return model


def _load_chat():
    return lambda chats: [f"{len(c)} turns, {len(c[-1]['content'])} characters" for c in chats]


@query(
    _sql(
        f"""SELECT conv_id, turn, length(question) || ' characters' AS answer,
      '2 turns, ' || length(question) || ' characters' AS chat_answer FROM qa""",
        "qa",
    )
)
def model_answers(spark, sf):
    """Models behind their adapters, for texts (with a call that fails and is repeated) and for messages."""
    ask = providers.batched(_load_model, pause=0.01)
    talk = providers.chat(_load_chat)
    rows = data.qa_pairs(spark, sf)
    return rows.select("conv_id", "turn", ask(F.col("question")).alias("answer"), talk(prompts.messages(F.lit("be brief"), F.col("question"))).alias("chat_answer"))


@query(
    _sql(
        f"""SELECT conv_id, turn, md5(CASE WHEN turn % 4 = 1 THEN {_filled(prompts.INSTRUCT, instruction="question")} ELSE {_filled(prompts.INSTRUCT_INPUT, instruction="question", input="answer")} END || 'done') AS prompt_md5 FROM qa""",
        "qa",
    )
)
def instruct_with_input(spark, sf):
    rows = data.qa_pairs(spark, sf)
    given = F.when(F.col("turn") % 4 == 1, F.lit(None).cast("string")).otherwise(F.col("answer"))
    return rows.select("conv_id", "turn", _md5(prompts.instruct(F.col("question"), given, F.lit("done"))).alias("prompt_md5"))


@query("""SELECT doc_id, 'Unknown' AS prediction FROM documents WHERE doc_id % 5 <> 0 AND trim("text") <> ''""")
def empty_samples_skipped(spark, sf):
    """Samples without a summary are not asked about; the others' answer, which says nothing, is unknown."""
    summary = F.when(F.col("doc_id") % 5 == 0, "  ").otherwise(F.col("text"))
    rows = data.table(spark, sf, "documents").select("doc_id", F.col("lang").alias("ticker"), summary.alias("summary"))
    told = forecast.profiles(rows, providers.sketch)
    return forecast.forecasts(rows, told, lambda messages: F.lit("no idea")).select("doc_id", "prediction")


def _quoted(c: str) -> str:
    body = f"replace(replace(replace(replace({c}, chr(92), chr(92) || chr(92)), chr(10), chr(92) || 'n'), chr(13), chr(92) || 'r'), chr(9), chr(92) || 't')"
    return f"""CASE WHEN contains({c}, chr(39)) AND NOT contains({c}, chr(34)) THEN chr(34) || {body} || chr(34) ELSE chr(39) || replace({body}, chr(39), chr(92) || chr(39)) || chr(39) END"""


@query(
    _sql(f"""SELECT ticker, date AS day, md5('[' || string_agg({_quoted('"text"')}, ', ' ORDER BY line_no) || ']') AS list_md5 FROM posts GROUP BY ticker, date""", "posts")
)
def python_list_prompts(spark, sf):
    """A day's posts as Python writes a list of them, as the baseline's news prompt shows them."""
    return samples.fold_days(data.posts(spark, sf), samples.list_digest, "list_md5 string")


@query("SELECT event_type AS ticker, CAST(CAST(ts AS DATE) + CAST(k AS INTEGER) AS DATE) AS day, count(*) AS n FROM events, unnest([1, 2, 3, 4, 5]) u(k) GROUP BY ALL")
def stream_sliding_counts(spark, sf):
    """Posts of the five days before each day, as a stream."""
    source = data.table(spark, sf, "events")
    stream = streaming.read_stream(spark, f"{sf.rstrip('/')}/events.parque[t]", source.schema)
    counts = streaming.sliding_counts(stream.select(F.col("event_type").alias("ticker"), F.col("ts").cast("timestamp").alias("created_at")))
    out, marks = shared_folder(spark, "sliding"), shared_folder(spark, "marks")
    job = counts.writeStream.outputMode("complete").foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(out))
    job.option("checkpointLocation", marks).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out)


@query("SELECT event_id, event_type AS ticker, CAST(ts AS DATE) AS day, CAST(1 AS INTEGER) AS n_versions FROM events")
def stream_store(spark, sf):
    """Posts, each arriving twice, streamed into a table of the store; the last batch is replayed and changes nothing."""
    source = data.table(spark, sf, "events")
    stream = streaming.read_stream(spark, f"{sf.rstrip('/')}/events.parque[t]", source.schema).select("event_id", F.col("event_type").alias("ticker"), F.col("ts").cast("timestamp").alias("created_at"))
    twice = stream.withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2)))).drop("copy")
    store = Store(spark, shared_folder(spark, "stream-store"))
    checkpoint_folder(spark)
    make = lambda df: df.select("event_id", "ticker", F.to_date("created_at").alias("day"))
    streaming.into_store(streaming.without_repeats(twice, "event_id"), store, "posts", ["event_id"], shared_folder(spark, "marks"), make).awaitTermination()
    first = store.newest("posts", "event_id")
    streaming.add_batch(store, "posts", first.withColumn("ticker", F.lit("replayed")), 0, "event_id")
    rows = [v for v in store.versions("posts") if store.get("posts", v).head() is not None]
    return store.newest("posts", "event_id").select("event_id", "ticker", "day", F.lit(len(rows)).alias("n_versions"))
