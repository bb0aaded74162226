"""Queries over the training side: stores, resumable trials, cached answers, reward fits, rollouts, batches, adapters; with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import prompts, text
from ..functions.text import NEGATIVE, POSITIVE
from ..operators import adapters, agents, answers, batches, forecast, reward, rollouts, samples, similar
from ..providers import BAD, GOOD, lexicon, reflection
from ..sources import testdata as data
from ..store import Store
from .oracles import _HISTORY, _filled, _lit, _sql
from .queries import _days, _length_answer, _md5
from .shared import checkpoint_folder, if_small, shared_folder

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


_SAMPLES_SQL = _sql("SELECT sample_id, trial, prediction, len(notes) AS n_reflections, prediction = target AS correct FROM history", more=_HISTORY)


@query(
    """SELECT id, CAST(rank AS INTEGER) AS rank, other, round(score, 9) AS score FROM (
      SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, other) AS rank FROM (
        SELECT a.vec_id AS id, b.vec_id AS other, list_inner_product(a.v, b.v) / (sqrt(list_inner_product(a.v, a.v)) * sqrt(list_inner_product(b.v, b.v))) AS score
        FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings) a JOIN (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings) b ON a.vec_id <> b.vec_id))
    WHERE rank <= 3"""
)
def similar_companies_top3(spark, sf):
    """Each company's three most similar ones, vectors taken as companies."""
    checkpoint_folder(spark)
    return similar.cosine_top(data.table(spark, sf, "embeddings"), 3).withColumn("score", F.round("score", 9))


@query(_SAMPLES_SQL)
def resumed_trials(spark, sf):
    """Trials that were cut off after the second and are started again: the same history as without a break."""
    labels = if_small(data.table(spark, sf, "labels").select("doc_id", "quality"))  # texts then stay where they are
    rows = data.table(spark, sf, "documents").select("doc_id", "source", "text").join(labels, "doc_id")
    target = F.when(F.col("quality") == 1, POSITIVE).otherwise(NEGATIVE)
    rows = rows.select(F.col("doc_id").alias("sample_id"), F.col("source").alias("ticker"), F.col("text").alias("summary"), target.alias("target"))
    store = Store(spark, shared_folder(spark, "trials"))
    rows = store.put(rows, "samples")  # joined once for all runs
    agents.run_trials(rows, _length_answer, reflection, 1, store)
    never = lambda prompt: F.raise_error(F.concat(F.lit("asked again: "), prompt)).cast("string")
    agents.run_trials(rows, never, never, 1, store)  # what is complete is not asked for again
    out = agents.run_trials(rows, _length_answer, reflection, 2, store)
    return out.select("sample_id", "trial", "prediction", F.size("reflections").cast("long").alias("n_reflections"), agents.is_correct().alias("correct"))


def _kinds(words: tuple[str, ...]) -> str:
    return "(" + " + ".join(f"CAST(contains(lower(question), {_lit(w)}) AS INTEGER)" for w in words) + ")"


@query(
    _sql(
        f"""SELECT conv_id, turn, CASE WHEN {_kinds(GOOD)} > {_kinds(BAD)} OR ({_kinds(GOOD)} = {_kinds(BAD)} AND length(question) % 2 = 0)
          THEN 'Positive' ELSE 'Negative' END AS answer, CAST(0 AS BIGINT) AS asked_again FROM qa""",
        "qa",
    )
)
def cached_answers(spark, sf):
    """Questions asked twice: the second run finds all answers, and a provider that would answer otherwise isn't asked."""
    checkpoint_folder(spark)
    rows = data.qa_pairs(spark, sf).select("conv_id", "turn", "question")
    store = Store(spark, shared_folder(spark, "cache"))
    answers.ask(rows, "question", lexicon, store, "lexicon")
    left = answers.unanswered(rows, "question", store, "lexicon").count()
    again = answers.ask(rows, "question", lambda p: F.lit("another answer"), store, "lexicon")
    return again.select("conv_id", "turn", F.substring_index("answer", "\n", 1).alias("answer"), F.lit(left).cast("long").alias("asked_again"))


def _flipped(flag: Column) -> Column:
    return F.when(F.col("doc_id") % 3 == 0, 1 - flag).otherwise(flag)


@query("SELECT doc_id, CAST(CASE WHEN doc_id % 3 = 0 THEN 1 - quality ELSE quality END AS BIGINT) AS quality, CAST(toxic AS BIGINT) AS toxic, 3 AS n_versions FROM labels")
def store_compaction(spark, sf):
    """Two appends and a compaction; the newer row of a document counts, and a folder that the manifest doesn't name is not there."""
    rows = data.table(spark, sf, "labels").select("doc_id", F.col("quality").cast("long").alias("quality"), F.col("toxic").cast("long").alias("toxic"))
    store = Store(spark, shared_folder(spark, "labels"))
    store.put(rows, "labels")
    store.put(rows.where("doc_id % 3 = 0").withColumn("quality", _flipped(F.col("quality"))), "labels")
    rows.withColumn("toxic", F.lit(9)).write.parquet(f"{store.path}/labels/half-written")
    store.compact("labels", "doc_id")
    return store.every("labels").select("doc_id", "quality", "toxic", F.lit(len(store.versions("labels"))).alias("n_versions"))


_REWARD_STEPS, _REWARD_RATE = 25, 0.5


@query(
    f"""WITH RECURSIVE features AS (
      SELECT doc_id // 10 AS grp, doc_id, quality, length("text") / 2000.0::DOUBLE AS x0, (length("text") - length(replace("text", ' ', ''))) / greatest(length("text"), 1)::DOUBLE AS x1,
        (length("text") - length(replace("text", chr(10), ''))) / 20.0::DOUBLE AS x2 FROM labels JOIN documents USING (doc_id) WHERE "text" IS NOT NULL),
    good AS (SELECT grp, min(doc_id) AS doc_id FROM features WHERE quality = 1 GROUP BY grp), bad AS (SELECT grp, min(doc_id) AS doc_id FROM features WHERE quality = 0 GROUP BY grp),
    pairs AS (SELECT a.x0 - b.x0 AS d0, a.x1 - b.x1 AS d1, a.x2 - b.x2 AS d2 FROM good g JOIN bad h USING (grp) JOIN features a ON a.doc_id = g.doc_id JOIN features b ON b.doc_id = h.doc_id),
    fitted AS (SELECT 0 AS step, 0.0::DOUBLE AS w0, 0.0::DOUBLE AS w1, 0.0::DOUBLE AS w2
      UNION ALL SELECT step + 1, w0 + {_REWARD_RATE} * sum(d0 * p) / count(*), w1 + {_REWARD_RATE} * sum(d1 * p) / count(*), w2 + {_REWARD_RATE} * sum(d2 * p) / count(*)
      FROM (SELECT f.*, d0, d1, d2, 1 / (1 + exp(w0 * d0 + w1 * d1 + w2 * d2)) AS p FROM fitted f, pairs WHERE step < {_REWARD_STEPS}) GROUP BY step, w0, w1, w2)
    SELECT CAST(i AS INTEGER) AS coordinate, round(w, 6) AS weight FROM (SELECT unnest([0, 1, 2]) AS i, unnest([w0, w1, w2]) AS w FROM fitted WHERE step = {_REWARD_STEPS})"""
)
def reward_fit(spark, sf):
    """Weights after a fixed number of steps, half of them in a run that was cut off: of every ten documents the first good one against the first bad one."""
    size = F.length("text")
    without = lambda c: size - F.length(F.replace("text", F.lit(c), F.lit("")))
    x = F.array(size / 2000.0, without(" ") / F.greatest(size, F.lit(1)), without("\n") / 20.0)
    told = data.table(spark, sf, "documents").where(F.col("text").isNotNull()).select("doc_id", x.alias("x"))  # texts stay where they are
    docs = data.table(spark, sf, "labels").join(told, "doc_id")
    first = lambda q: F.min_by(F.when(F.col("quality") == q, F.col("x")), F.when(F.col("quality") == q, F.col("doc_id")))
    pairs = docs.groupBy(F.floor(F.col("doc_id") / 10)).agg(first(1).alias("chosen"), first(0).alias("rejected"))
    store = Store(spark, shared_folder(spark, "reward"))
    reward.fit(pairs, steps=_REWARD_STEPS // 2, rate=_REWARD_RATE, settled=0.0, store=store)
    reward.fit(pairs, steps=_REWARD_STEPS, rate=_REWARD_RATE, settled=0.0, store=store)
    return store.get(reward.WEIGHTS).select(F.col("at").alias("coordinate"), F.round("weight", 6).alias("weight"))


@query(
    """WITH t AS (SELECT conv_id, turn, row_number() OVER w AS i, count(*) OVER (PARTITION BY conv_id) AS n, -(length(b) % 7 + 1) / 10.0::DOUBLE AS logp,
        -(length(b) % 5 + 1) / 10.0::DOUBLE AS ref, (length(b) % 11) / 10.0::DOUBLE AS v FROM (SELECT *, coalesce("text", '') AS b FROM conversations) WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
    d AS (SELECT conv_id, i, 0.1 * (ref - logp) + CASE WHEN i = n THEN conv_id % 3 - 1 ELSE 0 END + coalesce(lead(v) OVER (PARTITION BY conv_id ORDER BY i), 0) - v AS delta FROM t),
    a AS (SELECT x.conv_id, x.i, sum(power(0.95, y.i - x.i) * y.delta) AS adv FROM d x JOIN d y ON y.conv_id = x.conv_id AND y.i >= x.i GROUP BY x.conv_id, x.i),
    m AS (SELECT avg(adv) AS mean, var_samp(adv) AS var FROM a)
    SELECT conv_id, CAST(i - 1 AS INTEGER) AS pos, round((adv - mean) / sqrt(var + 1e-8), 6) AS advantage FROM a, m"""
)
def rollout_advantages(spark, sf):
    """A conversation is a rollout, a turn a token: penalised rewards, advantages from the end, whitened over all."""
    b = F.coalesce("text", F.lit(""))
    size = F.length(b)
    turn = F.struct("turn", (-(size % 7 + 1) / 10.0).alias("logp"), (-(size % 5 + 1) / 10.0).alias("ref"), ((size % 11) / 10.0).alias("v"))
    rows = data.table(spark, sf, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("t"))
    each = lambda c: F.transform("t", lambda x: x[c])
    scored = rows.select("conv_id", each("v").alias("v"), rollouts.penalised_rewards(each("logp"), each("ref"), (F.col("conv_id") % 3 - 1).cast("double")).alias("r"))
    checkpoint_folder(spark)
    done = rollouts.whitened(scored.withColumn("a", rollouts.advantages(F.col("r"), F.col("v"))).select("conv_id", "a").checkpoint(), "a")
    return done.select("conv_id", F.posexplode("a").alias("pos", "advantage")).withColumn("advantage", F.round("advantage", 6))


_BUDGET = 20_000


@query(
    f"""WITH s AS (SELECT doc_id, coalesce(length("text"), 0) AS chars FROM documents),
    p AS (SELECT *, CASE WHEN chars <= {_BUDGET} THEN least({_BUDGET}, CAST(1 AS BIGINT) << length(bin(greatest(chars, 8) - 1))) END AS padded FROM s),
    n AS (SELECT *, row_number() OVER (PARTITION BY padded ORDER BY chars, doc_id) - 1 AS i FROM p),
    c AS (SELECT padded, coalesce(sum(CAST(ceil(count(*) / floor({_BUDGET} / padded)) AS BIGINT)) OVER (ORDER BY padded ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS first
      FROM p WHERE padded IS NOT NULL GROUP BY padded)
    SELECT doc_id, coalesce(padded, -1) AS padded, CAST(coalesce(first + i // CAST(floor({_BUDGET} / padded) AS BIGINT), -1) AS BIGINT) AS batch_id,
      CAST(coalesce(CASE WHEN padded IS NOT NULL THEN i % CAST(floor({_BUDGET} / padded) AS BIGINT) END, -1) AS BIGINT) AS place
    FROM n LEFT JOIN c USING (padded)"""
)
def batch_plan(spark, sf):
    """Documents in batches of 20,000 characters, padding included; those longer than that have no batch (-1)."""
    checkpoint_folder(spark)
    rows = data.table(spark, sf, "documents").select("doc_id", F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("chars"))
    return batches.batch_plan(rows, "chars", "doc_id", _BUDGET).select("doc_id", *(F.coalesce(c, F.lit(-1)).cast("long").alias(c) for c in ("padded", "batch_id", "place")))


@query(
    """WITH w AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), a AS (SELECT vec_id AS k, v FROM w WHERE vec_id < 4),
    cells AS (SELECT vec_id, v, unnest(generate_series(1, len(v))) AS j FROM w),
    merged AS (SELECT vec_id, j, max(c.v[j]) + CASE WHEN vec_id % 3 <> 0 THEN 0.5 * sum(c.v[k + 1] * a.v[j]) ELSE 0 END AS x FROM cells c, a GROUP BY vec_id, j)
    SELECT vec_id AS row, CAST((j - 1) // 16 AS INTEGER) AS block, round(sum(x), 6) AS total, round(min(x), 6) AS least FROM merged GROUP BY ALL"""
)
def adapter_merge(spark, sf):
    """The vectors as a matrix; the first four are an adapter's A, the first four numbers of two rows in three its B."""
    rows = data.table(spark, sf, "embeddings").select(F.col("vec_id").alias("row"), F.col("embedding").cast("array<double>").alias("values"))
    blocks = adapters.column_blocks(rows, 16)
    a = adapters.column_blocks(rows.where("row < 4"), 16).withColumnRenamed("row", "k")
    b = rows.where("row % 3 <> 0").select("row", F.slice("values", 1, 4).alias("factors"))
    merged = adapters.merge_adapter(blocks, b, a, 0.5)
    return merged.select("row", "block", F.round(F.aggregate("values", F.lit(0.0), lambda s, x: s + x), 6).alias("total"), F.round(F.array_min("values"), 6).alias("least"))


_WINDOWS = r"""samples AS (SELECT ticker, date, target, regexp_replace(string_agg(strftime(day, '%Y-%m-%d') || chr(10) || summary, chr(10) || chr(10) ORDER BY day), '\s+$', '') AS s
      FROM slots JOIN days USING (ticker, date) JOIN summaries USING (ticker, day) WHERE summary <> '' AND NOT regexp_matches(summary, """ + _lit(f"^(?:{text.UNINFORMATIVE})") + """) GROUP BY ALL)"""
_USER = {"company_description": "''", "summary": "s"}


@query(
    _sql(
        f"""SELECT ticker, date AS end_date, md5(CASE WHEN example IS NULL THEN {_filled(prompts.FORECAST_USER, **_USER)}
          ELSE {_filled(prompts.FORECAST_USER_SHOTS, few_shot_learning_examples="example", **_USER)} END) AS user_md5 FROM (
          SELECT *, lag({_filled(prompts.EXAMPLE, summary="s", target="target")}) OVER (PARTITION BY ticker ORDER BY date) AS example FROM samples)""",
        "posts", "days", "slots", "summaries",
        more=_WINDOWS,
    )
)
def few_shot_forecasts(spark, sf):
    """Forecast messages that show the ticker's last sample whose outcome was known before the day."""
    checkpoint_folder(spark)
    rows = samples.sample_windows(_days(spark, sf), samples.extractive_summaries(data.posts(spark, sf))).select("ticker", "end_date", "summary", "target")
    shown = forecast.with_examples(rows).withColumn("profile", F.lit(""))
    return shown.select("ticker", "end_date", _md5(forecast.user_message(F.col("example"))).alias("user_md5"))
