"""The logical tables, built from the test tables; every recipe uses whole tables and whole texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import tight, tighten

MUTE = "No information available"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def posts(spark: SparkSession, sf_dir: str, small: bool = False) -> DataFrame:
    """Events as posts: ticker is the event type, the text is a document's; every eleventh says nothing.

    ``small``: texts as ``functions.text.tight`` makes them, once per document.
    """
    docs = table(spark, sf_dir, "documents")
    n = max(1, docs.count())  # from the files' footers
    events = table(spark, sf_dir, "events").withColumn("doc_id", F.col("event_id") % n)
    texts = docs.select("doc_id", tight(F.col("text")).alias("text") if small else "text")
    text = F.when(F.col("event_id") % 11 == 0, F.lit(tighten(MUTE) if small else MUTE)).otherwise(F.col("text"))
    return events.join(texts, "doc_id").select(
        F.col("event_type").alias("ticker"),
        F.to_date("ts").alias("date"),
        F.col("event_id").alias("line_no"),
        F.col("event_id").alias("id"),
        F.col("user_id").alias("author_id"),
        F.col("ts").alias("created_at"),
        text.alias("text"),
    )


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily price changes from events, in whole cents; the first day of a ticker has none."""
    cents = F.round(F.col("value") * 100).cast("long")
    daily = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("ticker"), F.to_date("ts").alias("date")).agg(F.sum(cents).alias("cents"))
    return daily.withColumn("pct_change", _change("ticker"))


def bars_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Price changes over many days, from orders."""
    cents = F.round(F.col("o_totalprice") * 100).cast("long")
    daily = (
        table(spark, sf_dir, "orders")
        .groupBy(F.col("o_orderpriority").alias("ticker"), F.to_date("o_orderdate").alias("date"))
        .agg(F.sum(cents).alias("cents"))
    )
    return daily.withColumn("pct_change", _change("ticker"))


def _change(key: str):
    before = F.lag("cents").over(Window.partitionBy(key).orderBy("date"))
    return F.col("cents").cast("double") / F.nullif(before, F.lit(0)).cast("double") - 1


def kg_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers and every third customer are companies, other customers persons, parts products."""
    pick = lambda t, key, name, kind: table(spark, sf_dir, t).select(F.concat(F.lit(t[0]), F.col(key).cast("string")).alias("id"), F.col(name).alias("entity"), kind.alias("type_name"))
    person = F.when(F.col("c_custkey") % 3 == 0, "COMP").otherwise("PERSON")
    return (
        pick("supplier", "s_suppkey", "s_name", F.lit("COMP"))
        .unionByName(pick("customer", "c_custkey", "c_name", person))
        .unionByName(pick("part", "p_partkey", "p_name", F.lit("PRODUCT")))
    )


def kg_relations(spark: SparkSession) -> DataFrame:
    return spark.sql("SELECT * FROM VALUES ('A', 'supplies'), ('R', 'returns to') AS t(id, relation)")


def kg_order_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The object of each order's quads: its customer."""
    return table(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("obj_id"))


def kg_quads(spark: SparkSession, sf_dir: str, objects: DataFrame | None = None) -> DataFrame:
    """Line items as quads: supplier, return flag, customer, week.

    ``objects``: what else to take for the objects of orders.
    """
    week = F.to_date(F.date_trunc("week", "l_shipdate")).alias("date_wk")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_returnflag", week, "l_linestatus")
    ends = kg_order_objects(spark, sf_dir) if objects is None else objects
    return lines.join(ends, lines["l_orderkey"] == ends["o_orderkey"]).select(
        F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("subj_id"),
        F.col("l_returnflag").alias("rel_id"),
        *[c for c in ends.columns if c != "o_orderkey"],
        "date_wk",
        F.col("l_linestatus").alias("source_file"),
    )


def ticker_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ticker -> entity name, for suppliers and customers of nations with even keys."""
    pick = lambda t, key, name, nation: table(spark, sf_dir, t).where(F.col(nation) % 2 == 0).select(F.concat(F.lit(t[0].upper()), F.col(key).cast("string")).alias("ticker"), F.col(name).alias("entity"))
    return pick("supplier", "s_suppkey", "s_name", "s_nationkey").unionByName(pick("customer", "c_custkey", "c_name", "c_nationkey"))


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels with a model's answer in one of five shapes."""
    k = F.col("doc_id") % 5
    up = F.when(F.col("doc_id") % 3 == 0, "down").otherwise("up")
    response = (
        F.when(k == 0, F.concat(F.lit("**Stock Return:** 2.5% ("), up, F.lit(")")))
        .when(k == 1, F.concat(F.lit("Summary: x\nStock Return: -1.2% ("), F.upper(up), F.lit(")")))
        .when(k == 2, F.concat(F.lit("stock return : +3 ( "), up, F.lit(" ) (down)")))
        .when(k == 3, F.concat(F.lit("Stock Return: 2% "), up))
        .otherwise("no idea")
    )
    return table(spark, sf_dir, "labels").select("doc_id", F.when(F.col("quality") == 1, "Positive").otherwise("Negative").alias("label"), response.alias("response"))


def qa_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's turn and the assistant's answer right after it."""
    lane = Window.partitionBy("conv_id").orderBy("turn")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text", F.lag("role").over(lane).alias("was"), F.lag("text").over(lane).alias("question"))
    return rows.where("role = 'assistant' AND was = 'user'").select("conv_id", "turn", "question", F.col("text").alias("answer"))
