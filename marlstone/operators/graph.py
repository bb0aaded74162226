"""Temporal knowledge graph: decoding of id quads, mapped relationships, profiles.

Entity dimensions join by key; Spark broadcasts a side only below its size threshold. Filters on
dimensions come before the quads are joined.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

COMPANY, UNKNOWN_TYPE = "COMP", "UNKNOWN"
SIDES = {"subject": "subj_id", "object": "obj_id"}


def first_names(entities: DataFrame, order: str = "line_no_first") -> DataFrame:
    """One name per id: the one that came first."""
    lane = Window.partitionBy("id").orderBy(order, "entity")
    return entities.withColumn("_n", F.row_number().over(lane)).where("_n = 1").drop("_n")


def relationships(quads: DataFrame, entities: DataFrame, mapped: DataFrame, first: str, last: str, relations: DataFrame | None = None) -> DataFrame:
    """Relationships between mapped companies in a range of dates, both ends included.

    ``quads`` has subj_id, rel_id, obj_id, date_wk, source_file; unresolvable ids drop out. The relation stays an id;
    with ``relations`` its name is added.
    """
    companies = entities.where(F.col("type_name") == COMPANY).join(mapped.select("entity").distinct(), "entity", "left_semi").select("id", "entity")
    inside = quads.where(F.col("date_wk").between(F.lit(first).cast("date"), F.lit(last).cast("date")))
    out = inside.join(companies.select(F.col("id").alias("subj_id"), F.col("entity").alias("subject")), "subj_id").join(
        companies.select(F.col("id").alias("obj_id"), F.col("entity").alias("object")), "obj_id"
    )
    cols = ["subject", F.col("rel_id").alias("relation"), "object", F.col("date_wk").alias("time"), "source_file"]
    if relations is not None:
        out = out.join(relations.select(F.col("id").alias("rel_id"), F.col("relation").alias("_name")), "rel_id", "left")
        cols.append(F.coalesce("_name", "rel_id").alias("relation_name"))
    return out.select(*cols)


def named(rows: DataFrame, entities: DataFrame, side: str) -> DataFrame:
    """``side`` (subject or object) and its type instead of its id; an id without a name stays as it is, its type is UNKNOWN."""
    key = SIDES[side]
    names = entities.select(F.col("id").alias(key), F.col("entity").alias("_e"), F.col("type_name").alias("_t"))
    kept = [c for c in rows.columns if c != key]
    return rows.join(names, key, "left").select(*kept, F.coalesce("_e", key).alias(side), F.coalesce("_t", F.lit(UNKNOWN_TYPE)).alias(f"{side}_type"))


def decode(quads: DataFrame, entities: DataFrame, relations: DataFrame) -> DataFrame:
    """Names and types for all quads; an id without a name stays as it is, its type is UNKNOWN.

    A side that ``named`` has dealt with, where its rows are fewer or the entities that it can mean are few, is taken as it is.
    """
    out = quads
    for side in SIDES:
        if side not in quads.columns:
            out = named(out, entities, side)
    out = out.join(relations.select(F.col("id").alias("rel_id"), F.col("relation").alias("_r")), "rel_id", "left")
    return out.select("subject", "subject_type", F.coalesce("_r", "rel_id").alias("relation"), "object", "object_type", F.col("date_wk").alias("time"))


def value_counts(rows: DataFrame, column: str) -> DataFrame:
    """Counts of non-null values, largest first."""
    return rows.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column)


def type_counts(decoded: DataFrame) -> DataFrame:
    """Counts of types on both sides."""
    sides = decoded.select(F.explode(F.array(F.struct(F.lit("subject").alias("side"), F.col("subject_type").alias("type")), F.struct(F.lit("object").alias("side"), F.col("object_type").alias("type")))).alias("x"))
    return sides.groupBy("x.side", "x.type").agg(F.count("*").alias("n"))


def year_histogram(rows: DataFrame, time: Column) -> DataFrame:
    return rows.groupBy(F.year(time).alias("year")).agg(F.count("*").alias("n")).orderBy("year")


def dataset_stats(decoded: DataFrame) -> DataFrame:
    """Quads, distinct entities on either side, distinct relations."""
    part = lambda kind, c: F.struct(F.lit(kind).alias("kind"), F.col(c).alias("name"))
    names = decoded.select(F.explode(F.array(part("e", "subject"), part("e", "object"), part("r", "relation"))).alias("x"))
    kinds = names.groupBy("x.kind").agg(F.countDistinct("x.name").alias("d"), F.count("*").alias("n"))
    pick = lambda kind, c: F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col(c))), F.lit(0)).cast("long")
    return kinds.agg(pick("r", "n").alias("n_quads"), pick("r", "d").alias("n_relations"), pick("e", "d").alias("n_entities"))


def map_tickers(tickers: DataFrame, mapping: DataFrame, entities: DataFrame) -> DataFrame:
    """Entity id and name of each ticker; null unless it is mapped and the entity exists."""
    named = entities.select("entity", "id").groupBy("entity").agg(F.max("id").alias("entity_id"))
    out = tickers.join(mapping, "ticker", "left").join(named, "entity", "left")
    return out.select("ticker", F.when(F.col("entity_id").isNotNull(), F.col("entity")).alias("entity"), "entity_id")


def unmapped(tickers: DataFrame, mapping: DataFrame) -> DataFrame:
    return tickers.join(mapping, "ticker", "left_anti")


def keyword_entities(entities: DataFrame, words: tuple[str, ...] = ("stock", "share", "equity")) -> DataFrame:
    """Entities whose name holds one of the words, in any case."""
    found = F.lit(False)
    for w in words:
        found = found | F.lower("entity").contains(w)
    return entities.where(found)
