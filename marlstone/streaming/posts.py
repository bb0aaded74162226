"""Streaming ingest of posts (an extension): daily counts and sliding five-day windows with late data, and a summary store that each batch updates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..store import Store


def read_stream(spark: SparkSession, path: str, schema, fmt: str = "parquet", **options: str) -> DataFrame:
    """A stream of the files that arrive in a folder."""
    return spark.readStream.format(fmt).schema(schema).options(**options).load(path)


def daily_counts(posts: DataFrame, time: str = "created_at", key: str = "ticker", late: str = "1 day") -> DataFrame:
    """Posts per key and calendar day; rows later than ``late`` behind the watermark are dropped."""
    day = F.window(time, "1 day")
    return posts.withWatermark(time, late).groupBy(day, key).agg(F.count("*").alias("n")).select(key, F.to_date("window.start").alias("day"), "n")


def sliding_counts(posts: DataFrame, days: int = 5, time: str = "created_at", key: str = "ticker", late: str = "1 day") -> DataFrame:
    """Posts in the ``days`` days before each day."""
    span = F.window(time, f"{days} days", "1 day")
    return posts.withWatermark(time, late).groupBy(span, key).agg(F.count("*").alias("n")).select(key, F.to_date("window.end").alias("day"), "n")


def start(rows: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Write finished windows as Parquet, exactly once, until the files at hand are used up."""
    return rows.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def without_repeats(posts: DataFrame, *key: str, time: str = "created_at", late: str = "1 day") -> DataFrame:
    """The first post of each ``key``; a repeat that arrives within ``late`` of it is dropped, and its state forgotten afterwards."""
    return posts.withWatermark(time, late).dropDuplicatesWithinWatermark(list(key))


def add_batch(store: Store, name: str, rows: DataFrame, batch: int, *key: str) -> bool:
    """Add a batch's rows to a table of the store, once: a batch that is replayed changes nothing. Returns whether it was new.

    ``newest`` of the store reads the table with the last row of every ``key``; the batch's rows hold one of each.
    """
    if any(int(f.get("batch", -1)) >= batch for f in store.all_facts(name)):
        return False
    store.put(rows.dropDuplicates(list(key)), name, batch=str(batch))
    return True


def into_store(rows: DataFrame, store: Store, name: str, key: list[str], checkpoint: str, make=lambda df: df) -> StreamingQuery:
    """A stream that updates a table of the store by ``key``, batch by batch, until the files at hand are used up; ``make`` turns a batch into rows of the table."""
    job = rows.writeStream.foreachBatch(lambda df, batch: add_batch(store, name, make(df), batch, *key) and None)
    return job.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
