"""Streams into a table of the store."""

from pyspark.sql import functions as F

from marlstone.store import Store
from marlstone.streaming import posts


def test_repeats_and_replays_change_nothing(spark, tmp_path):
    store = Store(spark, f"{tmp_path}/store")
    schema = "id long, ticker string, created_at timestamp"

    def arrive(name, rows):
        spark.createDataFrame(rows, "id long, ticker string, created_at string").withColumn("created_at", F.to_timestamp("created_at")).write.parquet(f"{tmp_path}/in/{name}")

    def run():
        stream = posts.read_stream(spark, f"{tmp_path}/in/*", schema)
        posts.into_store(posts.without_repeats(stream, "id"), store, "posts", ["id"], f"{tmp_path}/marks").awaitTermination()
        return sorted((r.id, r.ticker) for r in store.newest("posts", "id").collect())

    arrive("a", [(1, "A", "2022-01-01 10:00:00"), (2, "A", "2022-01-01 11:00:00"), (1, "again", "2022-01-01 12:00:00")])
    first = run()
    assert [i for i, _ in first] == [1, 2]
    arrive("b", [(2, "again", "2022-01-01 13:00:00"), (3, "B", "2022-01-01 14:00:00")])
    assert run() == [*first, (3, "B")]
    before = store.versions("posts")
    done = max(int(f["batch"]) for f in store.all_facts("posts"))
    assert not posts.add_batch(store, "posts", spark.createDataFrame([(1, "replayed", None)], schema), done, "id")
    assert store.versions("posts") == before and run() == [*first, (3, "B")]
