"""Writers of the engine's outputs, all through Spark and so to any store."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .operators.order import together
from .sources.files import last_summaries, read_raw_summaries


def write_summaries(rows: DataFrame, path: str, mode: str = "append", sequence: int | None = None) -> None:
    """Append to the summary store, a folder per model, method and ticker.

    ``sequence`` says which of two writes of a day is the later; without it the writer's clock does.
    """
    written = time.time_ns() // 1_000 if sequence is None else sequence
    rows.withColumn("written", F.lit(written).cast("long")).write.mode(mode).partitionBy("model", "method", "ticker").json(path)


def compact_summaries(spark: SparkSession, path: str) -> int:
    """One row per day, the one that ``files.read_summaries`` gives, in every folder of the store that has more; the number of such folders.

    Folders without repeats are not touched. Rows are checkpointed before their folders are overwritten.
    """
    folder = ["model", "method", "ticker"]
    raw = read_raw_summaries(spark, path)
    many = raw.groupBy(*folder).agg(F.count("*").alias("n"), F.countDistinct("date").alias("d")).where("n > d").select(*folder).checkpoint()
    n = many.count()
    if n:
        kept = last_summaries(raw.join(many, folder, "left_semi")).checkpoint()
        out = kept.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        out.partitionBy(*folder).json(path)
    return n


def write_samples_csv(rows: DataFrame, path: str) -> None:
    _csv(rows, path)


def write_sft(rows: DataFrame, path: str) -> None:
    """JSON lines of instruction, input, output, appended."""
    rows.select("instruction", "input", "output").write.mode("append").json(path)


def write_preferences(rows: DataFrame, path: str) -> bool:
    """JSON of preference pairs; nothing is written without any. Returns whether it was."""
    if rows.isEmpty():
        return False
    rows.select("user_input", "completion_a", "completion_b").write.mode("overwrite").json(path)
    return True


def write_results(rows: DataFrame, path: str) -> None:
    """CSV of prompt, response, target; line ends inside values survive."""
    _csv(rows.select("Prompt", "Response", "Target"), path)


def _csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", True).option("quoteAll", True).option("escape", '"').csv(path)


def metrics_row(metrics: DataFrame, model_name: str, dataset_name: str | None = None) -> DataFrame:
    """The metrics as one nested row for JSON."""
    n = lambda *c: F.array(*[F.col(x).cast("long") for x in c])
    return metrics.select(
        F.lit(model_name).alias("model_name"),
        F.lit(dataset_name).cast("string").alias("dataset_name"),
        F.date_format(F.current_timestamp(), "yyyyMMdd_HHmmss").alias("timestamp"),
        F.col("total").alias("total_samples"),
        F.col("total").alias("valid_samples"),
        F.lit(0).cast("long").alias("invalid_samples"),
        "accuracy",
        "mcc",
        "precision",
        "recall",
        F.col("f1").alias("f1_score"),
        F.struct(F.array(F.lit("Negative"), F.lit("Positive")).alias("labels"), F.array(n("tn", "fp"), n("fn", "tp")).alias("matrix")).alias("confusion_matrix"),
    )


def write_metrics(metrics: DataFrame, path: str, model_name: str, dataset_name: str | None = None) -> None:
    metrics_row(metrics, model_name, dataset_name).write.mode("append").json(f"{path.rstrip('/')}/{model_name}")


def write_state(rows: DataFrame, path: str) -> None:
    """Agents' states as Parquet."""
    rows.write.mode("overwrite").parquet(path)


def report(rows: DataFrame, line: Column, *order: str) -> DataFrame:
    """(n, line): a numbered line of text per row, in an explicit order; numbers come from range partitions, not from one task."""
    kept = rows.select(line.alias("_line"), *order)
    sorted_ = kept.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_p", F.spark_partition_id()).withColumn("_i", F.monotonically_increasing_id())
    sorted_ = sorted_.checkpoint()
    sizes = sorted_.groupBy("_p").agg(F.count("*").alias("_n"), F.min("_i").alias("_first"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # one row per partition
    n = F.col("_before") + F.col("_i") - F.col("_first") + 1
    return sorted_.join(sizes.withColumn("_before", before), "_p").select(n.alias("n"), F.concat(n.cast("string"), F.lit(". "), "_line").alias("line"))


def name_files(spark: SparkSession, folder: str, name: Callable[[dict[str, str]], str]) -> int:
    """Rename the part files below partition folders ``key=value`` to what ``name`` makes of their keys, relative to ``folder``; the number of files.

    For layouts that other programs read, one file per key: rows must have been written with one part file in each folder. The driver renames; no data moves.
    """
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    root = jvm.org.apache.hadoop.fs.Path(folder)
    fs = root.getFileSystem(conf)
    found, moved = fs.listFiles(root, True), 0
    parts = []
    while found.hasNext():
        path = found.next().getPath()
        if path.getName().startswith("part-"):
            parts.append(path)
    for path in parts:
        keys, up = {}, path.getParent()
        while "=" in up.getName():
            key, _, value = up.getName().partition("=")
            keys[key] = unquote(value)
            up = up.getParent()
        target = jvm.org.apache.hadoop.fs.Path(f"{folder.rstrip('/')}/{name(keys)}")
        if fs.exists(target):
            raise ValueError(f"two files for {target}")
        fs.mkdirs(target.getParent())
        fs.rename(path, target)
        moved += 1
    for status in fs.listStatus(root):
        if "=" in status.getPath().getName():
            fs.delete(status.getPath(), True)
    return moved


def write_price_files(rows: DataFrame, path: str) -> int:
    """A file ``<ticker>.txt`` per ticker, as ``files.read_prices`` reads them: day, change and further figures between tabs. One task writes a ticker."""
    number = [F.coalesce(F.col(c).cast("string"), F.lit("0")) if c in rows.columns else F.lit("0") for c in ("pct_change", "c2", "c3", "c4", "c5", "volume")]
    lines = rows.select("ticker", "date", F.concat_ws("\t", F.date_format("date", "yyyy-MM-dd"), *number).alias("value"))
    lines.repartition("ticker").sortWithinPartitions("ticker", "date").select("ticker", "value").write.partitionBy("ticker").text(path)
    return name_files(rows.sparkSession, path, lambda k: f"{k['ticker']}.txt")


def _post_line(*more: str) -> Column:
    """A post as a JSON line, with ``more`` columns in it as they are."""
    fields = F.struct(*(F.col(c).cast("string").alias(c) for c in ("id", "author_id")), F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("created_at"), "text", *more)
    return F.to_json(fields).alias("value")


@contextmanager
def _open_files(spark: SparkSession, most: int = 1_000) -> Iterator[None]:
    """A task that writes to up to ``most`` folders keeps a file open in each; rows are sorted by folder only beyond that."""
    name = "spark.sql.maxConcurrentOutputFileWriters"
    kept = spark.conf.get(name)
    spark.conf.set(name, most)
    try:
        yield
    finally:
        spark.conf.set(name, kept)


def write_post_folders(rows: DataFrame, path: str, compression: str = "none") -> None:
    """A folder ``ticker=<ticker>/date=<day>`` per ticker and day, of JSON lines in any number of files; a line's ``line_no`` says its place.

    Texts are not shuffled for it: each task writes the posts that it has.
    """
    lines = rows.select("ticker", F.date_format("date", "yyyy-MM-dd").alias("date"), _post_line("line_no"))
    with _open_files(rows.sparkSession):
        lines.write.partitionBy("ticker", "date").option("compression", compression).text(path)


def write_post_files(rows: DataFrame, path: str, compression: str = "none") -> int:
    """A file ``<ticker>/<day>`` of JSON lines per ticker and day, in line order; with ``compression`` gzip or bzip2, ``<ticker>/<day>.gz`` or ``.bz2``.

    A line is a row all the way. ``text`` may be given as ``functions.text.tight`` makes it.
    """
    posts = rows.select("ticker", F.date_format("date", "yyyy-MM-dd").alias("day"), "line_no", "id", "author_id", "created_at", "text")
    lines = together(posts, ["ticker", "day"], "line_no", "text").select("ticker", "day", _post_line())
    lines.write.partitionBy("ticker", "day").option("compression", compression).text(path)
    end = {"none": "", "gzip": ".gz", "bzip2": ".bz2"}[compression]
    return name_files(rows.sparkSession, path, lambda k: f"{k['ticker']}/{k['day']}{end}")


def write_relationships(rows: DataFrame, path: str) -> None:
    _csv(rows, path)
