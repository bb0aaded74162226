"""Labels, splits and trailing-window samples of price days."""

from __future__ import annotations

import datetime
import hashlib
from collections.abc import Callable, Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import prompts
from ..functions.text import NEGATIVE, POSITIVE, fill, informative, list_parts, pack, packed, packed_size, rstrip, unpack, unpack_bytes
from ..store import Store
from .answers import ask


def label(pct: Column) -> Column:
    """Positive above zero; zero, null and NaN are Negative."""
    return F.when((pct > 0) & ~F.isnan(pct), POSITIVE).otherwise(NEGATIVE)


def labelled(bars: DataFrame) -> DataFrame:
    return bars.withColumn("target", label(F.col("pct_change")))


def positions(bars: DataFrame) -> DataFrame:
    """``idx``, a day's place within its ticker from 0 (oldest), and ``n``, the ticker's days."""
    lane = Window.partitionBy("ticker")
    return bars.withColumn("idx", F.row_number().over(lane.orderBy("date")) - 1).withColumn("n", F.count("*").over(lane))


def in_range(bars: DataFrame, first: str | datetime.date, last: str | datetime.date) -> DataFrame:
    """Days from ``first`` to ``last``, both included."""
    return bars.where(F.col("date").between(F.lit(first).cast("date"), F.lit(last).cast("date")))


def temporal_split(bars: DataFrame, fraction: float = 0.8, train_rows: int | None = None) -> DataFrame:
    """``split`` per ticker: test from place round(n * fraction) on, train before it.

    With ``train_rows`` only the first so many days are train; those between are null.
    """
    placed = positions(bars)
    test = F.col("idx") >= F.round(F.col("n") * fraction)
    train = F.lit(True) if train_rows is None else F.col("idx") < train_rows
    return placed.withColumn("split", F.when(test, "test").when(train, "train"))


def day_slots(days: DataFrame, length: int = 5) -> DataFrame:
    """A row for each of the ``length`` calendar days before a sample's day, which is itself left out."""
    return days.withColumn("day", F.explode(F.sequence(F.date_sub("date", length), F.date_sub("date", 1))))


def posts_by_day(posts: DataFrame) -> DataFrame:
    """(ticker, day, tweets): the texts of a day in line order."""
    ordered = F.array_sort(F.collect_list(F.struct("line_no", "text")))
    return posts.groupBy("ticker", F.col("date").alias("day")).agg(F.transform(ordered, lambda x: x["text"]).alias("tweets"))


def fold_days(posts: DataFrame, fold: Callable[[Iterator[str | None]], tuple], schema: str) -> DataFrame:
    """(ticker, day, and ``schema``'s columns): what ``fold`` makes of a day's texts, which come to it one by one in line order.

    For days of any size: they are sorted on disk where memory ends, travel compressed, and none is held whole.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in batches for r in zip(*(b.column(c).to_pylist() for c in ("ticker", "day", "text")), strict=True))
        for key, own in groupby(rows, key=lambda r: r[:2]):
            values = (*key, *fold(unpack(t) for _, _, t in own))
            yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, out, strict=True)], schema=out)

    kinds = {"string": pa.string(), "long": pa.int64()}
    out = pa.schema([("ticker", pa.string()), ("day", pa.date32()), *((n, kinds[k]) for n, k in (x.split() for x in schema.split(", ")))])
    rows = posts.select("ticker", F.col("date").alias("day"), "line_no", packed(F.col("text")).alias("text"))
    placed = rows.repartition("ticker", "day").sortWithinPartitions("ticker", "day", "line_no").select("ticker", "day", "text")
    return placed.mapInArrow(run, f"ticker string, day date, {schema}")


def joined_digest(texts: Iterator[str | None]) -> tuple[str | None, int | None]:
    """MD5 and characters of texts joined by line ends; nulls are left out, and of none but nulls both are null."""
    told, chars, n = hashlib.md5(), 0, 0
    for t in texts:
        if t is not None:
            told.update(b"\n" * (n > 0) + t.encode())
            chars, n = chars + len(t) + (n > 0), n + 1
    return (told.hexdigest(), chars) if n else (None, None)


def array_digest(texts: Iterator[str | None]) -> tuple[int, int | None, str | None]:
    """Number of texts, their characters (null without a text) and the MD5 of the first that is not null."""
    n, chars, first = 0, None, None
    for t in texts:
        n += 1
        if t is not None:
            first = first or hashlib.md5(t.encode()).hexdigest()
            chars = (chars or 0) + len(t)
    return n, chars, first


def list_digest(texts: Iterator[str | None]) -> tuple[str]:
    """MD5 of the texts as Python writes a list of them."""
    told = hashlib.md5()
    for piece in list_parts(texts):
        told.update(piece.encode())
    return (told.hexdigest(),)


def extractive_summaries(posts: DataFrame, first: int = 3) -> DataFrame:
    """(ticker, day, summary): the default summariser, which takes the first posts of a day.

    The limit by rank is applied on each task before the shuffle, so that busy days don't gather in one.
    """
    lane = Window.partitionBy("ticker", "date").orderBy("line_no")
    head = posts.withColumn("_n", F.row_number().over(lane)).where(F.col("_n") <= first)
    return head.groupBy("ticker", F.col("date").alias("day")).agg(F.expr("listagg(text, '\\n') WITHIN GROUP (ORDER BY line_no)").alias("summary"))


def distinct_texts(posts: DataFrame, held_bytes: int = 1 << 25) -> DataFrame:
    """(ticker, day, lines, text): each text of a day compressed, with the numbers of all its lines.

    A task gives a text that its rows repeat once, unless what it holds passes ``held_bytes`` in between; tasks may give the same text.
    """
    out = pa.schema([("ticker", pa.string()), ("day", pa.date32()), ("lines", pa.list_(pa.int64())), ("text", pa.binary())])

    def give(held: dict) -> pa.RecordBatch:
        columns = zip(*((ticker, day, lines, text) for (ticker, day, text), lines in held.items()), strict=True)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, out, strict=True)], schema=out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = {}, 0
        for b in batches:
            codes = b.column("text").dictionary_encode()
            texts = [pack(t) for t in codes.dictionary.to_pylist()]
            rows = pa.table({"ticker": b.column("ticker"), "day": b.column("day"), "text": codes.indices, "line_no": b.column("line_no")})
            grouped = rows.group_by(["ticker", "day", "text"]).aggregate([("line_no", "list")])
            for ticker, day, i, lines in zip(*(grouped.column(c).to_pylist() for c in ("ticker", "day", "text", "line_no_list")), strict=True):
                text = None if i is None else texts[i]
                size += 40 * len(lines)
                if (ticker, day, text) in held:
                    held[ticker, day, text] += lines
                else:
                    held[ticker, day, text] = lines
                    size += 200 + len(text or b"")
            if size > held_bytes:
                yield give(held)
                held, size = {}, 0
        if held:
            yield give(held)

    line = F.coalesce(F.col("line_no").cast("long"), F.lit(-(2**63)))  # as SQL sorts: null first
    rows = posts.select("ticker", F.col("date").alias("day"), line.alias("line_no"), "text")
    return rows.mapInArrow(run, "ticker string, day date, lines array<long>, text binary")


def joined_days(posts: DataFrame) -> DataFrame:
    """(ticker, day, text): a day's texts in line order, joined by line ends; nulls are left out, and of none but nulls it is null.

    Before the shuffle each task gives a text of a day once and compressed. A day's different texts are held so, beside the one value that it becomes.
    """
    out = pa.schema([("ticker", pa.string()), ("day", pa.date32()), ("text", pa.string())])

    def joined(own: list[tuple[np.ndarray, bytes]]) -> pa.Array:
        if not own:
            return pa.nulls(1, pa.string())
        sizes = [len(lines) for lines, _ in own]
        order = np.repeat(np.arange(len(own)), sizes)[np.argsort(np.concatenate([lines for lines, _ in own]), kind="stable")]
        total = sum(n * (packed_size(text) + 1) for n, (_, text) in zip(sizes, own, strict=True)) - 1
        value, at = pa.allocate_buffer(total), 0
        view = memoryview(value).cast("B")
        for i in order:
            if at:
                view[at - 1] = 10
            raw = unpack_bytes(own[i][1])
            view[at : at + len(raw)] = raw
            at += len(raw) + 1
        return pa.Array.from_buffers(pa.string(), 1, [None, pa.py_buffer(np.array([0, total], np.int32)), value])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (
            (ticker, day, lines.values.to_numpy(), text)
            for b in batches
            for ticker, day, lines, text in zip(b.column("ticker").to_pylist(), b.column("day").to_pylist(), b.column("lines"), b.column("text").to_pylist(), strict=True)
        )
        for (ticker, day), own in groupby(rows, key=lambda r: r[:2]):
            text = joined([(lines, t) for _, _, lines, t in own if t is not None])
            yield pa.RecordBatch.from_arrays([pa.array([ticker], pa.string()), pa.array([day], pa.date32()), text], schema=out)

    placed = distinct_texts(posts).repartition("ticker", "day").sortWithinPartitions("ticker", "day", "text")
    return placed.mapInArrow(run, "ticker string, day date, text string")


def model_summaries(posts: DataFrame, provider: Callable[[Column], Column], template: str = prompts.SUMMARY, examples: str = prompts.SUMMARY_EXAMPLES, limit: int | None = None, cache: Store | None = None, asker: str = "summary") -> DataFrame:
    """(ticker, day, prompt, summary): a model's summary of each day's posts, in line order.

    ``limit``: posts beyond so many characters of a day are not shown (none: whole days are). A day whose prompt shows no text is not asked about and has no summary.
    ``cache``: see ``answers.ask``.
    """
    lane = Window.partitionBy("ticker", "date").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    shown = posts if limit is None else posts.withColumn("_up", F.sum(F.length("text")).over(lane)).where(F.col("_up") <= limit)
    days = joined_days(shown).withColumnRenamed("text", "_t")
    prompt = fill(template, {"ticker": F.col("ticker"), "tweets": F.col("_t"), "examples": F.lit(examples)})
    asked = days.withColumn("prompt", F.when(F.trim("_t") != "", prompt))
    if cache is not None:
        return ask(asked, "prompt", provider, cache, asker, "summary").select("ticker", "day", "prompt", "summary")
    return asked.select("ticker", "day", "prompt", F.when(F.col("prompt").isNotNull(), provider(F.col("prompt"))).alias("summary"))


def sample_windows(days: DataFrame, summaries: DataFrame, length: int = 5) -> DataFrame:
    """Samples: the informative summaries of the days before, under their dates, oldest first.

    ``days`` has ticker, date, target; a day without any such summary gives no sample. A day is
    summarised once however many windows it lies in.
    """
    useful = summaries.where(informative(F.col("summary")))
    slots = day_slots(days, length).join(useful, ["ticker", "day"])
    text = F.concat(F.date_format("day", "yyyy-MM-dd"), F.lit("\n"), F.col("summary"))
    joined = slots.withColumn("_part", text).groupBy("ticker", "date", "target").agg(
        F.expr("listagg(_part, '\\n\\n') WITHIN GROUP (ORDER BY day)").alias("_text"), F.count("*").alias("n_days")
    )
    return joined.select("ticker", F.col("date").alias("end_date"), rstrip(F.col("_text")).alias("summary"), "target", "n_days")


def merge_summaries(wanted: DataFrame, stored: DataFrame, make: Column, keep_empty: bool = True) -> DataFrame:
    """Stored summaries, and ``make`` for the days without one.

    ``keep_empty`` also stores days that got no summary, so that they are not tried again.
    """
    key = ["ticker", "day"]
    made = wanted.join(stored, key, "left_anti").select(*key, make.alias("summary"), F.lit(True).alias("is_new"))
    if not keep_empty:
        made = made.where(F.col("summary").isNotNull())
    return stored.select(*key, "summary", F.lit(False).alias("is_new")).unionByName(made)
