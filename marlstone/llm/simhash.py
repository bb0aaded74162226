"""SimHash fingerprints and near-duplicate groups by multi-index hashing.

A fingerprint is cut into two segments of 32 bits, each with a table from values to fingerprints. Of two
fingerprints with at most two differing bits, either the upper segments differ in at most one bit or the lower ones are
equal: so the upper segment is looked up with its Hamming ball of radius one, the lower one with radius zero.
Two upper values that differ in one bit meet when the one that has the bit clears it, so only bits that are set are
flipped: 18 lookups a fingerprint on average. The matches are verified by their complete distance.

A table entry with more than ``crowd`` fingerprints is not compared pair by pair: its fingerprints, and those
that look it up, enumerate the ball of radius one of the other segment too, that is around the whole fingerprint. Two
of them within two bits meet at the fingerprint between them. At most 65 lie around any, all within two bits of
each other, and they are linked as a chain. So no entry makes the square of its size, and no link is lost.

Exact copies share a fingerprint and are one node. Components come from distributed
star contraction.

Defined results: null, empty and blank texts have the fingerprint zero and link to each other
like any others; a very long text is hashed whole, in slices of its shingles; equal rows get equal results; rows that share a
``doc_id`` in different groups name each of them; a null ``doc_id`` is ignored as a name of its
group (a group of nulls has a null name); an empty table gives an empty result. Input columns other
than the two named ones are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WORD, delete_written, fresh, materialize, table, written
from .components import components

_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_WORD = re.compile(WORD.encode())
#: Shingles whose bits are counted at once.
_SLICE = 1 << 16


def fingerprint(text: str | None, shingle: int = 3, seed: int = 42) -> int:
    """The 64-bit SimHash of one text."""
    words = _WORD.findall((text or "").encode().translate(_LOWER))
    n = len(words)
    if not n:
        return 0
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if n <= shingle:
        hashes = [digest(joined, seed)]
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
        starts = np.concatenate([[0], ends[:-1] + 1])
        hashes = [digest(joined[a:b], seed) for a, b in zip(starts[: n - shingle + 1].tolist(), ends[shingle - 1 :].tolist(), strict=True)]
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), _SLICE):
        some = np.array(hashes[i : i + _SLICE], "<u8")
        ones += np.unpackbits(some.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, fp): the fingerprint as the bits of a long, one row per row of ``docs``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            fps = np.array([fingerprint(t, shingle, seed) for t in rows["text"]], np.uint64)
            yield pd.DataFrame({"doc_id": rows["doc_id"], "fp": fps.view(np.int64)})

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInPandas(run, "doc_id long, fp long")


#: Longest list of fingerprints that a table entry is compared pair by pair with.
CROWD = 64
_UPPER, _LOWER_KEY = "shiftrightunsigned(fp, 32)", "(fp & 4294967295L) | 4294967296L"
_BALL = f"filter(transform(sequence(0, 31), bit -> ({_UPPER}) & ~shiftleft(1L, bit)), x -> x != {_UPPER})"


def links(fps: DataFrame, *, crowd: int = CROWD) -> DataFrame:
    """(a, b): links that join all of the distinct fingerprints ``fp`` at 2 or fewer differing bits.

    A key is a segment's value, for the lower segment with a mark above it.
    """
    own = F.expr(f"array({_UPPER}, {_LOWER_KEY})")
    tables = fps.select("fp", F.explode(own).alias("key"))
    asked = fps.select("fp", F.explode(F.expr(f"concat(array({_UPPER}, {_LOWER_KEY}), {_BALL})")).alias("key"))
    flipped = (F.col("key") < 1 << 32) & (F.col("key") != F.expr(_UPPER.replace("fp", "a")))
    crowded = materialize(tables.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > crowd).select("key"), "crowded")
    within = lambda a, b: F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= 2
    entries = tables.join(crowded, "key", "left_anti").withColumnRenamed("fp", "b")
    matched = asked.withColumnRenamed("fp", "a").join(entries, "key").where((flipped | (F.col("a") > F.col("b"))) & within("a", "b")).select("a", "b")

    many = asked.join(crowded, "key", "left_semi").select("fp").distinct()
    around = many.select("fp", F.explode(F.expr("concat(array(fp), transform(sequence(0, 63), bit -> fp ^ shiftleft(1L, bit)))")).alias("key"))
    chained = around.withColumn("b", F.lag("fp").over(Window.partitionBy("key").orderBy("fp")))
    return matched.union(chained.where(F.col("b").isNotNull() & within("fp", "b")).select("fp", "b"))


def near_duplicates(docs: DataFrame, **settings) -> DataFrame:
    """``doc_id, fp, component_id``, one row per row of ``docs``."""
    marked = materialize(fingerprints(docs, **settings), "simhash")
    since = len(written)
    # Copies meet here: one row per fingerprint and task goes into the shuffle.
    fps = materialize(marked.groupBy("fp").agg(F.min("doc_id").alias("first")), "fingerprints")
    roots = components(links(fps.select("fp")))
    named = fps.join(roots, F.col("fp") == F.col("node"), "left").withColumn("root", F.coalesce("root", "fp"))
    least = named.groupBy("root").agg(F.min("first").alias("component_id"))
    by_fp = materialize(named.join(least, "root").select("fp", "component_id"), "components")
    delete_written(docs.sparkSession, since=since, keep=1)
    return marked.join(by_fp, "fp").select("doc_id", "fp", "component_id")


def keep_one_of_each(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each group: that with the smallest ``doc_id``, nulls last.

    Rows get a key of their own, so null and repeated ids are rows like any others.
    """
    key = fresh("_key", docs.columns)
    keyed = materialize(docs.withColumn(key, F.monotonically_increasing_id()), "simhash-rows")
    found = near_duplicates(keyed.select(key, "text"), id_col=key).select(F.col("doc_id").alias(key), "fp", F.col("component_id").alias("_group"))
    named = found.join(keyed.select(key, F.col("doc_id").alias("_id")), key)
    first = F.min(F.struct(F.col("_id").isNull().alias("none"), F.col("_id").alias("id"), F.col("fp").alias("fp"), F.col(key).alias("key")))
    best = named.groupBy("_group").agg(first.alias("_first")).select(F.col("_first")["key"].alias(key))
    return keyed.join(best, key, "left_semi").select(*docs.columns)


def op3_simhash(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )
