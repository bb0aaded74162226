"""Periodic runs in texts: stretches of words that repeat with a period, found and collapsed.

A run is a stretch of consecutive words with smallest period q (words q apart are identical), at least ``least`` words and two periods long, that no neighbouring word
extends keeping that period. Harmonic grid probing finds all of them: a stretch of two periods p holds two neighbouring points jp and (j+1)p
of the grid of p, so a run of period p makes their words equal. All grids together have n ln n points. They are tested in numpy, period by period for small
periods and, for large ones, point by point over all periods of a range at once, which is 3 sqrt(n) array operations in all. Points
whose words are equal survive; those with fewer than six equal neighbours in a row can't lie in a run (it needs max(p, least - p) of them) and go.
What is left is extended to both sides by comparing growing chunks of the array with itself p words on. A stretch that was found settles other points:
those of p within it, and those of multiples of p, whose stretch would be the same one.

Periods go upwards, so a stretch is first found with its smallest period q: a longer one, p, with two periods of p in the stretch, is a multiple
of q (Fine and Wilf), and its points were settled.

Defined results: a null or blank text has no words and no runs, and collapses to an empty text; white space between words becomes one space; a null
id stays null; equal rows give equal rows; an empty table gives an empty result; further columns are ignored. Texts are read whole, row by row, without
a shuffle; memory is a small multiple of the longest text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import compress
from math import isqrt

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, table, words

LEAST = 12
#: Words compared at first when a point is extended, and at most.
CHUNK, MOST_CHUNK = 64, 1 << 16
_WORD = re.compile(WORD)


def _grid(a: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """(p, jp) for all grid points of the periods from ``low`` up to ``high`` whose words are equal, in order of p."""
    n, periods, points = len(a), [], []
    if (high - low) * low <= n:  # few periods with many points each
        for p in range(low, high):
            grid = a[::p]
            at = np.flatnonzero(grid[1:] == grid[:-1])
            if len(at):
                periods.append(np.full(len(at), p))
                points.append(at * p)
    else:
        for j in range((n - 1) // low):
            some = min(high, (n - 1) // (j + 1) + 1) - low  # periods with (j+1)p < n
            left = a[j * low : j * (low + some - 1) + 1 : j] if j else a[0]
            right = a[(j + 1) * low : (j + 1) * (low + some - 1) + 1 : j + 1]
            at = np.flatnonzero(right == left) + low
            if len(at):
                periods.append(at)
                points.append(at * j)
    if not periods:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    p, i = np.concatenate(periods), np.concatenate(points)
    order = np.lexsort((i, p))
    return p[order], i[order]


def _steps(a: np.ndarray, p: np.ndarray, i: np.ndarray, way: int, most: int) -> np.ndarray:
    """Number of equal neighbours of every point on one side, ``most`` at most."""
    out, live, n = np.zeros(len(i), np.int64), np.arange(len(i)), len(a)
    for t in range(1, most + 1):
        k = i[live] + way * t
        inside = (k >= 0) & (k + p[live] < n)
        live, k = live[inside], k[inside]
        live = live[a[k] == a[k + p[live]]]
        if not len(live):
            break
        out[live] = t
    return out


def _reach(a: np.ndarray, p: int, i: int) -> tuple[int, int]:
    """First and last-but-one word of the stretch around ``i`` in which words ``p`` apart are equal."""
    n, size, end = len(a), CHUNK, i + 1
    while end + p < n:
        m = min(size, n - p - end)
        differ = np.flatnonzero(a[end : end + m] != a[end + p : end + p + m])
        if len(differ):
            end += int(differ[0])
            break
        end, size = end + m, min(2 * size, MOST_CHUNK)
    start, size = i, CHUNK
    while start > 0:
        m = min(size, start)
        differ = np.flatnonzero(a[start - m : start] != a[start - m + p : start + p])
        if len(differ):
            start -= m - 1 - int(differ[-1])
            break
        start, size = start - m, min(2 * size, MOST_CHUNK)
    return start, end + p


def _settle(settled: bytearray, key: np.ndarray, n: int, s: int, e: int, periods: np.ndarray) -> None:
    """Mark the points of these periods with both words from ``s`` up to ``e``; points go by period and place, so a period's are one slice."""
    for x, y in zip(np.searchsorted(key, periods * n + s).tolist(), np.searchsorted(key, periods * n + np.maximum(e - periods, s)).tolist(), strict=True):
        if x < y:
            settled[x:y] = b"\1" * (y - x)


def find_runs(a: np.ndarray, least: int = LEAST) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of the array, by start and period."""
    n, found = len(a), []
    if n < max(least, 2):
        return []
    low, high = 1, isqrt(n) + 1
    while low <= n // 2:
        high = min(high, n // 2 + 1)
        p, i = _grid(a, low, high)
        if len(p):  # a run of period p needs max(p, least - p) equal neighbours in a row, this point among them
            need = max((least + 1) // 2, low)
            near = np.minimum(np.maximum(p, least - p), need)
            keep = 1 + _steps(a, p, i, 1, min(need, 6)) + _steps(a, p, i, -1, min(need, 6)) >= np.minimum(near, 6)
            p, i = p[keep], i[keep]
        key, settled = p * n + i, bytearray(len(p))
        for s, size, q in found:
            if size > low:
                _settle(settled, key, n, s, s + size, q * np.arange(-(-low // q), (min(high - 1, size) // q) + 1))
        at = settled.find(0)
        while at >= 0:
            q = int(p[at])
            s, e = _reach(a, q, int(i[at]))
            run = e - s >= max(least, 2 * q)
            if run:
                found.append((s, e - s, q))
            settled[at] = 1
            _settle(settled, key, n, s, e, q * np.arange(1, (min(high - 1, e - s) // q if run else 1) + 1))
            at = settled.find(0, at)
        low, high = high, 2 * high
    return sorted(found, key=lambda r: (r[0], r[2]))


def runs_of(text: str | None, least: int = LEAST) -> tuple[list[tuple[int, int, int]], str]:
    """Runs of a text's words, and its words without those after the first period of a run."""
    parts = _WORD.findall(text or "")
    if len(parts) < least:
        return [], " ".join(parts)
    codes = dict.fromkeys(parts)
    if len(codes) == len(parts):
        return [], " ".join(parts)
    codes = dict(zip(codes, range(len(codes)), strict=True))
    runs = find_runs(np.fromiter(map(codes.__getitem__, parts), np.int32, len(parts)), least)
    if not runs:
        return [], " ".join(parts)
    kept = np.ones(len(parts), bool)
    for s, size, q in runs:
        kept[s + q : s + size] = False
    return runs, " ".join(compress(parts, kept.tolist()))


RUNS = "doc_id {}, runs array<struct<start: long, length: long, period: long>>, collapsed string"


def periodic_runs(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST) -> DataFrame:
    """``doc_id, runs, collapsed``, one row per row of ``docs``: its runs by start and period, and the text without their repetitions."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for k in range(0, len(rows), 256):
                part = rows.iloc[k : k + 256]
                runs, texts = zip(*(runs_of(t, least) for t in part["text"]), strict=True)
                yield pd.DataFrame({"doc_id": part["doc_id"].to_numpy(), "runs": runs, "collapsed": texts})

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInPandas(run, RUNS.format(kind))


def repeated_tail(doc_id: Column, text: Column) -> Column:
    """The text; if the id's CRC-32 is divisible by 10, its words from a place on repeat a stretch of them, place and stretch set by the CRC-32."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g, w = F.floor(h / 10), words(text)
    n = F.size(w)
    a = (g % n).cast("int")
    p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
    tail = F.slice(F.flatten(F.array_repeat(F.slice(w, a + 1, p), F.ceil((n - a) / p).cast("int"))), F.lit(1), n - a)
    return F.when((h % 10 == 0) & (n > 0), F.concat_ws(" ", F.slice(w, F.lit(1), a), tail)).otherwise(text)


def op13_periodic_runs(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", repeated_tail(F.col("doc_id"), F.col("text")).alias("text"))
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    text = F.when(F.size("runs") > 0, F.concat(F.array_join(lines, "\n"), F.lit("\n"))).otherwise("")
    out = periodic_runs(docs).withColumn("best", longest)
    return out.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("best.start")).alias("start"), F.col("best.length").alias("length"), (-F.col("best.period")).alias("period"),
        F.floor(1000 * F.col("best.length") / -F.col("best.period")).cast("long").alias("exponent_milli"),
        F.sha2(text, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
