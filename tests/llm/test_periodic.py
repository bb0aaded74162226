"""Periodic runs against all periods at all places."""

import hashlib
import re
import zlib

import numpy as np
import pandas as pd
from hypothesis import given, settings
from hypothesis import strategies as st

from marlstone.llm import periodic
from marlstone.llm.common import WORD


def all_runs(a, least=12):
    """Every period over the whole array: stretches of words equal to those p on; the smallest period of a stretch counts."""
    n, out = len(a), {}
    for p in range(1, n // 2 + 1):
        flags = np.concatenate([[0], (a[p:] == a[:-p]).astype(np.int8), [0]])
        edges = np.flatnonzero(np.diff(flags))
        for s, e in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
            if e + p - s >= max(least, 2 * p):
                out.setdefault((s, e + p), p)
    return sorted((s, e - s, p) for (s, e), p in out.items())


@settings(max_examples=400, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=80), st.lists(st.tuples(st.integers(0, 79), st.integers(1, 30), st.integers(0, 79)), max_size=3), st.sampled_from([2, 5, 12]))
def test_finds_all(words, copies, least):
    for s, p, e in copies:
        for i in range(s + p, min(e, len(words))):
            words[i] = words[i - p]
    a = np.array(words, np.int32)
    assert periodic.find_runs(a, least) == all_runs(a, least)


def test_long_and_nested():
    rng = np.random.default_rng(3)
    line = rng.integers(0, 50, 700)
    inner = np.concatenate([np.tile(line[:20], 4), line])
    a = np.concatenate([rng.integers(0, 50, 3_000), np.tile(inner, 5)[:-9], np.zeros(2_000, int), rng.integers(0, 3, 4_000)])
    assert periodic.find_runs(a) == all_runs(a)
    assert periodic.find_runs(np.zeros(300_000, np.int32)) == [(0, 300_000, 1)]  # every point of every grid is equal
    fib = ["a", "ab"]
    while len(fib[-1]) < 3_000:
        fib.append(fib[-1] + fib[-2])
    word = np.frombuffer(fib[-1].encode(), np.uint8)  # the word richest in runs
    assert periodic.find_runs(word) == all_runs(word)


def expected(doc_id, text):
    parts = re.findall(WORD, text or "")
    n = len(parts)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        parts = [parts[i if i < a else a + (i - a) % p] for i in range(n)]
    runs = all_runs(np.unique(np.array(parts, object), return_inverse=True)[1]) if parts else []
    dropped = {i for s, size, q in runs for i in range(s + q, s + size)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else None
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (
        doc_id, len(runs), *((best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4),
        sha("".join(f"{s},{size},{q}\n" for s, size, q in runs)), sha(" ".join(w for i, w in enumerate(parts) if i not in dropped)),
    )


COLUMNS = "doc_id n_runs start length period exponent_milli runs_sha256 collapsed_sha256".split()


def same(df, rows):
    got = sorted((tuple(r) for r in df.select(*COLUMNS).collect()), key=repr)
    assert got == sorted((expected(*r) for r in rows), key=repr)


def test_query(spark, sf):
    rows = pd.read_parquet(f"{sf}/documents.parquet", columns=["doc_id", "text"]).itertuples(index=False, name=None)
    same(periodic.op13_periodic_runs(spark, sf), list(rows))


def test_edge_rows(spark, edge, tmp_path):
    edge.write.parquet(f"{tmp_path}/documents.parquet")
    rows = [tuple(r) for r in edge.select("doc_id", "text").collect()]
    same(periodic.op13_periodic_runs(spark, str(tmp_path)), rows)
    # ids whose texts the query makes periodic, over the same texts
    planted = [i for i in range(200) if zlib.crc32(str(i).encode()) % 10 == 0]
    rows = [(i, t) for i in planted[:6] for t in (None, "", " \n ", "one", "a b c a b c a b c", "é\x00 字 \U0001f600 " * 9, "x y " * 4_000)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/more/documents.parquet")
    same(periodic.op13_periodic_runs(spark, f"{tmp_path}/more"), rows)


def test_operator(spark, none):
    docs = spark.createDataFrame([("k", "so \t " + "a b\n" * 7 + "end"), ("z", None)], "name string, body string")
    got = {r.doc_id: r for r in periodic.periodic_runs(docs, id_col="name", text_col="body").collect()}
    assert [tuple(x) for x in got["k"].runs] == [(1, 14, 2)] and got["k"].collapsed == "so a b end"
    assert got["z"].runs == [] and got["z"].collapsed == ""
    assert periodic.periodic_runs(none).count() == 0
