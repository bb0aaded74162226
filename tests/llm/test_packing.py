"""Packing against the library's ids and a plain best fit."""

import random
import unicodedata
import zlib
from collections import defaultdict

import numpy as np
import pandas as pd
import pytest

from marlstone.llm import packing, tokens


def plain_fit(lengths, capacity):
    windows = []  # (remaining, time it became so, pieces)
    for t, k in enumerate(sorted(range(len(lengths)), key=lambda k: (-lengths[k], k))):
        fit = [w for w in windows if w[0] >= lengths[k]]
        w = min(fit, key=lambda w: (w[0], -w[1])) if fit else [capacity, 0, []]
        if not fit:
            windows.append(w)
        w[0] -= lengths[k]
        w[1] = t + 1
        w[2].append(k)
    return [w[2] for w in windows]


@pytest.mark.parametrize("capacity", [1, 7, 64, 100, 4096])
def test_best_fit(capacity):
    rng = random.Random(capacity)
    for _ in range(40):
        lengths = [rng.randint(1, capacity) if rng.random() < 0.5 else rng.randint(1, max(1, capacity // 9)) for _ in range(rng.randint(0, 120))]
        assert packing.best_fit(lengths, capacity) == plain_fit(lengths, capacity)


@pytest.mark.parametrize("lengths", [[], [1], [2100] * 40, [4095] * 9, [3000], [4096, 1, 1], [4079] * 5 + [3], list(range(1, 900)), [1] * 5000])
def test_pack_keeps_every_token(lengths):
    sequences, seen = packing.pack(lengths), defaultdict(list)
    for parts in sequences:
        used = sum(b - a for _, a, b in parts)
        assert 0 < used <= 4096 and all(a < b for _, a, b in parts)
        assert 4096 - used <= packing.SLACK or used & (used - 1) == 0
        for k, a, b in parts:
            seen[k].append((a, b))
    assert sorted(seen) == list(range(len(lengths)))
    for k, spans in seen.items():
        assert [x for s in sorted(spans) for x in s] == [0, *(x for x in sorted({b for _, b in spans} | {a for a, _ in spans} - {0}) for x in ([x, x] if x < lengths[k] else [x]))]


def check(rows, docs):
    """``rows`` of the query hold every document's ids, and its sequences are sound; returns the share of padding."""
    tok = tokens.tokenizer("word_bpe_49k.json")
    want = defaultdict(int)
    for doc_id, text in docs:
        ids = np.array([*tok.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        want[doc_id, len(ids), ids.tobytes()] += 1
    by_doc, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        sequences[r.sequence_id].append((r.offset, r.length))
    for (doc_id, n, ids), times in want.items():
        pieces = sorted({(r.start, r.length, r.ids_crc32) for r in by_doc[doc_id] if r.doc_tokens == n})
        assert sum(r.length for r in by_doc[doc_id] if r.doc_tokens == n) >= times * n
        for start, length, crc in pieces:
            assert crc == zlib.crc32(ids[4 * start : 4 * (start + length)])
        if times == 1:
            assert sum(p[1] for p in pieces) == n and [p[0] for p in pieces] == [0, *np.cumsum([p[1] for p in pieces])[:-1].tolist()]
    assert sum(r.length for r in rows) == sum(n * t for (_, n, _), t in want.items())
    padding = 0
    for parts in sequences.values():
        parts.sort()
        used = sum(n for _, n in parts)
        assert [o for o, _ in parts] == [0, *np.cumsum([n for _, n in parts])[:-1].tolist()] and used <= 4096
        padding += 0 if used & (used - 1) == 0 else 4096 - used
    return padding / max(1, sum(r.length for r in rows))


def test_query(spark, sf):
    docs = pd.read_parquet(f"{sf}/documents.parquet", columns=["doc_id", "text"])
    rows = packing.op12_packing(spark, sf).collect()
    assert check(rows, list(docs.itertuples(index=False, name=None))) < 0.004
    assert rows == packing.op12_packing(spark, sf).collect() or sorted(map(tuple, rows)) == sorted(map(tuple, packing.op12_packing(spark, sf).collect()))


def test_edge_rows(spark, edge, tmp_path):
    edge.write.parquet(f"{tmp_path}/documents.parquet")
    docs = [tuple(r) for r in edge.select("doc_id", "text").collect()]
    check(packing.op12_packing(spark, str(tmp_path)).collect(), docs)


def test_small_groups(spark):
    docs = spark.createDataFrame([(str(i), f"w{i} " * (i * 37 % 900)) for i in range(120)], "name string, body string")
    out = packing.pack_documents(docs, id_col="name", text_col="body", capacity=256, slack=4, group_tokens=5_000).collect()
    used = defaultdict(int)
    for r in out:
        used[r.sequence_id] += r.length
        assert len(r.ids) == 4 * r.length
    assert all(256 - n <= 4 or n & (n - 1) == 0 for n in used.values())
    got = {i: b"".join(bytes(r.ids) for r in sorted((r for r in out if r.doc_id == str(i)), key=lambda r: r.start)) for i in range(120)}
    own = packing.Ids(tokens.tokenizer("word_bpe_49k.json"))
    assert got == {i: own.of(f"w{i} " * (i * 37 % 900)) + b"\2\0\0\0" for i in range(120)}


def test_empty(none):
    assert packing.pack_documents(none).count() == 0


def test_written_rules_are_the_library():
    """Every character below KNOWN, alone, among letters and between spaces; and texts that only the library handles."""
    own = packing.Ids(tokens.tokenizer("word_bpe_49k.json"))
    ids = lambda t: np.array(own.tok.encode(t, add_special_tokens=False).ids, "<u4").tobytes()
    for c in map(chr, range(tokens.KNOWN)):
        if unicodedata.category(c) != "Cs":
            for t in (c, f"a{c}B", f" {c} 1{c}{c}' {c}", f"'{c}s {c}'s"):
                assert own.of(t) == ids(t), t
    for t in ("It's we'RE 12 a.b!'s", "<|endoftext|> x <|startoftext|>", "ΑΣ ΟΔΟΣ", "é a", "字 \U0001f600", "\x1c\x85\xa0 a b", "İI", ""):
        assert own.of(t) == ids(t), t


def test_slices():
    text = " ".join(f"word{i} é'S <|endoftext|>" for i in range(3_000)) + "\n\n" + "x" * 5_000 + " " + " " * 900 + "end"
    own = packing.Ids(tokens.tokenizer("word_bpe_49k.json"))
    parts = list(packing.slices(text, 100))
    assert "".join(parts) == text and len(parts) > 500
    assert b"".join(map(own.of, parts)) == np.array(own.tok.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
