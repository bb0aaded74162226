"""The prefix trie against a dictionary of prefixes."""

import hashlib
import zlib
from collections import defaultdict

import pytest

from marlstone.llm import trie

CHATS = "conv_id long, turn long, role string, text string, depth string, owner string"


def ordered(rows):
    out = defaultdict(list)
    for c, turn, role, text, *_ in rows:
        if c is not None:
            out[c].append((turn is not None, turn or 0, role or "", text or ""))
    return {c: [t[2:] for t in sorted(v)] for c, v in out.items()}


def rebuild(convs):
    out = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (abs(c) % 5) * (1 if c > 0 else -1)
        out[c] = convs.get(base, [])[:h] + own[h:]
    return out


def plain(convs):
    members, ends = defaultdict(list), defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
        ends[tuple(turns)].append(c)
    out = []
    for node, who in members.items():
        below = [n for n in members if n[: len(node)] == node]
        out.append((
            min(who), len(node), min(members[node[:-1]]) if node else None, len(who), sum(len(n) == len(node) + 1 for n in below),
            sum(not any(len(m) == len(n) + 1 and m[:-1] == n for m in below) for n in below),
            sum((len(members[n]) - 1) * len(n[-1][1].encode()) for n in below if n),
            hashlib.sha256(",".join(map(str, sorted(ends[node]))).encode()).hexdigest(),
        ))
    return sorted(out, key=repr)


COLUMNS = "conv_id depth parent_conv_id n_convs n_children n_leaves saved_tokens ends_sha256".split()


def got(df):
    return sorted((tuple(r) for r in df.select(*COLUMNS).collect()), key=repr)


ROWS = [
    *[(c, t, "user", f"t{t}", "x", "y") for c in range(7) for t in range(c % 4 + 1)],
    (10, None, None, None, None, None), (10, 1, "user", "é", None, None), (10, 1, "user", "é", None, None), (10, 1, "user", "a", None, None),
    (11, 1, "user", "t0", None, None), (12, 1, "", "", None, None), (-7, 0, "user", "t0", None, None), (-5, 0, "user", "t0", None, None),
    (None, 0, "user", "t0", None, None), (23, 0, "user", "alone", None, None), (900719925474099300, 0, "user", "t0", None, None),
]


def test_given_and_rebuilt(spark):
    df = spark.createDataFrame(ROWS, CHATS)
    assert got(trie.conversation_trie(df)) == plain(ordered(ROWS))
    turns, convs = trie.rebuilt(trie.ordered_turns(df))
    assert got(trie.prefix_trie(turns, convs)) == plain(rebuild(ordered(ROWS)))


def test_small_blocks_and_pieces(spark, monkeypatch):
    """Conversations that span blocks, lists that span pieces and batches, each conversation one turn longer than the one before."""
    monkeypatch.setattr(trie, "BLOCK", 3)
    monkeypatch.setattr(trie, "PIECE", 2)
    rows = [(c, t, "user", f"t{t}", None, None) for c in range(1, 24) for t in range(c)] + [(50 + c, t, "user", "t0", None, None) for c in range(9) for t in range(2)]
    df = spark.createDataFrame(rows, CHATS).repartition(5)
    assert got(trie.conversation_trie(df)) == plain(ordered(rows))
    turns, convs = trie.rebuilt(trie.ordered_turns(df))
    assert got(trie.prefix_trie(turns, convs)) == plain(rebuild(ordered(rows)))


def test_one_long_conversation(spark):
    """A conversation with nearly all rows is spread over tasks and blocks."""
    n = 5_000
    long = spark.range(n).selectExpr("7L as conv_id", "id as turn", "'user' as role", "concat('t', id) as text")
    short = spark.createDataFrame([(8, 0, "user", "t0"), (9, 0, "user", "t0"), (9, 1, "user", "t1")], "conv_id long, turn long, role string, text string")
    out = {(r.conv_id, r.depth): r for r in trie.conversation_trie(long.union(short)).collect()}
    assert len(out) == n + 1  # all in one path
    assert (out[7, 0].n_convs, out[7, 1].n_convs, out[7, 2].n_convs, out[7, 3].n_convs) == (3, 3, 2, 1)
    assert {r.n_leaves for r in out.values()} == {1}
    assert (out[7, 0].saved_tokens, out[7, 2].saved_tokens, out[7, 3].saved_tokens) == (2 * 2 + 2, 2, 0)


def test_empty(spark):
    df = spark.createDataFrame([], CHATS)
    assert got(trie.conversation_trie(df)) == []
    assert trie.prefix_trie(*trie.rebuilt(trie.ordered_turns(df))).count() == 0


def test_equal_digests_are_an_error(spark):
    """A digest that two different prefixes share is found out."""
    p = spark.createDataFrame(
        [(1, 1, 5, 5, 0, 0, b"a", 1, True), (2, 1, 5, 5, 0, 0, b"b", 1, True)], "conv_id long, depth long, x1 long, x2 long, y1 long, y2 long, sha binary, n_bytes long, ends boolean"
    )
    with pytest.raises(Exception, match="two prefixes have one digest"):
        trie.minima(p)
