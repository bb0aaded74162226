"""Prefix trie of conversations: which first turns conversations share, and what sharing them saves.

Conversations with the same first d turns (role and text) meet in one node of depth d; the root holds all of them. A node is named by its smallest
member and its depth, and the members' digests of their first d turns are its key. A conversation *owns* the nodes whose smallest member it is. As members
only drop out on the way down, it owns all its nodes from some depth on: one chain. So the trie is a tree of chains, one per conversation at most:

* ``P``: a row per conversation and depth with the digest of the prefix. Digests are running XORs of salted hashes of the turns, so that a
  conversation of any length is cut into blocks of ``BLOCK`` turns whose totals are combined, and no task holds it whole.
* ``M``: the nodes; one aggregate of ``P`` by depth and digest gives members and the smallest one (the minima).
* Every conversation's first owned depth by binary search: a round joins the middles of all open intervals with the minima by (owner, depth), which no
  two rows share, so no key of the join is busy. Closed intervals leave the loop.
* A chain is summed from its end up, within the conversation that owns it (again by blocks). Its total then goes to every node above its top. Those are the
  nodes of its own conversation's first turns, so one aggregate of ``P`` adds all chains to all nodes above them, however deep chains hang on chains.

Equal digests are never trusted: a node also compares the 128-bit SHA-256 parts of its members' last turns and the digests one turn before, and a difference is an error.
By induction on the depth members of a node have equal turns.

Defined results: rows without a conversation id take no part; a null role or text is empty; turns go by number (null first), then by role and
text, and equal rows are turns of their own; ids are compared as numbers; an empty table has no node, not even a root; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, table

#: Turns of a conversation that one window holds; conversation ids in one piece of a list.
BLOCK, PIECE = 1024, 4096
KEY = ["depth", "x1", "x2"]


def ordered_turns(rows: DataFrame) -> DataFrame:
    """``conv_id, pos, sha, n_bytes``: the turns of every conversation numbered from 0, the digest of role and text, the bytes of the text.

    Sorted by ranges, so that a conversation may spread over many tasks; its rows in earlier ranges are counted.
    """
    by = ["conv", "turn", "role", "text"]
    plain = rows.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv"), "turn", *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text"))
    )
    sha = F.unhex(F.substring(F.sha2(F.concat_ws(":", F.length("role"), "role", "text"), 256), 1, 32))
    at = materialize(
        plain.repartitionByRange(*by)
        .sortWithinPartitions(*by)
        .select("conv", F.monotonically_increasing_id().alias("at"), sha.alias("sha"), F.octet_length("text").cast("long").alias("n_bytes")),
        "turns",
    ).withColumn("part", F.shiftright("at", 33))
    parts = at.groupBy("conv", "part").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    before = Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row per range
    parts = parts.select("conv", "part", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("shift"))
    return materialize(at.join(parts, ["conv", "part"]).select(F.col("conv").alias("conv_id"), (F.col("at") + F.col("shift")).alias("pos"), "sha", "n_bytes"), "positions")


def running(rows: DataFrame, key: str, at: str, columns: dict[str, Column], combine, *, backwards: bool = False) -> DataFrame:
    """``rows`` with running values of ``columns`` per ``key`` in the order of ``at``, its own row included; from the end if ``backwards``.

    ``combine`` is an aggregate function; its value over blocks of ``BLOCK`` numbers is combined with that over the blocks before. ``rows`` are read twice.
    """
    block = F.floor(F.col(at) / BLOCK)
    order = (lambda c: F.col(c).desc()) if backwards else F.col
    own = rows.withColumn("_block", block)
    lane = Window.partitionBy(key, "_block").orderBy(order(at)).rowsBetween(Window.unboundedPreceding, 0)
    out = own.withColumns({name: combine(value).over(lane) for name, value in columns.items()})
    long = own.where(F.col("_block") > 0).select(key).distinct()
    totals = own.join(long, key, "left_semi").groupBy(key, "_block").agg(*(combine(v).alias(f"_{n}") for n, v in columns.items()))
    before = Window.partitionBy(key).orderBy(order("_block")).rowsBetween(Window.unboundedPreceding, -1)  # a row per block
    totals = totals.withColumns({f"_{n}": combine(F.col(f"_{n}")).over(before) for n in columns})
    out = out.join(totals, [key, "_block"], "left")
    both = lambda a, b: F.when(F.col(b).isNull(), F.col(a)).otherwise(F.col(a).bitwiseXOR(F.col(b)) if combine is F.bit_xor else F.col(a) + F.col(b))
    return out.select(*rows.columns, *(both(n, f"_{n}").alias(n) for n in columns))


def prefixes(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """``P``: conversation, depth, digest (x1, x2), that of one turn less (y1, y2), last turn's digest and bytes, whether it ends here."""
    salted = turns.withColumns({f"z{i}": F.xxhash64(F.lit(i), "pos", "sha") for i in (1, 2)})
    x = running(salted, "conv_id", "pos", {"x1": F.col("z1"), "x2": F.col("z2")}, F.bit_xor)
    x = x.select(
        "conv_id", (F.col("pos") + 1).alias("depth"), "x1", "x2", F.col("x1").bitwiseXOR(F.col("z1")).alias("y1"), F.col("x2").bitwiseXOR(F.col("z2")).alias("y2"),
        "sha", "n_bytes", (F.col("pos") + 1 == F.col("length")).alias("ends"),
    )
    zero = F.lit(0).cast("long")
    root = convs.select("conv_id", *(zero.alias(c) for c in ("depth", "x1", "x2", "y1", "y2")), F.unhex(F.lit("")).alias("sha"), zero.alias("n_bytes"), (F.col("length") == 0).alias("ends"))
    return materialize(x.unionByName(root), "prefixes")


def minima(p: DataFrame) -> DataFrame:
    """``M``: a row per node: members, smallest member, digest one turn before, bytes of the last text."""
    same = [F.min(c) == F.max(c) for c in ("sha", "y1", "y2", "n_bytes")]
    grouped = p.groupBy(*KEY).agg(
        F.min("conv_id").alias("owner"), F.count("*").alias("n_convs"), F.min("y1").alias("y1"), F.min("y2").alias("y2"), F.max("n_bytes").alias("n_bytes"),
        (same[0] & same[1] & same[2] & same[3]).alias("same"),
    )
    sure = F.when(F.col("same"), F.col("n_convs")).otherwise(F.raise_error(F.lit("two prefixes have one digest")).cast("long"))
    return materialize(grouped.withColumn("n_convs", sure).drop("same"), "nodes")


def first_owned(convs: DataFrame, nodes: DataFrame) -> DataFrame:
    """``conv_id, first``: the least depth at which a conversation is its node's smallest member; without one, its length plus 1.

    Binary search for all conversations at once: ``low`` to ``high`` holds the answer; a round tests the middle.
    """
    owned = nodes.select(F.col("owner").alias("conv_id"), F.col("depth").alias("mid"))
    middle = F.floor((F.col("low") + F.col("high")) / 2).cast("long")
    open_, done = convs.select("conv_id", F.lit(0).cast("long").alias("low"), (F.col("length") + 1).alias("high")), None
    longest = convs.agg(F.max("length")).first()[0] or 0
    for _ in range((longest + 1).bit_length()):
        asked = open_.withColumn("mid", middle)
        hits = owned.join(asked.select("conv_id", "mid"), ["conv_id", "mid"], "left_semi").withColumn("hit", F.lit(True))
        told = asked.join(hits, ["conv_id", "mid"], "left")
        step = materialize(
            told.select("conv_id", F.when(F.col("hit"), F.col("low")).otherwise(F.col("mid") + 1).alias("low"), F.when(F.col("hit"), F.col("mid")).otherwise(F.col("high")).alias("high")), "search"
        )
        closed = step.where(F.col("low") >= F.col("high"))
        done = closed if done is None else done.unionByName(closed)
        open_ = step.where(F.col("low") < F.col("high"))
    if done is None:
        done = open_.limit(0)
    return done.select("conv_id", F.col("low").alias("first"))


def _runs(rows: pd.DataFrame) -> Iterator[tuple[int, int]]:
    """Bounds of stretches of rows with one key."""
    k = rows[KEY].to_numpy()
    edges = np.flatnonzero((k[1:] != k[:-1]).any(axis=1)) + 1
    yield from zip([0, *edges.tolist()], [*edges.tolist(), len(rows)], strict=True)


def _pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sorted (key, conv_id) to (key, first id, ids joined): at most PIECE ids in a piece."""
    for rows in batches:
        out = []
        if len(rows):
            for a, b in _runs(rows):
                ids = rows["conv_id"].iloc[a:b].tolist()
                key = tuple(rows[c].iloc[a] for c in KEY)
                out += [(*key, ids[i], ",".join(map(str, ids[i : i + PIECE]))) for i in range(0, len(ids), PIECE)]
        yield pd.DataFrame(out, columns=[*KEY, "id", "ids"])


def _hashes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sorted pieces to (key, digest of all ids): a key's pieces may come in several batches and are never held together."""
    key, sha = None, None
    for rows in batches:
        out = []
        for *k, ids in zip(*(rows[c] for c in KEY), rows["ids"], strict=True):
            if k == key:
                sha.update(b",")
            else:
                if key is not None:
                    out.append((*key, sha.hexdigest()))
                key, sha = k, hashlib.sha256()
            sha.update(ids.encode())
        yield pd.DataFrame(out, columns=[*KEY, "ends_sha256"])
    if key is not None:
        yield pd.DataFrame([(*key, sha.hexdigest())], columns=[*KEY, "ends_sha256"])


def end_digests(p: DataFrame) -> DataFrame:
    """Digest of the ids of the conversations that end at a node, in order, a row per node with such.

    Ids are sorted by ranges and joined to pieces there; only pieces of one node meet in a task, which reads them one after the other.
    """
    form = "depth long, x1 long, x2 long, "
    ends = p.where("ends").select(*KEY, "conv_id").repartitionByRange(*KEY, "conv_id").sortWithinPartitions(*KEY, "conv_id")
    pieces = ends.mapInPandas(_pieces, form + "id long, ids string")
    return pieces.repartition(*KEY).sortWithinPartitions(*KEY, "id").mapInPandas(_hashes, form + "ends_sha256 string")


def prefix_trie(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """A row per node: ``conv_id`` (smallest member), ``depth``, ``parent_conv_id``, ``n_convs``, ``n_children``, ``n_leaves``, ``saved_tokens``, ``ends_sha256``.

    ``turns`` has conv_id, pos (from 0 without gaps), sha, n_bytes and length (of the conversation); ``convs`` every conv_id, once, and its length, which may be 0.
    """
    p = prefixes(turns, convs)
    nodes = minima(p)
    # A root's key is that of no child: its depth is 0.
    parent = [(F.col("depth") - 1).alias("depth"), F.col("y1").alias("x1"), F.col("y2").alias("x2")]
    children = nodes.where("depth > 0").groupBy(*parent).agg(F.count("*").alias("n_children"))
    own = nodes.join(children, KEY, "left").fillna(0, ["n_children"])
    own = materialize(own.withColumns({"saved": (F.col("n_convs") - 1) * F.col("n_bytes"), "leaf": (F.col("n_children") == 0).cast("long")}), "own")
    tops = first_owned(convs, nodes)
    chains = own.groupBy(F.col("owner").alias("conv_id")).agg(F.sum("saved").alias("saved"), F.sum("leaf").alias("leaves")).join(tops, "conv_id")
    above = p.select("conv_id", *KEY).join(materialize(chains, "chains"), "conv_id").where(F.col("depth") < F.col("first"))
    above = above.groupBy(*KEY).agg(F.sum("saved").alias("above_saved"), F.sum("leaves").alias("above_leaves"))
    below = running(own, "owner", "depth", {"saved_tokens": F.col("saved"), "n_leaves": F.col("leaf")}, F.sum, backwards=True)
    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("x1").alias("y1"), F.col("x2").alias("y2"), F.col("owner").alias("parent_conv_id"))
    below = materialize(below.join(parents, ["depth", "y1", "y2"], "left"), "chained")
    out = below.join(above, KEY, "left").join(end_digests(p), KEY, "left")
    plus = lambda a, b: (F.col(a) + F.coalesce(b, F.lit(0))).cast("long")
    return out.select(
        F.col("owner").alias("conv_id"), "depth", "parent_conv_id", "n_convs", "n_children",
        plus("n_leaves", "above_leaves").alias("n_leaves"), plus("saved_tokens", "above_saved").alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"),
    )


def conversation_trie(rows: DataFrame) -> DataFrame:
    """The trie of conversations as they are: ``rows`` has conv_id, turn, role, text."""
    turns = ordered_turns(rows)
    convs = materialize(turns.groupBy("conv_id").agg(F.count("*").alias("length")), "convs")
    return prefix_trie(materialize(turns.join(convs, "conv_id"), "turns"), convs)


def rebuilt(turns: DataFrame, *, every: int = 5, most: int = 9) -> tuple[DataFrame, DataFrame]:
    """(turns, convs): every conversation starts with the first h turns of its group's first one, in place of its own first h.

    The group's first is the id less its remainder by ``every``; h is the id's CRC-32 modulo ``most``.
    """
    sizes = turns.groupBy("conv_id").agg(F.count("*").alias("n"))
    bases = sizes.select(F.col("conv_id").alias("base"), F.col("n").alias("n_base"))
    own = sizes.withColumns({"base": F.col("conv_id") - F.col("conv_id") % every, "h": F.crc32(F.col("conv_id").cast("string").cast("binary")) % most})
    own = own.join(bases, "base", "left").withColumn("lent", F.least("h", F.coalesce("n_base", F.lit(0))))
    convs = materialize(own.withColumn("length", F.col("lent") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).drop("n", "n_base"), "convs")
    lent = turns.where((F.col("pos") < most - 1) & (F.col("conv_id") % every == 0)).withColumnRenamed("conv_id", "base")
    heads = lent.join(convs, "base").where(F.col("pos") < F.col("h")).select("conv_id", "pos", "sha", "n_bytes", "length")
    tails = turns.join(convs, "conv_id").where(F.col("pos") >= F.col("h"))
    tails = tails.select("conv_id", (F.col("pos") - F.col("h") + F.col("lent")).alias("pos"), "sha", "n_bytes", "length")
    return materialize(heads.unionByName(tails), "rebuilt"), convs


def op11_prefix_trie(spark, sf_dir: str) -> DataFrame:
    return prefix_trie(*rebuilt(ordered_turns(table(spark, sf_dir, "conversations"))))


#: ``op11_prefix_trie``: CRC-32 bit by bit over the id's decimals; prefixes as lists of turns. A node's subtree: the nodes whose smallest member passes through it.
OP11_SQL = """
  WITH t AS (SELECT conv_id AS c, coalesce(role, '') AS role, coalesce("text", '') AS body,
      row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce("text", '')) - 1 AS pos
    FROM conversations WHERE conv_id IS NOT NULL),
  sizes AS (SELECT c, count(*) AS n, CAST(c AS VARCHAR) AS d FROM t GROUP BY c),
  hashed AS (SELECT c, n, c - c % 5 AS base, xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)],
      flatten(list_transform(range(1, length(d) + 1), lambda i: [CAST(ascii(substr(d, i, 1)) AS BIGINT), 0, 0, 0, 0, 0, 0, 0]))),
      lambda s, b: xor(xor(s, b) >> 1, (xor(s, b) & 1) * 3988292384)), 4294967295) % 9 AS h FROM sizes),
  convs AS (SELECT x.c, x.base, x.h, least(x.h, coalesce(b.n, 0)) AS lent FROM hashed x LEFT JOIN sizes b ON b.c = x.base),
  r AS (SELECT v.c, t.pos, t.role, t.body FROM convs v JOIN t ON t.c = v.base AND t.pos < v.h
    UNION ALL SELECT v.c, t.pos - v.h + v.lent, t.role, t.body FROM convs v JOIN t ON t.c = v.c AND t.pos >= v.h),
  p AS (SELECT c, pos + 1 AS depth, sha256(CAST(list({'role': role, 'body': body}) OVER (PARTITION BY c ORDER BY pos) AS VARCHAR)) AS k, strlen(body) AS bytes FROM r
    UNION ALL SELECT c, 0, '', 0 FROM convs),
  q AS (SELECT *, depth = max(depth) OVER (PARTITION BY c) AS ends, lag(k) OVER (PARTITION BY c ORDER BY depth) AS before FROM p),
  nodes AS (SELECT depth, k, min(before) AS before, min(c) AS owner, count(*) AS n_convs, (count(*) - 1) * min(bytes) AS saved,
      sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (ends), '')) AS ends_sha256 FROM q GROUP BY depth, k),
  kids AS (SELECT depth - 1 AS depth, before AS k, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY ALL),
  full_nodes AS (SELECT n.*, coalesce(kids.n, 0) AS n_children FROM nodes n LEFT JOIN kids ON kids.depth = n.depth AND kids.k = n.k),
  sums AS (SELECT p.depth, p.k, sum(f.saved) AS saved, count(*) FILTER (f.n_children = 0) AS leaves
    FROM full_nodes f JOIN p ON p.c = f.owner AND p.depth <= f.depth GROUP BY p.depth, p.k)
  SELECT f.owner AS conv_id, CAST(f.depth AS BIGINT) AS depth, up.owner AS parent_conv_id, f.n_convs, f.n_children, s.leaves AS n_leaves,
    CAST(s.saved AS BIGINT) AS saved_tokens, f.ends_sha256
  FROM full_nodes f JOIN sums s ON s.depth = f.depth AND s.k = f.k LEFT JOIN nodes up ON up.depth = f.depth - 1 AND up.k = f.before"""
