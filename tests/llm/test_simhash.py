import random

import numpy as np
import xxhash

from marlstone.llm import components, simhash


def brute_fingerprint(text):
    import re

    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", lower)
    sh = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(fps, ids):
    parent = list(range(len(fps)))

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= 2:
                parent[find(i)] = find(j)
    out = {}
    for i in range(len(fps)):
        if ids[i] is not None:
            out[find(i)] = min(out.get(find(i), ids[i]), ids[i])
    return [out.get(find(i)) for i in range(len(fps))]


def test_fingerprints():
    for t in ["", None, "one", "One Two", "a b c", "a b c d e É   x", "A b\tc d\ne f g h i j"]:
        assert simhash.fingerprint(t) == brute_fingerprint(t)


def test_edge_rows(edge, none):
    rows = simhash.near_duplicates(edge).collect()
    fps = [np.uint64(r.fp & 0xFFFFFFFFFFFFFFFF) for r in rows]
    want = brute_components([int(x) for x in fps], [r.doc_id for r in rows])
    assert [r.component_id for r in rows] == want and len(rows) == edge.count()
    assert simhash.near_duplicates(none).count() == 0
    kept = simhash.keep_one_of_each(edge)
    assert kept.columns == edge.columns and sorted(x.doc_id for x in kept.collect() if x.doc_id is not None)[:2] == [1, 2]


def test_links_lose_nothing(spark):
    rnd = random.Random(4)
    fps = set()
    for _ in range(12):
        base = rnd.getrandbits(64)
        for _ in range(60):
            x = base
            for b in rnd.sample(range(64), rnd.randint(0, 4)):
                x ^= 1 << b
            fps.add(x)
    fps = sorted(fps)
    signed = [int(np.uint64(x).astype(np.int64)) for x in fps]
    df = spark.createDataFrame([(x,) for x in signed], "fp long")
    links = simhash.links(df)
    assert links.count() <= 65 * len(fps)
    roots = {r.node: r.root for r in components.components(links).collect()}
    mine = [roots.get(x, x) for x in signed]
    want = brute_components(fps, list(range(len(fps))))
    groups = lambda labels: sorted(sorted(i for i, y in enumerate(labels) if y == x) for x in set(labels))
    assert groups(mine) == groups(want)


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(7, i) for i in range(200, 260)] + [(3, 3), (5, 4), (4, 5)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 100 for i in range(100, 161)}, **{i: 7 for i in [7, *range(200, 260)]}, 4: 4, 5: 4}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_one_row_of_each_group_stays(spark, edge, none):
    rows = [(None, "a b c d"), (3, "a b c d"), (3, "a b c d"), (None, "x y z"), (None, "x y z"), (4, "p q r"), (4, "s t u"), (5, "p q r")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for df in (docs, docs.repartition(3)):
        kept = sorted(tuple(r) for r in simhash.keep_one_of_each(df).collect() if r.doc_id is not None)
        assert kept == [(3, "a b c d"), (4, "p q r"), (4, "s t u")]
        assert simhash.keep_one_of_each(df).where("doc_id is null").collect() == [(None, "x y z")]
    groups = set(brute_components([brute_fingerprint(r.text) for r in edge.collect()], list(range(edge.count()))))
    kept = simhash.keep_one_of_each(edge)
    assert kept.columns == edge.columns and kept.count() == len(groups) and simhash.keep_one_of_each(none).count() == 0


def test_crowded_table_entries_lose_nothing(spark):
    """500 fingerprints share a segment, far more than ``CROWD``: their entry is split, and the groups are those of all pairs."""
    rnd = random.Random(11)
    fps = {(0xDEADBEEF << 32) | rnd.getrandbits(32) for _ in range(420)}
    for x in rnd.sample(sorted(fps), 60):  # neighbours at one and two bits, in either segment
        fps.add(x ^ (1 << rnd.randrange(32)))
        fps.add(x ^ (1 << rnd.randrange(32)) ^ (1 << rnd.randrange(32, 64)))
    fps = sorted(fps)
    assert sum(x >> 32 == 0xDEADBEEF for x in fps) > 6 * simhash.CROWD
    signed = [int(np.uint64(x).astype(np.int64)) for x in fps]
    roots = {r.node: r.root for r in components.components(simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long"))).collect()}
    mine, want = [roots.get(x, x) for x in signed], brute_components(fps, list(range(len(fps))))
    groups = lambda labels: sorted(sorted(i for i, y in enumerate(labels) if y == x) for x in set(labels))
    assert groups(mine) == groups(want) and len(set(want)) < len(fps) - 100
