import random
from collections import defaultdict

from pyspark.sql import functions as F

from marlstone.llm import mixing


def greedy(weights, seats, caps):
    got = [0] * len(weights)
    for _ in range(min(seats, sum(caps))):
        open_ = [i for i in range(len(weights)) if got[i] < caps[i]]
        best = max(open_, key=lambda i: (weights[i] / (2 * got[i] + 1), -i))
        got[best] += 1
    return got


def test_sainte_lague_is_the_highest_quotients():
    rnd = random.Random(1)
    for _ in range(300):
        n = rnd.randint(1, 6)
        w = [rnd.choice([1, 2, 3, 0.5, rnd.random() + 0.01]) for _ in range(n)]
        caps = [rnd.randint(0, 30) for _ in range(n)]
        seats = rnd.randint(0, 90)
        assert mixing.sainte_lague(w, seats, caps) == greedy(w, seats, caps)


def test_capped_shares():
    assert mixing.capped_shares(150, [3, 1, 2], [100, 100, 20]) == [97.5, 32.5, 20.0]
    assert mixing.capped_shares(0, [3, 1], [0, 0]) == [0, 0]


def test_mix_of_edge_rows(edge, none):
    rows = mixing.mix_sources(edge).collect()
    assert len(rows) == edge.count() and all(0 <= r.taken <= 2 * r["size"] for r in rows)
    assert {r["size"] for r in rows if r.doc_id in (2, 3, 4)} == {0}
    assert mixing.mix_sources(none).count() == 0 and mixing.cut_mix(none).count() == 0


def test_mix_meets_targets_and_repeats(spark):
    rnd = random.Random(2)
    rows = [(i, " ".join(["w"] * rnd.randint(0, 300)), "en", rnd.choice("aaab") if i % 9 else None, 0) for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    a = mixing.mix_sources(docs).collect()
    assert sorted(a) == sorted(mixing.mix_sources(docs.repartition(3)).collect())
    taken, size, target = defaultdict(int), defaultdict(int), {}
    for r in a:
        taken[r.source] += r.taken
        size[r.source] += r["size"]
        target[r.source] = r.target
    words = defaultdict(int)
    for _, text, _, source, _ in rows:
        words[source] += len(text.split())
    assert all(r.source_size == words[r.source] for r in a) and size == words
    want = mixing.capped_shares(1.5 * sum(size.values()), [3, 1, 2], [2 * size[s] for s in ("a", "b", None)])
    for s, t in zip(("a", "b", None), want, strict=True):
        assert abs(target[s] - t) < 1e-6 and abs(taken[s] - t) <= 0.01 * t + 64
    cut = mixing.cut_mix(docs)
    assert cut.columns == docs.columns
    n = cut.select(F.sum(F.size(F.filter(F.split("text", " "), lambda w: w != "")))).first()[0]
    assert n == sum(r.taken for r in a)


def test_null_and_repeated_ids_are_cut_once(spark):
    rnd = random.Random(3)
    ids = [None if i % 3 == 0 else i // 4 if i % 3 == 1 else i + 1000 for i in range(900)]
    rows = [(d, " ".join(f"d{i}w{j}" for j in range(rnd.randint(0, 200))), rnd.choice("ab")) for i, d in enumerate(ids)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    size, taken = defaultdict(int), defaultdict(int)
    for _, text, source in rows:
        size[source] += len(text.split())
    whole = {text for _, text, _ in rows}
    seen = defaultdict(int)
    for r in mixing.cut_mix(docs).collect():
        taken[r.source] += len(r.text.split())
        seen[r.text.split("w")[0]] += 1
        assert r.text in whole or len({w.split("w")[0] for w in r.text.split()}) == 1
    want = mixing.capped_shares(1.5 * sum(size.values()), [3, 1], [2 * size[s] for s in "ab"])
    for s, t in zip("ab", want, strict=True):
        assert abs(taken[s] - t) <= 0.01 * t + 64
    assert max(seen.values()) <= 2
