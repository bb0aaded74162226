import numpy as np
from pyspark.sql import functions as F

from marlstone.llm import ann


def brute(ids, vectors, q_id, q, k):
    rows = [(-round(float(np.dot(v, q) / np.linalg.norm(v) / np.linalg.norm(q)), 12), i) for i, v in zip(ids, vectors, strict=True) if i != q_id]
    return sorted(rows)[:k]


def clustered(n, size=4, centres=20):
    rng = np.random.default_rng(7)
    return rng.normal(size=(centres, size))[rng.integers(centres, size=n)] + rng.normal(size=(n, size)) * 0.05


def test_factor_one_is_exact_and_larger_ones_skip():
    x = clustered(3000)
    shard = ann.Shard(np.arange(3000), x, 5)
    found, seen = shard.nearest(np.arange(50), x[:50], 1.0)
    got = {q: [(-round(s, 12), i) for a, i, s in found if a == q] for q in range(50)}
    assert all(got[q] == brute(range(3000), x, q, x[q], 5) for q in range(50))
    less, fewer = shard.nearest(np.arange(50), x[:50], 4.0)
    assert fewer < seen < 50 * 3000
    assert len({r[:2] for r in less} & {r[:2] for r in found}) >= 0.5 * 250  # factor 4, far from the default


def test_parallel_vectors_are_ranked_by_id(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(300, 5))
    rows = [(1000 + i, [float(y) for y in v]) for i, v in enumerate(x)]
    rows += [(i, [float(y) * 2.0**i for y in x[50]]) for i in range(40)]  # 40 multiples of one vector
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for factor in (1.0, 4.0):
        out = ann.search(df, df.where("vec_id = 1050"), factor=factor).orderBy("rank").collect()
        assert [r.vec_id for r in out] == [0, 1, 2, 3, 4]
        assert [r.vec_id for r in ann.search(df, df.where("vec_id = 2"), factor=factor).orderBy("rank").collect()] == [0, 1, 3, 4, 5]


def test_shards_blocks_and_centres_change_nothing(spark):
    x = clustered(2000)
    df = spark.createDataFrame([(i, [float(y) for y in v]) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    asked = df.where("vec_id % 50 = 0")
    out = ann.search(df, asked, factor=1.0, rows_per_centre=100, pivots=64, shard_values=400, block_rows=7).collect()
    got = {}
    for r in out:
        got.setdefault(r.query_id, []).append((-round(r.score, 12), r.vec_id))
    assert len(got) == 40 and all(sorted(got[q]) == brute(range(2000), x, q, x[q], 5) for q in got)


def test_rows(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(400, 6)).round(2)
    rows = [(i, [float(y) for y in v]) for i, v in enumerate(x)]
    rows += [(1000 + i, rows[50][1]) for i in range(150)]  # copies of one vector
    rows += [(2000, None), (2050, []), (2100, [0.0] * 6), (2150, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (2200, [float("nan")] * 6), (2250, [float("inf")] + [0.0] * 5)]
    rows += [(None, rows[3][1]), rows[7], rows[7], (3000, [1.0, 2.0])]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "vec_id long, embedding array<double>, score string")
    out = ann.search(df, df.where(F.col("vec_id") % 50 == 0), factor=1.0)
    got = {}
    for r in out.collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    good = [(i, v) for i, v in rows if i is not None and v and len(v) == 6 and all(y is not None and np.isfinite(y) for y in v) and any(v)]
    queries = {i: v for i, v in good if i % 50 == 0}
    assert set(got) == set(queries)
    for q, v in queries.items():
        want = brute([i for i, _ in good], [np.array(y) for _, y in good], q, np.array(v), 5)
        mine = sorted(got[q])
        assert [m[0] for m in mine] == [1, 2, 3, 4, 5]
        assert np.allclose([m[2] for m in mine], [-w[0] for w in want])
        if q in (50, 1000):
            assert [m[1] for m in mine] == sorted(i for i, y in good if y == v and i != q)[:5]
    assert ann.search(df.limit(0), df.limit(0)).count() == 0


def test_recall_of_the_query(spark, sf):
    df = spark.read.parquet(f"{sf}/embeddings.parquet")
    rows = df.collect()
    x = np.array([r.embedding for r in rows], float)
    ids = [r.vec_id for r in rows]
    got = {}
    for r in ann.op6_vp_trees(spark, sf).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    hit = [len(got[i] & {w[1] for w in brute(ids, x, i, v, 5)}) for i, v in zip(ids, x, strict=True) if i % 50 == 0]
    assert sum(hit) / (5 * len(hit)) >= 0.9


def recall_and_short(spark, x, **options):
    n = len(x)
    df = spark.createDataFrame([(i, [float(y) for y in v]) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {}
    for r in ann.search(df, df.where("vec_id % 50 = 0"), **options).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    u = x / np.linalg.norm(x, axis=1)[:, None]
    asked = np.arange(0, n, 50)
    scores = u[asked] @ u.T
    scores[np.arange(len(asked)), asked] = -2
    true = np.argsort(-scores, axis=1)[:, :5]
    return sum(len(got.get(q, set()) & set(t)) for q, t in zip(asked.tolist(), true.tolist(), strict=True)) / true.size, sum(len(got.get(q, ())) < 5 for q in asked.tolist())


def test_recall_at_the_default_factor(spark):
    for x in (clustered(10_000, 8), np.random.default_rng(5).normal(size=(10_000, 8)), clustered(10_000, 4)):
        for options in ({}, {"rows_per_centre": 200}):
            recall, short = recall_and_short(spark, x, **options)
            assert recall >= 0.9 and not short, (recall, short)


def test_every_query_has_all_its_rows_at_any_factor(spark):
    x = clustered(3_000, 8)
    recall, short = recall_and_short(spark, x, factor=50.0, rows_per_centre=100, pivots=300)
    assert not short and recall < 1
    few = spark.createDataFrame([(i, [1.0, float(i)]) for i in range(3)] + [(0, [2.0, 0.0]), (7, [1.0, 2.0, 3.0])], "vec_id long, embedding array<double>")
    out = sorted((r.query_id, r["rank"], r.vec_id) for r in ann.search(few, few).collect())
    assert out == [(0, 1, 1), (0, 2, 2), (1, 1, 2), (1, 2, 0), (1, 3, 0), (2, 1, 1), (2, 2, 0), (2, 3, 0)]
