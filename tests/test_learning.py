"""Similar rows, reward fits, rollouts, batches, adapters and as-of examples against plain Python."""

import math

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from marlstone.operators import adapters, asof, batches, order, reward, rollouts, similar
from marlstone.store import Store


def test_cosine_top(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(90, 4)).round(1)
    data = [(i, v.tolist()) for i, v in enumerate(x)] + [(200 + i, (x[3] * 2.0**i).tolist()) for i in range(6)]
    data += [(300, None), (301, []), (302, [0.0] * 4), (303, [1.0, None, 1.0, 1.0]), (304, [float("nan")] * 4), (305, [1.0, 2.0]), (None, x[1].tolist()), (5, x[7].tolist())]
    df = spark.createDataFrame([(*r, "c") for r in data], "vec_id long, embedding array<double>, score string")
    good = [(i, np.array(v)) for i, v in data if i is not None and v and len(v) == 4 and all(y is not None and math.isfinite(y) for y in v) and any(v)]
    for block_rows in (1000, 20):
        got = {}
        for r in similar.cosine_top(df, 3, block_rows=block_rows).collect():
            got.setdefault(r.id, []).append((r["rank"], r.other, r.score))
        assert 305 not in got and set(got) == {i for i, _ in good}
        for i, v in good:
            if i == 5:
                continue
            s = sorted((-round(float(v @ w / np.linalg.norm(v) / np.linalg.norm(w)), 12), j) for j, w in good if j != i)[:3]
            assert [g[0] for g in sorted(got[i])] == [1, 2, 3] and np.allclose([g[2] for g in sorted(got[i])], [-a for a, _ in s])
        assert [g[1] for g in sorted(got[3])] == [200, 201, 202]  # parallel vectors by id
    assert similar.cosine_top(df.limit(0)).count() == 0


def test_cosine_of_many_equal_vectors_in_little_memory():
    import tracemalloc

    rng = np.random.default_rng(1)
    v = np.repeat(rng.normal(size=(10, 64)), 400, axis=0)
    ids = np.arange(len(v))
    tracemalloc.start()
    cell = similar._Cell(ids, v, 3)
    cell.offer(ids, v)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    first = ids // 400 * 400
    want = [[x for x in range(f, f + 4) if x != i][:3] for i, f in zip(ids, first, strict=True)]
    assert cell.who.tolist() == np.repeat(ids, 3).tolist() and cell.other.reshape(-1, 3).tolist() == want
    assert peak < 80e6


def test_reward_fit(spark, tmp_path):
    rng = np.random.default_rng(1)
    true = np.array([1.5, -2.0, 0.5])
    a, b = rng.normal(size=(400, 3)), rng.normal(size=(400, 3))
    better = (a - b) @ true + rng.logistic(size=400) > 0
    pairs = [(*((x, y) if g else (y, x)),) for x, y, g in zip(a.tolist(), b.tolist(), better, strict=True)]
    df = spark.createDataFrame([*pairs, (None, [1.0] * 3), ([1.0, None, 1.0], [1.0] * 3), ([1.0], [1.0, 2.0, 3.0])], "chosen array<double>, rejected array<double>")
    w = np.zeros(3)
    d = np.array([np.subtract(c, r) for c, r in pairs])
    for _ in range(30):
        w = w + 0.5 * (d.T @ (1 / (1 + np.exp(d @ w)))) / len(d) - 0.5 * 0.01 * w
    got, steps, _ = reward.fit(df, steps=30, l2=0.01, settled=0.0)
    assert steps == 30 and np.allclose(got, w)
    store = Store(spark, str(tmp_path))
    reward.fit(df, steps=11, l2=0.01, settled=0.0, store=store, every=4)  # cut off
    again, steps, loss = reward.fit(df, steps=30, l2=0.01, settled=0.0, store=store)
    assert steps == 30 and np.allclose(again, w)
    end, steps, less = reward.fit(df, steps=400, l2=0.01, settled=1e-3)
    assert steps < 400 and less < math.log(2) and np.all(np.sign(end) == np.sign(true))
    scored = df.where("size(chosen) = 3").limit(5).select("chosen", reward.reward(F.col("chosen"), end).alias("r")).collect()
    assert all(r.r is None or abs(r.r - float(np.dot(r.chosen, end))) < 1e-9 for r in scored)
    assert reward.fit(df.limit(0))[1] == 0


@settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.tuples(*[st.floats(-3, 3)] * 3), max_size=9), min_size=1, max_size=6))
def test_rollouts(spark, data):
    df = spark.createDataFrame([(i, [x[0] for x in r], [x[1] for x in r], [x[2] for x in r], float(i)) for i, r in enumerate(data)], "id int, p array<double>, q array<double>, v array<double>, s double")
    out = df.withColumn("r", rollouts.penalised_rewards(F.col("p"), F.col("q"), F.col("s"), 0.2)).withColumn("a", rollouts.advantages(F.col("r"), F.col("v"), 0.9, 0.8))
    for row in out.collect():
        want, ahead = [], 0.0
        for i in reversed(range(len(row.p))):
            r = 0.2 * (row.q[i] - row.p[i]) + (row.s if i == len(row.p) - 1 else 0.0)
            ahead = r + 0.9 * (row.v[i + 1] if i + 1 < len(row.v) else 0.0) - row.v[i] + 0.72 * ahead
            want.insert(0, ahead)
        assert np.allclose(row.a, want)
    every = np.array([x for r in out.collect() for x in r.a])
    white = np.array([x for r in rollouts.whitened(out, "a").orderBy("id").collect() for x in r.a])
    if len(every) > 1:
        order_ = np.array([x for r in out.orderBy("id").collect() for x in r.a])
        assert np.allclose(white, (order_ - every.mean()) / np.sqrt(every.var(ddof=1) + 1e-8), atol=1e-6)


def test_batches(spark):
    rng = np.random.default_rng(2)
    sizes = [int(x) for x in rng.integers(0, 700, 500)] + [1000, 1000, 1001, 5000, 0, 512, 513, 8, 9]
    df = spark.createDataFrame([(i, n) for i, n in enumerate(sizes)], "id long, n long").repartition(7)
    got = batches.batch_plan(df, "n", "id", 1000).collect()
    assert sorted(r.id for r in got) == list(range(len(sizes)))
    held = {}
    for r in got:
        if r.n > 1000:
            assert r.batch_id is None and r.padded is None and r.place is None
        else:
            assert r.n <= r.padded <= 1000
            held.setdefault(r.batch_id, []).append((r.place, r.padded, r.n))
    assert sorted(held) == list(range(len(held)))
    for b in held.values():
        assert len({p for _, p, _ in b}) == 1 and sum(p for _, p, _ in b) <= 1000 and sorted(x[0] for x in b) == list(range(len(b)))
    assert sum(1 for b in held.values() if sum(p for _, p, _ in b) + b[0][1] <= 1000) <= len({b[0][1] for b in held.values()})  # one open batch a range at most
    assert batches.batch_plan(df.limit(0), "n", "id", 1000).count() == 0


def test_numbered_with_one_busy_group(spark):
    data = [(None if i % 7 == 0 else "busy" if i % 3 else "rare", i * 37 % 1000, i) for i in range(1000)]
    df = spark.createDataFrame(data, "g string, t long, id long").repartition(6)
    got = {r.id: r.n for r in order.numbered(df, "g", "t", "id").collect()}
    for g in {d[0] for d in data}:
        assert [got[i] for _, i in sorted((t, i) for h, t, i in data if h == g)] == list(range(sum(d[0] == g for d in data)))


def test_adapter(spark):
    rng = np.random.default_rng(3)
    w, b, a = rng.normal(size=(30, 10)), rng.normal(size=(30, 2)), rng.normal(size=(2, 10))
    table = lambda m, name="row": spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], f"{name} long, values array<double>")
    blocks = adapters.column_blocks(table(w), 4)
    factors = table(b).where("row <> 5").withColumnRenamed("values", "factors")
    merged = adapters.merge_adapter(blocks, factors, adapters.column_blocks(table(a), 4).withColumnRenamed("row", "k"), 0.5, lanes=3)
    got = np.zeros_like(w)
    for r in merged.collect():
        got[r.row, 4 * r.block : 4 * r.block + len(r["values"])] = r["values"]
    want = w + 0.5 * b @ a
    want[5] = w[5]
    assert np.allclose(got, want)


@pytest.mark.parametrize("inclusive", [False, True])
def test_as_of(spark, inclusive):
    rng = np.random.default_rng(6)
    events = [(str(rng.integers(3)) if i % 9 else None, int(rng.integers(60)), f"e{i}" if i % 11 else None) for i in range(200)]
    asks = [(str(rng.integers(4)) if i % 10 else None, int(rng.integers(60)), i) for i in range(150)]
    left, right = spark.createDataFrame(asks, "k string, t int, id int"), spark.createDataFrame(events, "k string, t int, v string")
    got = {r.id: r.v for r in asof.as_of(left.repartition(5), right.repartition(3), "k", "t", "v", inclusive=inclusive).collect()}
    assert len(got) == 150
    for k, t, i in asks:
        before = [(u, v) for h, u, v in events if h == k and v is not None and (u < t or (inclusive and u == t))]
        assert got[i] == (max(before)[1] if before else None)
