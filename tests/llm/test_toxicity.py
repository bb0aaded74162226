import os
import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from marlstone.llm import toxicity


def corpus(n=900, seed=5):
    rnd = random.Random(seed)
    clean = ["".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(3, 8))) for _ in range(400)]
    bad = ["zwoxx", "zwoxxen", "zwoxxig", "quvvel", "quvvels"]
    rows, labels = [], []
    for i in range(n):
        words = [rnd.choice(clean) for _ in range(rnd.randint(20, 120))]
        toxic = int(rnd.random() < 0.15)
        if toxic:
            for _ in range(3):
                words.insert(rnd.randrange(len(words)), rnd.choice(bad))
        rows.append((i, " ".join(words)))
        if i % 2:
            labels.append((i, toxic))
    return rows, labels, {i: int(any(b in t for b in ("zwox", "quvv"))) for i, t in rows}


def test_held_out_accuracy(spark):
    rows, labels, truth = corpus()
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.fit(docs, marks)
    out = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    held = [i for i in truth if zlib.crc32(str(i).encode()) % 4 == 2]
    hit = [(out[i] >= toxicity.THRESHOLD) == bool(truth[i]) for i in held]
    assert sum(hit) / len(hit) >= 0.98
    assert toxicity.fit(docs.repartition(3), marks).weights == model.weights
    kept = {r.doc_id for r in toxicity.drop_toxic(docs, marks).collect()}
    assert sum(truth[i] for i in kept) <= 2 and len(kept) > 600


def test_labels_of_the_held_out_fold_are_not_learned(spark):
    rows, labels, _ = corpus(300)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    flipped = [(i, 1 - y if zlib.crc32(str(i).encode()) % 4 == 2 else y) for i, y in labels]
    a, b = (toxicity.fit(docs, spark.createDataFrame(x, "doc_id long, toxic int")) for x in (labels, flipped))
    assert a.weights == b.weights and a.bias == b.bias


def test_edge_rows(spark, edge, none):
    marks = spark.createDataFrame([(1, 1), (1, 0), (5, 0), (None, 1), (2, None)], "doc_id long, toxic int")
    model = toxicity.fit(edge, marks)
    rows = toxicity.score(edge, model).collect()
    assert len(rows) == edge.count() and all(0 <= r.score <= 1 for r in rows)
    assert len({r.score for r in rows if not (r.text or "").strip()}) == 1
    assert toxicity.score(none, toxicity.fit(none, marks)).count() == 0
    assert toxicity.fit(edge, marks.where(F.lit(False))).weights == {}
    assert toxicity.drop_toxic(edge, marks.where(F.lit(False))).columns == edge.columns


def test_pieces_stay_if_the_unlabelled_hold_more_toxic_texts_than_the_labels():
    rows, _, truth = corpus(1800, 7)
    toxic, clean = ([t for i, t in rows if truth[i] == y] for y in (1, 0))
    for unlabelled in (clean[:400] + toxic[:200], toxic + clean, clean[:900] + [toxic[0]] * 250):  # more of them; at the start; one of them as copies
        model = toxicity.train(toxic, unlabelled, 0.15)
        scores = model.scores(toxic[1:])
        assert (scores >= toxicity.THRESHOLD).mean() >= 0.9
        assert (model.scores(clean) < toxicity.THRESHOLD).mean() >= 0.95


def test_risk_and_direction_agree_with_dense_numpy():
    rng = np.random.default_rng(3)
    x_p, x_u = (rng.random((n, 12)) * (rng.random((n, 12)) < share) for n, share in ((30, 0.7), (80, 0.2)))
    rows = lambda x: toxicity._Rows([{int(i): r[i] for i in np.flatnonzero(r)} for r in x], 12)
    signs = set()
    for scale in (0.1, 3.0):
        for _ in range(10):
            w, b, prior = (rng.normal(size=12) + scale) * scale, float(rng.normal()), 0.6
            g_p, g_u = x_p @ w + b, x_u @ w + b
            first, bracket = toxicity.risk(w, b, rows(x_p), rows(x_u), prior)
            loss = lambda g, y: np.log(1 + np.exp(-y * g)).mean()
            assert np.isclose(first, prior * loss(g_p, 1)) and np.isclose(bracket, loss(g_u, -1) - prior * loss(g_p, -1))
            # The risk where the bracket counts, minus the bracket where it is below zero: central differences.
            value = lambda w, b, up=bracket >= 0: (lambda r: r[0] + r[1] if up else -r[1])(toxicity.risk(w, b, rows(x_p), rows(x_u), 0.6))
            d_w, d_b = toxicity.descent(w, b, rows(x_p), rows(x_u), prior)
            for i in range(12):
                e = np.eye(12)[i] * 1e-6
                assert np.isclose(d_w[i], (value(w + e, b) - value(w - e, b)) / 2e-6, atol=1e-6)
            assert np.isclose(d_b, (value(w, b + 1e-6) - value(w, b - 1e-6)) / 2e-6, atol=1e-6)
            signs.add(bracket >= 0)
    assert signs == {True, False}


def test_held_out_labels_of_the_documents(spark, sf):
    """Recall and false alarms on the held-out fold of sf0.1, which nothing was chosen by (``cross_validate`` on the learned fold chose)."""
    folder = f"{os.path.dirname(sf)}/sf0.1"
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    out = toxicity.op4_toxicity(spark, folder).where("held_out").join(labels, "doc_id").collect()
    toxic, clean = [r for r in out if r.toxic == 1], [r for r in out if r.toxic == 0]
    assert sum(r.predicted for r in toxic) >= 0.9 * len(toxic) and sum(r.predicted for r in clean) <= 0.02 * len(clean)


def test_busy_ids_do_not_fill_the_sample(spark):
    rows, labels, truth = corpus(600)
    busy = next(i for i in truth if zlib.crc32(str(i).encode()) % 4 != 2 and not truth[i])
    docs = spark.createDataFrame(rows + [(busy, f"again {k}") for k in range(4000)], "doc_id long, text string")
    model = toxicity.fit(docs, spark.createDataFrame(labels, "doc_id long, toxic int"), max_unlabelled=300)
    assert (model.scores([t for i, t in rows if truth[i]]) >= toxicity.THRESHOLD).mean() >= 0.9
