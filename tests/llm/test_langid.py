import zlib

import pytest

from marlstone.llm import langid

EN, DE, FR = "the house and the garden of this thing ", "das haus und der garten von diesem ding ", "la maison et le jardin de cette chose "


def test_mixtures():
    model = langid.Model.train([("en", EN * 20), ("de", DE * 20), ("fr", FR * 20)])
    assert model.mixture(EN * 5) == {"en": 1.0}
    mixed = model.mixture(EN * 20 + DE * 10)
    assert set(mixed) == {"en", "de"} and mixed["en"] == pytest.approx(2 / 3, abs=0.08)
    assert model.predict("123 ▁ !!") == (langid.UNKNOWN, 0.0)
    assert model.predict(None) == (langid.UNKNOWN, 0.0)
    assert model.predict(FR.upper())[0] == "fr"


def test_held_out_accuracy(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = {r.doc_id: r.lang_pred for r in langid.identify(docs, langid.fit(docs)).collect()}
    held = [r for r in docs.collect() if zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert sum(got[r.doc_id] == r.lang for r in held) / len(held) >= 0.95


def test_edge_rows(edge, none):
    rows = langid.identify(edge, langid.fit(edge)).collect()
    assert len(rows) == edge.count()
    assert {r.lang_pred for r in rows if r.doc_id in (2, 3, 4)} == {langid.UNKNOWN} and all(0 <= r.score <= 1 for r in rows)
    assert langid.identify(none, langid.fit(none)).count() == 0
    assert langid.Model.train([]).predict("word") == (langid.UNKNOWN, 0.0)


def test_sets_agree_with_enumeration(sf):
    """The chosen set has the best penalised likelihood of all sets of languages, up to what EM leaves."""
    from itertools import combinations

    import numpy as np
    import pyarrow.parquet as pq

    rows = [r for r in pq.read_table(f"{sf}/documents.parquet").to_pylist() if r["text"] and r["lang"]]
    model = langid.Model.train([(r["lang"], r["text"]) for r in rows if r["doc_id"] % 2])
    pick = {x: next(r["text"] for r in rows if r["lang"] == x and r["doc_id"] % 2 == 0 and len(r["text"]) > 600) for x in model.languages}
    texts = [pick[a][:m] + " " + pick[b][:n] for a in pick for b in pick for m, n in ((300, 300), (500, 60), (500, 15))]
    texts += [" ".join(pick[x][:250] for x in model.languages), *[r["text"] for r in rows[:40]]]
    off = 0
    for text in texts:
        found = model.mixture(text)
        bins = langid.trigrams(text)
        if not len(bins):
            continue
        n, every = np.unique(bins, return_counts=True)[::-1]
        like = model.prob[:, every].astype(float)
        score = lambda s, n=n, like=like: langid.settle(n.astype(float), like[list(s)])[1] - model.price(n.sum()) * len(s)
        best = max(score(s) for k in range(1, len(like) + 1) for s in combinations(range(len(like)), k))
        off += score([model.languages.index(x) for x in found]) < best - 0.5
    assert off == 0
    two = model.mixture(pick["en"][:300] + " " + pick["de"][:300])
    assert set(two) == {"en", "de"} and 0.3 < two["en"] < 0.7


def test_counts_of_tasks_are_those_of_the_texts(spark, sf):
    """The model that executors count is the one of the same texts at once; equal shares go to the first language."""
    import numpy as np

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    learned = sorted((r.lang, r.text) for r in docs.collect() if r.lang and r.text and len(r.text) <= 20_000 and zlib.crc32(str(r.doc_id).encode()) % 4 != 2)
    model, want = langid.fit(docs.repartition(7)), langid.Model.train(learned)
    assert model.languages == want.languages and np.allclose(model.prob, want.prob, rtol=1e-6)
    tie = langid.Model(["aa", "bb"], np.full((2, langid.BINS), 1 / langid.BINS, np.float32))
    assert tie.predict("any words") == ("aa", 1.0)
