"""Models that were saved and loaded score as they did."""

import numpy as np

from marlstone.llm import langid, models, toxicity
from marlstone.store import Store


def test_round_trips(spark, sf, tmp_path):
    store = Store(spark, str(tmp_path))
    assert models.load_toxicity(store) is None and models.load_languages(store) is None
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = [r.text for r in docs.limit(60).collect()]
    for settings in (toxicity.DEFAULT, toxicity.Settings(4, 100, 7)):
        model = toxicity.fit(docs, spark.read.parquet(f"{sf}/labels.parquet"), settings=settings)
        version = models.save_toxicity(store, model)
        again = models.load_toxicity(store)
        assert again.weights == model.weights and again.bias == model.bias and again.settings == settings
        assert np.array_equal(again.scores(texts), model.scores(texts))
    assert version == 2
    model = langid.fit(docs)
    models.save_languages(store, model)
    again = models.load_languages(store)
    assert again.languages == model.languages and np.array_equal(again.prob, model.prob)
    assert [again.mixture(t) for t in texts] == [model.mixture(t) for t in texts]
    models.save_languages(store, langid.Model.train([]))
    models.save_toxicity(store, toxicity.Model({}, -40.0))
    assert models.load_languages(store).predict("word") == (langid.UNKNOWN, 0.0) and models.load_toxicity(store).weights == {}
    spark.createDataFrame([("x", 1.0)], "piece string, weight double").write.parquet(f"{tmp_path}/{models.TOXICITY}/cut-off")
    assert len(store.versions(models.TOXICITY)) == 3
