import random

import corpus_pipeline
from marlstone.llm import common, mixing, pieces


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stage(spark, docs, sf)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns and docs.count() > 0
        if name in ("quality", "toxicity", "simhash"):
            assert docs.count() == docs.join(before, columns, "left_semi").count() <= before.count()
    texts = sorted(r.text for r in before.collect())
    assert sorted(r.text for r in pieces.decode_pieces(docs).collect()) == texts


def test_run(spark, sf):
    before = len(common.written)
    out = corpus_pipeline.run(spark, sf)
    assert len(common.written) == before + 1 and out.count() > 0


def test_run_on_null_and_repeated_ids_and_clashing_columns(spark, tmp_path):
    """Copies go, all other clean rows stay, and the mix holds as many words as its plan says."""
    rnd = random.Random(21)
    vocabulary = ["".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(3, 9))) for _ in range(2000)]
    rows = []
    for i in range(240):
        text = " ".join(rnd.choice(vocabulary) for _ in range(rnd.randint(60, 200)))
        rows.append((None if i % 3 == 0 else 7 if i % 3 == 1 else 1000 + i, text, "en", "ab"[i % 2], len(text), *["clash"] * 4))
    rows += [(None, *rows[0][1:]), (7, *rows[1][1:]), rows[2]]  # copies
    rows += [(None, None, None, None, None, *["clash"] * 4), (1, "", "en", "a", 0, *["clash"] * 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, _text string, _taken string, _id string, row string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1004, 1), (1007, 0), (None, 1)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    seen = {}
    now = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = common.materialize(stage(spark, now, str(tmp_path)), "test")
        seen[name] = [r for r in now.collect()]
        assert now.columns == docs.columns and {r._taken for r in seen[name]} == {"clash"}
    texts = [r.text for r in seen["simhash"]]
    assert len(seen["quality"]) >= 230 and len(texts) == len(set(texts)) and set(texts) == {r.text for r in seen["toxicity"]}
    words = lambda some: sum(len(r.text.split()) for r in some)
    plan = mixing.mix_sources(spark.createDataFrame(seen["simhash"], docs.schema))
    assert abs(words(seen["mixing"]) - plan.selectExpr("sum(taken)").first()[0]) <= 64 and words(seen["mixing"]) <= 1.5 * words(seen["simhash"]) + 64
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(seen["mixing"])


def test_empty_documents(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
