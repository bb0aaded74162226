import datetime as dt

import pytest
from pyspark.sql import functions as F

from marlstone.operators import graph
from marlstone.sources import files


@pytest.fixture
def root(tmp_path):
    (tmp_path / "entity2id.txt").write_text("Acme\t1\tCOMP\t0\nBolt\t2\tCOMP\t0\nCora\t3\tPERSON\t1\nDusk Stock\t07\tCOMP\t0\nAcme\t5\tCOMP\t0\nshort\t9\nEcho\t2\tCOMP\t0\n")
    (tmp_path / "relation2id.txt").write_text("owns\t0\nsues\t1\n")
    (tmp_path / "time2id.txt").write_text("id,week\n0,2019-12-29\n1,2020-01-05\n2,2022-12-25\n")
    (tmp_path / "train.txt").write_text("5\t0\t2\t1\tx\n5\t1\t2\t0\tx\n5\t0\t3\t1\tx\n5\t0\t2\t9\tx\n8\t0\t2\t1\tx\n5\t0\t2\t1\n1\t0\t2\t1\tx\n")
    (tmp_path / "valid.txt").write_text("2\t1\t5\t2\tx\n07\t0\t2\t2\tx\n")
    (tmp_path / "test.txt").write_text("5\t7\t2\t2\tx\n")
    return str(tmp_path)


def load(spark, root):
    entities = graph.first_names(files.read_entities(spark, f"{root}/entity2id.txt"))
    times = files.read_times(spark, f"{root}/time2id.txt").select("time_id", F.to_date("date_wk").alias("date_wk"))
    quads = files.read_quads(spark, [f"{root}/{x}.txt" for x in ("train", "valid", "test")])
    return entities, files.read_relations(spark, f"{root}/relation2id.txt"), quads.join(times, "time_id")


def test_relationships(spark, root):
    entities, relations, quads = load(spark, root)
    assert {(r.id, r.entity) for r in entities.collect()} == {("5", "Acme"), ("2", "Bolt"), ("3", "Cora"), ("07", "Dusk Stock")}
    mapped = spark.createDataFrame([("A", "Acme"), ("B", "Bolt"), ("C", "Cora"), ("N", "Nobody")], "ticker string, entity string")
    out = graph.relationships(quads, entities, mapped, "2020-01-01", "2022-12-31", relations)
    got = sorted((r.subject, r.relation, r.object, str(r.time), r.source_file, r.relation_name) for r in out.collect())
    assert got == [
        ("Acme", "0", "Bolt", "2020-01-05", "train.txt", "owns"),
        ("Acme", "7", "Bolt", "2022-12-25", "test.txt", "7"),
        ("Bolt", "1", "Acme", "2022-12-25", "valid.txt", "sues"),
    ]
    assert [(r.year, r.n) for r in graph.year_histogram(out, F.col("time")).collect()] == [(2020, 1), (2022, 2)]
    assert [(r.relation, r.n) for r in graph.value_counts(out, "relation").collect()] == [("0", 1), ("1", 1), ("7", 1)]


def test_profile(spark, root):
    entities, relations, quads = load(spark, root)
    decoded = graph.decode(quads, entities, relations)
    assert decoded.where("subject = '8' AND subject_type = 'UNKNOWN'").count() == 1
    stats = graph.dataset_stats(decoded).first()
    assert (stats.n_quads, stats.n_relations, stats.n_entities) == (8, 3, 6)
    assert [r.entity for r in graph.keyword_entities(entities).collect()] == ["Dusk Stock"]


def test_mapping(spark, root):
    entities, _, _ = load(spark, root)
    mapping = spark.createDataFrame([("A", "Acme"), ("N", "Nobody")], "ticker string, entity string")
    tickers = spark.createDataFrame([("A",), ("N",), ("X",)], "ticker string")
    got = {r.ticker: (r.entity, r.entity_id) for r in graph.map_tickers(tickers, mapping, entities).collect()}
    assert got == {"A": ("Acme", "5"), "N": (None, None), "X": (None, None)}
    assert [r.ticker for r in graph.unmapped(tickers, mapping).collect()] == ["X"]


def test_quads_are_shuffled_once_to_be_decoded(spark, tmp_path):
    from marlstone.plans.queries import QUERIES
    from marlstone.sources import testdata as data

    week = dt.datetime(2022, 1, 5)
    tables = {
        "supplier": ("s_suppkey long, s_name string", [(1, "S1"), (2, "S2"), (2, "S2 again")]),
        "customer": ("c_custkey long, c_name string", [(1, "C1"), (3, None)]),
        "part": ("p_partkey long, p_name string", [(1, "P1")]),
        "orders": ("o_orderkey long, o_custkey long", [(10, 1), (11, 3), (12, 9), (13, None), (None, 1)]),
        "lineitem": (
            "l_orderkey long, l_suppkey long, l_returnflag string, l_linestatus string, l_shipdate timestamp",
            [(10, 1, "A", "O", week), (10, 2, "N", "F", week), (11, 9, None, "O", None), (12, None, "R", "O", week), (13, 1, "A", "O", week), (14, 1, "A", "O", week), (None, 1, "A", "O", week)],
        ),
    }
    for name, (schema, rows) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    sf, key = str(tmp_path), "spark.sql.autoBroadcastJoinThreshold"
    kept = spark.conf.get(key)
    spark.conf.set(key, "500")
    try:
        out = QUERIES["kg_decode_fallback"](spark, sf)
        plan = out._jdf.queryExecution().executedPlan().toString()
        got = out.collect()
    finally:
        spark.conf.set(key, kept)
    assert plan.count("Exchange hashpartitioning(") == 4 and "Exchange hashpartitioning(subj_id" not in plan
    plain = graph.decode(data.kg_quads(spark, sf), data.kg_entities(spark, sf), data.kg_relations(spark)).collect()
    monday = dt.date(2022, 1, 3)
    assert sorted(map(repr, got)) == sorted(map(repr, plain))
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, [
        ("S1", "COMP", "supplies", "C1", "PERSON", monday), ("S2", "COMP", "N", "C1", "PERSON", monday), ("S2 again", "COMP", "N", "C1", "PERSON", monday),
        ("s9", "UNKNOWN", None, "c3", "COMP", None), (None, "UNKNOWN", "returns to", "c9", "UNKNOWN", monday), ("S1", "COMP", "supplies", None, "UNKNOWN", monday),
    ]))
