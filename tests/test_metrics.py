import math

import pytest
from pyspark.sql import functions as F

from marlstone.operators import metrics

P, N, U = "Positive", "Negative", "Unknown"
CASES = [
    ([P, N, P, N, P], [P, N, P, N, P], (2, 0, 0, 3), (1, 1, 1, 1, 1)),
    ([P, P, P, N, N], [P, N, P, N, N], (2, 1, 0, 2), (0.8, 2 / 3, 1, 0.8, 2 / 3)),
    ([P, U, P, N, P], [P, N, P, N, N], (1, 2, 0, 2), (0.6, 0.5, 1, 2 / 3, 2 / math.sqrt(24))),
    ([], [], (0, 0, 0, 0), (0, 0, 0, 0, 0)),
]


@pytest.mark.parametrize(("said", "true", "counts", "want"), CASES)
def test_cases(spark, said, true, counts, want):
    r = metrics.binary_metrics(spark.createDataFrame(list(zip(said, true, strict=True)), "prediction string, label string")).first()
    assert (r.tn, r.fp, r.fn, r.tp) == counts
    assert (r.accuracy, r.precision, r.recall, r.f1, r.mcc) == pytest.approx(want)


# Published confusion matrices and metrics: accuracy, mcc, precision, recall, f1.
GOLDEN = [
    ((512, 3375, 1554, 2355), (0.36775, -0.30116, 0.41099, 0.60246, 0.48864)),
    ((624, 3263, 712, 3197), (0.49012, -0.02867, 0.49489, 0.81786, 0.61665)),
    ((745, 2274, 754, 2251), (0.49734, -0.00479, 0.49746, 0.74908, 0.59788)),
]


@pytest.mark.parametrize(("counts", "want"), GOLDEN)
def test_published_matrices(spark, counts, want):
    r = metrics.with_metrics(spark.createDataFrame([counts], "tn long, fp long, fn long, tp long")).first()
    assert (r.accuracy, r.mcc, r.precision, r.recall, r.f1) == pytest.approx(want, abs=6e-6)


def test_unknown_labels_are_counted_apart(spark):
    r = metrics.binary_metrics(spark.createDataFrame([(P, P), (P, "x"), (None, N), (P, None)], "prediction string, label string")).first()
    assert (r.total, r.unlabelled, r.fp) == (2, 2, 1)


def test_pairs_and_tally(spark):
    rows = spark.createDataFrame([(1, 1000.0, 0.0), (2, 0.5, 0.5), (3, 0.0, 1000.0)], "i int, r_j double, r_k double")
    assert metrics.pair_accuracy(rows).first()[0] == pytest.approx(2 / 3)
    assert metrics.pair_loss(rows).first()[0] == pytest.approx((0 + math.log(2) + 1000) / 3)
    out = metrics.running_tally(rows.withColumn("g", F.lit("a")), "i", F.col("i") != 2, ["g"]).orderBy("i").collect()
    assert [(r.n_correct, r.n_incorrect) for r in out] == [(1, 0), (1, 1), (2, 1)]
