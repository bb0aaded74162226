"""Classification metrics as one aggregate; every function takes optional grouping columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import NEGATIVE, POSITIVE, same


def _count(condition: Column) -> Column:
    return F.coalesce(F.count_if(condition), F.lit(0))


def binary_metrics(rows: DataFrame, prediction: str = "prediction", label: str = "label", by: list[str] | None = None) -> DataFrame:
    """Counts and metrics with Positive as the positive class.

    A prediction that is neither class counts as wrong. Rows whose label is neither are left out and
    counted in ``unlabelled``. Without rows there is one row of zeros (if not grouped).
    """
    truth, said = F.col(label), F.col(prediction)
    known = truth.isin(POSITIVE, NEGATIVE)
    actual = F.coalesce(truth == POSITIVE, F.lit(False))
    valid = F.coalesce(said.isin(POSITIVE, NEGATIVE), F.lit(False))
    positive = F.when(valid, said == POSITIVE).otherwise(~actual)
    flags = rows.select(*(by or []), F.coalesce(known, F.lit(False)).alias("_k"), actual.alias("_a"), positive.alias("_p"))
    k, a, p = F.col("_k"), F.col("_a"), F.col("_p")
    counts = flags.groupBy(*(by or [])).agg(
        _count(k & ~a & ~p).alias("tn"), _count(k & ~a & p).alias("fp"), _count(k & a & ~p).alias("fn"), _count(k & a & p).alias("tp"), _count(~k).alias("unlabelled")
    )
    return with_metrics(counts)


def with_metrics(counts: DataFrame) -> DataFrame:
    """Metrics from the columns tn, fp, fn, tp; a zero denominator gives zero. Products are doubles."""
    tn, fp, fn, tp = (F.col(c).cast("double") for c in ("tn", "fp", "fn", "tp"))
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    out = (
        counts.withColumn("total", (F.col("tn") + F.col("fp") + F.col("fn") + F.col("tp")).cast("long"))
        .withColumn("accuracy", ratio(tp + tn, tp + tn + fp + fn))
        .withColumn("precision", ratio(tp, tp + fp))
        .withColumn("recall", ratio(tp, tp + fn))
        .withColumn("f1", ratio(2 * tp, 2 * tp + fp + fn))
    )
    return out.withColumn("mcc", ratio(tp * tn - fp * fn, F.sqrt(tp + fp) * F.sqrt(tp + fn) * F.sqrt(tn + fp) * F.sqrt(tn + fn)))


def running_tally(rows: DataFrame, order: str, correct: Column, by: list[str]) -> DataFrame:
    """Running counts of correct and incorrect rows in the order of ``order``, per group.

    A large group is dealt by ranges of the order: running counts within a range, and the totals of the ranges before it.
    """
    flag = F.when(correct, 1).otherwise(0).cast("long")
    group = F.struct(*by)
    ranged = rows.withColumns({"_flag": flag, "_group": group}).repartitionByRange("_group", order).withColumn("_range", F.spark_partition_id()).checkpoint()
    totals = ranged.groupBy("_range", "_group").agg(F.sum("_flag").alias("_c"), F.sum(1 - F.col("_flag")).alias("_i"))
    before = Window.partitionBy("_group").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    sums = [F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}_before") for c in ("_c", "_i")]
    lane = Window.partitionBy("_range", "_group").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    out = ranged.withColumn("_c", F.sum("_flag").over(lane)).withColumn("_i", F.sum(1 - F.col("_flag")).over(lane))
    out = out.join(totals.select("_range", "_group", *sums), ["_range", "_group"])
    return out.select(*rows.columns, (F.col("_c") + F.col("_c_before")).alias("n_correct"), (F.col("_i") + F.col("_i_before")).alias("n_incorrect"))


def trial_summary(state: DataFrame) -> DataFrame:
    """Correct and (finished) incorrect agents per trial."""
    right = same(F.col("prediction"), F.col("target"))
    return state.groupBy("trial").agg(_count(right).alias("correct"), _count(F.col("finished") & ~right).alias("incorrect"))


def pair_accuracy(rows: DataFrame, chosen: str = "r_j", rejected: str = "r_k") -> DataFrame:
    """Share of pairs whose first reward is not less; a tie counts."""
    return rows.agg(F.avg((F.col(chosen) >= F.col(rejected)).cast("double")).alias("accuracy"))


def pair_loss(rows: DataFrame, chosen: str = "r_j", rejected: str = "r_k") -> DataFrame:
    """Mean of -log sigmoid(difference), stable for large differences of either sign."""
    d = (F.col(chosen) - F.col(rejected)).cast("double")
    return rows.agg(F.avg(F.greatest(-d, F.lit(0.0)) + F.log1p(F.exp(-F.abs(d)))).alias("loss"))
