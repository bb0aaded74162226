"""What was known last before a time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def as_of(rows: DataFrame, events: DataFrame, key: str, at: str, value: str, out: str | None = None, inclusive: bool = False) -> DataFrame:
    """``rows`` with the ``value`` of the key's last event before the row's time (``inclusive``: or at it), null if there is none.

    Both have ``key`` and ``at``. Rows and events are put in one order and sorted by ranges, so a busy key spreads over tasks: within a range the last event so far,
    before the range the last one of earlier ranges. Of events at one time the greatest value counts; a null value is no event; null is a key like others.
    """
    out = out or value
    order = ["_t", "_s", "_v"]  # rows of a time come before its events, or after them
    told = events.where(F.col(value).isNotNull()).select(F.col(key).alias("_k"), F.col(at).alias("_t"), F.lit(0 if inclusive else 1).alias("_s"), F.col(value).alias("_v"))
    asked = rows.withColumns({"_k": F.col(key), "_t": F.col(at), "_s": F.lit(1 if inclusive else 0), "_row": F.lit(True)})
    mixed = told.unionByName(asked, allowMissingColumns=True)
    placed = mixed.repartitionByRange("_k", *order).sortWithinPartitions("_k", *order).withColumn("_p", F.spark_partition_id()).checkpoint()
    lane = Window.partitionBy("_p", "_k").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    here = placed.withColumn("_here", F.last("_v", ignorenulls=True).over(lane))
    lasts = placed.groupBy("_p", "_k").agg(F.max(F.when(F.col("_v").isNotNull(), F.struct("_t", "_v")))["_v"].alias("_l"))
    earlier = Window.partitionBy("_k").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)  # a row per range
    before = lasts.select(F.col("_p").alias("_bp"), F.col("_k").alias("_bk"), F.last("_l", ignorenulls=True).over(earlier).alias("_before"))
    joined = here.where(F.col("_row")).join(before, (F.col("_p") == F.col("_bp")) & F.col("_k").eqNullSafe(F.col("_bk")), "left")
    return joined.withColumn(out, F.coalesce("_here", "_before")).select(*(c for c in rows.columns if c != out), out)
