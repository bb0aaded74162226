"""Low-rank adapters merged into the matrix they adapt: W + scale * B A, over tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Copies of an adapter's block that tasks are dealt, so that all rows of a matrix don't meet one.
LANES = 32


def column_blocks(matrix: DataFrame, width: int = 256) -> DataFrame:
    """(row, block, values) of (row, values): every row cut into pieces of ``width`` columns."""
    n = F.ceil(F.size("values") / width).cast("int")
    cut = matrix.where(F.size("values") > 0).select("row", F.posexplode(F.transform(F.sequence(F.lit(0), n - 1), lambda b: F.slice("values", b * width + 1, width))).alias("block", "values"))
    return cut.select("row", "block", "values")


def merge_adapter(weights: DataFrame, b: DataFrame, a: DataFrame, scale: float = 1.0, lanes: int = LANES) -> DataFrame:
    """(row, block, values) of the merged matrix.

    ``weights``: (row, block, values) as ``column_blocks`` gives them. ``b``: (row, factors), an array of the rank's length per row; rows without
    one stay as they are. ``a``: (k, block, values), the rank's rows, in the same blocks. One block of A (rank x width numbers) is held per
    task; weights are joined once by row and once by block, their blocks spread over ``lanes`` copies of A's.
    """
    held = a.groupBy("block").agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "values"))), lambda r: r["values"]).alias("_a"))  # rank rows each
    held = held.withColumn("_lane", F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))))
    rows = weights.join(b.select("row", F.col("factors").alias("_b")), "row", "left").withColumn("_lane", F.pmod(F.xxhash64("row"), F.lit(lanes)).cast("int"))
    joined = rows.join(held, ["block", "_lane"], "left")
    # Per column the products are added in the order of k.
    product = F.aggregate(
        F.zip_with("_b", "_a", lambda x, r: F.struct(x.alias("x"), r.alias("r"))),
        F.transform("values", lambda _: F.lit(0.0)),
        lambda sums, t: F.zip_with(sums, t["r"], lambda s, y: s + t["x"] * y),
    )
    merged = F.zip_with(F.col("values"), product, lambda w, p: w + p * scale)
    return joined.select("row", "block", F.when(F.col("_b").isNotNull() & F.col("_a").isNotNull(), merged).otherwise(F.col("values")).alias("values"))
