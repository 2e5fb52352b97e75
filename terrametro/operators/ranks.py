"""Ranks over a whole table without ordering it in one task.

Distinct values are counted first (hot values fold), then cut into ranges; range
totals give each range its offset and only the inside of a range is ordered.
"""

import math

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window, functions as F

from ..sources.staging import staged

RANGES = 1024


def _with_range(counts: DataFrame, splits) -> DataFrame:
    """Adds `_range` by binary search. The cut points only balance the work; any cut
    points give the same ranks."""
    inner = sorted({s for s in splits or [] if math.isfinite(s)}) or [0.0]
    edges = [-math.inf, *inner, math.inf]
    # NaN comes last, as it does in Spark's order.
    return Bucketizer(splits=edges, inputCol="_v", outputCol="_range", handleInvalid="keep").transform(counts)


def value_positions(df: DataFrame, column: str, ranges: int = RANGES) -> DataFrame:
    """Per distinct value: `_v`, its count `_c`, rows before it `_before`."""
    counts = (
        df.select(F.col(column).cast("double").alias("_v"))
        .where(F.col("_v").isNotNull())
        .groupBy("_v")
        .agg(F.count("*").alias("_c"))
    )
    cuts = F.array(*[F.lit((i + 1) / ranges) for i in range(ranges - 1)])
    counts = staged(counts, "ranks")  # read for the cuts, the range totals and the ranks
    splits = counts.agg(F.array_distinct(F.percentile_approx("_v", cuts, 10 * ranges)).alias("s")).first()["s"]
    ranged = _with_range(counts, splits)
    totals = ranged.groupBy("_range").agg(F.sum("_c").alias("_t"))
    # At most `ranges` rows, whatever the data: safe to order in one task and to broadcast.
    offsets = totals.select(
        F.col("_range").alias("_r"),
        (F.sum("_t").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_t")).alias("_offset"),
    )
    inside = Window.partitionBy("_range").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    return (
        ranged.join(F.broadcast(offsets), F.col("_range") == F.col("_r"))
        .withColumn("_before", F.col("_offset") + F.sum("_c").over(inside) - F.col("_c"))
        .select("_v", "_c", "_before")
    )


def with_average_rank(df: DataFrame, column: str, name: str) -> DataFrame:
    """Adds the 1-based rank of a numeric column, ties sharing their mean rank."""
    ranks = value_positions(df, column).select(
        F.col("_v").alias(f"_v_{name}"), (F.col("_before") + (F.col("_c") + 1) / 2.0).alias(name)
    )
    return df.join(ranks, df[column].cast("double") == ranks[f"_v_{name}"], "left").drop(f"_v_{name}")
