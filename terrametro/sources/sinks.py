"""Writers and keyed merges."""

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.dedup import keep_last


def save_listings(df: DataFrame, path: str, append: bool = True) -> None:
    df.write.mode("append" if append else "overwrite").parquet(path)


def upsert(existing: DataFrame, incoming: DataFrame, key: str, order) -> DataFrame:
    """Existing rows plus incoming ones, incoming winning on the key.

    Among incoming copies the last by `order` stays. Only the incoming side is
    deduplicated, so a small batch does not shuffle the stored table (the key list
    is broadcast when it turns out small).
    """
    fresh = keep_last(incoming, [key], order)
    keys = fresh.select(F.col(key).alias("_k"))
    kept = existing.join(keys, existing[key].eqNullSafe(keys["_k"]), "left_anti")
    return kept.unionByName(fresh, allowMissingColumns=True)


def upsert_to_path(existing_path: str, incoming: DataFrame, key: str, order, target_path: str) -> None:
    """Merge into a fresh path: a table is never overwritten while it is read, and a
    lost executor can be re-run from the untouched input."""
    if existing_path == target_path:
        raise ValueError("write the merged table to a fresh path")
    existing = incoming.sparkSession.read.parquet(existing_path)
    upsert(existing, incoming, key, order).write.mode("overwrite").parquet(target_path)


def write_segments(df: DataFrame, path: str, column: str) -> None:
    """One directory per segment. AQE's rebalance splits big segments over several
    files and packs small ones, so a hot segment does not end on one writer."""
    df.hint("rebalance", F.col(column)).write.mode("overwrite").partitionBy(column).parquet(path)


def read_segment(spark: SparkSession, path: str, column: str, value) -> DataFrame:
    """Partition-pruned read of one segment."""
    return spark.read.parquet(path).where(F.col(column) == value)


def list_segments(spark: SparkSession, path: str, column: str) -> DataFrame:
    return spark.read.parquet(path).select(column).distinct().orderBy(column)
