"""Helpers the operators of this package share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..sources.staging import staged

#: Rows of a one-column key table that may be broadcast; a larger one is shuffled.
BROADCAST_ROWS = 500_000


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """A staged table, hinted for broadcast only if its counted rows are few."""
    return F.broadcast(df) if df.count() <= rows else df


def without_ids(docs: DataFrame, ids: DataFrame, column: str = "doc_id") -> DataFrame:
    """The rows of docs whose id is not in ids, all columns kept. Rows without an id stay.

    The dropped ids are staged and counted; few are broadcast, so that texts aren't shuffled.
    """
    gone = small(staged(ids.select(F.col(column).alias("gone_id")).where("gone_id IS NOT NULL").distinct(), "gone"))
    return docs.join(gone, docs[column] == gone["gone_id"], "left_anti")


def in_bucket(column: str, modulus: int, remainder: int):
    """Whether crc32 of the id, as text, has this remainder; a missing id counts as empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit(""))) % modulus == remainder
