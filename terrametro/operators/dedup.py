"""Deduplication with an explicit order."""

from pyspark.sql import Column, DataFrame, Window, functions as F


def _ranked(df: DataFrame, keys, order) -> DataFrame:
    # `row_number() = 1` lets Spark keep one row per key and map task before the
    # shuffle, so a key with very many copies (NULL included) arrives already folded.
    numbered = df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return numbered.where(F.col("_rn") == 1).drop("_rn")


def _column(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def keep_first(df: DataFrame, keys, order) -> DataFrame:
    """First row of every key by `order`; NULL keys count as one key."""
    return _ranked(df, keys, [_column(c).asc() for c in order])


def keep_last(df: DataFrame, keys, order) -> DataFrame:
    return _ranked(df, keys, [_column(c).desc() for c in order])


def distinct_by_first_position(df: DataFrame, value: str, position: str) -> DataFrame:
    """Distinct values with the position where each first occurred."""
    return df.groupBy(value).agg(F.min(position).alias(position))


def not_yet_stored(df: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not in the stored table."""
    return df.join(stored.select(key).distinct(), key, "left_anti")


def first_new_urls(df: DataFrame, stored: DataFrame, key: str, order, limit: int) -> DataFrame:
    """The first `limit` rows, by `order`, that are not stored yet."""
    return not_yet_stored(df, stored, key).orderBy(*order).limit(limit)
