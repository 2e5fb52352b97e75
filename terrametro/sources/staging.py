"""Intermediate tables in the cluster's shared folder."""

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder the session names in spark.checkpoint.dir. A local one stands in only in
    local mode, as in tests; on a cluster executors would each write to their own disk."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.conf.get("spark.master", "local").split("[")[0] == "local":
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return os.path.join(tempfile.gettempdir(), "terrametro")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/terrametro-{name}-{os.urandom(8).hex()}"


def staged(df: DataFrame, name: str = "stage") -> DataFrame:
    """The rows written once as a table and read back.

    For rows that several passes read: the table is columnar, so each pass reads its
    own columns; it cuts the plan; and it survives lost executors.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def as_local_row(df: DataFrame) -> DataFrame:
    """A table of at most one row, computed now and kept in the plan as a constant."""
    return df.sparkSession.createDataFrame(df.limit(1).collect(), df.schema)
