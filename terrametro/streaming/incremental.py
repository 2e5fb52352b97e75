"""Arrivals of listings: deduplicate, skip what is stored, merge by URL."""

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.dedup import keep_last
from ..sources.staging import staged

BATCH = "lote"
#: Columns of a bucketed store, as folders: the batch that wrote a bucket last, and the bucket.
VERSION, BUCKET = "versao", "balde"


def read_arrivals(spark: SparkSession, path: str, schema, files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def dedup_arrivals(stream: DataFrame, key: str, event_time: str, horizon: str = "7 days") -> DataFrame:
    """First arrival of each key. State is dropped once the watermark has passed, so it
    is bounded by the keys of one horizon."""
    # Watermarks need zoned time; files may carry local timestamps.
    timed = stream.withColumn(event_time, F.col(event_time).cast("timestamp"))
    return timed.withWatermark(event_time, horizon).dropDuplicatesWithinWatermark([key])


def new_arrivals_only(stream: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    """Arrivals whose key the stored table lacks (stream to static anti join)."""
    return stream.join(stored.select(key).distinct(), key, "left_anti")


def upsert_arrivals(stream: DataFrame, table: str, checkpoint: str, key: str, order, available_now: bool = True) -> StreamingQuery:
    """Every micro-batch is merged by key into a stored table, arrivals winning.

    A batch writes only itself, deduplicated, into its own directory, so its cost does
    not grow with the table, and a batch repeated after a failure overwrites its own
    directory. `read_merged` resolves the keys; `compact` folds the directories.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        keep_last(batch, [key], order).write.mode("overwrite").parquet(f"{table}/{BATCH}={batch_id}")

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()


def read_merged(spark: SparkSession, table: str, key: str) -> DataFrame:
    """The table as it stands: the latest batch's row of every key."""
    return keep_last(spark.read.parquet(table), [key], [BATCH]).drop(BATCH)


def compact(spark: SparkSession, table: str, target: str, key: str) -> None:
    """The merged rows as one directory of a fresh table, in place of all batches."""
    if table == target:
        raise ValueError("compact into a fresh path")
    rows = spark.read.parquet(table)
    latest = rows.agg({BATCH: "max"}).first()[0]
    read_merged(spark, table, key).write.mode("overwrite").parquet(f"{target}/{BATCH}={latest}")


# --- a store by buckets of the key ------------------------------------------
def _current_buckets(spark: SparkSession, table: str, before: int | None = None, only=None) -> list[str]:
    """Folder of every bucket's latest version, from the listing alone; versions below `before`."""
    try:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").load(table)
    except AnalysisException:  # nothing is stored yet
        return []
    version, bucket = (F.regexp_extract("path", rf"/{c}=(\d+)/", 1).cast("bigint") for c in (VERSION, BUCKET))
    found = files.select(version.alias(VERSION), bucket.alias(BUCKET))
    if before is not None:
        found = found.where(F.col(VERSION) < before)
    latest = found.groupBy(BUCKET).agg(F.max(VERSION).alias(VERSION)).collect()  # one row a bucket
    return [f"{table}/{VERSION}={r[VERSION]}/{BUCKET}={r[BUCKET]}" for r in latest if only is None or r[BUCKET] in only]


def merge_arrivals(stream: DataFrame, table: str, checkpoint: str, key: str, order, buckets: int = 64) -> StreamingQuery:
    """Every micro-batch is merged into a store that is cut into buckets by a hash of the key, arrivals winning.

    A batch reads and rewrites the buckets that its keys fall into, as a new version of each, and leaves the others;
    readers take each bucket's latest version and need no shuffle. Within a batch the last row by `order` wins. A batch
    repeated after a failure merges into the versions before it and overwrites its own. Run again with the same
    checkpoint it takes up what has arrived since. A missing key is a key of its own.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        rows = staged(keep_last(batch, [key], order).withColumn(BUCKET, F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")), "batch")
        touched = {r[0] for r in rows.select(BUCKET).distinct().collect()}
        if not touched:
            return
        stored = _current_buckets(spark, table, batch_id, touched)
        merged = rows
        if stored:
            old = spark.read.option("basePath", table).parquet(*stored).drop(VERSION)
            new = rows.select(F.col(key).alias("_arrived"))
            merged = old.join(new, old[key].eqNullSafe(new["_arrived"]), "left_anti").unionByName(rows)
        merged.repartition(BUCKET).write.partitionBy(BUCKET).mode("overwrite").parquet(f"{table}/{VERSION}={batch_id}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_store(spark: SparkSession, table: str) -> DataFrame:
    """The bucketed store as it stands."""
    return spark.read.option("basePath", table).parquet(*_current_buckets(spark, table)).drop(VERSION, BUCKET)
