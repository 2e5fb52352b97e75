"""Incremental collection with Structured Streaming over the events table."""

from pyspark.sql import functions as F

from ...sources.staging import scratch_path
from ...streaming import incremental as I
from ..bindings import table
from ..registry import query

# An event is an arrival of the listing `user_id`-`event_type`, priced at `value`.
_URL = "concat(user_id, '-', event_type)"


def _arrivals(spark, sf):
    schema = table(spark, sf, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    return stream.withColumn("url", F.expr(_URL))


def _finished(query):
    query.awaitTermination()
    if query.exception():
        raise query.exception()


@query("stream_upsert_by_url", "T1 S9",
       f"SELECT url, event_id, value FROM (SELECT {_URL} AS url, event_id, value, row_number() OVER (PARTITION BY {_URL} ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1")
def _(spark, sf):
    base = scratch_path(spark, "arrivals")
    _finished(I.upsert_arrivals(_arrivals(spark, sf), f"{base}/table", f"{base}/checkpoint", "url", ["ts", "event_id"]))
    return I.read_merged(spark, f"{base}/table", "url").select("url", "event_id", "value")


@query("stream_compacted_table", "T1",
       f"SELECT count(DISTINCT {_URL}) AS urls FROM events")
def _(spark, sf):
    base = scratch_path(spark, "arrivals")
    _finished(I.upsert_arrivals(_arrivals(spark, sf), f"{base}/table", f"{base}/checkpoint", "url", ["ts", "event_id"]))
    I.compact(spark, f"{base}/table", f"{base}/compact", "url")
    return spark.read.parquet(f"{base}/compact").agg(F.count("*").alias("urls"))


@query("stream_dedup_within_watermark", "T2", f"SELECT DISTINCT {_URL} AS url FROM events")
def _(spark, sf):
    base = scratch_path(spark, "dedup")
    first = I.dedup_arrivals(_arrivals(spark, sf), "url", "ts", "3650 days").select("url")
    writer = first.writeStream.format("parquet").option("path", f"{base}/table").option("checkpointLocation", f"{base}/checkpoint")
    _finished(writer.outputMode("append").trigger(availableNow=True).start())
    return spark.read.parquet(f"{base}/table")


@query("stream_only_new_urls", "T1 J6",
       f"SELECT event_id FROM events WHERE {_URL} NOT IN (SELECT {_URL} FROM events WHERE event_id % 50 = 0)")
def _(spark, sf):
    base = scratch_path(spark, "fresh")
    stored = table(spark, sf, "events").where("event_id % 50 = 0").selectExpr(f"{_URL} AS url")
    fresh = I.new_arrivals_only(_arrivals(spark, sf), stored, "url").select("event_id")
    writer = fresh.writeStream.format("parquet").option("path", f"{base}/table").option("checkpointLocation", f"{base}/checkpoint")
    _finished(writer.trigger(availableNow=True).start())
    return spark.read.parquet(f"{base}/table")


#: Deliveries that arrive one after the other, each taken up by a run of its own from the same checkpoint.
DELIVERIES = 8


def _deliver(spark, sf, name, run, rows=lambda df, i: df):
    """run(stream) after each delivery: the events whose id leaves this remainder."""
    base = scratch_path(spark, name)
    events = table(spark, sf, "events").withColumn("url", F.expr(_URL))
    for i in range(DELIVERIES):
        part = rows(events.where(F.col("event_id") % DELIVERIES == i), i)
        part.write.parquet(f"{base}/in/entrega={i}")
        _finished(run(I.read_arrivals(spark, f"{base}/in/entrega=*", part.schema), base))
    return base


@query("stream_merge_over_deliveries", "T1 S9",
       f"""SELECT url, event_id, value FROM (SELECT {_URL} AS url, event_id, value,
       row_number() OVER (PARTITION BY {_URL} ORDER BY event_id % {DELIVERIES} DESC, ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1""")
def _(spark, sf):
    """The same URLs arrive in several deliveries; each is merged into the buckets it touches."""
    base = _deliver(spark, sf, "deliveries", lambda stream, base: I.merge_arrivals(stream, f"{base}/store", f"{base}/checkpoint", "url", ["ts", "event_id"], 16))
    return I.read_store(spark, f"{base}/store").select("url", "event_id", "value")


@query("stream_dedup_after_eviction", "T2",
       f"""WITH a AS (SELECT DISTINCT {_URL} AS url, event_id % {DELIVERIES} AS d FROM events WHERE user_id % 3 <> 0 OR event_id % {DELIVERIES} IN (0, 4)),
       f AS (SELECT url, min(d) AS m FROM a GROUP BY 1)
       SELECT url, m AS entrega FROM f UNION ALL SELECT url, min(d) FROM a JOIN f USING (url) WHERE d >= m + 4 GROUP BY 1""")
def _(spark, sf):
    """Deliveries are ten days apart and the horizon has twelve: what was seen four deliveries ago is forgotten,
    and comes through again; what was seen later is still known."""
    start = F.to_timestamp(F.lit("2024-01-01 00:00:00"))

    def dated(df, i):
        kept = df.where(f"user_id % 3 <> 0 OR {i} IN (0, 4)")
        return kept.select("url", (start + F.expr(f"INTERVAL {10 * i} DAYS")).alias("at"), F.lit(i).cast("bigint").alias("entrega"))

    def run(stream, base):
        first = I.dedup_arrivals(stream, "url", "at", "12 days").select("url", "entrega")
        writer = first.writeStream.format("parquet").option("path", f"{base}/table").option("checkpointLocation", f"{base}/checkpoint")
        return writer.outputMode("append").trigger(availableNow=True).start()

    return spark.read.parquet(f"{_deliver(spark, sf, 'eviction', run, dated)}/table")
