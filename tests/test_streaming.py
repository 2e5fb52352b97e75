"""The bucketed store over several deliveries: what a batch rewrites, and what a repeated batch does."""

import glob
import re

from pyspark.sql import functions as F

from terrametro.streaming import incremental as I

ROW = "url string, at int, value double"


def versions(table):
    return {tuple(map(int, re.findall(r"(?:versao|balde)=(\d+)", p))) for p in glob.glob(f"{table}/versao=*/balde=*")}


def test_batches_touch_only_their_buckets(spark, tmp_path):
    table, check, into = (str(tmp_path / n) for n in ("store", "check", "in"))

    def deliver(rows):
        spark.createDataFrame(rows, ROW).write.mode("append").parquet(into)
        query = I.merge_arrivals(I.read_arrivals(spark, into, spark.createDataFrame([], ROW).schema), table, check, "url", ["at"], 8)
        query.awaitTermination()
        assert query.exception() is None

    deliver([(f"u{i}", 1, 1.0) for i in range(100)] + [(None, 1, 1.0), (None, 2, 2.0)])
    before = versions(table)
    assert {b for _, b in before} == set(range(8))
    deliver([("u1", 5, 9.0), ("u1", 4, 8.0), ("new", 1, 3.0)])
    bucket = {r[0]: r[1] for r in spark.createDataFrame([("u1",), ("new",)], "url string").select("url", F.pmod(F.xxhash64("url"), F.lit(8))).collect()}
    assert {b for v, b in versions(table) - before} == set(bucket.values())
    deliver([(None, 3, 7.0)])
    got = {r.url: r.value for r in I.read_store(spark, table).collect()}
    assert got == {**{f"u{i}": 1.0 for i in range(100)}, "u1": 9.0, "new": 3.0, None: 7.0}
    assert I.read_store(spark, table).count() == 102
    assert len(I._current_buckets(spark, table)) == 8 and len(I._current_buckets(spark, table, before=1)) == 8
