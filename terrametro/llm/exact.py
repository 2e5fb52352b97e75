"""Exact duplicates by 128-bit content hash, with byte comparison inside groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..sources.staging import staged
from .common import small

_KEEP = {"smallest": F.min, "largest": F.max}


def content_hash(text: Column) -> Column:
    """128 bits: the first half of SHA-256, which resists collisions made on purpose."""
    return F.substring(F.unhex(F.sha2(text, 256)), 1, 16)


def exact_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", keep: str = "smallest", key=content_hash) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    keep: "smallest" or "largest" id of a group stays. key: the content hash, text to binary.

    Ids are grouped by hash, without texts. Only rows whose hash occurs more than once are
    then grouped by hash and bytes. Both groupings fold copies before they shuffle, so a group
    of any size reaches a task as one row per map task. Where one hash has several texts, its
    rows are told apart by their bytes.

    A missing text counts as empty. Missing ids never stand for a group that has another id;
    where a group has none, keep_id is null and its rows are all kept. Rows that repeat an id
    and its text have the same answer. An empty table gives no rows. Other columns are ignored.
    """
    best = _KEEP[keep]
    rows = docs.select(F.col(id_column).alias("id"), F.coalesce(F.col(text_column), F.lit("")).alias("body"))
    digests = staged(rows.select("id", key(F.col("body")).alias("h"), F.unhex(F.sha2("body", 256)).alias("sha")), "digests")
    groups = digests.groupBy("h").agg(F.count("*").alias("n"), best("id").alias("keep_id"))
    repeated = staged(groups.where("n > 1"), "repeated")
    members = rows.withColumn("h", key(F.col("body"))).join(small(repeated.select("h")), "h", "left_semi")
    texts = members.groupBy("h", "body").agg(F.count("*").alias("n"), best("id").alias("keep_id"))
    mixed = staged(texts.groupBy("h").agg(F.count("*").alias("texts")).where("texts > 1").select("h"), "mixed")

    alone = digests.join(repeated, "h", "left")
    if not mixed.isEmpty():
        exact = members.join(mixed, "h", "left_semi")
        told = exact.groupBy("h", "body").agg(F.count("*").alias("n"), best("id").alias("keep_id"))
        # The bytes decide; the full digest only saves hashing again.
        split = exact.join(told, ["h", "body"]).select("id", "h", F.unhex(F.sha2("body", 256)).alias("sha"), "n", "keep_id")
        alone = alone.join(mixed, "h", "left_anti").select("id", "h", "sha", "n", "keep_id").unionByName(split)
    single = F.col("n").isNull()
    keep_id = F.when(single, F.col("id")).otherwise(F.col("keep_id"))
    return alone.select(
        F.col("id").alias(id_column), keep_id.alias("keep_id"), F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        F.col("id").eqNullSafe(keep_id).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"),
    )
