"""Near copies by two SimHash fingerprints, confirmed on whole shingle sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..sources.staging import staged
from .common import small
from .components import components
from .minhash import confirmed, links_of_sets
from .simhash import _named, close_pairs, filed, fingerprints, shingle_sets


def near_copies(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", words: int = 5, percent: int = 80, max_bits: int = 6, loose_bits: int = 26,
) -> DataFrame:
    """One row per input row with an id: id, component_id (smallest id reachable over links).

    Two texts are linked if one of two 64-bit fingerprints over distinct shingles differs in at most max_bits, both
    together in at most loose_bits, and 100 x common shingles >= percent x shingles of both. The pigeonhole finds
    every pair within the bits. Shingle sets of similarity s differ in acos(2s / (1 + s)) / pi of the bits; with
    6 bits about 0.9 of the pairs of similarity 0.93 are linked, more above it and fewer below.

    Cells give a spanning forest of their close pairs, and its pairs are confirmed on whole sets. Where that leaves
    close pairs in different classes, cells of whole sets compare the members that have such a pair. What is
    written grows with the texts also in crowded groups; only the comparing inside a task does not.

    Rows without an id take no part. Missing, empty and blank texts are linked with each other. Repeated rows are
    answered alike. Texts that share both fingerprints are one node, compared by one of them. Very long texts are
    held one at a time. An empty table gives no rows. Other columns are ignored.
    """
    docs = docs.where(F.col(id_column).isNotNull())
    hashed = staged(fingerprints(docs, id_column, text_column, words, True), "fingerprints")
    distinct = staged(hashed.groupBy("fp", "fp2").agg(F.min("id").alias("low")).withColumn("node", F.xxhash64("fp", "fp2")), "distinct")
    nodes = distinct.select("node")

    def sets_of(asked: DataFrame) -> DataFrame:
        ids = small(staged(distinct.join(asked, "node", "left_semi").select(F.col("low").alias("wanted")).distinct(), "wanted"))
        texts = docs.join(ids, docs[id_column] == ids["wanted"], "left_semi")
        return staged(shingle_sets(texts, text_column, words), "shingles")

    def with_roots(links: DataFrame) -> DataFrame:
        roots = components(links).withColumnRenamed("node", "linked")
        return staged(nodes.join(roots, F.col("node") == F.col("linked"), "left").select("node", F.coalesce("root", "node").alias("root")), "roots")

    cells = filed(distinct.select("node", "fp", "fp2"), ["fp", "fp2"], max_bits)
    pairs = staged(close_pairs(cells.withColumn("root", F.col("node")), max_bits, loose_bits), "pairs")
    linked = staged(confirmed(pairs, sets_of(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()), percent), "confirmed")
    names = with_roots(linked)

    # A refuted pair may have stood for others of its cell.
    one, two = names.withColumnsRenamed({"node": "a", "root": "r"}), names.withColumnsRenamed({"node": "b", "root": "s"})
    refuted = staged(pairs.join(one, "a").join(two, "b").where("r <> s").select(F.explode(F.array("r", "s")).alias("root")).distinct(), "refuted")
    if not refuted.isEmpty():
        more = staged(close_pairs(cells.join(names.join(refuted, "root", "left_semi"), "node"), max_bits, loose_bits), "open")
        families = staged(components(more).withColumnRenamed("root", "key"), "families")
        whole = families.join(names, "node").join(sets_of(families.select("node")), "node")
        names = with_roots(linked.union(staged(links_of_sets(whole, percent), "confirmed")))
    return _named(hashed, distinct, names).select(F.col("id").alias(id_column), "component_id")
