"""MinHash near duplicates: hash minima, banding, verification, connected components.

Every distinct set of shingles has the minima of many universal hashes. Runs of minima are bands;
sets that agree in a band share a bucket. In a first step each member of a bucket is compared
with the bucket's smallest set only, which settles groups of copies of any size with one pair a
member. Buckets whose other members still belong to different classes are then compared member by
member on signatures, in cells of bounded size, and what may be linked there on the whole sets.
Every link is confirmed on whole sets.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from ..sources.staging import staged
from .common import small
from .components import components
from .simhash import _spanning, shingle_hashes

HASHES = 192
#: Chance to lose a pair just at the threshold, by banding and by comparing signatures.
MISS = 1e-6
#: Members of one cell of signatures, and members and shingles of one cell of whole sets.
SIGNATURE_BLOCK, SET_BLOCK, SET_SHINGLES = 1024, 512, 1 << 20
_CHUNK, _COLUMNS = 1024, 8192

_draw = np.random.default_rng(20111)
_A = _draw.integers(0, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _draw.integers(0, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2)


def band_rows(percent: int) -> int:
    """Minima of a band: the most that lose a pair at the threshold with at most MISS."""
    s = percent / 100
    return max([r for r in range(1, HASHES + 1) if (1 - s**r) ** (HASHES // r) <= MISS], default=1)


def least_same(percent: int) -> int:
    """Equal minima that a pair at the threshold falls short of with at most MISS."""
    s, below = percent / 100, 0.0
    for k in range(HASHES + 1):
        below += math.comb(HASHES, k) * s**k * (1 - s) ** (HASHES - k)
        if below > MISS:
            return k
    return HASHES


def minima(shingles: np.ndarray) -> np.ndarray:
    """The least of (a x + b) mod 2^64, upper half, for every hash; x: 32 bits of each shingle's hash."""
    x, out = shingles & np.uint64(0xFFFFFFFF), None
    for at in range(0, len(x), _CHUNK):
        low = (np.multiply.outer(x[at : at + _CHUNK], _A) + _B).min(axis=0)
        out = low if out is None else np.minimum(out, low)
    return (out >> np.uint64(32)).astype(np.uint32)


def shingle_set(text: bytes | None, words: int) -> np.ndarray:
    """Sorted distinct shingle hashes."""
    return np.unique(np.array(shingle_hashes(text, words), np.uint64))


def hashed_sets(docs: DataFrame, id_column: str, text_column: str, words: int, rows: int) -> DataFrame:
    """(id, n, digest, signature, bands): size and 128-bit digest of the set, a byte of every minimum, keys of its bands."""
    texts = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("body"))
    cuts = [(band, 4 * rows * band, 4 * rows * (band + 1)) for band in range(HASHES // rows)]

    def run(batches):
        for batch in batches:
            n, digests, signatures, bands = [], [], [], []
            for text in batch.column(1).cast(pa.binary()):
                found = shingle_set(text.as_py(), words)
                n.append(len(found))
                if len(found):
                    least = minima(found)
                    raw = least.tobytes()
                    digests.append(hashlib.blake2b(found.tobytes(), digest_size=16).digest())
                    signatures.append((least & np.uint32(255)).astype(np.uint8).tobytes())
                    bands.append(np.array([xxhash.xxh64_intdigest(raw[i:j], band) for band, i, j in cuts], np.uint64).view(np.int64))
                else:
                    digests.append(None), signatures.append(None), bands.append(None)
            columns = [pa.array(n, pa.int64()), pa.array(digests, pa.binary()), pa.array(signatures, pa.binary()), pa.array(bands, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["id", "n", "digest", "signature", "bands"])

    return texts.mapInArrow(run, f"id {texts.schema['id'].dataType.simpleString()}, n bigint, digest binary, signature binary, bands array<bigint>")


def whole_sets(docs: DataFrame, id_column: str, text_column: str, words: int, distinct: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, shingles) of the asked nodes, read again from a text of each; one row a node."""
    asked = distinct.join(nodes, "node", "left_semi").select("node", "digest", "low")
    asked = staged(asked, "asked")
    ids = small(asked.select(F.col("low").alias("wanted")).distinct())
    texts = docs.join(ids, docs[id_column].eqNullSafe(ids["wanted"]), "left_semi").select(F.col(text_column).alias("body"))

    def run(batches):
        for batch in batches:
            sets = [shingle_set(t.as_py(), words).view(np.int64) for t in batch.column(0).cast(pa.binary())]
            digests = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
            yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), pa.array(sets, pa.list_(pa.int64()))], ["digest", "shingles"])

    found = texts.mapInArrow(run, "digest binary, shingles array<bigint>").join(asked.select("node", "digest"), "digest")
    return staged(found.groupBy("node").agg(F.first("shingles").alias("shingles")), "sets")


def alike(pairs: DataFrame, distinct: DataFrame, least: int) -> DataFrame:
    """(a, b, same): pairs whose signatures agree in at least so many minima."""
    one = distinct.select(F.col("node").alias("a"), F.col("signature").alias("x"))
    two = distinct.select(F.col("node").alias("b"), F.col("signature").alias("y"))
    both = pairs.join(two, "b").join(one, "a").select("a", "b", "x", "y")

    def run(batches):
        for batch in batches:
            x, y = (_signatures(batch.column(c)) for c in (2, 3))
            same = (x == y).sum(axis=1)
            out = pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(same, pa.int64())], ["a", "b", "same"])
            yield out.filter(pa.array(same >= least))

    return both.mapInArrow(run, "a bigint, b bigint, same bigint")


def _signatures(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, HASHES)


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b): pairs whose whole sets are linked."""
    one = sets.withColumnsRenamed({"node": "a", "shingles": "x"})
    two = sets.withColumnsRenamed({"node": "b", "shingles": "y"})
    both = pairs.select("a", "b").join(two, "b").join(one, "a").select("a", "b", "x", "y")

    def run(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = x.values.to_numpy(), y.values.to_numpy()
                common = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * common >= percent * (len(x) + len(y) - common))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.mapInArrow(run, "a bigint, b bigint")


def _in_cells(rows: DataFrame, blocks: DataFrame, payload: str, compare) -> DataFrame:
    """compare(left, right, same) -> (i, j) over rows(key, node, root, payload), as links (a, b).

    blocks(key, blocks): members of a key are dealt into so many blocks; any two blocks meet in
    one cell. left and right: (nodes, roots, payloads) of the cell's two blocks.
    """
    dealt = rows.join(blocks, "key").withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")))
    other = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)))
    cells = other.select("key", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "own", "node", "root", payload)
    cells = cells.repartition("key", "x", "y").sortWithinPartitions("key", "x", "y", "own")

    def met(held):
        cell = pa.Table.from_batches(held)
        x, y, own, node, root = (cell.column(c).to_numpy() for c in ("x", "y", "own", "node", "root"))
        values = cell.column(payload).to_pylist()
        parts = []
        for block in (x[0], y[0]):
            at = np.flatnonzero(own == block)
            parts.append((node[at], root[at], [values[i] for i in at]))
        i, j = compare(parts[0], parts[1], x[0] == y[0])
        return pa.RecordBatch.from_arrays([pa.array(parts[0][0][i]), pa.array(parts[1][0][j])], ["a", "b"])

    def run(batches):
        held, key = [], None
        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy() for c in range(3)], axis=1)
            cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
            for i, j in zip([0, *cuts], [*cuts, len(keys)]):
                if j > i:
                    if held and tuple(keys[i]) != key:
                        yield met(held)
                        held = []
                    key = tuple(keys[i])
                    held.append(batch.slice(i, j - i))
        if held:
            yield met(held)

    return cells.mapInArrow(run, "a bigint, b bigint")


def _near_signatures(least: int):
    def compare(left, right, same):
        x, y = (np.frombuffer(b"".join(p[2]), np.uint8).reshape(-1, HASHES) for p in (left, right))
        near = np.zeros((len(x), len(y)), bool)
        for at in range(0, len(x), 64):
            near[at : at + 64] = (x[at : at + 64, None, :] == y[None]).sum(axis=2) >= least
        return _spanning(near & (left[1][:, None] != right[1][None]), same)

    return compare


def common_counts(left: list, right: list) -> np.ndarray:
    """How many values every two sorted lists of distinct values share; columns of the incidence matrix a few at a time."""
    sets = [np.asarray(s, np.int64) for s in (*left, *right)]
    values, place, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    column = np.cumsum(times > 1) - 1
    row, keep = np.repeat(np.arange(len(sets)), [len(s) for s in sets]), times[place] > 1
    row, place = row[keep], column[place[keep]]
    order = np.argsort(place, kind="stable")
    row, place = row[order], place[order]
    out = np.zeros((len(left), len(right)), np.float64)
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, _COLUMNS):
        i, j = np.searchsorted(place, [at, at + _COLUMNS])
        part = np.zeros((len(sets), _COLUMNS), np.float32)
        part[row[i:j], place[i:j] - at] = 1
        out += part[: len(left)] @ part[len(left) :].T
    return out.astype(np.int64)


def _linked_sets(percent: int):
    def compare(left, right, same):
        if not len(left[2]) or not len(right[2]):
            return np.zeros(0, int), np.zeros(0, int)
        sizes = [np.array([len(s) for s in p[2]]) for p in (left, right)]
        common = common_counts(left[2], right[2])
        union = sizes[0][:, None] + sizes[1][None] - common
        return _spanning((100 * common >= percent * union) & (left[1][:, None] != right[1][None]), same)

    return compare


def links_of_sets(whole: DataFrame, percent: int) -> DataFrame:
    """whole(key, node, root, shingles) -> (a, b): links that connect what links between different roots of a key connect."""
    weight = F.greatest(F.ceil(F.count("*") / SET_BLOCK), F.ceil(F.sum(F.size("shingles")) / SET_SHINGLES))
    return _in_cells(whole, whole.groupBy("key").agg(weight.alias("blocks")), "shingles", _linked_sets(percent))


def _classes(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """nodes with root, the smallest node its links reach."""
    roots = components(links).withColumnRenamed("node", "linked")
    return nodes.join(roots, F.col("node") == F.col("linked"), "left").withColumn("root", F.coalesce("root", "node")).drop("linked")


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", words: int = 5, percent: int = 85) -> DataFrame:
    """One row per input row: id, n_shingles, component_id (smallest id reachable over links), kept.

    Two rows are linked if 100 x common shingles >= percent x shingles of both. A row's set: its distinct
    shingles of so many words; with fewer words the whole sequence; without words none, and no links.
    Candidates share a band of minima and agree in enough of all minima; each bound loses a pair at the
    threshold with a chance of at most MISS, pairs above it with less. Links are confirmed on whole sets.

    Rows with equal sets are one node, so copies cost nothing. A bucket gives one pair a member. Where
    members other than its smallest remain in different classes, cells compare them; a cell hands on a
    spanning forest, so that what is written grows with the members also there.

    Missing text has no words. Missing ids never name a component; where a component has no other, its id
    is null. Rows that repeat an id and text have the same answer, rows with equal ids and different texts
    are apart unless linked. kept: id and component_id are equal, both missing included. Extremely long
    texts are held one at a time. An empty table gives no rows. Other columns are ignored.
    """
    rows, least = band_rows(percent), least_same(percent)
    hashed = staged(hashed_sets(docs, id_column, text_column, words, rows), "hashed")
    groups = hashed.where("n > 0").groupBy("digest").agg(F.min("id").alias("low"), F.first("signature").alias("signature"), F.first("bands").alias("bands"))
    distinct = staged(groups.withColumn("node", F.monotonically_increasing_id()), "distinct")

    buckets = distinct.select("node", F.explode("bands").alias("key"))
    firsts = buckets.groupBy("key").agg(F.min("node").alias("first"), F.count("*").alias("members")).where("members > 1")
    shared = staged(buckets.join(firsts, "key"), "buckets")
    stars = shared.where("node <> first").select(F.col("first").alias("a"), F.col("node").alias("b")).distinct()
    stars = staged(alike(stars, distinct, least), "stars")
    nodes = stars.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    sets = whole_sets(docs, id_column, text_column, words, distinct, nodes)
    nearest = stars.groupBy("b").agg(F.max_by("a", F.struct("same", "a")).alias("a")).select("a", "b")
    links = staged(confirmed(nearest, sets, percent), "links")

    # Other pairs of a member matter only where they would join two classes.
    names = staged(_classes(distinct.select("node"), links), "names")
    one, two = names.withColumnsRenamed({"node": "a", "root": "r"}), names.withColumnsRenamed({"node": "b", "root": "s"})
    apart = stars.select("a", "b").join(nearest, ["a", "b"], "left_anti").join(one, "a").join(two, "b").where("r <> s").select("a", "b")
    links = links.union(staged(confirmed(apart, sets, percent), "links"))

    names = staged(_classes(distinct.select("node"), links), "names")
    others = staged(shared.where("node <> first AND members > 2").select("key", "node").join(names, "node"), "others")
    mixed = others.groupBy("key").agg(F.count("*").alias("n"), F.min("root").alias("r"), F.max("root").alias("s")).where("r <> s")
    blocks = staged(mixed.select("key", F.ceil(F.col("n") / SIGNATURE_BLOCK).alias("blocks")), "mixed")
    if not blocks.isEmpty():
        signed = others.join(distinct.select("node", "signature"), "node")
        maybe = staged(_in_cells(signed, blocks, "signature", _near_signatures(least)).distinct(), "maybe")
        families = staged(components(maybe).withColumnRenamed("root", "key"), "families")
        sets = whole_sets(docs, id_column, text_column, words, distinct, families.select("node"))
        whole = families.join(names, "node").join(sets, "node")
        links = links.union(staged(links_of_sets(whole, percent), "links"))
        names = _classes(distinct.select("node"), links)

    named = distinct.select("node", "digest", "low").join(names, "node")
    lowest = named.groupBy("root").agg(F.min("low").alias("component_id"))
    answers = staged(named.join(lowest, "root").select("digest", "component_id"), "answers")
    out = hashed.select("id", "n", "digest").join(answers, "digest", "left")
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id"))
    return out.select(F.col("id").alias(id_column), F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))
