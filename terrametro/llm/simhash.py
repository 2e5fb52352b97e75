"""SimHash near duplicates by the generalised pigeonhole principle.

The 64 bits are dealt into parts, correlated bits together, and part i gets a threshold t_i
such that sum(t_i + 1) = max_bits + 1. Of two fingerprints within max_bits, at least one part
then differs in at most t_i bits. For each part a fingerprint is filed under its bits with every
choice of t_i of them blanked: two that differ in at most t_i bits of the part share a bucket.
Buckets are compared in blocks of bounded size.
"""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from ..sources.staging import staged
from .common import small
from .components import components

BITS = 64
#: Fingerprints of one bucket that are compared in one block; larger buckets are cut into blocks.
BLOCK = 2048
#: Relative costs of filing a fingerprint in one bucket and of comparing one pair.
FILE_COST, COMPARE_COST = 1.0, 0.004
_CHUNK = 1 << 15


def fingerprint(text: bytes | None, words: int = 4) -> int:
    """SimHash of the word shingles, repeats counted; 0 for a text without words."""
    return fingerprint_pair(text, words, False)[0]


def shingle_hashes(text: bytes | None, words: int) -> list[int]:
    """XXH64 of every shingle in order; of the whole sequence if it has fewer words."""
    tokens = (text or b"").lower().split()
    if not tokens:
        return []
    line, digest = b" ".join(tokens), xxhash.xxh64_intdigest
    if len(tokens) <= words:
        return [digest(line, 42)]
    sizes = np.fromiter(map(len, tokens), np.int64, len(tokens))
    begin = np.zeros(len(tokens), np.int64)
    np.cumsum(sizes[:-1] + 1, out=begin[1:])
    end = (begin + sizes)[words - 1 :]
    return [digest(line[i:j], 42) for i, j in zip(begin.tolist(), end.tolist())]


def fingerprint_pair(text: bytes | None, words: int, second: bool = True) -> tuple[int, int]:
    """The fingerprint and an independent one, from the same hashes mixed once more. The pair
    is taken over distinct shingles, the fingerprint alone counts repeats."""
    hashes = shingle_hashes(text, words)
    if not hashes:
        return 0, 0
    if second:
        hashes = list(set(hashes))
    first, other = np.zeros(BITS, np.int64), np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), _CHUNK):
        part = np.array(hashes[at : at + _CHUNK], dtype="<u8")
        first += _votes(part)
        if second:
            part = (part ^ (part >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            part = (part ^ (part >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            other += _votes(part ^ (part >> np.uint64(31)))
    return tuple(int(np.packbits(v * 2 > len(hashes), bitorder="little").view("<u8")[0]) for v in (first, other))


def _votes(hashes: np.ndarray) -> np.ndarray:
    return np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)


def fingerprints(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", words: int = 4, second: bool = False) -> DataFrame:
    """(id, fp, fp2): fingerprints as signed bigints; fp2 is 0 unless second."""
    rows = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("body"))

    def run(batches):
        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            found = np.array([fingerprint_pair(t.as_py(), words, second) for t in texts], np.uint64).reshape(-1, 2).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found[:, 0]), pa.array(found[:, 1])], ["id", "fp", "fp2"])

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, fp bigint, fp2 bigint")


def bit_statistics(fps: DataFrame, column: str = "fp") -> tuple[int, np.ndarray]:
    """Number of fingerprints and the 64 x 64 counts of bits set together."""

    def run(batches):
        total, n = np.zeros((BITS, BITS)), 0
        for batch in batches:
            bits = np.unpackbits(batch.column(0).to_numpy().view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
            for at in range(0, len(bits), _CHUNK):
                total += bits[at : at + _CHUNK].T @ bits[at : at + _CHUNK]
            n += len(bits)
        yield pa.RecordBatch.from_pydict({"pos": np.arange(-1, BITS * BITS), "n": np.concatenate([[n], total.ravel()]).astype(np.int64)})

    rows = fps.select(column).mapInArrow(run, "pos bigint, n bigint").groupBy("pos").agg(F.sum("n").alias("n")).collect()
    flat = np.zeros(BITS * BITS + 1)
    for row in rows:
        flat[row["pos"] + 1] = row["n"]
    return int(flat[0]), flat[1:].reshape(BITS, BITS)


def group_bits(n: int, together: np.ndarray, parts: int) -> list[list[int]]:
    """Parts of near equal width; each is grown from a free bit by its most correlated free bits."""
    mean = np.diag(together) / max(n, 1)
    cov = together / max(n, 1) - np.outer(mean, mean)
    spread = np.sqrt(np.maximum(np.diag(cov), 1e-12))
    strength = np.abs(cov / np.outer(spread, spread))
    np.fill_diagonal(strength, 0)
    free, groups = list(range(BITS)), []
    for k in range(parts):
        width = len(free) // (parts - k)
        group = [max(free, key=lambda b: strength[b, free].sum())]
        free.remove(group[0])
        while len(group) < width:
            nearest = max(free, key=lambda b: strength[b, group].sum())
            group.append(nearest)
            free.remove(nearest)
        groups.append(sorted(group))
    return groups


def allocate(n: int, mean: np.ndarray, groups: list[list[int]], max_bits: int) -> tuple[float, list[int]]:
    """Thresholds (-1: part unused) with sum(t + 1) = max_bits + 1 of least estimated cost.

    A part's candidates at threshold t: pairs times the chance that at most t of its bits
    differ, bits taken as independent with their measured means.
    """
    n, budget = max(n, 2), max_bits + 1
    pairs = n * (n - 1) / 2
    best = {0: (0.0, [])}
    for group in groups:
        chance = np.array([1.0])
        for b in group:
            p = 2 * mean[b] * (1 - mean[b])
            chance = np.convolve(chance, [1 - p, p])
        below, after = np.cumsum(chance), {}
        for used, (cost, chosen) in best.items():
            for t in range(-1, min(len(group), budget - used - 1) + 1):
                filed = math.comb(len(group), t) if t >= 0 else 0
                more = cost + (FILE_COST * n * filed + COMPARE_COST * pairs * below[t] * filed if filed else 0.0)
                if used + t + 1 not in after or more < after[used + t + 1][0]:
                    after[used + t + 1] = (more, [*chosen, t])
        best = after
    return best[budget]


def plan_masks(n: int, together: np.ndarray, max_bits: int) -> list[int]:
    """Masks of the bits that stay in a bucket's key, for the cheapest number of parts."""
    mean = np.diag(together) / max(n, 1)
    plans = []
    for parts in range(1, max_bits + 2):
        groups = group_bits(n, together, parts)
        cost, thresholds = allocate(n, mean, groups, max_bits)
        plans.append((cost, parts, groups, thresholds))
    _, _, groups, thresholds = min(plans, key=lambda p: p[:2])
    masks = []
    for group, t in zip(groups, thresholds):
        if t >= 0:
            whole = sum(1 << b for b in group)
            masks += [whole & ~sum(1 << b for b in blank) for blank in combinations(group, t)]
    return masks


def _spanning(near: np.ndarray, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Links of a block pair (same: of a block with itself): all if few, else a spanning forest."""
    i, j = np.nonzero(np.triu(near, 1) if same else near)
    if len(i) <= 4 * sum(near.shape):
        return i, j
    rows, cols, out_a, out_b = near.any(axis=1), near.any(axis=0), [], []
    while rows.any():
        frontier = np.array([np.argmax(rows)])
        rows[frontier] = False
        if same:
            cols[frontier] = False
        while len(frontier):
            reach = near[frontier] & cols
            found = np.flatnonzero(reach.any(axis=0))
            if not len(found):
                break
            out_a.append(frontier[reach[:, found].argmax(axis=0)])
            out_b.append(found)
            cols[found] = False
            if same:
                rows[found] = False
                frontier = found
            else:
                back = near[:, found] & rows[:, None]
                frontier = np.flatnonzero(back.any(axis=1))
                out_a.append(frontier)
                out_b.append(found[back[frontier].argmax(axis=1)])
                rows[frontier] = False
    return np.concatenate(out_a), np.concatenate(out_b)


def filed(fps: DataFrame, columns: list[str], max_bits: int) -> DataFrame:
    """fps(node, fp, fp2), distinct -> (k, v, x, y, own, node, fp, fp2): the cells in which all
    pairs within max_bits of a column meet."""
    keys = []
    for column in columns:
        for m in plan_masks(*bit_statistics(fps, column), max_bits):
            value = F.col(column).bitwiseAND(F.lit(m - (1 << 64) if m >> 63 else m).cast("bigint"))
            keys.append(F.struct(F.lit(len(keys)).alias("k"), value.alias("v")))
    rows = fps.select("node", "fp", "fp2", F.explode(F.array(*keys)).alias("key")).select("key.k", "key.v", "node", "fp", "fp2")
    # Buckets beyond a block are cut into blocks; every pair of blocks meets in one cell.
    sizes = rows.groupBy("k", "v").agg(F.count("*").alias("size")).where(F.col("size") > BLOCK)
    blocks = small(staged(sizes.select("k", "v", F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks")), "crowded"))
    own = F.when(F.col("blocks").isNull(), 0).otherwise(F.pmod(F.xxhash64("node"), F.col("blocks"))).cast("int")
    dealt = rows.join(blocks, ["k", "v"], "left").withColumn("own", own)
    others = F.explode(F.sequence(F.lit(0), F.coalesce(F.col("blocks"), F.lit(1)) - 1))
    return dealt.withColumn("other", others).select(
        "k", "v", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "own", "node", "fp", "fp2"
    )


def _in_cells(cells: DataFrame, compare, schema: str) -> DataFrame:
    """compare(left, right, same) over the rows of each cell's two blocks, as int64 columns of cells in order."""
    cells = cells.repartition("k", "v", "x", "y").sortWithinPartitions("k", "v", "x", "y", "own")

    def run(batches):
        held = None
        for batch in batches:
            rows = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in range(batch.num_columns)], axis=1)
            rows = rows if held is None else np.concatenate([held, rows])
            cuts = np.flatnonzero((rows[1:, :4] != rows[:-1, :4]).any(axis=1)) + 1
            edges = [0, *cuts.tolist()]
            held = rows[edges[-1] :]
            yield from met(rows, edges)
        if held is not None:
            yield from met(held, [0, len(held)])

    def met(rows, edges):
        found = []
        for i, j in zip(edges[:-1], edges[1:]):
            if j - i > 1:
                cell = rows[i:j]
                same = cell[0, 2] == cell[0, 3]
                left = np.ones(j - i, bool) if same else cell[:, 4] == cell[0, 2]
                found += compare(cell[left], cell[left if same else ~left], same)
        if found:
            yield pa.Table.from_batches(found).combine_chunks().to_batches()[0] if len(found) > 1 else found[0]

    return cells.mapInArrow(run, schema)


def _apart(p: np.ndarray, q: np.ndarray, column: int) -> np.ndarray:
    return np.bitwise_count(p[:, None, column].view(np.uint64) ^ q[None, :, column].view(np.uint64))


def links(fps: DataFrame, max_bits: int = 4) -> DataFrame:
    """fps(node, fp, fp2), distinct -> (a, b): pairs that connect all that pairs within max_bits of fp connect."""

    def compare(p, q, same):
        i, j = _spanning(_apart(p, q, 6) <= max_bits, same)
        return [pa.RecordBatch.from_pydict({"a": p[i, 5], "b": q[j, 5]})] if len(i) else []

    return _in_cells(filed(fps, ["fp"], max_bits), compare, "a bigint, b bigint")


def close_pairs(cells: DataFrame, max_bits: int, loose_bits: int) -> DataFrame:
    """cells of filed() with root, a class of the node -> (a, b): a spanning forest of each cell's pairs of different
    classes that differ in at most max_bits of one fingerprint and in at most loose_bits of both."""

    def compare(p, q, same):
        one, two = _apart(p, q, 6), _apart(p, q, 7)
        near = (np.minimum(one, two) <= max_bits) & (one + two <= loose_bits) & (p[:, None, 8] != q[None, :, 8])
        i, j = _spanning(near, same)
        return [pa.RecordBatch.from_pydict({"a": p[i, 5], "b": q[j, 5]})] if len(i) else []

    pairs = _in_cells(cells.select("k", "v", "x", "y", "own", "node", "fp", "fp2", "root"), compare, "a bigint, b bigint")
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def shingle_sets(docs: DataFrame, text_column: str, words: int) -> DataFrame:
    """(node, shingles): the sorted distinct shingle hashes of each text, by its pair of fingerprints."""
    rows = docs.select(F.col(text_column).alias("body"))

    def run(batches):
        for batch in batches:
            texts = [t.as_py() for t in batch.column(0).cast(pa.binary())]
            prints = np.array([fingerprint_pair(t, words) for t in texts], np.uint64).reshape(-1, 2).view(np.int64)
            sets = [np.unique(np.array(shingle_hashes(t, words), np.uint64).view(np.int64)) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [pa.array(prints[:, 0]), pa.array(prints[:, 1]), pa.array(sets, pa.list_(pa.int64()))], ["fp", "fp2", "shingles"]
            )

    sets = rows.mapInArrow(run, "fp bigint, fp2 bigint, shingles array<bigint>")
    return sets.select(F.xxhash64("fp", "fp2").alias("node"), "shingles").dropDuplicates(["node"])


def _named(hashed: DataFrame, distinct: DataFrame, roots: DataFrame) -> DataFrame:
    """hashed with the smallest id of each component of nodes."""
    linked = roots.withColumnRenamed("node", "linked")
    named = distinct.join(linked, F.col("node") == F.col("linked"), "left").select("fp", "fp2", "low", F.coalesce("root", "node").alias("root"))
    lowest = named.groupBy("root").agg(F.min("low").alias("component_id"))
    classes = staged(named.join(lowest, "root").select("fp", "fp2", "component_id"), "classes")
    return hashed.join(classes, ["fp", "fp2"])


def simhash_groups(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", words: int = 4, max_bits: int = 4) -> DataFrame:
    """One row per input row: id, fingerprint (16 hex digits), component_id (smallest id reachable over links).

    Links are compared once per distinct fingerprint, so copies cost nothing. Texts that are
    missing, empty or blank share fingerprint zero and are linked like others. Missing ids
    never name a component; one that has no other id is null. Repeated rows are answered
    alike. An empty table gives no rows. Other columns are ignored.
    """
    hashed = staged(fingerprints(docs, id_column, text_column, words), "fingerprints")
    distinct = staged(hashed.groupBy("fp", "fp2").agg(F.min("id").alias("low")).withColumn("node", F.col("fp")), "distinct")
    roots = staged(components(links(distinct.select("node", "fp", "fp2"), max_bits)), "roots")
    out = _named(hashed, distinct, roots)
    return out.select(F.col("id").alias(id_column), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
