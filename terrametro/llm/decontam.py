"""Benchmark passages in documents, found in a positional inverted index.

Every document gets postings (term, positions) for the words that occur in the benchmark; the
index is sharded by document and written to the shared folder. A window of an item is looked up
from its rarest word: the places of that word, moved by its offset, are intersected with those
of the next rarest until none is left or all words have agreed.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..sources.staging import staged

#: Characters of benchmark text whose windows are broadcast at once; a larger benchmark takes several passes.
BLOCK_CHARS = 8_000_000

_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    """Runs of ASCII letters, digits and non-ASCII characters, A-Z in lower case."""
    return (text or b"").translate(_FOLD).split()


class Windows:
    """The windows of some benchmark items over a common dictionary of words."""

    def __init__(self, items: list[tuple[str | None, bytes]], length: int):
        self.terms: dict[bytes, int] = {}
        self.items: list[str] = []
        found: dict[tuple, set[int]] = {}
        for item, text in items:
            words = words_of(text)
            if not words:
                continue
            ids = [self.terms.setdefault(w, len(self.terms)) for w in words]
            # Windows without an id hit words, but are nobody's.
            owner = set() if item is None else {len(self.items)}
            if item is not None:
                self.items.append(item)
            span = min(length, len(ids))
            for at in range(len(ids) - span + 1):
                found.setdefault(tuple(ids[at : at + span]), set()).update(owner)
        self.keys = list(found)
        self.owners = [sorted(v) for v in found.values()]

    def order(self, counts: dict[int, int]) -> None:
        """Offsets of each window's words, rarest first by their counts over all documents."""
        self.by_rarity = [sorted(range(len(k)), key=lambda o: (counts.get(k[o], 0), o)) for k in self.keys]
        first = {}
        for w, key in enumerate(self.keys):
            first.setdefault(key[self.by_rarity[w][0]], []).append(w)
        self.by_first = first


def _index(rows: DataFrame, windows, spark: SparkSession, carry: bool) -> DataFrame:
    """Postings of the benchmark's words: per document its terms, their list sizes and the positions."""
    shared = spark.sparkContext.broadcast(windows.terms)

    def run(batches):
        terms = shared.value
        for batch in batches:
            out = {"id": batch.column("id"), "hits": batch.column("hits"), "items": batch.column("items"), "near": batch.column("near")}
            count, ids, sizes, places = [], [], [], []
            for text in batch.column("body").cast(pa.binary()):
                words = words_of(text.as_py())
                found = np.fromiter(map(terms.get, words, [-1] * len(words)), np.int32, len(words))
                at = np.flatnonzero(found >= 0)
                at = at[np.argsort(found[at], kind="stable")]
                term, size = np.unique(found[at], return_counts=True)
                count.append(len(words))
                ids.append(term)
                sizes.append(size.astype(np.int32))
                places.append(at.astype(np.int32))
            out |= {"n_words": pa.array(count, pa.int64()), "terms": _lists(ids), "sizes": _lists(sizes), "places": _lists(places)}
            if carry:
                out["body"] = batch.column("body")
            yield pa.RecordBatch.from_pydict(out)

    schema = f"id {rows.schema['id'].dataType.simpleString()}, hits array<int>, items array<string>, near array<string>, n_words bigint, terms array<int>, sizes array<int>, places array<int>"
    return staged(rows.mapInArrow(run, schema + (", body string" if carry else "")), "postings")


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    sizes = np.zeros(len(arrays) + 1, np.int32)
    np.cumsum([len(a) for a in arrays], out=sizes[1:])
    return pa.ListArray.from_arrays(pa.array(sizes), pa.array(np.concatenate(arrays) if arrays else np.zeros(0, np.int32), pa.int32()))


def _flat(column) -> tuple[np.ndarray, np.ndarray]:
    """Values of a list column and the row of each."""
    sizes = np.diff(column.offsets.to_numpy())
    return column.flatten().to_numpy(), np.repeat(np.arange(len(column)), sizes)


def _frequencies(index: DataFrame) -> dict[int, int]:
    """Occurrences of each benchmark word over all documents: at most one row per word."""

    def run(batches):
        total: dict[int, int] = {}
        for batch in batches:
            terms, sizes = batch.column(0).flatten().to_numpy(), batch.column(1).flatten().to_numpy()
            if len(terms):
                for t, n in enumerate(np.bincount(terms, weights=sizes).astype(np.int64).tolist()):
                    if n:
                        total[t] = total.get(t, 0) + n
        yield pa.RecordBatch.from_pydict({"t": pa.array(list(total), pa.int32()), "n": pa.array(list(total.values()), pa.int64())})

    rows = index.select("terms", "sizes").mapInArrow(run, "t int, n bigint").groupBy("t").agg(F.sum("n").alias("n")).collect()
    return {r["t"]: r["n"] for r in rows}


def _look_up(index: DataFrame, windows, spark: SparkSession, slop: int | None) -> DataFrame:
    shared = spark.sparkContext.broadcast((windows.keys, windows.owners, windows.items, windows.by_rarity, windows.by_first))

    def run(batches):
        keys, owners, items, by_rarity, by_first = shared.value
        for batch in batches:
            terms, row_of = _flat(batch.column("terms"))
            sizes = batch.column("sizes").flatten().to_numpy()
            places = batch.column("places").flatten().to_numpy().astype(np.int64)
            term = np.repeat(terms, sizes)
            where = (np.repeat(row_of, sizes).astype(np.int64) << 32) + places
            order = np.lexsort((where, term))
            term, where = term[order], where[order]
            have, starts = np.unique(term, return_index=True)
            stops = np.append(starts[1:], len(term))
            lists = {t: where[i:j] for t, i, j in zip(have.tolist(), starts.tolist(), stops.tolist())}
            hits: list[np.ndarray] = []
            found, near = set(), set()
            for t in lists.keys() & by_first.keys():
                for w in by_first[t]:
                    key, offsets = keys[w], by_rarity[w]
                    begin = _intersect(lists, key, offsets)
                    if len(begin):
                        hits.append((begin[:, None] + np.arange(len(key))).ravel())
                        found.update((r, o) for r in np.unique(begin >> 32).tolist() for o in owners[w])
                    if slop is not None:
                        close = _intersect_near(lists, key, offsets, slop)
                        near.update((r, o) for r in np.unique(close >> 32).tolist() for o in owners[w])
            yield _merge(batch, hits, found, near, items)

    fields = [f for f in index.schema.fieldNames() if f in ("id", "hits", "items", "near", "n_words", "body")]
    return index.mapInArrow(run, index.select(*fields).schema)


def _intersect(lists, key, offsets) -> np.ndarray:
    begin = lists[key[offsets[0]]] - offsets[0]
    for o in offsets[1:]:
        if not len(begin):
            break
        other = lists.get(key[o])
        if other is None:
            return begin[:0]
        at = np.searchsorted(other, begin + o)
        begin = begin[other[np.minimum(at, len(other) - 1)] == begin + o]
    return begin


def _intersect_near(lists, key, offsets, slop: int) -> np.ndarray:
    begin = lists[key[offsets[0]]] - offsets[0]
    for o in offsets[1:]:
        if not len(begin):
            break
        other = lists.get(key[o])
        if other is None:
            return begin[:0]
        at = np.searchsorted(other, begin + o - slop)
        begin = begin[(at < len(other)) & (other[np.minimum(at, len(other) - 1)] <= begin + o + slop)]
    return begin + offsets[0]


def _merge(batch, hits, found, near, items) -> pa.RecordBatch:
    """The batch with new hits and items added to those of earlier passes."""
    n = batch.num_rows
    old, row = _flat(batch.column("hits"))
    spots = np.unique(np.concatenate([*hits, (row.astype(np.int64) << 32) + old]))
    rows = spots >> 32
    per_row = np.searchsorted(rows, np.arange(n + 1)).astype(np.int32)
    out = {name: batch.column(name) for name in ("id", "n_words", "body") if name in batch.schema.names}
    out["hits"] = pa.ListArray.from_arrays(pa.array(per_row), pa.array((spots & 0xFFFFFFFF).astype(np.int32)))
    for name, pairs in (("items", found), ("near", near)):
        column = [set(x) for x in batch.column(name).to_pylist()]
        for r, o in pairs:
            column[r].add(items[o])
        out[name] = pa.array([sorted(x) for x in column], pa.list_(pa.string()))
    order = [c for c in ("id", "hits", "items", "near", "n_words", "body") if c in out]
    return pa.RecordBatch.from_pydict({c: out[c] for c in order})


def benchmark_hits(
    docs: DataFrame, benchmark: DataFrame, window: int = 10, slop: int | None = None, id_column: str = "doc_id", text_column: str = "text", item_column: str = "item_id"
) -> DataFrame:
    """One row per document: id, n_words, hits (positions of words inside an occurring window),
    items (ids, as sorted text, with such a window), near (ids with a proximity match).

    A window is `window` consecutive words of an item, or all of a shorter item's words.
    slop: if given, near lists the items with a window whose words all stand within slop words of
    their places, as seen from its rarest word; an exact match is one too. Positions count from 0.
    Items without an id count in hits, but are listed nowhere.

    Missing and empty texts have no words, so no hits; an item without words occurs nowhere.
    Rows that repeat an id are answered each. Tables may be empty; other columns are ignored.
    """
    spark = docs.sparkSession
    parts = benchmark.select(F.col(item_column).cast("string").alias("item"), F.col(text_column).alias("body")).where("body IS NOT NULL").distinct()
    chars = parts.agg(F.sum(F.length("body"))).first()[0] or 0
    passes = max(1, -(-chars // BLOCK_CHARS))
    none = F.array().cast("array<string>")
    rows = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("body"), F.array().cast("array<int>").alias("hits"), none.alias("items"), none.alias("near"))
    for k in range(passes):
        block = parts.where(F.pmod(F.xxhash64("item", "body"), F.lit(passes)) == k).collect()
        windows = Windows([(r["item"], r["body"].encode("utf-8")) for r in block], window)
        more = k + 1 < passes
        index = _index(rows, windows, spark, more)
        windows.order(_frequencies(index))
        rows = _look_up(index, windows, spark, slop)
    return rows.select(F.col("id").alias(id_column), "n_words", "hits", "items", "near")
