"""Divergence of sources within a language, over run-length columns.

Every source is a column of counts over the language's vocabulary. Terms with equal counts in
all sources are put together, the vocabulary is ordered by its counts, and columns are stored as
runs. Two columns are compared on the intersection of their run boundaries: what a pair adds is
the same all over a segment and counts as often as the segment has terms.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ..sources.staging import staged

SCALE = 1_000_000_000
#: Rows of one block of the ordered vocabulary, a power of two.
BLOCK = 1024
#: Distinct terms of sources a task holds before it hands its counts on.
HELD = 200_000

#: ASCII letters in lower case and bytes of other letters and signs stay, all else is a blank.
_TERM_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c > 127 else 32 for c in range(256))


def term_counts(docs: DataFrame, lang: str, source: str, text: str) -> DataFrame:
    """(lang, source, term, n, docs): occurrences, and rows of the group with the term."""
    rows = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(name) for c, name in ((lang, "lang"), (source, "source"), (text, "text"))])

    def given(held):
        for (lang, source), (n, docs) in held.items():
            if n:
                terms = pa.array(list(n), pa.binary()).cast(pa.string())
                counts = [pa.array(list(n.values()), pa.int64()), pa.array([docs[t] for t in n], pa.int64())]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(n)), pa.array([source] * len(n)), terms, *counts], ["lang", "source", "term", "n", "docs"])

    def run(batches):
        held, size = {}, 0
        for batch in batches:
            texts = batch.column(2).cast(pa.binary())
            for lang, source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts):
                n, docs = held.setdefault((lang, source), (Counter(), Counter()))
                words = text.as_py().translate(_TERM_BYTES).split()
                size -= len(n)
                n.update(words)
                docs.update(set(words))
                size += len(n)
                if size > HELD:
                    yield from given(held)
                    held, size = {}, 0
        yield from given(held)

    parts = rows.mapInArrow(run, "lang string, source string, term string, n bigint, docs bigint")
    return parts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _rate(count: str, total: str) -> str:
    """1 + floor(SCALE * (count + 1) / (total + terms)) in exact arithmetic."""
    return f"1 + (CAST({SCALE} AS DECIMAL(38,0)) * ({count} + 1)) div CAST({total} + terms AS DECIMAL(38,0))"


def column_runs(counts: np.ndarray) -> np.ndarray:
    """Which places of a column start a run of equal counts."""
    return np.concatenate([[True], counts[1:] != counts[:-1]]) if len(counts) else np.zeros(0, bool)


def block_divergence(columns: np.ndarray, times: np.ndarray, totals: list[int], terms: int) -> np.ndarray:
    """Sum of floor((p - q)^2 / q) of every ordered pair of columns over a block of the vocabulary.

    columns: counts, a row per source; times: how many terms each place stands for. Sums stay
    below (SCALE + terms)^2, within 64 bits for vocabularies of up to two billion terms.
    """
    out = np.zeros((len(columns), len(columns)), np.int64)
    starts, rates = [], []
    for column, total in zip(columns, totals):
        start = column_runs(column)
        counts, place = np.unique(column[start], return_inverse=True)
        of = np.array([1 + SCALE * (int(c) + 1) // (total + terms) for c in counts], np.int64)
        starts.append(start)
        rates.append(of[place])
    run_of = [np.cumsum(s) - 1 for s in starts]
    before = np.concatenate([[0], np.cumsum(times)])
    for a in range(len(columns)):
        for b in range(a):
            at = np.flatnonzero(starts[a] | starts[b])
            length = np.diff(before[np.append(at, len(times))])
            p, q = rates[a][run_of[a][at]], rates[b][run_of[b][at]]
            square = (p - q) * (p - q)
            out[a, b], out[b, a] = (square // q * length).sum(), (square // p * length).sum()
    return out


def _pair_sums(vocabulary: DataFrame, languages: DataFrame) -> DataFrame:
    """(lang, source, item, value): what blocks of the vocabulary add to each pair."""
    classes = vocabulary.groupBy("lang", "counts").agg(F.count("*").alias("times"))
    ordered = staged(classes.repartitionByRange("lang", "counts").sortWithinPartitions("lang", "counts").withColumn("at", F.monotonically_increasing_id()), "ordered")
    blocks = ordered.groupBy("lang", F.floor(F.col("at") / BLOCK).alias("block")).agg(F.collect_list(F.struct("at", "times", "counts")).alias("rows"))
    # Few blocks a language, each with the language's list of sources.
    met = blocks.select("lang", "rows").join(languages, "lang").select("lang", "rows", "sources", "terms")

    def run(batches):
        sums, names = {}, {}
        for batch in batches:
            for row in batch.to_pylist():
                sources = [s["source"] for s in row["sources"]]
                place = {s: i for i, s in enumerate(sources)}
                rows = sorted(row["rows"], key=lambda r: r["at"])
                columns = np.zeros((len(sources), len(rows)), np.int64)
                for i, r in enumerate(rows):
                    for c in r["counts"]:
                        columns[place[c["source"]], i] = c["n"]
                times = np.array([r["times"] for r in rows], np.int64)
                found = block_divergence(columns, times, [s["total"] for s in row["sources"]], row["terms"])
                names[row["lang"]] = sources
                sums[row["lang"]] = sums.get(row["lang"], 0) + found
        for lang, total in sums.items():
            a, b = np.nonzero(total)
            of = np.array(names[lang], object)
            yield pa.RecordBatch.from_pydict({
                "lang": pa.array([lang] * len(a), pa.string()), "source": pa.array(of[a], pa.string()),
                "item": pa.array(of[b], pa.string()), "value": pa.array(total[a, b], pa.int64()),
            })

    return met.mapInArrow(run, "lang string, source string, item string, value bigint")


def source_divergence(
    docs: DataFrame, lang_column: str = "lang", source_column: str = "source", text_column: str = "text", least_docs: int = 3, top: int = 200
) -> DataFrame:
    """(lang, source, part, item, value, rank): how far each source lies from the others and from its language.

    Terms are runs of letters, that is of ASCII letters in lower case and of all signs beyond ASCII.
    A language keeps the terms in at least `least_docs` of its rows. A column (a source, or the language)
    gives each kept term p = 1 + floor(1e9 (count + 1) / (all its kept counts + number of kept terms)).
    Part "pair": for each other source of the language the sum of floor((p - q)^2 / q) over all kept
    terms, q being the other's. Part "term": the `top` terms of the source by that value against the
    language, of those it has and that are more frequent in it. Ranks from 1 by value, then item.

    Missing text, language and source count as ''. Every source that has a row takes part, also without
    terms; languages without kept terms have pairs of value 0. A source alone in its language has no pairs.
    Repeated rows count each. An empty table gives no rows. Other columns are ignored. Counts fold before
    they are shuffled, so a hot source costs a task no more than the vocabulary; a row of the
    vocabulary is as long as the language has sources, as are its pairs.
    """
    counted = staged(term_counts(docs, lang_column, source_column, text_column), "counted")
    words = counted.groupBy("lang", "term").agg(
        F.sum("docs").alias("in_docs"), F.sum("n").alias("in_lang"), F.sort_array(F.collect_list(F.struct("source", "n"))).alias("counts")
    )
    vocabulary = staged(words.where(F.col("in_docs") >= least_docs).drop("in_docs"), "vocabulary")

    text = {c: F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (lang_column, source_column)}
    groups = docs.select(text[lang_column].alias("lang"), text[source_column].alias("source")).distinct()
    totals = vocabulary.select("lang", F.inline("counts")).groupBy("lang", "source").agg(F.sum("n").alias("total"))
    sizes = vocabulary.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("in_lang").alias("lang_total"))
    groups = groups.join(totals, ["lang", "source"], "left").join(sizes, "lang", "left").na.fill(0, ["total", "terms", "lang_total"])
    groups = staged(groups, "groups")
    languages = groups.groupBy("lang", "terms").agg(F.sort_array(F.collect_list(F.struct("source", "total"))).alias("sources"))

    others = languages.select("lang", F.explode("sources.source").alias("source"), "sources").select("lang", "source", F.explode("sources.source").alias("item"), F.lit(0).cast("bigint").alias("value"))
    pairs = others.where("source <> item").union(_pair_sums(vocabulary, languages)).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))

    cells = vocabulary.select("lang", "term", "in_lang", F.inline("counts")).join(groups, ["lang", "source"])
    rated = cells.withColumns({"p": F.expr(_rate("n", "total")), "q": F.expr(_rate("in_lang", "lang_total"))}).where("p > q")
    valued = rated.select("lang", "source", F.col("term").alias("item"), F.expr("(p - q) * (p - q) div q").alias("value"))

    def ranked(df, part):
        best = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
        return df.select("lang", "source", F.lit(part).alias("part"), "item", "value", F.row_number().over(best).alias("rank"))

    return ranked(pairs, "pair").union(ranked(valued, "term").where(F.col("rank") <= top))
