"""Corpus pipeline: toxicity, exact duplicates, near duplicates, benchmark passages, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes every result to the
shared folder and reads it back as the next stage's docs. All but the last return the columns of
docs. Rows without an id are never dropped by a stage that decides by id.

All stages: missing texts count as empty, whole texts are read however long, rows that repeat an id and text
are answered alike, ties are settled by the id, an empty table gives an empty one, and extra columns of any name
stay as they are but for the names the last stage gives its results.
"""

import public_tokenizers
from pyspark.sql import functions as F

from terrametro.llm import bpe, decontam, exact, near_copies, toxicity
from terrametro.llm.common import table, without_ids
from terrametro.sources.staging import staged


def drop_toxic(spark, docs, sf_dir):
    """Texts scored below 0.5 stay; the model learns from labelled rows of docs."""
    model = toxicity.fit_toxicity(docs, table(spark, sf_dir, "labels"))
    return docs.where(toxicity.score_column(docs["text"], model, spark) < 0.5)


def drop_copies(spark, docs, sf_dir):
    """Of texts with the same bytes, the row with the largest id stays."""
    found = exact.exact_duplicates(docs, keep="largest")
    return without_ids(docs, found.where("NOT kept"))


def drop_near_copies(spark, docs, sf_dir):
    """Of texts that fingerprints bring together and that share 0.8 or more of their shingles of five words, the smallest id stays."""
    found = near_copies.near_copies(docs, words=5, percent=80)
    return without_ids(docs, found.where("doc_id <> component_id"))


def drop_contaminated(spark, docs, sf_dir):
    """Texts without a word inside a benchmark window of ten words stay."""
    found = decontam.benchmark_hits(docs, table(spark, sf_dir, "benchmark"))
    return without_ids(docs, found.where(F.size("hits") > 0))


def tokenize(spark, docs, sf_dir):
    """All columns of docs, with token_ids, n_tokens and round_trip, whether the ids decode to the text; columns that
    already have one of these three names are replaced."""
    tokens = bpe.read_ranks(spark, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    coded = "coded"
    while coded in docs.columns:
        coded += "_"
    out = docs.withColumn(coded, bpe.encode_column(docs["text"], tokens, public_tokenizers.PATTERN, spark))
    same = F.col(f"{coded}.decoded") == F.encode(F.coalesce("text", F.lit("")), "utf-8")
    given = {"token_ids": F.col(f"{coded}.ids"), "n_tokens": F.size(f"{coded}.ids").cast("long"), "round_trip": same}
    return out.withColumns(given).drop(coded)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("simhash_near_dedup", drop_near_copies),
    ("benchmark_decontamination", drop_contaminated),
    ("byte_bpe", tokenize),
]

#: SQL can express neither the trained scorer nor the tokenizer.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), name)
    return docs
