import os
import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline

DOCS = "doc_id long, text string, lang string, source string, n_chars long, coded string, gone_id long, token_ids string"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Documents with every case, labels and one benchmark passage."""
    rnd, path = random.Random(12), str(tmp_path_factory.mktemp("tables"))
    vocabulary = [f"word{i}" for i in range(400)]
    passage = " ".join(rnd.choices(vocabulary, k=14))
    rows = []
    for i in range(120):
        words = rnd.choices(vocabulary, k=rnd.randint(60, 90))
        if i % 3 == 0:
            words[::4] = ["vile"] * len(words[::4])
        if i % 3 == 1 and i % 4 == 0:
            words[5:5] = passage.split()
        rows.append((i, " ".join(words)))
    rows += [(300, rows[1][1]), (300, rows[1][1]), (301, rows[2][1] + " tail"), (302, None), (303, ""), (None, rows[5][1]), (304, " ".join(rnd.choices(vocabulary, k=30_000)))]
    spark.createDataFrame([(i, t, "en", "s", 0, "c", 7, "t") for i, t in rows], DOCS).write.parquet(os.path.join(path, "documents.parquet"))
    spark.createDataFrame([(i, i % 2, int(i % 3 == 0)) for i in range(120)], "doc_id long, quality int, toxic int").write.parquet(os.path.join(path, "labels.parquet"))
    spark.createDataFrame([("b1", passage), (None, None)], "item_id string, text string").write.parquet(os.path.join(path, "benchmark.parquet"))
    return path, rows, passage


def test_stages_take_effect_and_keep_columns(spark, folder):
    path, rows, passage = folder
    docs = spark.read.parquet(path + "/documents.parquet")
    columns = docs.columns
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        out = corpus_pipeline.staged(stage(spark, docs, path), name)
        kept[name] = out.select("doc_id", "text").collect()
        assert out.columns == columns if name != "byte_bpe" else set(out.columns) == {*columns, "n_tokens", "round_trip"}
        docs = out
    toxic = {i for i, _ in rows if i is not None and i < 120 and i % 3 == 0}
    first = {r.doc_id for r in kept["toxicity"]}
    assert not toxic & first and {1, 2, 301, 302, 303, 304, None} <= first
    second = [r.doc_id for r in kept["exact_dedup"]]
    assert 1 not in second and second.count(300) == 2 and None in second
    third = {r.doc_id for r in kept["simhash_near_dedup"]}
    assert 2 in third and 301 not in third and len({302, 303} & third) <= 1 and 304 in third
    fourth = {r.doc_id for r in kept["benchmark_decontamination"]}
    assert fourth == {r.doc_id for r in kept["simhash_near_dedup"] if passage not in (r.text or "")}
    last = docs.select("doc_id", "round_trip", "coded", "gone_id", F.size("token_ids").alias("n"), "n_tokens").collect()
    assert all(r.round_trip and r.n == r.n_tokens and r.coded == "c" and r.gone_id == 7 for r in last) and len(last) == len(kept["benchmark_decontamination"])


def test_an_empty_table_passes_all_stages_that_learn_nothing(spark, folder):
    path, _, _ = folder
    docs = spark.read.parquet(path + "/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES[1:]:
        docs = corpus_pipeline.staged(stage(spark, docs, path), name)
    assert docs.count() == 0
