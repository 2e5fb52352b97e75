import random

import numpy as np
import pytest

from terrametro.llm import decontam, toxicity

DOCS = "doc_id long, text string, items string"


def brute(text, items, window=10):
    words = decontam.words_of((text or "").encode())
    hit, found = set(), set()
    for item, body in items:
        w = decontam.words_of((body or "").encode())
        span = min(window, len(w))
        for i in range(len(w) - span + 1 if w else 0):
            for s in range(len(words) - span + 1):
                if words[s : s + span] == w[i : i + span]:
                    hit |= set(range(s, s + span))
                    found |= {item} - {None}
    return sorted(hit), sorted(found)


@pytest.mark.parametrize("block", [8_000_000, 150])
def test_hits_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(decontam, "BLOCK_CHARS", block)
    rnd = random.Random(3)
    vocabulary = ["the", "of", "Rare", "wörd", "x1", "a"]
    phrase = lambda n: " ".join(rnd.choice(vocabulary) for _ in range(n))
    items = [(str(i), phrase(n)) for i, n in enumerate((1, 3, 10, 14, 30, 12))] + [("9", None), ("10", ""), ("11", "of"), ("11", "of"), (None, "x1 wörd a"), (None, phrase(12))]
    docs = [(i, phrase(rnd.randint(0, 60)) + " -- " + rnd.choice(items[:6])[1].upper().replace("Ö", "ö"), "c") for i in range(40)]
    docs += [(60, items[-1][1], "c"), (None, items[3][1], "c"), (50, None, "c"), (51, "", "c"), (1, docs[1][1], "c")]
    got = decontam.benchmark_hits(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, "item_id string, text string"), slop=2).collect()
    assert sorted([(str(r.doc_id), r.hits, r.items) for r in got]) == sorted([(str(i), *brute(t, items)) for i, t, _ in docs])
    assert all(set(r["items"]) <= set(r.near) for r in got)
    assert decontam.benchmark_hits(spark.createDataFrame([], DOCS), spark.createDataFrame(items, "item_id string, text string")).count() == 0
    assert decontam.benchmark_hits(spark.createDataFrame(docs, DOCS), spark.createDataFrame([], "item_id string, text string")).where("size(hits) > 0").count() == 0


def test_proximity_tolerates_shifts(spark):
    docs = spark.createDataFrame([(1, "alpha one two beta three four gamma five six seven eight nine", "")], DOCS)
    items = spark.createDataFrame([(5, "alpha one beta three four gamma five six seven eight")], "item_id int, text string")
    row = decontam.benchmark_hits(docs, items, slop=2).first()
    assert (row["items"], row.near) == ([], ["5"])
    rows = [(1, "alpha one far far far beta", ""), (2, "alpha one", ""), (3, "alpha gap beta one", ""), (4, "one alpha beta", "")]
    items = spark.createDataFrame([(6, "alpha one beta")], "item_id int, text string")
    near = {r.doc_id: r.near for r in decontam.benchmark_hits(spark.createDataFrame(rows, DOCS), items, slop=2).collect()}
    assert near == {1: [], 2: [], 3: ["6"], 4: ["6"]}


def test_toxicity_learns_stems_and_handles_edges(spark):
    rnd = random.Random(0)
    clean = lambda: [f"w{rnd.randrange(300)}" for _ in range(rnd.randint(5, 60))]
    texts, labels = [], []
    for i in range(600):
        words, bad = clean(), i % 4 == 0
        if bad:
            words.insert(rnd.randrange(len(words)), rnd.choice(["idiot", "scumx", "lowei" + rnd.choice("abcdefgh")]))
        texts.append(" ".join(words))
        labels.append(int(bad))
    model = toxicity.train(texts, np.array(labels))
    fresh = [" ".join(clean()) for _ in range(50)]
    assert (model.score(fresh) < 0.5).mean() > 0.97
    assert (model.score([t + " loweiz" for t in fresh]) >= 0.5).mean() > 0.9
    assert len(model.score(["", None, " "])) == 3 and len(model.score([])) == 0
    long = " ".join(fresh * 40)
    chunk, toxicity.CHUNK = toxicity.CHUNK, 64
    parts = model.score([long, *fresh, ""])
    toxicity.CHUNK = chunk
    assert np.allclose(parts, model.score([long, *fresh, ""]), atol=1e-5)
    assert max(map(len, map(toxicity.words_of, [long]))) > 3 * 64
    one = toxicity.train(["a", "b"], np.array([0, 0]))
    assert (one.score(["a", ""]) < 0.5).all()
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] + [(None, None, "x"), (7, "", "x")], DOCS)
    marks = spark.createDataFrame([(i, b, 1) for i, b in enumerate(labels)] + [(None, 1, 1), (3, None, 1)], "doc_id long, toxic int, text int")
    fitted = toxicity.fit_toxicity(docs, marks)
    assert docs.select(toxicity.score_column(docs.text, fitted, spark).alias("s")).where("s between 0 and 1").count() == 602
    assert (toxicity.fit_toxicity(docs.limit(0), marks).score(["a"]) < 0.5).all()
