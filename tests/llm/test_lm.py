import math
import random
import re
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from terrametro.llm import lm
from terrametro.llm.common import in_bucket


def tokens(text):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in text or "")) if w] + ["\0end"]


def test_scores(spark, monkeypatch):
    monkeypatch.setattr(lm, "HELD_WORDS", 30)
    # Small steps, as 20,000 tokens give only a few large ones.
    monkeypatch.setattr(lm, "BATCH", 128)
    rnd = random.Random(2)
    tongues = [[f"{p}{i}{p}" for i in range(60)] for p in ("ab", "cd", "ef")]
    docs = [(i, " ".join(rnd.choice(tongues[i % 3]) for _ in range(rnd.randint(20, 80))), "x") for i in range(400)]
    docs += [(500, None, "x"), (501, "", "x"), (None, "AB0ab Éa neverseen", "x"), (3, docs[3][1], "x")]
    table = spark.createDataFrame(docs, "doc_id long, text string, learn string")
    got = lm.score_texts(table, ~in_bucket("doc_id", 7, 2)).collect()
    learn = [zlib.crc32(("" if i is None else str(i)).encode()) % 7 != 2 for i, _, _ in docs]
    counts = Counter(t for (_, text, _), k in zip(docs, learn) if k for t in tokens(text))
    n, v = sum(counts.values()), len(counts)
    want = []
    for (i, text, _), k in zip(docs, learn):
        line = tokens(text)
        base = sum(math.log10((counts[t] + 1) / (n + v + 1)) for t in line)
        want.append((str(i), not k, len(line), sum(counts[t] > 0 for t in line), n, round(base, 6)))
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == sorted(want)
    long = [r for r in got if r.held_out and r.n_tokens > 20]
    assert sum(r.score for r in long) > 0.9 * sum(r.base_score for r in long) and all(r.score < 0 for r in got)
    none = lm.score_texts(table, F.lit(False)).collect()
    assert all(r.train_tokens == 0 and r.n_known == 0 and r.base_score == 0 for r in none)
    assert lm.score_texts(table.limit(0), F.lit(True)).count() == 0


def test_next_word_probabilities_sum_to_one(spark):
    texts = spark.createDataFrame([("a b c a b the end",), ("c c d",)], "body string")
    counts = lm.word_counts(texts)
    vocabulary = lm.Vocabulary(counts, 2)
    assert vocabulary.slot_tokens.sum() == vocabulary.tokens == 12 and vocabulary.slot_words.sum() == vocabulary.distinct
    model = lm.start(vocabulary)
    before = lm.sequence([np.array([1, 2, 200])])[:-1]
    total = sum(10 ** lm.slot_log10(model, np.append(before, s))[-1] for s in range(lm.SLOTS))
    assert abs(total - 1) < 1e-4
    slots = np.random.default_rng(1).integers(0, lm.SLOTS, 700)
    assert abs(lm._whole(model, slots) - lm._whole(model, slots, 64)) < 1e-3
    lines = [slots[:5], slots[5:5], slots[:600], slots[100:130]]
    assert np.allclose(lm._sums(model, lines, 50), [lm._whole(model, x) for x in lines], atol=1e-3)


def test_scores_equal_plain_sums_of_log_probabilities(spark, monkeypatch):
    monkeypatch.setattr(lm, "HELD_WORDS", 25)
    fitted = []
    fit = lm.fit
    monkeypatch.setattr(lm, "fit", lambda texts, vocabulary: fitted.append((fit(texts, vocabulary), vocabulary)) or fitted[0][0])
    rnd = random.Random(4)
    docs = [(i, " ".join(f"w{min(rnd.randrange(200), rnd.randrange(200))}x" for _ in range(rnd.randint(0, 60)))) for i in range(120)] + [(900, "never W1x seen w1x"), (901, None)]
    learn = {i: zlib.crc32(str(i).encode()) % 7 != 2 for i, _ in docs}
    got = {r.doc_id: r.score for r in lm.score_texts(spark.createDataFrame(docs, "doc_id long, text string"), ~in_bucket("doc_id", 7, 2)).collect()}
    model, vocabulary = fitted[0]
    counts = Counter(t for i, text in docs if learn[i] for t in tokens(text))
    top = [w for w, _ in sorted((p for p in counts.items() if p[0] != "\0end"), key=lambda p: (-p[1], p[0]))[: lm.TOP]]
    slot = lambda w: 0 if w == "\0end" else 1 + top.index(w) if w in top else lm.slot_of_rare(w.encode())
    inside = Counter()
    for word, c in counts.items():
        inside[slot(word)] += c + 1
    for i, text in docs:
        line = tokens(text)
        slots = [lm.SLOTS] * (lm.NEAR + lm.WIDE + 1) + [slot(t) for t in line]
        total = 0.0
        for k, word in enumerate(line, lm.NEAR + lm.WIDE + 1):
            vector = model["mix"][lm.NEAR] * sum(model["context"][slots[j]] for j in range(k - lm.NEAR - lm.WIDE, k - lm.NEAR)) / lm.WIDE
            vector = vector + sum(model["mix"][j] * model["context"][slots[k - 1 - j]] for j in range(lm.NEAR))
            scores = model["target"].astype(float) @ vector + model["bias"]
            total += (scores[slots[k]] - np.log(np.exp(scores).sum())) / math.log(10)
            total += math.log10((counts[word] + 1) / (inside[slots[k]] + 1))
        assert abs(total - got[i]) < 1e-3 * max(1, abs(total)), (i, total, got[i])


def test_pieces_keep_their_context_and_one_end():
    slots = np.random.default_rng(3).integers(1, lm.SLOTS, 1000)
    lead = lm.NEAR + lm.WIDE + 1
    cut = list(lm.pieces(slots, 64))
    assert np.array_equal(np.concatenate([p[lead:] for p in cut]), np.append(slots, 0))
    whole = lm.sequence([slots])
    assert all(np.array_equal(p[:lead], whole[64 * k : 64 * k + lead]) for k, p in enumerate(cut))
    assert [len(p) - lead for p in lm.pieces(slots[:0], 64)] == [1]
    model = {"context": np.random.default_rng(1).normal(size=(lm.SLOTS + 1, lm.DIM)).astype(np.float32), "mix": np.ones((lm.NEAR + 1, lm.DIM), np.float32)}
    vectors = lm.predict(model, whole)[0][lead:]
    assert np.allclose(np.concatenate([lm.predict(model, p)[0][lead:] for p in cut]), vectors, atol=1e-4)


def test_step_follows_the_gradient():
    """The step's gradient against finite differences of its noise-contrastive objective."""
    rnd = np.random.default_rng(0)
    share = rnd.random(lm.SLOTS) + 0.1
    share /= share.sum()
    model = {"context": rnd.normal(0, 0.3, (lm.SLOTS + 1, lm.DIM)), "target": rnd.normal(0, 0.3, (lm.SLOTS, lm.DIM)), "mix": rnd.normal(0, 0.5, (lm.NEAR + 1, lm.DIM)), "bias": np.log(share)}
    slots = lm.sequence([rnd.integers(1, 30, 50), rnd.integers(1, 30, 5)])
    aims, noise = np.flatnonzero(slots < lm.SLOTS), rnd.integers(0, 30, lm.NOISE)

    def objective(m):
        h = lm.predict(m, slots)[0][aims]
        shift = np.log(len(noise) * share)
        real = (h * m["target"][slots[aims]]).sum(axis=1) + (m["bias"] - shift)[slots[aims]]
        drawn = h @ m["target"][noise].T + (m["bias"] - shift)[noise]
        return -(np.log1p(np.exp(-real)).sum() + np.log1p(np.exp(drawn)).sum()) / len(aims)

    for name, at in (("context", (7, 3)), ("context", (lm.SLOTS, 2)), ("target", (slots[aims[4]], 1)), ("mix", (1, 4)), ("mix", (lm.NEAR, 0)), ("bias", (int(noise[0]),))):
        up, down = ({k: v.copy() for k, v in model.items()} for _ in range(2))
        up[name][at] += 1e-5
        down[name][at] -= 1e-5
        slope = (objective(up) - objective(down)) / 2e-5
        moved, square = {k: v.copy() for k, v in model.items()}, {k: np.zeros(v.shape) for k, v in model.items()}
        with np.errstate(all="ignore"):
            lm.fit_batch(moved, square, slots, aims, noise, share)
        step = np.sqrt(square[name][at]) * np.sign(np.nan_to_num(moved[name][at] - model[name][at]))
        assert abs(step - slope) < 1e-3 * max(1, abs(slope)), (name, at, step, slope)
