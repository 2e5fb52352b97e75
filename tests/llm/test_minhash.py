import random

import numpy as np
import pytest

from terrametro.llm import minhash

DOCS = "doc_id long, text string, key string, root int, n string"


def plain_sets(rows, words=5):
    out = []
    for i, text, *_ in rows:
        tokens = [t for t in __import__("re").split(r"[\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")) if t]
        out.append((i, {" ".join(tokens[k : k + words]) for k in range(max(1, len(tokens) - words + 1))} if tokens else set()))
    return out


def plain(rows, percent=85):
    """Expected rows, all pairs compared on their sets."""
    sets = plain_sets(rows)
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (_, a) in enumerate(sets):
        for j, (_, b) in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                root[find(i)] = find(j)
    low = {}
    for i, (doc, _) in enumerate(sets):
        if doc is not None:
            low[find(i)] = min(low.get(find(i), doc), doc)
    component = [low.get(find(i)) if s else doc for i, (doc, s) in enumerate(sets)]
    return sorted([(doc, len(s), c, doc == c) for (doc, s), c in zip(sets, component)], key=str)


def answers(spark, rows, **more):
    df = spark.createDataFrame([(*r, "k", 1, "n") for r in rows], DOCS).repartition(3)
    return sorted([tuple(r) for r in minhash.near_duplicates(df, **more).collect()], key=str)


def families(seed, groups, size, length=120, most=6):
    """Variants of one text, variants of variants, so that links go over several steps."""
    rnd = random.Random(seed)
    rows = []
    for _ in range(groups):
        made = [[f"w{rnd.randrange(4000)}" for _ in range(length)]]
        for _ in range(size - 1):
            words = list(rnd.choice(made[-8:]))
            for at in rnd.sample(range(length), rnd.randint(0, most)):
                words[at] = f"x{rnd.randrange(10**6)}"
            made.append(words)
        rows += [(len(rows) + i, " ".join(w)) for i, w in enumerate(made)]
    rnd.shuffle(rows)
    return rows


def test_links_are_those_of_all_pairs(spark):
    rows = families(1, 12, 12)
    rows += [(1000, None), (1001, ""), (1002, " \n\t"), (None, rows[0][1]), (None, "lone words of a row without id here"), (1003, "two Words"), (1004, "TWO words"),
             (1005, "a b c d e"), (1006, "a b c d e"), (1006, "a b c d e"), (1006, "quite another text with the same id as others"), (1007, "Ä b\x0bc d e f"), (1008, "ä b c d e f")]
    assert answers(spark, rows) == plain(rows)
    assert answers(spark, rows, percent=60) == plain(rows, 60)
    assert answers(spark, []) == []


@pytest.mark.parametrize("blocks", [(1024, 512, 1 << 20), (8, 4, 1000)])
def test_large_families_near_the_threshold_lose_no_link(spark, monkeypatch, blocks):
    """Families in which few are linked to the bucket's smallest: cells must find the others."""
    for name, value in zip(("SIGNATURE_BLOCK", "SET_BLOCK", "SET_SHINGLES"), blocks):
        monkeypatch.setattr(minhash, name, value)
    rnd = random.Random(7)
    base, rows = [f"w{rnd.randrange(5000)}" for _ in range(160)], []
    for i in range(120):
        words = list(base)
        for at in rnd.sample(range(160), rnd.choice([1, 2, 3, 4])):
            words[at] = f"y{rnd.randrange(60)}"
        rows.append((i, " ".join(words)))
    got, want = answers(spark, rows), plain(rows)
    assert len({r[2] for r in want}) not in (1, 120)
    assert got == want


def test_very_long_texts_and_many_copies(spark):
    rnd = random.Random(3)
    long = " ".join(f"w{rnd.randrange(10**6)}" for _ in range(60_000))
    rows = [(1, long), (2, long + " tail"), (3, long.upper())] + [(i, "the same short text for many rows of it") for i in range(10, 400)]
    got = {r[0]: r for r in answers(spark, rows)}
    assert {got[i][2] for i in (1, 2, 3)} == {1} and {got[i][2] for i in range(10, 400)} == {10}


def test_bounds_and_counts():
    assert minhash.band_rows(85) == 6 and (1 - 0.85**6) ** 32 <= minhash.MISS
    assert 130 < minhash.least_same(85) < 163
    rnd = np.random.default_rng(2)
    left, right = ([np.unique(rnd.integers(0, 300, rnd.integers(1, 200))) for _ in range(n)] for n in (7, 5))
    want = [[len(np.intersect1d(a, b)) for b in right] for a in left]
    assert (minhash.common_counts(left, right) == np.array(want)).all()
    sets = [rnd.integers(0, 1 << 62, 500).astype(np.uint64) for _ in range(40)]
    errors = []
    for s in sets:
        t = np.concatenate([s[:460], rnd.integers(0, 1 << 62, 40).astype(np.uint64)])
        errors.append((minhash.minima(s) == minhash.minima(t)).mean() - 460 / 540)
    assert abs(np.mean(errors)) < 0.015 and np.std(errors) < 0.04
