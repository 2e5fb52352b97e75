import hashlib
import random

import pytest
import xxhash
from pyspark.sql import functions as F

from terrametro.llm import near_copies, simhash
from terrametro.llm.components import components
from terrametro.llm.exact import exact_duplicates

DOCS = "doc_id long, text string, h string, n int"


def test_exact_groups_nulls_ties_and_extra_columns(spark):
    rows = [(1, "a", "x", 1), (2, "a", None, 2), (3, None, "y", 3), (4, "", "y", 4), (None, "a", "z", 5), (None, "b", "z", 6), (5, "A", "z", 7), (5, "A", "z", 7)]
    for key in ({}, {"key": lambda t: F.substring(F.encode(F.lower(t), "utf-8"), 1, 1)}):
        got = {(r.doc_id, r.text_sha256[:4]): (r.keep_id, r.group_size, r.kept) for r in exact_duplicates(spark.createDataFrame(rows, DOCS), keep="largest", **key).collect()}
        a, e, b, big = (hashlib.sha256(t).hexdigest()[:4] for t in (b"a", b"", b"b", b"A"))
        assert got == {(1, a): (2, 3, False), (2, a): (2, 3, True), (None, a): (2, 3, False), (3, e): (4, 2, False), (4, e): (4, 2, True), (None, b): (None, 1, True), (5, big): (5, 2, True)}
    assert exact_duplicates(spark.createDataFrame([], DOCS)).count() == 0
    assert {r.keep_id for r in exact_duplicates(spark.createDataFrame(rows[:2], DOCS)).collect()} == {1}


def plain_fingerprint(text, words):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    tokens = [t for t in __import__("re").split(r"[\x20\x09-\x0D]+", low) if t]
    if not tokens:
        return 0
    grams = [" ".join(tokens[i : i + words]) for i in range(max(1, len(tokens) - words + 1))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprint_matches_definition(spark):
    texts = ["", " \n", "One", "a b c d", "a b c d e", "Äé ÀB c\x0bd\x1ce f g", "x y " * 300]
    for t in texts:
        for words in (4, 5):
            assert simhash.fingerprint(t.encode(), words) == plain_fingerprint(t, words)
    got = spark.createDataFrame([("one two three four",)], "t string").select(F.xxhash64("t")).first()[0]
    assert got % (1 << 64) == xxhash.xxh64_intdigest(b"one two three four", 42)


def brute(fps, bits):
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    fps = list(fps)
    for i, a in enumerate(fps):
        for b in fps[:i]:
            if (a ^ b).bit_count() <= bits:
                root[find(a)] = find(b)
    return {f: find(f) for f in fps}


@pytest.mark.parametrize("seed,block", [(1, 2048), (2, 16)])
def test_links_connect_what_brute_force_connects(spark, monkeypatch, seed, block):
    monkeypatch.setattr(simhash, "BLOCK", block)
    rnd = random.Random(seed)
    fps = {rnd.getrandbits(64) for _ in range(150)}
    centre = rnd.getrandbits(64)
    fps |= {centre ^ sum(1 << b for b in rnd.sample(range(64), rnd.randint(0, 4))) for _ in range(120)}
    for f in list(fps)[:60]:
        fps.add(f ^ sum(1 << b for b in rnd.sample(range(64), rnd.randint(3, 6))))
    signed = [(f - (1 << 64) if f >> 63 else f,) for f in fps]
    for bits in (2, 4):
        want = brute(fps, bits)
        roots = {r.node % (1 << 64): r.root for r in components(simhash.links(spark.createDataFrame([(f, f, 0) for f, in signed], "node long, fp long, fp2 long"), bits)).collect()}
        groups = {}
        for f, r in want.items():
            groups.setdefault(r, set()).add(f)
        mine = {}
        for f in fps:
            mine.setdefault(roots.get(f, f), set()).add(f)
        assert sorted(map(sorted, groups.values())) == sorted(map(sorted, mine.values()))


def test_thresholds_follow_the_pigeonhole():
    import numpy as np

    together = np.full((64, 64), 250.0)
    np.fill_diagonal(together, 500.0)
    for parts in range(1, 6):
        groups = simhash.group_bits(1000, together, parts)
        assert sorted(b for g in groups for b in g) == list(range(64))
        _, thresholds = simhash.allocate(1000, np.full(64, 0.5), groups, 4)
        assert sum(t + 1 for t in thresholds) == 5


def test_groups_over_texts(spark):
    base = " ".join(f"w{i}" for i in range(400))
    rows = [(7, base, "f", 1), (3, base + " end", "f", 1), (9, "other words here now", "f", 1), (None, base, "f", 1), (5, None, "f", 1), (4, " ", "f", 1), (4, " ", "f", 1)]
    got = [(r.doc_id, r.component_id) for r in simhash.simhash_groups(spark.createDataFrame(rows, DOCS)).collect()]
    assert sorted(got, key=str) == sorted([(7, 3), (3, 3), (9, 9), (None, 3), (5, 4), (4, 4), (4, 4)], key=str)
    assert simhash.simhash_groups(spark.createDataFrame([], DOCS)).count() == 0


def linked(rows, words=5, percent=80, max_bits=6, loose_bits=26):
    """Smallest id of every text's class, all pairs compared by the rule."""
    sets = {i: {tuple(t.split()[k : k + words]) for k in range(max(1, len(t.split()) - words + 1))} for i, t in rows}
    prints = {i: simhash.fingerprint_pair(t.encode(), words) for i, t in rows}
    root, within = {i: i for i in sets}, 0

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b:
                apart = [(x ^ y).bit_count() for x, y in zip(prints[a], prints[b])]
                near = min(apart) <= max_bits and sum(apart) <= loose_bits
                if near and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                    one, two = sorted((find(a), find(b)))
                    root[two] = one
                    within += 1
    return {i: find(i) for i in sets}, within


def family(seed, size=200, length=200, edits=3):
    rnd = random.Random(seed)
    base, rows = [f"w{rnd.randrange(5000)}" for _ in range(length)], []
    for i in range(size):
        words = list(base)
        for at in rnd.sample(range(length), edits):
            words[at] = f"x{rnd.randrange(10**6)}"
        rows.append((i, " ".join(words)))
    return rows


def answers(spark, rows):
    df = spark.createDataFrame([(*r, "", 0) for r in rows], DOCS).repartition(3)
    return {r.doc_id: r.component_id for r in near_copies.near_copies(df).collect()}


@pytest.mark.parametrize("block", [2048, 8])
def test_near_copies_follow_the_rule_in_crowded_cells(spark, monkeypatch, block):
    monkeypatch.setattr(simhash, "BLOCK", block)
    rows = family(2, edits=2)
    rows += [(1000 + 100 * k + i, t) for k in range(6) for i, t in family(20 + k, 6, 300, 1 + k)]
    want, within = linked(rows)
    assert within > 200 and len(set(want.values())) > 20
    extra = [(5000, None), (5001, ""), (5001, ""), (None, rows[0][1]), (5002, "two words")]
    assert answers(spark, rows + extra) == {**want, 5000: 5000, 5001: 5000, 5002: 5002}


def test_near_copies_of_an_empty_table(spark):
    assert near_copies.near_copies(spark.createDataFrame([], DOCS)).count() == 0


def test_share_of_pairs_linked_by_similarity():
    """What the docstring says of the bits, on pairs of known similarity."""
    rnd, shares = random.Random(6), {}
    for similarity in (0.8, 0.93, 0.97):
        hits = 0
        for _ in range(300):
            common = [rnd.getrandbits(64) for _ in range(600)]
            own = round(600 * (1 - similarity) / similarity / 2)
            prints = []
            for _ in range(2):
                mine = common + [rnd.getrandbits(64) for _ in range(own)]
                monkey = simhash.shingle_hashes
                simhash.shingle_hashes = lambda *_: mine
                prints.append(simhash.fingerprint_pair(b"", 5))
                simhash.shingle_hashes = monkey
            apart = [(x ^ y).bit_count() for x, y in zip(*prints)]
            hits += min(apart) <= 6 and sum(apart) <= 26
        shares[similarity] = hits / 300
    print(shares)
    assert shares[0.93] > 0.85 and shares[0.97] > 0.98 and shares[0.8] < 0.5
