import hashlib
import itertools
import random
import re
import zlib
from collections import Counter

import pytest

from terrametro.llm import divergence, repair

TURNS = "conv_id long, turn long, role string, text string, k string, at int"
SPACE = "\x20\x09\x0a\x0b\x0c\x0d"


def plain_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind:
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            out += [(conv, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


def faults(rows):
    seen, out = set(), []
    for _, _, role, text in rows:
        bare = text.rstrip(SPACE)
        out.append("blank" if not bare else "duplicate" if (role, text) in seen else "none" if bare[-1] in ".!?" else "truncated")
        seen.add((role, text))
    return out


def edits(rows, found, gap=2):
    """Every way to edit the turns: (cost, audit, lines, initials), up to `gap` insertions in a row."""
    between = [(2 * n, "I" * n, [(r, "") for r in roles]) for n in range(gap + 1) for roles in itertools.product(("user", "assistant"), repeat=n)]
    ways = list(between)
    for (_, _, role, text), fault in zip(rows, found):
        more = fault == "truncated"
        each = [(3, "D", [])]
        if fault in ("none", "truncated"):
            each += [(more, "K", [(role, text)])] + [(2 + more, "R", [(r, text)]) for r in ("user", "assistant")]
        ways = [(a + b + c, x + y + z, p + q + s) for a, x, p in ways for b, y, q in each for c, z, s in between if len(p + q + s) <= 2 * len(rows) + 2]
    return ways


def brute(rows):
    """Expected row of one conversation by trying every edit."""
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), r[3].encode()))
    found = faults(rows)
    sound = [w for w in edits(rows, found) if re.fullmatch("(s?(ua)+)?", "".join(r[:1] or "-" for r, _ in w[2]))]
    cost, audit, lines = min(sound, key=lambda w: w[:2])
    turns = [r[1] for r in rows if r[1] is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in lines).encode()).hexdigest()
    return (gaps, found.count("blank"), found.count("duplicate"), found.count("truncated"), illegal, cost, audit, digest)


def answer(r):
    return (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256)


def some_turns(seed, conversations, longest):
    rnd = random.Random(seed)
    rows = []
    for conv in range(conversations):
        for turn in range(rnd.randint(0, longest)):
            role = rnd.choice(["user", "assistant", "user", "assistant", "system", "tool", None, ""])
            text = rnd.choice(["Hi.", "Yes!", "no", "", None, " \n", "What? ", "ä…", "end. "])
            rows.append((rnd.choice([conv, conv, conv, None]) if conv == 0 and turn < 2 else conv, rnd.choice([turn, turn, turn + 1, None]), role, text))
    return rows


def test_repairs_are_those_of_trying_every_edit(spark):
    rows = some_turns(3, 60, 3)
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], TURNS)
    got = {r.conv_id: answer(r) for r in repair.repair(df).collect()}
    after = plain_damage(rows)
    assert set(got) == {r[0] for r in rows}
    for conv in got:
        assert got[conv] == brute([r for r in after if r[0] == conv]), conv
    assert repair.repair(spark.createDataFrame([], TURNS)).count() == 0


def forward(codes):
    """(cost, audit) turn by turn over the automaton, an independent reading of the grammar."""
    move = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}

    def insert(now):
        for _ in range(3):
            for state, (cost, audit) in list(now.items()):
                for role in "ua":
                    if state in move[role]:
                        now[move[role][state]] = min(now.get(move[role][state], (10**9, "")), (cost + 2, audit + "I"))
        return now

    now = insert({0: (0, "")})
    for code in codes:
        which, fault = divmod("ABCDEFGHIJKLMNOP".index(code), 4)
        then = {}
        for state, (cost, audit) in now.items():
            steps = [(state, 3, "D")]
            if fault < 2:
                steps += [(move[r][state], fault + (0 if letter == "K" else 2), letter) for r, letter in [("suax"[which], "K"), ("u", "R"), ("a", "R")] if state in move.get(r, {})]
            for to, more, letter in steps:
                then[to] = min(then.get(to, (10**9, "")), (cost + more, audit + letter))
        now = insert(then)
    return min(now[s] for s in (0, 3) if s in now)


def test_cells_of_any_bracketing_agree():
    rnd = random.Random(5)
    for n in (0, 1, 2, 7, 40, 129):
        for _ in range(30):
            codes = "".join(rnd.choice("ABCDEEEFGIIIJKMN") for _ in range(n))
            assert repair.best(repair.parse(codes))[:2] == forward(codes)
            cells = [repair.turn_cell(c) for c in codes]
            cut = rnd.randint(0, n)
            assert repair.join(repair.parse_cells(cells[:cut]), repair.parse_cells(cells[cut:])) == repair.parse(codes) or n == 0


@pytest.mark.parametrize("bits,together", [(7, 6), (2, 1)])
def test_long_conversations_are_parsed_in_parts(spark, monkeypatch, bits, together):
    """A conversation over many chunks, and rows without an id and turn number."""
    monkeypatch.setattr(repair, "CHUNK_BITS", bits)
    monkeypatch.setattr(repair, "TOGETHER_BITS", together)
    rnd = random.Random(9)
    rows = [(1, t, rnd.choice(["user", "assistant", "assistant", "tool"]), rnd.choice(["a.", "b", "c!", f"{t}?"])) for t in range(700)]
    rows += [(None, None, "user", f"t{i % 50}.") for i in range(300)] + [(2, 5, "user", "q?"), (2, 9, "assistant", "r.")]
    got = {r.conv_id: answer(r) for r in repair.repair(spark.createDataFrame([(*r, "x", 1) for r in rows], TURNS).repartition(5)).collect()}
    for conv in (1, None, 2):
        mine = sorted((r for r in plain_damage(rows) if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
        found = faults(mine)
        codes = "".join("ABCDEFGHIJKLMNOP"["suax".index(r[2][:1] if r[2][:1] in "sua" else "x") * 4 + ["none", "truncated", "blank", "duplicate"].index(f)] for r, f in zip(mine, found))
        cost, audit = forward(codes)
        assert got[conv][1:4] == (found.count("blank"), found.count("duplicate"), found.count("truncated")) and got[conv][5:7] == (cost, audit)
        roles = repair.best(repair.parse(codes))[2]
        assert got[conv][7] == hashlib.sha256("\n".join(repair.repaired_lines(audit, roles, [(r[2], r[3]) for r in mine])).encode()).hexdigest()


DOCS = "doc_id long, lang string, source string, text string, term string, n int"


def plain_divergence(rows, least=3, top=200):
    """Expected rows in plain integers."""
    groups, seen = {}, {}
    for _, lang, source, text, *_ in rows:
        words = re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        groups.setdefault((lang or "", source or ""), Counter()).update(words)
        seen.setdefault(lang or "", Counter()).update(set(words))
    out = set()
    for lang, docs in seen.items():
        kept = [t for t, n in docs.items() if n >= least]
        sources = {s: c for (x, s), c in groups.items() if x == lang}

        def rates(counts):
            total = sum(counts[t] for t in kept)
            return {t: 1 + 10**9 * (counts[t] + 1) // (total + len(kept)) for t in kept}

        q, ps = rates(sum(sources.values(), Counter())), {s: rates(c) for s, c in sources.items()}
        for s, p in ps.items():
            pairs = [(-sum((p[t] - o[t]) ** 2 // o[t] for t in kept), x.encode()) for x, o in ps.items() if x != s]
            terms = [(-((p[t] - q[t]) ** 2 // q[t]), t.encode()) for t in kept if sources[s][t] and p[t] > q[t]]
            for part, found, most in (("pair", pairs, None), ("term", terms, top)):
                out |= {(lang, s, part, item.decode(), -value, i + 1) for i, (value, item) in enumerate(sorted(found)[:most])}
    return out


@pytest.mark.parametrize("block,held", [(1024, 200_000), (4, 10)])
def test_divergence_equals_plain_integers(spark, monkeypatch, block, held):
    monkeypatch.setattr(divergence, "BLOCK", block)
    monkeypatch.setattr(divergence, "HELD", held)
    rnd = random.Random(1)
    words = [f"w{'abcdefghij'[i % 10]}{'xyzé'[i % 4]}{'Q' * (i % 3)}" for i in range(60)]
    rows = [(i, rnd.choice(["en", "de", None]), rnd.choice(["a", "b", "c", None, "é"]), " ".join(rnd.choices(words, k=rnd.randint(0, 30))) + "3x,y\x00z", "t", i) for i in range(150)]
    rows += [(900, "xx", "a", "one two", "t", 0), (901, "xx", "b", None, "t", 0), (902, "yy", "a", "", "t", 0), (1, "en", "a", "same same", "t", 0), (1, "en", "a", "same same", "t", 0)]
    got = [tuple(r) for r in divergence.source_divergence(spark.createDataFrame(rows, DOCS), top=20).collect()]
    assert len(got) == len(set(got)) and set(got) == plain_divergence(rows, top=20)
    assert divergence.source_divergence(spark.createDataFrame([], DOCS)).count() == 0


def test_very_long_text_and_rare_terms(spark):
    rows = [(i, "en", "s", " ".join(["alpha", f"r{i}"] * 50_000), "t", 0) for i in range(3)] + [(4, "en", "z", "alpha beta", "t", 0)]
    got = {(r.source, r.part, r.item): r.value for r in divergence.source_divergence(spark.createDataFrame(rows, DOCS)).collect()}
    assert got == {(r[1], r[2], r[3]): r[4] for r in plain_divergence(rows)}
