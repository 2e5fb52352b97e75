"""Conversation repair by weighted interval parsing.

The grammar of a sound conversation, (s?(ua)+)? over role initials, is taken as an automaton; a
nonterminal is a pair of its states, N(p, q) -> N(p, r) N(r, q), which is Chomsky normal form. A
span of turns has one cell: for every nonterminal the cheapest edits that turn the span into it,
ties by the least audit. Single turns are closed under insertion on both sides. Cells are put
together bottom-up by span length. As every nonterminal splits at every place, any bracketing gives
the same minimum: spans of doubling length, then spans of whole chunks, are enough, and long
conversations are parsed by many tasks.

(cost, audit) may be put together this way: of two audits of one span with equal cost, none is the
beginning of the other, as it would need insertions that cost more. So the lesser stays the lesser.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..sources.staging import staged

#: Turns of one chunk as a power of two; cells that one task puts together at a time.
CHUNK_BITS, TOGETHER_BITS = 7, 6
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1

#: States: nothing yet, after the system turn, after a user turn, after an assistant turn.
_STATES = range(4)
_START, _SYSTEM, _USER, _ASSISTANT = _STATES
_ACCEPTED = (_START, _ASSISTANT)
#: Initial -> moves it allows.
_MOVES = {
    "s": [(_START, _SYSTEM)],
    "u": [(_START, _USER), (_SYSTEM, _USER), (_ASSISTANT, _USER)],
    "a": [(_USER, _ASSISTANT)],
}
_LEGAL = {"su", "ua", "au"}
#: A turn's code: place in _INITIALS times 4, plus place in _FAULTS.
_INITIALS, _FAULTS = "suax", ("none", "truncated", "blank", "duplicate")
_LETTERS = "ABCDEFGHIJKLMNOP"


def _offer(cell: dict, key: tuple, entry: tuple) -> None:
    if key not in cell or entry < cell[key]:
        cell[key] = entry


def join(left: dict, right: dict) -> dict:
    """The cell of two neighbouring spans: {(p, q): (cost, audit, roles)}; roles name the outcome letter by letter."""
    cell = {}
    for (p, r), (cost, audit, roles) in left.items():
        for q in _STATES:
            other = right.get((r, q))
            if other is not None:
                known = cell.get((p, q))
                if known is None or cost + other[0] <= known[0]:
                    _offer(cell, (p, q), (cost + other[0], audit + other[1], roles + other[2]))
    return cell


def _closure() -> dict:
    """Insertions alone: every state reaches itself for nothing; no detour pays."""
    step, cell = {}, {(p, p): (0, "", "") for p in _STATES}
    for role in "ua":
        for p, q in _MOVES[role]:
            step[p, q] = (INSERT, "I", role)
    for _ in _STATES:
        longer = join(cell, step)
        for key, entry in longer.items():
            _offer(cell, key, entry)
    return cell


@lru_cache(maxsize=None)
def turn_cell(code: str) -> dict:
    """One turn: deleted, kept or given another role, with insertions before and after."""
    which, fault = divmod(_LETTERS.index(code), 4)
    cell = {(p, p): (DELETE, "D", "-") for p in _STATES}
    if _FAULTS[fault] in ("none", "truncated"):
        more = TRUNCATED if _FAULTS[fault] == "truncated" else 0
        for p, q in _MOVES.get(_INITIALS[which], []):
            _offer(cell, (p, q), (KEEP + more, "K", _INITIALS[which]))
        for role in "ua":
            for p, q in _MOVES[role]:
                _offer(cell, (p, q), (REROLE + more, "R", role))
    around = _closure()
    return join(join(around, cell), around)


def parse_cells(cells: list[dict]) -> dict:
    """Neighbours joined until one is left: spans of length 1, 2, 4, ..."""
    while len(cells) > 1:
        cells = [join(*cells[i : i + 2]) if i + 1 < len(cells) else cells[i] for i in range(0, len(cells), 2)]
    return cells[0] if cells else {(p, p): (0, "", "") for p in _STATES}


@lru_cache(maxsize=20_000)
def parse(codes: str) -> dict:
    """The cell of a run of turns; short conversations look alike, so many are known."""
    return parse_cells([turn_cell(c) for c in codes])


def best(cell: dict) -> tuple:
    """(cost, audit, roles) of the cheapest way to a sound conversation."""
    return min(cell[_START, q] for q in _ACCEPTED if (_START, q) in cell)


def illegal_pairs(codes: str) -> int:
    roles = [_INITIALS[_LETTERS.index(c) // 4] for c in codes]
    return sum(a + b not in _LEGAL for a, b in zip(roles, roles[1:]))


def damaged(turns: DataFrame) -> DataFrame:
    """Turns (conv, turn, role, text) after damage by crc32("conv:turn") % 20, nulls as one space: 0 drops a
    turn, 1 empties it, 2 takes its [.!?], 3 repeats it, 4 makes its role user."""
    space = {c: F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv", "turn", "role", "text")}
    kind = (F.crc32(F.concat(space["conv"], F.lit(":"), space["turn"])) % 20).cast("int")
    rows = turns.select("conv", "turn", space["role"].alias("role"), space["text"].alias("text"), kind.alias("kind")).where("kind <> 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    rows = rows.select("conv", "turn", role.alias("role"), text.alias("text"), F.when(F.col("kind") == 3, 2).otherwise(1).alias("copies"))
    return rows.withColumn("copy", F.explode(F.sequence(F.lit(1), "copies"))).drop("copies", "copy")


def _key(conv: Column) -> Column:
    """Conversations without an id are one."""
    return F.coalesce(F.concat(F.lit("="), conv.cast("string")), F.lit(""))


def _in_order(turns: DataFrame) -> DataFrame:
    """turns (k, turn, role, text) with `at`, which rises with k, turn (missing ones first), role and text; staged.

    Sorted by ranges: a conversation of any length is spread over tasks. Turns alike in all are told
    apart by a number of the scan, so that very many of them are no hot range.
    """
    order = ["k", "turn", "role", "text", "salt"]
    rows = turns.withColumn("salt", F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order)
    last = F.regexp_extract("text", r"([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z", 1)
    initial = F.substring("role", 1, 1)
    return staged(rows.select(
        "k", "turn", "role", "text", F.monotonically_increasing_id().alias("at"),
        F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256)).alias("said"),
        F.when(initial.isin("s", "u", "a"), initial).otherwise("x").alias("initial"),
        F.when(last == "", 2).when(last.isin(".", "!", "?"), 0).otherwise(1).alias("fault"),
    ), "turns")


_CELL = "costs array<bigint>, audits array<string>, roles array<string>"
_CELLS = f"k string, c bigint, codes string, chunks array<bigint>, sizes array<bigint>, blank bigint, duplicate bigint, truncated bigint, illegal bigint, {_CELL}"


def _packed(cell: dict) -> tuple[list, list, list]:
    flat = [cell.get((p, q), (None, None, None)) for p in _STATES for q in _STATES]
    return tuple(list(x) for x in zip(*flat))


def _unpacked(row: dict) -> dict:
    flat = zip(row["costs"], row["audits"], row["roles"])
    return {(i // 4, i % 4): entry for i, entry in enumerate(flat) if entry[0] is not None}


def _chunk_cells(codes: DataFrame) -> DataFrame:
    """codes(k, c, codes) -> a cell of each chunk. In cells, `codes` are the first and the last turn's code."""

    def run(batches):
        for batch in batches:
            out = []
            for k, c, codes in zip(*[batch.column(i).to_pylist() for i in range(3)]):
                faults = [_LETTERS.index(x) % 4 for x in codes]
                costs, audits, roles = _packed(parse(codes))
                out.append({
                    "k": k, "c": c, "codes": codes[0] + codes[-1], "chunks": [c], "sizes": [len(codes)], "blank": faults.count(2), "duplicate": faults.count(3),
                    "truncated": faults.count(1), "illegal": illegal_pairs(codes), "costs": costs, "audits": audits, "roles": roles,
                })
            yield _batch(out, _CELL_SCHEMA)

    return codes.mapInArrow(run, _CELLS)


_LISTS = {"costs": pa.int64(), "audits": pa.string(), "roles": pa.string(), "chunks": pa.int64(), "sizes": pa.int64()}
_CELL_SCHEMA = pa.schema([
    (name, pa.list_(_LISTS[name]) if name in _LISTS else pa.string() if name in ("k", "codes") else pa.int64())
    for name in ("k", "c", "codes", "chunks", "sizes", "blank", "duplicate", "truncated", "illegal", "costs", "audits", "roles")
])


def _batch(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema)


def _joined(cells: DataFrame, shift: int | None) -> DataFrame:
    """Neighbouring cells of a conversation put together: those whose c agrees but for its last bits; all for None."""
    c = F.lit(0).cast("bigint") if shift is None else F.shiftright("c", shift)
    groups = cells.groupBy("k", c.alias("up")).agg(F.sort_array(F.collect_list(F.struct(*[x for x in cells.columns if x != "k"]))).alias("parts"))

    def run(batches):
        for batch in batches:
            out = []
            for k, up, parts in zip(*[batch.column(i).to_pylist() for i in range(3)]):
                costs, audits, roles = _packed(parse_cells([_unpacked(p) for p in parts]))
                row = {"k": k, "c": up, "codes": parts[0]["codes"][0] + parts[-1]["codes"][-1], "costs": costs, "audits": audits, "roles": roles}
                for name in ("chunks", "sizes"):
                    row[name] = [x for p in parts for x in p[name]]
                for name in ("blank", "duplicate", "truncated", "illegal"):
                    row[name] = sum(p[name] for p in parts)
                row["illegal"] += sum(illegal_pairs(a["codes"][-1] + b["codes"][0]) for a, b in zip(parts, parts[1:]))
                out.append(row)
            yield _batch(out, _CELL_SCHEMA)

    return groups.select("k", "up", "parts").mapInArrow(run, _CELLS)


def _solved(cells: DataFrame) -> DataFrame:
    """Whole conversations: counts, cost, audit, and the edits cut by chunk."""
    schema = pa.schema([
        ("k", pa.string()), *[(n, pa.int64()) for n in ("blank", "duplicate", "truncated", "illegal", "cost")], ("audit", pa.string()),
        ("edits", pa.list_(pa.struct([("c", pa.int64()), ("letters", pa.string()), ("given", pa.string())]))),
    ])

    def run(batches):
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                cost, audit, roles = best(_unpacked(row))
                at, edits = 0, []
                for i, (c, size) in enumerate(zip(row["chunks"], row["sizes"])):
                    end = at
                    while size:  # a chunk's edits end with its last turn; insertions after it are the next one's
                        size -= audit[end] != "I"
                        end += 1
                    if i + 1 == len(row["chunks"]):
                        end = len(audit)
                    edits.append({"c": c, "letters": audit[at:end], "given": roles[at:end]})
                    at = end
                out.append({**{n: row[n] for n in ("k", "blank", "duplicate", "truncated", "illegal")}, "cost": cost, "audit": audit, "edits": edits})
            yield _batch(out, schema)

    return cells.mapInArrow(run, "k string, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, edits array<struct<c: bigint, letters: string, given: string>>")


def repaired_lines(letters: str, given: str, turns) -> list[str]:
    """"role:text" of the turns that stay or are inserted; turns gives (role, text) in order."""
    lines, turns = [], iter(turns)
    for letter, role in zip(letters, given):
        name = "user" if role == "u" else "assistant"
        if letter == "I":
            lines.append(f"{name}:")
            continue
        own, text = next(turns)
        if letter != "D":
            lines.append(f"{own if letter == 'K' else name}:{text}")
    return lines


def _digests(turns: DataFrame, edits: DataFrame) -> DataFrame:
    """(k, repaired_sha256): edits meet their turns in one sorted stream, hashed as it passes."""
    none = F.lit(None).cast("string")
    said = turns.select("k", F.shiftright("at", CHUNK_BITS).alias("c"), "at", "role", "text", none.alias("letters"), none.alias("given"))
    told = edits.select("k", "c", F.lit(-1).cast("bigint").alias("at"), none.alias("role"), none.alias("text"), "letters", "given")
    rows = told.union(said).repartition("k").sortWithinPartitions("k", "c", "at")

    def lines_of(letter, role, own, text):
        return repaired_lines(letter, role, [(own, text)])

    def run(batches):
        key, digest, first, letters, given, at = None, None, True, "", "", 0

        def put(lines):
            nonlocal first
            for line in lines:
                digest.update(("" if first else "\n").encode() + line.encode())
                first = False

        def inserted():
            nonlocal at
            while at < len(letters) and letters[at] == "I":
                put(lines_of("I", given[at], None, None))
                at += 1

        for batch in batches:
            done = []
            columns = [batch.column(n).to_pylist() for n in ("k", "at", "role", "text", "letters", "given")]
            for k, number, own, text, new_letters, new_given in zip(*columns):
                if number < 0:
                    inserted()
                    if key is not None and k != key:
                        done.append((key, digest.hexdigest()))
                    if k != key:
                        key, digest, first = k, hashlib.sha256(), True
                    letters, given, at = new_letters, new_given, 0
                    continue
                inserted()
                put(lines_of(letters[at], given[at], own, text))
                at += 1
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*done)], ["k", "repaired_sha256"])
        if key is not None:
            inserted()
            yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([digest.hexdigest()])], ["k", "repaired_sha256"])

    return rows.mapInArrow(run, "k string, repaired_sha256 string")


def repair(
    turns: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", damage=damaged
) -> DataFrame:
    """One row per conversation: id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    damage: what is done to the turns (conv, turn, role, text; missing roles and texts come back as one space)
    before they are looked at; by default the rule of `damaged`. Turns are ordered by number, missing ones
    first, then by role and text. A turn has one fault, the first of: blank, duplicate (role and text said
    before), truncated (its last sign is none of .!?). Edits: keep 0, other role 2, delete 3 (a must for blank
    and duplicate turns), insert an empty user or assistant turn 2; a truncated turn that stays adds 1.
    audit: initials of the cheapest edits that give (s?(ua)+)?, ties by the least text. illegal: neighbours
    whose initials are not su, ua or au. gaps: numbers missing between the least and the greatest.
    repaired_sha256: of the lines "role:text" left, joined by newlines.

    Conversations without an id are one. A conversation whose turns are all dropped has zeros, an empty audit
    and the hash of an empty text. Repeated rows are turns of their own, of which the first is no duplicate.
    An empty table gives no rows. Other columns are ignored. A task holds 128 turns of a conversation at a
    time, without their texts; its audit and the list of its chunks are single values, and its hash, which
    has no parts, is one pass over the sorted lines.
    """
    rows = turns.select(*[F.col(c).alias(name) for c, name in ((conversation, "conv"), (turn, "turn"), (role, "role"), (text, "text"))])
    left = damage(rows)
    ordered = _in_order(left.select(_key(F.col("conv")).alias("k"), "turn", "role", "text"))

    repeats = ordered.groupBy("k", "said").agg(F.min("at").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    known = ordered.select("k", "at", "said", "initial", "fault").join(repeats, ["k", "said"], "left")
    fault = F.when((F.col("fault") != 2) & (F.col("at") > F.col("first")), 3).otherwise(F.col("fault"))
    place = F.instr(F.lit(_INITIALS), F.col("initial")) - 1
    coded = known.select("k", "at", F.substring(F.lit(_LETTERS), place * 4 + fault + 1, F.lit(1)).alias("code"))
    told = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "code"))), lambda x: x["code"]), "")
    chunks = coded.groupBy("k", F.shiftright("at", CHUNK_BITS).alias("c")).agg(told.alias("codes"))

    cells, shift = staged(_chunk_cells(chunks), "cells"), TOGETHER_BITS
    while (cells.groupBy("k").count().agg(F.max("count")).first()[0] or 0) > 1 << TOGETHER_BITS and shift < 64:
        cells, shift = staged(_joined(cells, TOGETHER_BITS), "cells"), shift + TOGETHER_BITS
    solved = staged(_solved(_joined(cells, None)), "solved")

    digests = _digests(ordered, solved.select("k", F.inline("edits")))
    numbers = ordered.groupBy("k", "turn").agg(F.lit(1).alias("one")).groupBy("k").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).cast("bigint").alias("gaps")
    )
    all_of = rows.groupBy("conv").agg(F.lit(1).alias("one")).select("conv", _key(F.col("conv")).alias("k"))
    out = all_of.join(numbers, "k", "left").join(solved.drop("edits"), "k", "left").join(digests, "k", "left")
    empty = hashlib.sha256(b"").hexdigest()
    counts = [F.coalesce(c, F.lit(0).cast("bigint")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select(
        F.col("conv").alias(conversation), *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(empty)).alias("repaired_sha256")
    )
