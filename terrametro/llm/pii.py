"""Personal data replaced by keyed surrogates of the same type and format.

Digits, letters and octets are permuted by a keyed Feistel network over the entity's own format:
equal entities get equal surrogates, different ones of a format different ones. Names, which
have no such format, are drawn by a keyed hash from names of the same gender and script. A check
over the whole corpus finds surrogates that two entities share or that some real entity bears;
those entities are drawn again until none is left.
"""

from __future__ import annotations

import hashlib
import hmac
import re
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..sources.staging import staged

#: Entities drawn more than once that a task may hold (12 bytes each).
MAX_REDRAWN = 10_000_000

# Forms of address by gender, given names by gender and script.
TITLES = {"m": "Mr Herr Monsieur Señor Sr Don господин г-н", "f": "Mrs Ms Miss Frau Madame Mme Señora Sra Doña госпожа г-жа"}
GIVEN = {
    ("m", "latin"): "Adam Bruno Carl David Emil Felix Georg Henri Ivan Jonas Karl Leon Mark Nils Oscar Paul Rafael Simon Tomas Victor",
    ("f", "latin"): "Anna Berta Clara Diana Elena Flora Greta Helena Irene Julia Karin Laura Maria Nina Olga Paula Rosa Sara Tina Vera",
    ("m", "cyrillic"): "Антон Борис Виктор Глеб Денис Егор Иван Кирилл Лев Максим Никита Олег Павел Роман Сергей Фёдор",
    ("f", "cyrillic"): "Анна Вера Галина Дарья Елена Зоя Ирина Ксения Лидия Мария Нина Ольга Полина Раиса Софья Юлия",
}
SYLLABLES = {"latin": "ba den fel gor hal kes lin mar nor pel ras ster tov wen zim dal".split(), "cyrillic": "ба вен гор дал ким лин мар нор пел рас сав тов фед хол цев чер".split()}
_GENDER = {t: g for g, names in TITLES.items() for t in names.split()}
_NAME = r"[A-ZÀ-ÞА-ЯЁ][\w'’-]+"
_PATTERN = re.compile(
    r"(?P<email>[\w.+%-]+@[\w-]+(?:\.[\w-]*\w)+)"
    r"|(?:token|secret|passw(?:or)?d|api[_-]?key)\s*[=:]\s*[\"']?(?P<secret>[A-Za-z0-9_\-+/]{16,})"
    r"|(?<![\w.])(?P<ip>(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d))(?!\w|\.\d)"
    r"|(?<!\w)(?P<card>\d{13,19}|\d{4}(?:[ -]\d{4}){3})(?!\w)"
    r"|(?<![\w+])(?P<phone>\+\d{1,3}[ .-]?\(?\d{1,4}\)?(?:[ .-]?\d{2,4}){2,4}|\(\d{3}\)[ .-]?\d{3}[ .-]\d{4}|\d{3}[.-]\d{3}[.-]\d{4})(?!\w)"
    r"|(?<!\w)(?P<ssn>\d{3}-\d{2}-\d{4})(?!\w)",
    re.I,
)
_TITLED = re.compile(rf"(?<!\w)(?P<title>{'|'.join(sorted(map(re.escape, _GENDER), key=len, reverse=True))})\.?\s(?P<name>{_NAME}(?:\s{_NAME}){{0,2}})")
_HINT = re.compile(r"[\d@=:]")
_TITLE_HINT = re.compile(rf"(?:{'|'.join(sorted(map(re.escape, _GENDER), key=len, reverse=True))})\.?\s")


def mentions(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, value) of the entities, in order, not overlapping."""
    found = []
    if _HINT.search(text):
        found = [(*m.span(m.lastgroup), m.lastgroup, m[m.lastgroup]) for m in _PATTERN.finditer(text)]
    if _TITLE_HINT.search(text):
        found += [(*m.span("name"), f"name_{_GENDER[m['title']]}", m["name"]) for m in _TITLED.finditer(text)]
        found.sort()
    out, end = [], 0
    for one in found:
        if one[0] >= end:
            out.append(one)
            end = one[1]
    return out


def _keyed(key: bytes, *parts) -> int:
    return int.from_bytes(hmac.new(key, "\x1f".join(map(str, parts)).encode("utf-8"), hashlib.sha256).digest(), "big")


def permute(key: bytes, kind: str, values: list[int], radices: list[int], attempt: int) -> list[int]:
    """A keyed bijection on the tuples below the radices: alternating rounds over two halves."""
    half = (len(values) + 1) // 2
    sides = [list(values[:half]), list(values[half:])]
    bases = [radices[:half], radices[half:]]
    for turn in range(8):
        own, other = turn % 2, 1 - turn % 2
        number = size = 0
        size = 1
        for v, r in zip(sides[own], bases[own]):
            number, size = number * r + v, size * r
        number = (number + _keyed(key, kind, attempt, turn, radices, sides[other])) % size
        for i in range(len(bases[own]) - 1, -1, -1):
            number, sides[own][i] = divmod(number, bases[own][i])
    return sides[0] + sides[1]


#: Attempts after which a format is taken for full and grows by a sign a time; attempts that an entity may need.
GROW_AFTER, MAX_ATTEMPTS = 5, 64


@lru_cache(maxsize=100_000)
def _alphabet(c: str) -> str:
    """What may stand for a letter or digit: the digits of its script, or the letters of its kind nearby in Unicode."""
    plain = next(("".join(map(chr, range(ord(a), ord(a) + n))) for a, n in _RANGES if ord(a) <= ord(c) < ord(a) + n), "")
    if plain or not c.isalnum():
        return plain
    digit, kind = unicodedata.decimal(c, None), unicodedata.category(c)
    if digit is not None:
        return "".join(chr(ord(c) - digit + i) for i in range(10))
    start = ord(c) & ~63
    return "".join(x for x in map(chr, range(start, start + 64)) if unicodedata.category(x) == kind)


def _grown(value: str, more: int) -> str:
    """The value with its first letter or digit (behind a country code) so many times more."""
    lead = re.match(r"\+\d{1,3}(?=[ .(-])", value)
    at = next((i for i, c in enumerate(value) if c.isalnum() and (not lead or i >= lead.end())), 0)
    return value[:at] + value[at] * more + value[at:]


_RANGES = [("0", 10), ("a", 26), ("A", 26), ("а", 32), ("А", 32), ("α", 25), ("Α", 25), ("א", 27)]


def _shaped(key: bytes, kind: str, value: str, attempt: int, keep=(), hexadecimal: bool = False) -> str:
    """Letters and digits permuted within their script and case; all else, and places in keep, stays."""
    places, values, radices, alphabets = [], [], [], []
    for i, c in enumerate(value):
        if i in keep:
            continue
        if hexadecimal:
            alphabet = "0123456789ABCDEF" if value.isupper() else "0123456789abcdef"
        else:
            alphabet = _alphabet(c)
        if c in alphabet and alphabet:
            places.append(i)
            values.append(alphabet.index(c))
            radices.append(len(alphabet))
            alphabets.append(alphabet)
    out = list(value)
    for i, v, alphabet in zip(places, permute(key, kind, values, radices, attempt), alphabets):
        out[i] = alphabet[v]
    return "".join(out)


def _check_digit(digits: list[int]) -> int:
    """The Luhn digit that completes the digits."""
    total = sum(d if i % 2 else sum(divmod(2 * d, 10)) for i, d in enumerate(reversed(digits)))
    return -total % 10


def surrogate(key: bytes, kind: str, value: str, attempt: int = 0) -> str:
    """The attempt-th surrogate of an entity, never the entity itself if its format leaves a choice."""
    if attempt > MAX_ATTEMPTS and not kind.startswith("name"):
        raise ValueError(f"no free surrogate of kind {kind} and format {re.sub(r'[^\W_]', 'x', value)} in {MAX_ATTEMPTS} attempts")
    if attempt >= GROW_AFTER and kind != "ip" and not kind.startswith("name"):
        value, own = _grown(value, attempt - GROW_AFTER + 1), value
    else:
        own = value
    for turn in range(attempt * 8, attempt * 8 + 8):
        found = _draw(key, kind, value, turn)
        if found != own:
            return found
    return found


def _draw(key: bytes, kind: str, value: str, attempt: int) -> str:
    if kind == "ip":
        return ".".join(map(str, permute(key, kind, [int(x) for x in value.split(".")], [256] * 4, attempt)))
    if kind == "email":
        return _shaped(key, kind, value, attempt, range(value.rindex("."), len(value)))
    if kind == "secret":
        plain = re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", value)
        return _shaped(key, kind, value, attempt, hexadecimal=bool(plain))
    if kind == "phone":
        lead = re.match(r"\+\d{1,3}(?=[ .(-])|\+?", value).end()
        return _shaped(key, kind, value, attempt, range(lead))
    if kind == "card":
        digits = [int(c) for c in value if c.isdigit()]
        if digits[-1] != _check_digit(digits[:-1]):
            return _shaped(key, kind, value, attempt)
        body = _shaped(key, kind, value[:-1], attempt, (0,))
        return body + str(_check_digit([int(c) for c in body if c.isdigit()]))
    if kind.startswith("name"):
        script = "cyrillic" if re.search(r"[А-Яа-яЁё]", value) else "latin"
        given, syllables = GIVEN[kind[-1], script].split(), SYLLABLES[script]
        drawn, words = _keyed(key, kind, value, attempt), value.split()
        family = []
        # A syllable more for each attempt of surrogate(), so that names never run out.
        for _ in range(4 + attempt // 8):
            drawn, k = divmod(drawn, len(syllables))
            family.append(syllables[k])
        family = "".join(family).capitalize()
        if len(words) == 1:
            return family
        names = []
        for _ in words[:-1]:
            drawn, k = divmod(drawn, len(given))
            names.append(given[k])
        return " ".join([*names, family])
    return _shaped(key, kind, value, attempt)


def entities(docs: DataFrame, text_column: str = "text") -> DataFrame:
    """(kind, value) of the distinct entities of all texts."""
    schema = pa.schema([("kind", pa.string()), ("value", pa.string())])

    def run(batches):
        for batch in batches:
            found = sorted({(k, v) for t in batch.column(0) if (s := t.as_py()) for _, _, k, v in mentions(s)})
            yield pa.RecordBatch.from_pydict({"kind": [k for k, _ in found], "value": [v for _, v in found]}, schema)

    return docs.select(F.col(text_column).alias("body")).mapInArrow(run, "kind string, value string").distinct()


def redrawn(found: DataFrame, key: bytes) -> DataFrame:
    """(kind, value, attempt) of the entities whose first surrogate doesn't do.

    Of entities that share a surrogate the first by value keeps it; a surrogate that some entity
    of the corpus bears is given up. Only the losers are drawn and checked again.
    """
    schema = "kind string, value string, attempt int, drawn string"

    def draw(batches):
        for batch in batches:
            rows = batch.to_pydict()
            rows["drawn"] = [surrogate(key, k, v, a) for k, v, a in zip(rows["kind"], rows["value"], rows["attempt"])]
            yield pa.RecordBatch.from_pydict(rows, pa.schema([("kind", pa.string()), ("value", pa.string()), ("attempt", pa.int32()), ("drawn", pa.string())]))

    settled = None
    pending = found.withColumn("attempt", F.lit(0))
    real = found.select(F.col("value").alias("drawn")).distinct()
    while True:
        drawn = staged(pending.select("kind", "value", "attempt").mapInArrow(draw, schema), "drawn")
        everyone = drawn if settled is None else drawn.unionByName(settled)
        # Settled entities have fewer attempts than those drawn now.
        first = everyone.groupBy("drawn").agg(F.min(F.struct("attempt", "kind", "value")).alias("owner"))
        mine = drawn.join(first, "drawn").withColumn("lost", (F.col("owner.kind") != F.col("kind")) | (F.col("owner.value") != F.col("value")))
        taken = mine.join(real.withColumn("taken", F.lit(True)), "drawn", "left")
        judged = staged(taken.select("kind", "value", "attempt", "drawn", (F.col("lost") | F.coalesce("taken", F.lit(False))).alias("again")), "judged")
        good = judged.where("NOT again").drop("again")
        settled = good if settled is None else settled.unionByName(good)
        pending = judged.where("again").withColumn("attempt", F.col("attempt") + 1)
        if pending.isEmpty():
            return settled.where("attempt > 0").select("kind", "value", "attempt")


def replace_personal_data(docs: DataFrame, key: bytes, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per document: id, text with surrogates, n_entities, kinds (kind:count, sorted).

    Emails, phone numbers, card numbers, IP addresses, social security numbers, secrets and
    titled names are replaced, over the whole text. The same entity has the same surrogate
    everywhere; different entities never share one, and no surrogate equals an entity of the
    corpus. Letters and digits of any script are replaced within it. A format whose values are all taken
    grows by a sign with each further attempt; an entity that has no surrogate after MAX_ATTEMPTS is an error that
    names kind and format. A missing text stays missing and has no entities. Repeated rows are answered each; an
    empty table gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    again = staged(redrawn(staged(entities(docs, text_column), "entities"), key), "redrawn")
    rows = again.count()
    if rows > MAX_REDRAWN:
        raise ValueError(f"{rows} entities were drawn again; at most {MAX_REDRAWN} fit a task: use another key or fewer kinds")
    table = again.select(F.xxhash64("kind", "value").alias("h"), "attempt").toPandas().sort_values("h")
    shared = spark.sparkContext.broadcast((table["h"].to_numpy(np.int64), table["attempt"].to_numpy(np.int32)))
    found = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("body"))

    def run(batches):
        import xxhash

        hashes, attempts = shared.value
        cache: dict[tuple[str, str], str] = {}

        def stand_in(kind, value):
            if (kind, value) not in cache:
                if len(cache) > 100_000:
                    cache.clear()
                # Spark's xxhash64 of two strings: the first one's hash seeds the second's.
                h = xxhash.xxh64_intdigest(value.encode("utf-8"), xxhash.xxh64_intdigest(kind.encode(), 42))
                h = h - (1 << 64) if h >> 63 else h
                at = int(np.searchsorted(hashes, h))
                attempt = int(attempts[at]) if at < len(hashes) and hashes[at] == h else 0
                cache[kind, value] = surrogate(key, kind, value, attempt)
            return cache[kind, value]

        for batch in batches:
            texts, counts, kinds = [], [], []
            for one in batch.column(1):
                text, tally = one.as_py(), {}
                parts, at = [], 0
                for start, end, kind, value in mentions(text or ""):
                    parts += [text[at:start], stand_in(kind, value)]
                    at = end
                    tally[kind] = tally.get(kind, 0) + 1
                texts.append(text if text is None else "".join([*parts, text[at:]]))
                counts.append(sum(tally.values()))
                kinds.append(",".join(f"{k}:{n}" for k, n in sorted(tally.items())))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array(counts, pa.int64()), pa.array(kinds, pa.string())], ["id", "text", "n_entities", "kinds"])

    out = found.mapInArrow(run, f"id {found.schema['id'].dataType.simpleString()}, text string, n_entities bigint, kinds string")
    return out.withColumnRenamed("id", id_column)
