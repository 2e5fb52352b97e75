"""Text normalisation."""

import unicodedata

from pyspark.sql import Column, functions as F
from pyspark.sql.types import DoubleType

from ..constants import INVALID_TEXTS, KNOWN_TYPES, STREET_ABBREVIATIONS, TITLE_SMALL_WORDS


def _accent_pairs() -> tuple[str, str]:
    """Characters of any script that decompose to one base and marks, with that base."""
    accented, plain = [], []
    for code in range(0x00A0, 0x10000):
        parts = unicodedata.normalize("NFKD", chr(code))
        base = [c for c in parts if not unicodedata.combining(c)]
        if len(base) == 1 and base[0] != chr(code):
            accented.append(chr(code))
            plain.append(base[0])
    return "".join(accented), "".join(plain)


_ACCENTED, _PLAIN = _accent_pairs()


def strip_accents(text: Column) -> Column:
    return F.regexp_replace(F.translate(text, _ACCENTED, _PLAIN), r"\p{M}+", "")


def folded(text: Column) -> Column:
    """Accent-free, lower case, trimmed; separators stay."""
    return F.trim(F.lower(strip_accents(text)))


def match_key(text: Column, ascii_only: bool = False) -> Column:
    """Comparison key: no accents, no case, letters and digits only.

    ``ascii_only`` is the browser's narrower rule.
    """
    keep = r"[^a-z0-9]" if ascii_only else r"[^\p{L}\p{N}]"
    return F.regexp_replace(F.lower(strip_accents(F.coalesce(text, F.lit("")))), keep, "")


def is_valid_text(text: Column) -> Column:
    return F.coalesce(~F.trim(text).isin(INVALID_TEXTS), F.lit(False))


def cache_key(text: Column) -> Column:
    key = F.translate(F.lower(F.trim(text)), " -", "_")
    return F.when(is_valid_text(text) & (key != ""), key)


def _capitalised(word: Column) -> Column:
    # One letter may capitalise to two ("ß"), of which only the first is a capital.
    first = F.upper(F.substring(word, 1, 1))
    tail = F.concat(F.substring(first, 2, 1 << 30), F.substring(word, 2, 1 << 30))
    return F.concat(F.substring(first, 1, 1), F.lower(tail))


def title_case(text: Column) -> Column:
    """A capital after every non-letter, as dataframe libraries title-case."""
    runs = F.regexp_extract_all(text, F.lit(r"\p{L}+|\P{L}+"), F.lit(0))
    return F.array_join(F.transform(runs, _capitalised), "")


def title_case_words(text: Column) -> Column:
    """Form-field title case: words by spaces, small connecting words stay lower."""
    words = F.filter(F.split(F.lower(text), " "), lambda w: w != "")
    return F.array_join(
        F.transform(
            words,
            lambda w, i: F.when((i > 0) & w.isin(TITLE_SMALL_WORDS), w).otherwise(
                F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1 << 30))
            ),
        ),
        " ",
    )


def category_text(text: Column, missing: str) -> Column:
    """Trimmed title-case category; a missing one becomes its own category."""
    return F.coalesce(title_case(F.trim(text)), F.lit(missing))


def postcode(text: Column, keep_raw: bool = False) -> Column:
    """Eight digits as 00000-000; otherwise the digits (or the raw text)."""
    digits = F.regexp_replace(text, r"\D", "")
    rest = text if keep_raw else F.when(digits != "", digits).otherwise(F.trim(text))
    formatted = F.concat(F.substring(digits, 1, 5), F.lit("-"), F.substring(digits, 6, 3))
    return F.coalesce(F.when(F.length(digits) == 8, formatted).otherwise(rest), F.lit(""))


def deal_label(text: Column) -> Column:
    return F.when(F.lower(text).contains("vend"), "Venda").otherwise("Aluguel")


def known_type(text: Column) -> Column:
    """First vocabulary entry, in vocabulary order, found as a whole word."""
    hits = [F.when(text.rlike(rf"(?iU)\b{name}\b"), name) for name in KNOWN_TYPES]
    return F.coalesce(*hits, F.lit(""))


# --- addresses -------------------------------------------------------------
def _segments(text: Column, pattern: str) -> Column:
    parts = F.transform(F.split(text, pattern), lambda p: F.trim(p))
    return F.filter(parts, lambda p: p != "")


def neighbourhood_from_location(text: Column, city: str) -> Column:
    """Last segment that is not a number, a state code or the city."""
    bare = F.regexp_replace(text, r"\d{2}\.\d{3}-\d{3}", "")
    bare = F.regexp_replace(bare, r"\d{5}-\d{3}", "")
    bare = F.trim(F.regexp_replace(bare, r"\s+", " "))
    parts = _segments(bare, "[-,]")
    usable = F.filter(
        parts,
        lambda p: ~p.rlike(r"^\d+$")
        & ~p.rlike(r"^\p{L}{2}$")
        & ~F.lower(p).contains(city.lower()),
    )
    return F.coalesce(F.try_element_at(usable, F.lit(-1)), F.try_element_at(parts, F.lit(-1)), F.lit(""))


def neighbourhood_from_address(text: Column) -> Column:
    """`street, number, AREA, CITY/UF`: the token before the first one with a slash,
    else the second from the end."""
    parts = _segments(text, ",")
    # A slash in the very first token does not mark the city.
    later = F.slice(parts, 2, F.greatest(F.size(parts), F.lit(1)))
    slash = F.array_position(F.transform(later, lambda p: p.contains("/")), F.lit(True)).cast("int")
    before_city = F.when(slash > 0, F.try_element_at(parts, slash))
    second_last = F.when(F.size(parts) >= 2, F.try_element_at(parts, F.lit(-2)))
    return F.coalesce(title_case(F.coalesce(before_city, second_last)), F.lit(""))


def split_address(text: Column) -> Column:
    """struct(street, number, area): abbreviations expanded, number digits only."""
    parts = F.transform(F.split(F.coalesce(text, F.lit("")), ","), lambda p: F.trim(p))

    def part(i):
        return F.coalesce(F.try_element_at(parts, F.lit(i)), F.lit(""))

    street = part(1)
    for short, full in STREET_ABBREVIATIONS.items():
        street = F.regexp_replace(street, rf"(?iU)\b{short}\.", full)
    street = title_case(F.trim(F.regexp_replace(street, r"\s+", " ")))
    return F.struct(
        street.alias("street"),
        F.regexp_replace(part(2), r"\D", "").alias("number"),
        title_case(part(3)).alias("area"),
    )


def edit_similarity(left: Column, right: Column) -> Column:
    """1 - edit distance / longer length; both sides empty gives 0."""
    longest = F.greatest(F.length(left), F.length(right))
    return F.when(longest > 0, 1 - F.levenshtein(left, right) / longest).otherwise(0.0)


@F.pandas_udf(DoubleType())
def block_similarity(left, right):
    """Longest-matching-block ratio, Arrow-batched; for already blocked candidates."""
    import difflib

    import pandas as pd

    return pd.Series(
        [
            difflib.SequenceMatcher(None, a, b).ratio() if a is not None and b is not None else None
            for a, b in zip(left, right)
        ],
        dtype="float64",
    )


def street_matches(asked: Column, found: Column, threshold: float, exact_blocks: bool = True) -> Column:
    """Whether the found street is the asked one; an empty found street never is."""
    similarity = block_similarity if exact_blocks else edit_similarity
    score = similarity(folded(asked), folded(found))
    return F.coalesce((found != "") & (score >= threshold), F.lit(False))


def letters_in_common(left: Column, right: Column) -> Column:
    """2 x common letters / letters of both, repeats counted: no block ratio is higher.
    Both sides empty gives 1."""

    def times(text, letter):
        return F.length(text) - F.length(F.replace(text, letter))

    letters = F.array_distinct(F.filter(F.split(left, ""), lambda c: c != ""))
    common = F.aggregate(letters, F.lit(0), lambda n, c: n + F.least(times(left, c), times(right, c)))
    both = F.length(left) + F.length(right)
    return F.when(both > 0, 2.0 * common / both).otherwise(1.0)
