"""Number parsing and guarded arithmetic."""

from pyspark.sql import Column, functions as F

_NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def strict_double(text: Column) -> Column:
    """Text to double; anything that is not a plain number is NULL.

    The pattern keeps out spellings only the JVM accepts ("5d", "0x1p3") and NaN.
    """
    # Without a match the extracted text is empty, which does not cast either; the
    # input is evaluated once.
    return F.regexp_extract(F.trim(text.cast("string")), _NUMBER, 0).try_cast("double")


def whole_from_digits(text: Column) -> Column:
    """Every digit of the text read as one integer; no digits gives NULL."""
    return F.regexp_replace(text.cast("string"), r"\D", "").try_cast("bigint")


def decimal_point_only(text: Column) -> Column:
    """Number with an optional currency sign; a comma is the decimal mark and a
    thousands dot makes the value unreadable (NULL)."""
    bare = F.trim(F.replace(F.trim(text.cast("string")), F.lit("R$"), F.lit("")))
    return strict_double(F.replace(bare, F.lit(","), F.lit(".")))


def decimal_ptbr(text: Column) -> Column:
    """Number written with thousands dots and a decimal comma, any unit around it."""
    bare = F.regexp_replace(text.cast("string"), r"[^\d,.-]", "")
    return strict_double(F.translate(bare, ",.", "."))


def truncated(number: Column) -> Column:
    """Double to integer, dropping the fraction; out of range gives NULL."""
    return number.try_cast("int")


def decimal_locale(text: Column, decimal: str = ".") -> Column:
    """Census-style number; with a decimal comma the dots are thousands marks."""
    text = F.trim(text.cast("string"))
    if decimal == ",":
        text = F.translate(text, ",.", ".")
    return strict_double(text)


def null_if_zero(number: Column) -> Column:
    return F.when(number != 0, number)


def ratio_or_zero(numerator: Column, denominator: Column) -> Column:
    """numerator / max(denominator, 1); a missing operand gives 0."""
    # greatest() skips NULLs, so the NULL denominator is kept out explicitly.
    floor = F.when(denominator.isNotNull(), F.greatest(denominator.cast("double"), F.lit(1.0)))
    return F.coalesce(numerator / floor, F.lit(0.0))


def relative_error(actual: Column, predicted: Column) -> Column:
    """Signed error over the actual value; NULL where the actual value is 0."""
    return (predicted - actual) / null_if_zero(actual)


def truthy_number(number: Column) -> Column:
    return F.coalesce(number != 0, F.lit(False))


def truthy_text(text: Column) -> Column:
    return F.coalesce(text != "", F.lit(False))
