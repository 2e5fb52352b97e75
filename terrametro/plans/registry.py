"""Named queries and their oracle SQL."""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLE: dict[str, str] = {}
SURVEY: dict[str, str] = {}

# Tables several queries share, staged once per session and data folder.
_SHARED: dict[tuple, DataFrame] = {}


def shared(spark: SparkSession, sf: str, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    key = (spark.sparkContext.applicationId, sf, name)
    if key not in _SHARED:
        _SHARED[key] = build()
    return _SHARED[key]


def forget_shared() -> None:
    """Makes the next query stage its tables again, as a benchmark must."""
    _SHARED.clear()


def query(name: str, ids: str, sql: str | None = None):
    """Registers a query under a name with the survey items it covers."""

    def add(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        SURVEY[name] = ids
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return add


def rounded(df: DataFrame, digits: int = 4, skip=()) -> DataFrame:
    """Doubles rounded for comparison; sums are not associative."""
    return df.withColumns(
        {c: F.round(c, digits) for c, t in df.dtypes if t == "double" and c not in skip}
    )


def r(expr: str, name: str, digits: int = 4) -> str:
    return f"round({expr}, {digits}) AS {name}"


def title_sql(text: str) -> str:
    return (
        rf"array_to_string(list_transform(regexp_extract_all({text}, '\p{{L}}+|\P{{L}}+'), "
        "lambda w: CASE WHEN w[1] = 'ß' THEN 'Ss' ELSE upper(w[1]) END || lower(w[2:])), '')"
    )


def ptbr_number(number: Column) -> Column:
    """1234.5 as the text 1.234,50, to have something to parse."""
    return F.translate(F.format_number(number, 2), ",.", ".,")
