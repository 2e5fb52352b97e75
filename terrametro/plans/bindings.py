"""The star-schema tables read as listings, points of interest, sectors and series.

Every binding exists twice: as a DataFrame and as the same SQL for the oracle.
"""

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..constants import POI_CATEGORIES

AREA_NAMES = {
    "Brand#1": "Fátima", "Brand#2": "Jóquei Clube", "Brand#3": "Centro", "Brand#4": "Ininga",
    "Brand#5": "Morada do Sol", "Brand#6": "Piçarra",
}
TYPE_NAMES = {
    "STANDARD": "Apartamento", "PROMO": "Casa", "ECONOMY": "Terreno", "LARGE": "Sala",
    "MEDIUM": "Flat", "SMALL": "Loja",
}
DEALS = {"A": "Venda", "N": " comprar ", "R": "Aluguel"}
INGEST = ["data", "peca", "fornecedor", "quantidade", "valor", "desconto", "taxa", "situacao", "linha"]


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _case(expr: str, names: dict, otherwise: str) -> str:
    arms = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in names.items())
    return f"CASE {expr} {arms} ELSE {otherwise} END"


# Both engines read these expressions; every literal is typed so that they agree.
_LISTING = {
    "URL_Anuncio": "concat(l_orderkey, '-', l_linenumber)",
    "Valor_Anuncio": "l_extendedprice * CAST(12 AS DOUBLE)",
    "Area_m2": "CASE WHEN l_partkey % 7 = 0 THEN NULL WHEN l_partkey % 101 = 5 THEN CAST(0 AS DOUBLE)"
    " ELSE l_quantity * CAST(8 AS DOUBLE) END",
    "Quartos": "CASE WHEN l_suppkey % 11 = 3 THEN NULL ELSE l_linenumber END",
    "Banheiros": "CAST(round(l_tax * 100) AS INT)",
    "Vagas_Garagem": "CASE WHEN l_suppkey % 13 = 4 THEN NULL ELSE CAST(l_suppkey % 4 AS INT) END",
    "Tipo_Negocio": _case("l_returnflag", DEALS, "'?'"),
    "Latitude": "CASE WHEN l_partkey % 29 = 7 THEN NULL ELSE CAST(-5.14 AS DOUBLE)"
    " + CAST((l_partkey * 7919 + l_suppkey * 104729) % 100000 AS DOUBLE) / CAST(1000000 AS DOUBLE) END",
    "Longitude": "CASE WHEN l_partkey % 29 = 7 THEN NULL ELSE CAST(-42.85 AS DOUBLE)"
    " + CAST((l_partkey * 15485863 + l_suppkey * 32452843) % 100000 AS DOUBLE) / CAST(1000000 AS DOUBLE) END",
    "data": "l_shipdate", "peca": "l_partkey", "fornecedor": "l_suppkey", "quantidade": "l_quantity",
    "valor": "l_extendedprice", "desconto": "l_discount", "taxa": "l_tax", "situacao": "l_returnflag",
    "linha": "l_linestatus",
}
_PART = {
    "Bairro": "CASE WHEN p_partkey % 53 = 0 THEN NULL ELSE " + _case("p_brand", AREA_NAMES, "p_brand") + " END",
    "Tipo_Imovel": _case("p_type", TYPE_NAMES, "p_type"),
}


def _select(columns: dict) -> str:
    return ", ".join(f"{e} AS {n}" for n, e in columns.items())


LISTINGS_SQL = f"SELECT {_select({**_LISTING, **_PART})} FROM lineitem JOIN part ON l_partkey = p_partkey"
LISTINGS_BARE_SQL = f"SELECT {_select(_LISTING)} FROM lineitem"


def listings(spark: SparkSession, sf: str, with_part: bool = True) -> DataFrame:
    """Listings off lineitem; the neighbourhood and type come from part.

    Without them the join is left out: Catalyst cannot know that it loses no row.
    """
    return as_listings(listing_sources(spark, sf, with_part), with_part)


#: The tables' columns behind INGEST.
INGEST_SOURCES = [_LISTING[c] for c in INGEST]


def listing_sources(spark: SparkSession, sf: str, with_part: bool = True) -> DataFrame:
    """The rows that listings are read off, with the columns they need."""
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", *INGEST_SOURCES)
    if with_part:
        part = table(spark, sf, "part").select("p_partkey", "p_brand", "p_type")
        rows = rows.join(part, F.col("l_partkey") == F.col("p_partkey"))
    return rows


def part_sources(spark: SparkSession, sf: str) -> DataFrame:
    """One row a part key, so that joining it multiplies no listing."""
    part = table(spark, sf, "part").groupBy("p_partkey").agg(F.min(F.struct("p_brand", "p_type")).alias("_p"))
    return part.select("p_partkey", "_p.*")


def as_listings(rows: DataFrame, with_part: bool = True) -> DataFrame:
    columns = {**_LISTING, **_PART} if with_part else _LISTING
    return rows.select(*[F.expr(e).alias(n) for n, e in columns.items()])


# Deduplicated by URL in both engines; what most reports start from.
ORDER = ", ".join(INGEST)
UNIQUE_SQL = (
    "SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY URL_Anuncio ORDER BY "
    f"{ORDER}) AS rn FROM ({LISTINGS_SQL})) WHERE rn = 1"
)
UNIQUE_BARE_SQL = UNIQUE_SQL.replace(LISTINGS_SQL, LISTINGS_BARE_SQL)

_POI = {
    "categoria": "CASE s_suppkey % 8 "
    + " ".join(f"WHEN {i} THEN '{c}'" for i, c in enumerate(POI_CATEGORIES))
    + " END",
    "lat": "CAST(-5.14 AS DOUBLE) + CAST((s_suppkey * 7919) % 100000 AS DOUBLE) / CAST(1000000 AS DOUBLE)",
    "lon": "CAST(-42.85 AS DOUBLE) + CAST((s_suppkey * 48611) % 100000 AS DOUBLE) / CAST(1000000 AS DOUBLE)",
    "nome": "s_name",
}
POIS_SQL = f"SELECT {_select(_POI)} FROM supplier"


def pois(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "supplier").select(*[F.expr(e).alias(n) for n, e in _POI.items()])


# Sectors: a 5 x 5 chessboard of nations over the city square. Even ones are squares,
# odd ones the lower-left triangle of their square. The origin lies off the listings'
# micro-degree lattice, so no listing sits on an edge up to rounding.
SECTOR_SIDE = "CAST(0.02 AS DOUBLE)"
_SECTOR = {
    "CD_SETOR": "CAST(n_nationkey AS STRING)",
    "CD_MUN": "CASE WHEN n_nationkey % 6 = 5 THEN '1100000' ELSE '2211001' END",
    "NM_BAIRRO": "n_name",
    "AREA_KM2": "CAST(n_nationkey % 4 AS DOUBLE)",
    "sx": "CAST(-42.8500003 AS DOUBLE) + CAST(n_nationkey % 5 AS DOUBLE) * " + SECTOR_SIDE,
    "sy": "CAST(-5.1400004 AS DOUBLE) + CAST((n_nationkey - n_nationkey % 5) / 5 AS INT) * " + SECTOR_SIDE,
    "triangular": "n_nationkey % 2 = 1",
}
SECTORS_SQL = f"SELECT {_select(_SECTOR)}, {SECTOR_SIDE} AS side FROM nation".replace("STRING", "VARCHAR")


def sectors(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "nation").select(
        *[F.expr(e).alias(n) for n, e in _SECTOR.items()], F.expr(SECTOR_SIDE).alias("side")
    )
    x, y, s = F.col("sx"), F.col("sy"), F.col("side")

    def corner(a, b):
        return F.struct(a.alias("x"), b.alias("y"))

    square = F.array(corner(x, y), corner(x + s, y), corner(x + s, y + s), corner(x, y + s))
    triangle = F.array(corner(x, y), corner(x + s, y), corner(x, y + s))
    return rows.withColumn("ring", F.when(F.col("triangular"), triangle).otherwise(square)).drop("sx", "sy", "side", "triangular")


# Census texts: population and household size with decimal commas, income with a point.
def census_basics(spark: SparkSession, sf: str) -> DataFrame:
    counts = table(spark, sf, "customer").groupBy("c_nationkey").agg(F.count("*").alias("k"))
    return counts.select(
        F.col("c_nationkey").cast("string").alias("CD_SETOR"),
        F.concat(F.col("k").cast("string"), F.lit(".000,0")).alias("v0001"),
        F.concat((F.col("k") % 7).cast("string"), F.lit(",5")).alias("v0005"),
    )


def census_income(spark: SparkSession, sf: str) -> DataFrame:
    keys = table(spark, sf, "customer").select("c_nationkey").distinct().where("c_nationkey % 8 != 3")
    text = F.concat((F.col("c_nationkey") * 100).cast("string"), F.lit(".25"))
    return keys.select(
        F.col("c_nationkey").cast("string").alias("CD_SETOR"),
        F.when(F.col("c_nationkey") % 9 == 4, "X").otherwise(text).alias("V06004"),
    )


CENSUS_SQL = """SELECT CAST(c_nationkey AS VARCHAR) AS CD_SETOR, CAST(count(*) * 1000 AS DOUBLE) AS populacao_setor,
    CAST(count(*) % 7 AS DOUBLE) + CAST(0.5 AS DOUBLE) AS media_moradores,
    CASE WHEN c_nationkey % 8 = 3 OR c_nationkey % 9 = 4 THEN NULL
         ELSE CAST(c_nationkey * 100 AS DOUBLE) + CAST(0.25 AS DOUBLE) END AS renda_media_responsavel
    FROM customer GROUP BY c_nationkey"""

PRICE_SERIES_SQL = """SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS Data,
    round(avg(o_totalprice) / 50, 2) AS Residencial_Venda_PrecoMedio_BRL_m2,
    round(avg(o_totalprice) / 10000, 2) AS Residencial_Locacao_PrecoMedio_BRL_m2
    FROM orders GROUP BY 1"""


def price_series(spark: SparkSession, sf: str) -> DataFrame:
    month = F.date_trunc("month", "o_orderdate").cast("date").alias("Data")
    price = F.avg("o_totalprice")
    return table(spark, sf, "orders").groupBy(month).agg(
        F.round(price / 50, 2).alias("Residencial_Venda_PrecoMedio_BRL_m2"),
        F.round(price / 10000, 2).alias("Residencial_Locacao_PrecoMedio_BRL_m2"),
    )


# A rule-of-thumb prediction to measure metrics on: area times a rate by room count.
PREDICTED_SQL = (
    f"SELECT *, Area_m2 * (1500 + 250 * coalesce(Quartos, 0)) AS previsto FROM ({UNIQUE_SQL})"
    " WHERE Area_m2 IS NOT NULL"
)


def predicted(unique: DataFrame) -> DataFrame:
    rate = 1500 + 250 * F.coalesce(F.col("Quartos"), F.lit(0))
    return unique.where(F.col("Area_m2").isNotNull()).withColumn("previsto", F.col("Area_m2") * rate)
