"""Readers for listing, census, point-of-interest and price-index files."""

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..constants import DEFAULT_SOURCE, POI_TAGS

_TYPES = {
    "Area_m2": "double", "Valor_Anuncio": "double", "Latitude": "double", "Longitude": "double",
    "Quartos": "int", "Banheiros": "int", "Vagas_Garagem": "int", "Suites": "int",
    "Descricao_Length": "int",
}

POI_ELEMENT = T.StructType(
    [
        T.StructField("lat", T.DoubleType()),
        T.StructField("lon", T.DoubleType()),
        T.StructField(
            "center",
            T.StructType([T.StructField("lat", T.DoubleType()), T.StructField("lon", T.DoubleType())]),
        ),
        T.StructField("tags", T.MapType(T.StringType(), T.StringType())),
    ]
)
POI_SNAPSHOT = "categoria string, lat double, lon double, nome string"


def listing_schema(columns) -> T.StructType:
    return T.StructType.fromDDL(", ".join(f"`{c}` {_TYPES.get(c, 'string')}" for c in columns))


def read_listings(spark: SparkSession, path: str, columns) -> DataFrame:
    """Headered CSV with a declared schema; descriptions may span lines.

    A multi-line CSV file cannot be split, so large collections should arrive as
    many files (or be rewritten to parquet once).
    """
    return (
        spark.read.schema(listing_schema(columns))
        .options(header=True, multiLine=True, escape='"', nanValue="", mode="PERMISSIVE")
        .csv(path)
    )


def read_census(spark: SparkSession, path: str, columns) -> DataFrame:
    """Semicolon-separated Latin-1 file, every column text, only the named ones kept."""
    return (
        spark.read.options(header=True, sep=";", encoding="ISO-8859-1", inferSchema=False)
        .csv(path)
        .select(*columns)
    )


def read_latest_snapshot(
    spark: SparkSession, path: str, schema: str = POI_SNAPSHOT, name: str = r"[^/]+$", array_files: bool = True
) -> DataFrame:
    """Rows of the snapshot whose name is lexicographically last.

    The dated name is what the pattern finds in the file's path: the file name, or a
    dated folder for snapshots written in parts. `array_files`: each file is one JSON
    array (read whole); otherwise one object per line, which large files should use.
    The snapshot is chosen from the listing, and no other is opened.
    """
    # Paths alone: this source opens a file only if its content is asked for.
    files = spark.read.format("binaryFile").load(path).select(
        F.regexp_extract("path", name, 0).alias("snapshot"), F.regexp_extract("path", f"^.*?(?:{name})", 0).alias("place")
    )
    latest = files.groupBy("snapshot").agg(F.collect_set("place").alias("places")).orderBy(F.desc("snapshot")).first()
    if latest is None:
        raise FileNotFoundError(f"no snapshot under {path}")
    return spark.read.schema(schema).option("multiLine", array_files).json(sorted(latest["places"]))


def tag_pois(elements: DataFrame) -> DataFrame:
    """Raw map elements (see POI_ELEMENT) to categorised points.

    A zero coordinate counts as missing and falls through to the element's centre;
    the first category in vocabulary order wins; incomplete rows are dropped.
    """

    def coordinate(name):
        own = F.col(name)
        return F.coalesce(F.when(own != 0, own), F.col(f"center.{name}"))

    category = F.coalesce(
        *[F.when(F.try_element_at("tags", F.lit(k)) == v, name) for name, (k, v) in POI_TAGS.items()]
    )
    return elements.select(
        category.alias("categoria"),
        coordinate("lat").alias("lat"),
        coordinate("lon").alias("lon"),
        F.coalesce(F.try_element_at("tags", F.lit("name")), F.lit("")).alias("nome"),
    ).dropna(subset=["categoria", "lat", "lon"])


def latest_price_index(series: DataFrame) -> DataFrame:
    """Last row by date as (Venda, Aluguel). A NULL price in that row is an error.

    Several rows on the last date are settled by the larger sale, then rent price.
    """
    sale, rent = "Residencial_Venda_PrecoMedio_BRL_m2", "Residencial_Locacao_PrecoMedio_BRL_m2"
    latest = series.agg(F.max(F.struct(F.col("Data"), F.col(sale), F.col(rent))).alias("r"))

    def checked(name):
        value = F.col(f"r.{name}")
        problem = F.raise_error(F.lit(f"price index: no valid {name} in the latest row"))
        return F.when(value.isNotNull() & ~F.isnan(value), value).otherwise(problem.cast("double"))

    return latest.select(checked(sale).alias("Venda"), checked(rent).alias("Aluguel"))


# --- schema contracts ------------------------------------------------------
def require_columns(df: DataFrame, columns) -> DataFrame:
    """Plan-time check; the error names every missing column."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing required columns: {missing}; present: {df.columns}")
    return df


def align_schema(df: DataFrame, columns) -> DataFrame:
    """Exactly the given columns in order; new ones get an empty text (a missing
    source label becomes the default one)."""

    def default(name):
        return DEFAULT_SOURCE if name == "Fonte" else ""

    return df.select(*[F.col(c) if c in df.columns else F.lit(default(c)).alias(c) for c in columns])


def union_sources(sources: dict[str, DataFrame]) -> DataFrame:
    """Stack sources, labelling each; columns a source lacks are NULL."""
    stacked = None
    for label, df in sources.items():
        df = df.withColumn("Fonte", F.lit(label))
        stacked = df if stacked is None else stacked.unionByName(df, allowMissingColumns=True)
    return stacked


def null_nans(df: DataFrame) -> DataFrame:
    """NaN from dataframe-library files means missing; make it NULL."""
    floats = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: F.nanvl(c, F.lit(None).cast("double")) for c in floats})
