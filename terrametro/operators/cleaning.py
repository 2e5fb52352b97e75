"""Filters, imputation and preparation of listings."""

from pyspark.sql import Column, DataFrame, functions as F, types as T

from .. import constants as K
from ..functions.numbers import (
    null_if_zero,
    ratio_or_zero,
    strict_double,
    truthy_number,
    truthy_text,
)
from ..functions.text import category_text, title_case
from ..sources.readers import require_columns
from ..sources.staging import staged
from .dedup import keep_first
from .quantiles import exact_median, exact_quantiles


# --- filters ---------------------------------------------------------------
def only_sales(df: DataFrame, column: str = "Tipo_Negocio") -> DataFrame:
    """Sale listings; without the column every row passes."""
    if column not in df.columns:
        return df
    return df.where(F.lower(F.trim(F.col(column))).isin(K.SALE_WORDS))


def above_price_floor(df: DataFrame, floor: float = K.PRICE_FLOOR) -> DataFrame:
    return df.where(F.col(K.TARGET) >= floor)


def positive_area_and_price(df: DataFrame) -> DataFrame:
    return df.where((F.col("Area_m2") > 0) & (F.col(K.TARGET) > 0))


def _iqr_fences(df: DataFrame, column: str, factor: float) -> Column:
    q = exact_quantiles(df, column, {"q1": 0.25, "q3": 0.75})
    reach = (F.col("q3") - F.col("q1")) * factor
    return q.select(
        F.struct((F.col("q1") - reach).alias("low"), (F.col("q3") + reach).alias("high"))
    ).scalar()


def within_iqr_fences(
    df: DataFrame, column: str = K.TARGET, factor: float = K.IQR_FACTOR, fitted_on: DataFrame | None = None
) -> DataFrame:
    """Rows inside [Q1 - f*IQR, Q3 + f*IQR]; NULL drops out.

    `fitted_on` is a cheaper table with the same values to take the quartiles from.
    """
    fences = _iqr_fences(df if fitted_on is None else fitted_on, column, factor)
    return df.where(F.col(column).between(fences["low"], fences["high"]))


def flag_high_outliers(df: DataFrame, column: str, name: str = "eh_outlier") -> DataFrame:
    """Upper fence only, as a flag."""
    fences = _iqr_fences(df, column, K.IQR_FACTOR)
    return df.withColumn(name, F.col(column) > fences["high"])


def has_content(df: DataFrame, rule: str) -> DataFrame:
    """Minimum-content rules of the three collectors."""
    price, area = F.col(K.TARGET), F.col("Area_m2")
    rules = {
        "any_field": price.isNotNull() | area.isNotNull() | F.col("Quartos").isNotNull(),
        "price_and_area": truthy_number(price) & truthy_number(area),
        "url_and_price": truthy_text(F.col(K.URL)) & truthy_number(price),
    }
    return df.where(rules[rule])


def clear_untrusted_locations(df: DataFrame, source: str = "fonte") -> DataFrame:
    """NULL the location columns that exist on rows of the untrusted source."""
    if source not in df.columns:
        return df
    trusted = F.coalesce(F.lower(F.col(source)) != K.UNTRUSTED_LOCATION_SOURCE, F.lit(True))
    return df.withColumns({c: F.when(trusted, F.col(c)) for c in K.LOCATION_COLUMNS if c in df.columns})


def drop_small_segments(df: DataFrame, segment: str, minimum: int = K.MIN_SEGMENT_ROWS) -> DataFrame:
    """Rows of segments with enough rows: counted map-side, then a semi-join, so no
    segment is buffered."""
    big = df.groupBy(segment).count().where(F.col("count") >= minimum).select(segment)
    return df.join(big, segment, "left_semi")


def split_valid_requests(df: DataFrame) -> DataFrame:
    """Adds `motivo`: NULL for an acceptable request, else why it is rejected."""
    return df.withColumn(
        "motivo",
        F.when(~F.coalesce(F.col("area") > 0, F.lit(False)), "area")
        .when(~F.coalesce(F.col("quartos") >= 0, F.lit(False)), "quartos")
        .when(~F.coalesce(F.col("banheiros") >= 0, F.lit(False)), "banheiros")
        .when(~F.coalesce(F.lower("tipo").isin(K.RELIABLE_TYPES), F.lit(False)), "tipo")
        .when(F.col("bairro").isNull(), "bairro")
        .when(F.col("cidade").isNull(), "cidade"),
    )


# --- column selection ------------------------------------------------------
def drop_leaking_columns(df: DataFrame, extra=()) -> DataFrame:
    return df.drop(*K.LEAKAGE_COLUMNS, *extra)


def numeric_columns(df: DataFrame) -> list[str]:
    kinds = (T.NumericType, T.BooleanType)
    return [f.name for f in df.schema.fields if isinstance(f.dataType, kinds)]


def numeric_matrix(df: DataFrame) -> DataFrame:
    """Numeric and boolean columns as doubles."""
    return df.select(*[F.col(c).cast("double").alias(c) for c in numeric_columns(df)])


def column_spread(df: DataFrame, columns) -> DataFrame:
    """Per column: rows, NULLs, min, max and sample variance, in one pass."""
    wide = df.agg(
        *[
            F.struct(
                F.lit(c).alias("coluna"),
                F.count("*").alias("linhas"),
                F.count_if(F.col(c).isNull()).alias("nulos"),
                F.min(F.col(c).cast("double")).alias("minimo"),
                F.max(F.col(c).cast("double")).alias("maximo"),
                F.var_samp(F.col(c).cast("double")).alias("variancia"),
            ).alias(f"c{i}")
            for i, c in enumerate(columns)
        ]
    )
    return wide.select(F.inline(F.array(*[f"c{i}" for i in range(len(columns))])))


def constant_columns(df: DataFrame, columns, rule: str = "distinct") -> DataFrame:
    """Columns carrying no information.

    `distinct`: one value, NULL being a value; `variance`: no variance, or any
    NULL; `std`: no spread.
    """
    flat = F.coalesce(F.col("minimo") == F.col("maximo"), F.lit(True))
    no_spread = ~F.coalesce((F.col("variancia") > 0) & ~F.isnan("variancia"), F.lit(False))
    rules = {
        "distinct": flat & ((F.col("nulos") == 0) | F.col("minimo").isNull()),
        "variance": no_spread | (F.col("nulos") > 0),
        "std": no_spread,
    }
    return column_spread(df, columns).where(rules[rule]).select("coluna")


def drop_constant_columns(df: DataFrame, columns, rule: str = "distinct") -> DataFrame:
    """One row per column comes to the driver to decide the new schema."""
    return df.drop(*[r["coluna"] for r in constant_columns(df, columns, rule).collect()])


def select_training_columns(df: DataFrame, extra=()) -> DataFrame:
    """Numerics, engineered, categories, then optional and extra columns that are numeric."""
    numeric = set(numeric_columns(df))
    wanted = K.REQUIRED_NUMERIC + K.ENGINEERED + K.REQUIRED_CATEGORICAL
    wanted = wanted + [c for c in dict.fromkeys([*K.OPTIONAL_COLUMNS, *extra]) if c in numeric and c not in wanted]
    return df.select(*[c for c in wanted if c in df.columns])


def canonical_request_columns(df: DataFrame) -> DataFrame:
    """Form-compatible names and defaults; incomplete rows are dropped."""
    df = clear_untrusted_locations(df)
    names = {"Area_m2": "area", "Quartos": "quartos", "Banheiros": "banheiros"}
    df = df.withColumnsRenamed({k: v for k, v in names.items() if k in df.columns})
    defaults = {"bairro": "Desconhecido", "tipo": K.DEFAULT_TYPE, "cidade": K.DEFAULT_CITY}
    # Column names are case-insensitive in Spark: an input `Bairro` is already `bairro`.
    present = {c.lower(): c for c in df.columns}
    for name, value in defaults.items():
        if name in present:
            df = df.withColumnRenamed(present[name], name)
        else:
            df = df.withColumn(name, F.lit(value))
    required = [K.TARGET, "area", "quartos", "banheiros", "tipo", "bairro", "cidade"]
    require_columns(df, required)
    area = strict_double(F.col("area"))
    df = df.dropna(subset=required).withColumns(
        {
            # greatest() skips a NULL, so an unreadable area must not reach it.
            "area": F.when(area.isNotNull(), F.greatest(area, F.lit(1.0))),
            "quartos": strict_double(F.col("quartos")),
            "banheiros": strict_double(F.col("banheiros")),
        }
    )
    df = df.dropna(subset=["area", "quartos", "banheiros"])
    return df.withColumns(
        {
            "tipo": F.trim(F.lower("tipo")),
            "bairro": F.trim(title_case(F.col("bairro"))),
            "cidade": F.trim(title_case(F.col("cidade"))),
            "densidade_comodos": (F.col("quartos") + F.col("banheiros")) / F.col("area"),
        }
    )


def funnel(df: DataFrame, key: str, order) -> DataFrame:
    """Rows left after each cleaning step of the rental study, in step order.

    Row-wise steps are cumulative conditions counted in one pass; only the rows that
    pass them are deduplicated.
    """
    filled = F.col("Area_m2").isNotNull() & F.col(K.TARGET).isNotNull()
    residential = filled & F.col("Tipo_Imovel").isin(K.RESIDENTIAL_TYPES)
    low, high = K.PLAUSIBLE_RENT
    plausible = keep_first(df.where(residential), [key], order).where(F.col(K.TARGET).between(low, high))
    early = df.agg(
        F.count("*").alias("brutos"),
        F.count_if(filled).alias("com_area_e_valor"),
        F.count_if(residential).alias("residenciais"),
    ).withColumn("unicos_plausiveis", plausible.agg(F.count("*").alias("n")).scalar())
    steps = ["brutos", "com_area_e_valor", "residenciais", "unicos_plausiveis"]
    return early.select(
        F.inline(
            F.array(
                *[
                    F.struct(F.lit(i + 1).alias("ordem"), F.lit(s).alias("etapa"), F.col(s).alias("restam"))
                    for i, s in enumerate(steps)
                ]
            )
        )
    )


# --- imputation ------------------------------------------------------------
def impute_by_group_mean(df: DataFrame, columns, group: str) -> DataFrame:
    """Missing value <- mean of its group <- mean of the column after that fill.

    One aggregation gives every group's sums; the second-level mean follows from
    that small table, so the data are read once for statistics.
    """
    per_group = df.groupBy(group).agg(
        F.count("*").alias("_rows"),
        *[F.sum(c).alias(f"_sum_{c}") for c in columns],
        *[F.count(c).alias(f"_n_{c}") for c in columns],
    )
    means = per_group.select(
        F.col(group).alias("_g"),
        "_rows",
        *[f"_n_{c}" for c in columns],
        *[f"_sum_{c}" for c in columns],
        *[(F.col(f"_sum_{c}") / null_if_zero(F.col(f"_n_{c}"))).alias(f"_mean_{c}") for c in columns],
    )

    def overall(c):
        keyed = F.col("_g").isNotNull()  # rows without a group are not filled by it
        gaps = F.col("_rows") - F.col(f"_n_{c}")
        filled_sum = F.coalesce(F.col(f"_sum_{c}"), F.lit(0.0)) + F.when(
            keyed, gaps * F.coalesce(F.col(f"_mean_{c}"), F.lit(0.0))
        ).otherwise(0.0)
        filled_n = F.when(keyed & (F.col(f"_n_{c}") > 0), F.col("_rows")).otherwise(F.col(f"_n_{c}"))
        return (F.sum(filled_sum) / null_if_zero(F.sum(filled_n))).alias(c)

    fallback = means.agg(F.struct(*[overall(c) for c in columns]).alias("m")).scalar()
    lookup = means.select("_g", *[f"_mean_{c}" for c in columns])
    return (
        df.join(lookup, df[group] == lookup["_g"], "left")
        .withColumns({c: F.coalesce(F.col(c), F.col(f"_mean_{c}"), fallback[c]) for c in columns})
        .drop("_g", *[f"_mean_{c}" for c in columns])
    )


def impute_constants(df: DataFrame) -> DataFrame:
    """Counts and index columns <- 0, texts <- empty."""
    present = set(df.columns)
    counts = {c: F.coalesce(F.col(c).cast("int"), F.lit(0)) for c in [*K.COUNT_COLUMNS, "Descricao_Length"]}
    index = {c: F.coalesce(F.col(c), F.lit(0.0)) for c in ["FipeZap_m2", "FipeZap_Diferenca_m2"]}
    text = {"Descricao": F.coalesce(F.col("Descricao"), F.lit(""))}
    return df.withColumns({c: e for c, e in {**counts, **index, **text}.items() if c in present})


def impute_medians(df: DataFrame, columns) -> DataFrame:
    """Missing value <- exact median of its column; all medians come from one run."""
    cells = F.array(*[F.struct(F.lit(c).alias("_column"), F.col(c).cast("double").alias("_x")) for c in columns])
    medians = exact_median(df.select(F.inline(cells)), "_x", ["_column"], name="m")
    wide = medians.agg(F.struct(*[F.max(F.when(F.col("_column") == c, F.col("m"))).alias(c) for c in columns]).alias("s")).scalar()
    return df.withColumns({c: F.coalesce(F.col(c).cast("double"), wide[c]) for c in columns})


def remaining_nulls(df: DataFrame) -> DataFrame:
    cells = sum((F.col(c).isNull().cast("int") for c in df.columns), F.lit(0))
    return df.agg(F.sum(cells).cast("bigint").alias("nulos"))


# --- features and the whole preparation ------------------------------------
def add_engineered(df: DataFrame) -> DataFrame:
    """Room density, price per m2 and total rooms, from values not yet imputed."""
    area = F.col("Area_m2")
    return df.withColumns(
        {
            "Densidade_Comodos": ratio_or_zero(F.col("Quartos") + F.col("Banheiros"), area),
            "Preco_m2": ratio_or_zero(F.col(K.TARGET), area),
            "Total_Dependencias": F.col("Quartos") + F.col("Banheiros") + F.col("Vagas_Garagem"),
        }
    )


def coerce_types(df: DataFrame) -> DataFrame:
    """Numbers or NULL; categories trimmed, title-cased, missing as its own level."""
    kinds = dict(df.dtypes)

    def number(c):
        return strict_double(F.col(c)) if kinds[c] == "string" else F.col(c)

    return df.withColumns(
        {c: number(c) for c in K.REQUIRED_NUMERIC if c in kinds}
        | {c: category_text(F.col(c), K.MISSING_CATEGORY) for c in K.REQUIRED_CATEGORICAL if c in kinds}
    )


def prepare_training_set(raw: DataFrame, order, stage=staged, extra=(), enrich=None) -> DataFrame:
    """Raw enriched listings to the training table.

    Sales only, one row per URL, typed, engineered, imputed, without price outliers.
    Categories stay single columns; encoding into one sparse vector happens at
    training (`operators.features`). `extra` names numeric columns to keep beside the
    fixed list: point, distance, census and score features. `enrich` is a function that adds
    such columns; it meets only the deduplicated sales, one row each, with what training needs of them.

    The deduplicated rows feed quartiles, group means and the result, so they go
    through `stage` once: the default writes them to the shared folder.
    """
    require_columns(raw, K.REQUIRED_NUMERIC + K.REQUIRED_CATEGORICAL)
    df = only_sales(raw)
    if K.URL in df.columns:
        df = keep_first(df, [K.URL], order)
    if enrich is not None:
        wanted = {*K.REQUIRED_NUMERIC, *K.REQUIRED_CATEGORICAL, *K.OPTIONAL_COLUMNS, *extra} - {K.URL}
        df = enrich(stage(df.select(*[c for c in df.columns if c in wanted])))
    base = stage(impute_constants(add_engineered(coerce_types(df))))
    df = impute_by_group_mean(base, ["Area_m2", "Latitude", "Longitude"], "Bairro")
    # An area that nothing is known about stays NULL, and such a row goes below.
    df = df.withColumn("Area_m2", F.when(F.col("Area_m2").isNotNull(), F.greatest("Area_m2", F.lit(1.0))))
    # Imputation neither drops rows nor touches the price: fences come from the base.
    return select_training_columns(positive_area_and_price(within_iqr_fences(df, fitted_on=base)), extra)


def load_training_rows(df: DataFrame, order) -> DataFrame:
    """Checks before training: target present, price floor, one row per URL."""
    require_columns(df, [K.TARGET])
    df = above_price_floor(df.dropna(subset=[K.TARGET]))
    return keep_first(df, [K.URL], order) if K.URL in df.columns else df
