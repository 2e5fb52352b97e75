"""Encoding, scaling, grouping and profile tables for the price model."""

from pyspark.ml import PipelineModel
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler, VectorSlicer
from pyspark.sql import Column, DataFrame, functions as F

from .. import constants as K
from ..functions.hashing import fold_of, row_key, uniform
from ..functions.numbers import null_if_zero
from .quantiles import exact_quantiles


def fit_features(train: DataFrame, numeric, categorical=(), output: str = "features") -> PipelineModel:
    """Fitted encoding and assembly.

    One-hot indicators leave out the alphabetically first level, as sparse vectors; a
    level unseen in training has no indicator set. Descending order puts the omitted
    level last, where it is sliced off.
    """
    stages, vectors = [], []
    if categorical:
        names = list(categorical)
        indexer = StringIndexer(
            inputCols=names,
            outputCols=[f"{c}_idx" for c in names],
            stringOrderType="alphabetDesc",
            handleInvalid="keep",  # unseen levels get an index of their own, which the encoder drops
        ).fit(train)
        indexed = indexer.transform(train)
        encoder = OneHotEncoder(
            inputCols=[f"{c}_idx" for c in names], outputCols=[f"{c}_hot" for c in names], dropLast=True
        ).fit(indexed)
        stages += [indexer, encoder]
        for c, levels in zip(names, indexer.labelsArray):
            if len(levels) > 1:
                stages.append(VectorSlicer(inputCol=f"{c}_hot", outputCol=f"{c}_vec", indices=list(range(len(levels) - 1))))
                vectors.append(f"{c}_vec")
    stages.append(VectorAssembler(inputCols=[*numeric, *vectors], outputCol=output, handleInvalid="error"))
    return PipelineModel(stages=stages)


def level_columns(df: DataFrame, categorical, least_share: float = 1 / 32):
    """df with a column of level numbers for every category, and {category: {column: which levels are split off}}.

    The alphabetically first level and missing values have the number after the last. Levels are a vocabulary, listed when
    planning. A level that all but less than `least_share` of the rows have is not split off, as 0/1 columns cut at as
    many quantiles would not be.
    """
    found = {}
    for c in categorical:
        counts = [(r[0], r[1]) for r in df.groupBy(c).count().collect()]
        total = sum(n for _, n in counts)
        levels = sorted((v, n) for v, n in counts if v is not None)[1:]
        place = F.array_position(F.array(*[F.lit(v) for v, _ in levels]), F.col(c)) if levels else F.lit(0)
        df = df.withColumn(f"{c}#", F.coalesce(F.nullif(place, F.lit(0)) - 1, F.lit(len(levels))).cast("int"))
        found[c] = {f"{c}#": [total - n >= least_share * total for _, n in levels]}
    return df, found


def category_levels(df: DataFrame, column: str) -> DataFrame:
    """Distinct levels; the first one is the level one-hot encoding leaves out."""
    levels = df.select(column).where(F.col(column).isNotNull()).distinct()
    first = levels.agg(F.min(column).alias("m")).scalar()
    return levels.withColumn("omitido", F.col(column) == first)


def dummies_long(df: DataFrame, row_id: str, column: str) -> DataFrame:
    """One-hot in sparse long form: only the ones, without the first level."""
    first = df.agg(F.min(column).alias("m")).scalar()
    return df.where(F.col(column) > first).select(
        row_id, F.concat(F.lit(f"{column}_"), F.col(column)).alias("coluna"), F.lit(1).alias("valor")
    )


def from_dummies(df: DataFrame, columns, prefix: str, name: str) -> DataFrame:
    """Category back from its indicator columns: the largest one, the first on ties
    (so an all-zero row gets the first column)."""
    values = F.array(*[F.col(c).cast("double") for c in columns])
    labels = F.array(*[F.lit(c.removeprefix(prefix)) for c in columns])
    largest = F.array_position(values, F.array_max(values)).cast("int")
    return df.withColumn(name, F.element_at(labels, largest)).drop(*columns)


def label_table(df: DataFrame, column: str) -> DataFrame:
    """Alphabetical integer labels. A vocabulary has one row per level, so ordering
    it in one task is bounded by the number of levels."""
    from pyspark.sql import Window

    levels = df.select(column).where(F.col(column).isNotNull()).distinct()
    return levels.withColumn("codigo", F.row_number().over(Window.orderBy(column)) - 1)


def encode_labels(df: DataFrame, labels: DataFrame, column: str, unseen: int | None = 0) -> DataFrame:
    """Adds `<column>_encoded`; values without a label get `unseen`."""
    codes = labels.select(F.col(column).alias("_l"), F.col("codigo").alias("_c"))
    out = df.join(codes, df[column] == codes["_l"], "left")
    code = F.col("_c") if unseen is None else F.coalesce("_c", F.lit(unseen))
    return out.withColumn(f"{column}_encoded", code).drop("_l", "_c")


def class_labels(columns, prefixes) -> list[str]:
    """Level names read off indicator column names, underscores as spaces, in order."""
    names = []
    for column in columns:
        prefix = next((p for p in prefixes if column.startswith(p)), None)
        label = column.removeprefix(prefix).strip().replace("_", " ") if prefix else ""
        if label and label not in names:
            names.append(label)
    return names


# --- scaling ---------------------------------------------------------------
def scaler_table(df: DataFrame, columns) -> DataFrame:
    """Per column its mean and population deviation (0 counts as 1), one pass."""
    wide = df.agg(
        *[
            F.struct(
                F.lit(c).alias("coluna"),
                F.avg(F.col(c).cast("double")).alias("media"),
                F.coalesce(null_if_zero(F.stddev_pop(F.col(c).cast("double"))), F.lit(1.0)).alias("escala"),
            ).alias(f"c{i}")
            for i, c in enumerate(columns)
        ]
    )
    return wide.select(F.inline(F.array(*[f"c{i}" for i in range(len(columns))])))


def standardise(df: DataFrame, columns, fitted_on: DataFrame | None = None) -> DataFrame:
    """(x - mean) / deviation; statistics from `fitted_on` (train rows) when given."""
    columns = list(columns)
    source = df if fitted_on is None else fitted_on
    stats = source.agg(
        F.struct(
            *[F.avg(F.col(c).cast("double")).alias(f"m_{c}") for c in columns],
            *[F.coalesce(null_if_zero(F.stddev_pop(F.col(c).cast("double"))), F.lit(1.0)).alias(f"s_{c}") for c in columns],
        ).alias("s")
    ).scalar()
    return df.withColumns({c: (F.col(c) - stats[f"m_{c}"]) / stats[f"s_{c}"] for c in columns})


# --- groups and splits -----------------------------------------------------
def property_group(df: DataFrame, columns=tuple(K.PROPERTY_KEY), name: str = "imovel") -> DataFrame:
    """Id of the physical property behind a listing; NULL is a key value of its own.

    A digest of the key instead of a running number: no global order, and the id does
    not change when rows are added.
    """
    present = [c for c in columns if c in df.columns]
    if not present:
        raise ValueError(f"none of the key columns {list(columns)} is present")
    return df.withColumn(name, row_key(*[F.col(c) for c in present]))


def group_split(df: DataFrame, group: str, test_share: float = K.TEST_SHARE, seed: int = K.SEED, name: str = "teste") -> DataFrame:
    """Marks test rows by group: the share counts groups, and all rows of a group
    stay on one side. A function of the key alone, so no shuffle."""
    return df.withColumn(name, uniform(F.col(group), f"split:{seed}:") < test_share)


def assign_fold(df: DataFrame, key: str, folds: int = 5, seed: int = K.SEED, name: str = "dobra") -> DataFrame:
    """Cross-validation fold of each key (row id, or group id for grouped folds)."""
    return df.withColumn(name, fold_of(F.col(key), folds, f"fold:{seed}:"))


def nested_sample(df: DataFrame, key: str, share: float, draw: int = 0) -> DataFrame:
    """A reproducible share of the keys; a larger share contains the smaller one."""
    return df.where(uniform(F.col(key), f"draw:{draw}:") < share)


# --- what scoring needs ----------------------------------------------------
def _long(df: DataFrame, columns, keys=()) -> DataFrame:
    cells = [F.struct(F.lit(c).alias("atributo"), F.col(c).cast("double").alias("_x")) for c in columns]
    return df.select(*keys, F.inline(F.array(*cells)))


def feature_defaults(df: DataFrame, columns) -> DataFrame:
    """Exact median of every feature, long form."""
    return exact_quantiles(_long(df, columns), "_x", {"mediana": 0.5}, ["atributo"]).drop("n")


def neighbourhood_profiles(df: DataFrame, columns, area: str = "Bairro", minimum: int = K.MIN_PROFILE_ROWS) -> DataFrame:
    """Median context features of every neighbourhood with enough rows, long form."""
    enough = df.groupBy(area).count().where(F.col("count") >= minimum).select(area)
    rows = df.join(enough, area, "left_semi")
    return exact_quantiles(_long(rows, columns, [area]), "_x", {"mediana": 0.5}, [area, "atributo"]).drop("n")


def wide_profiles(long: DataFrame, columns, keys=()) -> DataFrame:
    """Long medians to one column per feature (the list is known when planning)."""
    return long.groupBy(*keys).agg(
        *[F.max(F.when(F.col("atributo") == c, F.col("mediana"))).alias(c) for c in columns]
    )
