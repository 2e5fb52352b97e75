"""Evaluation tables: errors, bands, distributions, leaderboards."""

from pyspark.sql import Column, DataFrame, Window, functions as F

from .. import constants as K
from ..functions.numbers import null_if_zero, relative_error
from ..sources.staging import staged
from .quantiles import exact_quantiles
from .ranks import with_average_rank


def attach(base: DataFrame, extra: DataFrame, keys=()) -> DataFrame:
    """Columns of `extra` next to `base`: by key, or one row to one row as scalars."""
    new = [c for c in extra.columns if c not in keys]
    if not keys:
        row = extra.select(F.struct(*new).alias("r")).scalar()
        return base.withColumns({c: row[c] for c in new})
    other = extra.toDF(*[f"_k_{c}" if c in keys else c for c in extra.columns])
    on = [base[k].eqNullSafe(other[f"_k_{k}"]) for k in keys]
    return base.join(other, on, "left").drop(*[f"_k_{k}" for k in keys])


def quantiles_of(df: DataFrame, columns, probs: dict[str, float], keys=()) -> DataFrame:
    """Exact quantiles of several columns at once: `<column>_<name>` per key."""
    keys = list(keys)
    pairs = F.array(*[F.struct(F.lit(c).alias("_m"), F.col(c).cast("double").alias("_x")) for c in columns])
    long = df.select(*keys, F.inline(pairs))
    stats = exact_quantiles(long, "_x", probs, [*keys, "_m"])
    picked = [
        F.max(F.when(F.col("_m") == c, F.col(p))).alias(f"{c}_{p}") for c in columns for p in probs
    ]
    return stats.groupBy(*keys).agg(*picked)


def _errors(df: DataFrame, actual: str, predicted: str, keys=()) -> DataFrame:
    y, p = F.col(actual).cast("double"), F.col(predicted).cast("double")
    rel = relative_error(y, p)
    return df.where(y.isNotNull() & p.isNotNull()).select(
        *keys,
        y.alias("_y"),
        p.alias("_p"),
        (y - p).alias("_res"),
        F.abs(p - y).alias("_abs"),
        rel.alias("_rel"),
        F.abs(rel).alias("_ape"),
        (F.abs(rel) * 100).alias("_pct"),
    )


def _fit_aggregates() -> list[Column]:
    squared = F.col("_res") * F.col("_res")
    return [
        F.count("*").alias("n"),
        F.avg("_abs").alias("mae"),
        F.sqrt(F.avg(squared)).alias("rmse"),
        (1 - F.avg(squared) / null_if_zero(F.var_pop("_y"))).alias("r2"),
    ]


def _hit_rate(tolerance_pct: float) -> Column:
    return (F.avg(F.when(F.col("_pct") <= tolerance_pct, 100.0).when(F.col("_pct").isNotNull(), 0.0))).alias(
        f"accuracy_{tolerance_pct}pct"
    )


def regression_metrics(df: DataFrame, actual: str, predicted: str, keys=()) -> DataFrame:
    """MAE, RMSE, R2, median relative error and the share within 20 %."""
    errors = _errors(df, actual, predicted, keys)
    base = errors.groupBy(*keys).agg(
        *_fit_aggregates(),
        F.avg((F.col("_ape") <= 0.20).cast("double")).alias("dentro_20pct"),
    )
    medians = exact_quantiles(errors, "_ape", {"mdape": 0.5}, keys).drop("n")
    return attach(base, medians, keys)


def price_band(price: Column) -> Column:
    label = F.lit(None).cast("string")
    for name, low, high in reversed(K.PRICE_BANDS):
        inside = (price >= low) if high is None else (price >= low) & (price < high)
        label = F.when(inside, name).otherwise(label)
    return label


def metrics_by_price_band(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """Rows, median relative error and median signed bias per fixed price band."""
    errors = _errors(df, actual, predicted).withColumn("faixa", price_band(F.col("_y")))
    errors = errors.where(F.col("faixa").isNotNull())
    sizes = errors.groupBy("faixa").agg(F.count("*").alias("n"))
    medians = quantiles_of(errors, ["_ape", "_rel"], {"m": 0.5}, ["faixa"]).select(
        "faixa", F.col("_ape_m").alias("mdape"), F.col("_rel_m").alias("vies_mediano")
    )
    return attach(sizes, medians, ["faixa"])


def metrics_by_quartile(df: DataFrame, actual: str, predicted: str, close_last: bool = False) -> DataFrame:
    """Error table per quartile of the actual value.

    Bands are left-closed, so by default the rows equal to the maximum belong to none
    (the established report); `close_last` puts them in the last band.
    """
    errors = _errors(df, actual, predicted)
    probs = {"b0": 0.0, "b1": 0.25, "b2": 0.5, "b3": 0.75, "b4": 1.0}
    # Five numbers, taken now: as a subquery, every place that names an edge would plan and run the quantiles again.
    found = exact_quantiles(errors, "_y", probs).first()
    edges = {b: F.lit(found[b] if found else None).cast("double") for b in probs}
    names = ["Q1 (0-25%)", "Q2 (25-50%)", "Q3 (50-75%)", "Q4 (75-100%)"]
    band = F.lit(None).cast("string")
    for i, name in enumerate(names):
        y, low, high = F.col("_y"), edges[f"b{i}"], edges[f"b{i + 1}"]
        top = (y <= high) if close_last and i == 3 else (y < high)
        band = F.when((y >= low) & top, name).otherwise(band)
    banded = errors.withColumn("faixa", band).where(F.col("faixa").isNotNull())
    base = banded.groupBy("faixa").agg(
        *_fit_aggregates(),
        F.avg("_pct").alias("mape"),
        F.avg("_pct").alias("mean_error_pct"),
        *[_hit_rate(t) for t in (10, 20, 30)],
    )
    base = base.withColumns(
        {
            side: F.coalesce(*[F.when(F.col("faixa") == n, edges[f"b{i + shift}"]) for i, n in enumerate(names)])
            for side, shift in (("min_valor", 0), ("max_valor", 1))
        }
    )
    return attach(base, exact_quantiles(banded, "_abs", {"medae": 0.5}, ["faixa"]).drop("n"), ["faixa"])


def hit_rate_metrics(df: DataFrame, actual: str, predicted: str, keys=()) -> DataFrame:
    """Hit rates by tolerance, MAPE, median error and percentage-error quantiles."""
    errors = _errors(df, actual, predicted, keys)
    base = errors.groupBy(*keys).agg(
        *_fit_aggregates(), F.avg("_pct").alias("mape"), *[_hit_rate(t) for t in K.HIT_TOLERANCES]
    )
    probs = {"q25": 0.25, "q50": 0.5, "q75": 0.75, "q95": 0.95, "q99": 0.99}
    stats = quantiles_of(errors, ["_abs", "_pct"], probs, keys).select(
        *keys, F.col("_abs_q50").alias("medae"), *[F.col(f"_pct_{q}").alias(f"error_pct_{q}") for q in probs]
    )
    return attach(base, stats, keys)


def bias_corrected_skewness(column: str) -> Column:
    n = F.count(column).cast("double")
    return F.when(n > 2, F.skewness(column) * F.sqrt(n * (n - 1)) / (n - 2))


def bias_corrected_kurtosis(column: str) -> Column:
    n = F.count(column).cast("double")
    return F.when(n > 3, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.kurtosis(column) + 6))


def error_distribution(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """Moments and quantiles of absolute, percentage and signed errors, one row each."""
    errors = _errors(df, actual, predicted)
    measures = {"erro_absoluto": "_abs", "erro_percentual": "_pct", "residual": "_res"}
    wide = errors.agg(
        *[
            F.struct(
                F.lit(name).alias("medida"),
                F.count(c).alias("n"),
                F.avg(c).alias("mean"),
                F.stddev_samp(c).alias("std"),
                F.max(c).alias("max"),
                bias_corrected_skewness(c).alias("skewness"),
                bias_corrected_kurtosis(c).alias("kurtosis"),
            ).alias(c)
            for name, c in measures.items()
        ]
    )
    moments = wide.select(F.inline(F.array(*measures.values())))
    probs = {"q25": 0.25, "q50": 0.5, "q75": 0.75, "q95": 0.95, "q99": 0.99}
    long = errors.select(
        F.inline(F.array(*[F.struct(F.lit(n).alias("medida"), F.col(c).alias("_x")) for n, c in measures.items()]))
    )
    return attach(moments, exact_quantiles(long, "_x", probs, ["medida"]).drop("n"), ["medida"])


def largest_errors(df: DataFrame, actual: str, predicted: str, tie_break, k: int = 10, relative: bool = False) -> DataFrame:
    """Top-k rows by absolute, or percentage, error (zero actual values excluded)."""
    y, p = F.col(actual), F.col(predicted)
    size = F.abs(relative_error(y, p)) * 100 if relative else F.abs(y - p)
    name = "erro_percentual" if relative else "erro_absoluto"
    ranked = df.withColumn(name, size).where(F.col(name).isNotNull())
    return ranked.orderBy(F.desc(name), *tie_break).limit(k)


# --- descriptions ----------------------------------------------------------
def data_dictionary(df: DataFrame, columns=None, few: int = 20, shown: int = 10) -> DataFrame:
    """Per column: type, completeness, moments, median, distinct count, examples.

    Values are counted as (column, value) pairs, so distinct counts come from one
    pre-aggregated shuffle; at most `shown` smallest values are listed for columns
    with at most `few` distinct ones.
    """
    columns = list(columns or df.columns)
    kinds = dict(df.dtypes)
    numeric = [c for c in columns if kinds[c] in ("double", "float", "int", "bigint", "smallint", "tinyint")]

    def moment(f, c):
        return f(F.col(c).cast("double")) if c in numeric else F.lit(None).cast("double")

    wide = df.agg(
        *[
            F.struct(
                F.lit(c).alias("coluna"),
                F.lit(kinds[c]).alias("tipo"),
                F.count("*").alias("linhas"),
                F.count(c).alias("nao_nulos"),
                moment(F.min, c).alias("minimo"),
                moment(F.max, c).alias("maximo"),
                moment(F.avg, c).alias("media"),
                moment(F.stddev_samp, c).alias("desvio"),
            ).alias(f"c{i}")
            for i, c in enumerate(columns)
        ]
    )
    base = wide.select(F.inline(F.array(*[f"c{i}" for i in range(len(columns))]))).withColumn(
        "pct_nao_nulos", 100.0 * F.col("nao_nulos") / null_if_zero(F.col("linhas"))
    )
    # A separate sort value keeps numbers in numeric order in the examples.
    pairs = F.array(
        *[
            F.struct(
                F.lit(c).alias("coluna"),
                F.col(c).cast("string").alias("_v"),
                (F.col(c).cast("double") if c in numeric else F.lit(None).cast("double")).alias("_s"),
            )
            for c in columns
        ]
    )
    values = df.select(F.inline(pairs)).where(F.col("_v").isNotNull()).groupBy("coluna", "_v", "_s").count()
    distinct = values.groupBy("coluna").agg(F.count("*").alias("unicos"))
    first = Window.partitionBy("coluna").orderBy("_s", "_v")
    examples = (
        values.withColumn("_rn", F.row_number().over(first))
        .where(F.col("_rn") <= shown)
        .groupBy("coluna")
        .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_rn", "_v"))), lambda s: s["_v"]), ", ").alias("_ex"))
    )
    out = attach(attach(base, distinct, ["coluna"]), examples, ["coluna"])
    if numeric:
        long = df.select(
            F.inline(F.array(*[F.struct(F.lit(c).alias("coluna"), F.col(c).cast("double").alias("_x")) for c in numeric]))
        )
        out = attach(out, exact_quantiles(long, "_x", {"mediana": 0.5}, ["coluna"]).drop("n"), ["coluna"])
    return out.withColumns(
        {
            "unicos": F.coalesce("unicos", F.lit(0)),
            "exemplos": F.when(F.coalesce("unicos", F.lit(0)) <= few, F.coalesce("_ex", F.lit(""))),
        }
    ).drop("_ex")


def share_by_category(df: DataFrame, category: str, order=()) -> DataFrame:
    """Count and percentage per category; `ordem` follows the given display order."""
    counts = df.groupBy(F.coalesce(F.col(category), F.lit("?")).alias(category)).agg(F.count("*").alias("n"))
    total = df.agg(F.count("*").alias("t")).scalar()
    out = counts.withColumn("pct", F.col("n") * 100.0 / total)
    if order:
        position = F.coalesce(*[F.when(F.col(category) == c, i + 1) for i, c in enumerate(order)])
        out = out.withColumn("ordem", position)
    return out


def distinct_counts(df: DataFrame, columns, approximate: bool = False) -> DataFrame:
    """Distinct values per column. Exact counts go through pre-aggregated
    (column, value) pairs instead of one buffer per column."""
    if approximate:
        wide = df.agg(*[F.struct(F.lit(c).alias("coluna"), F.approx_count_distinct(c).alias("unicos")).alias(c) for c in columns])
        return wide.select(F.inline(F.array(*columns)))
    pairs = F.array(*[F.struct(F.lit(c).alias("coluna"), F.col(c).cast("string").alias("_v")) for c in columns])
    long = df.select(F.inline(pairs)).where(F.col("_v").isNotNull()).distinct()
    return long.groupBy("coluna").agg(F.count("*").alias("unicos"))


def price_per_m2(df: DataFrame) -> DataFrame:
    return df.withColumn("_m2", F.col(K.TARGET) / null_if_zero(F.col("Area_m2")))


def median_price_per_m2(df: DataFrame, keys=()) -> DataFrame:
    return exact_quantiles(price_per_m2(df), "_m2", {"preco_m2_mediano": 0.5}, keys)


def price_per_m2_spread(df: DataFrame, group: str) -> DataFrame:
    """Dearest over cheapest group median."""
    return median_price_per_m2(df, [group]).agg(
        F.max("preco_m2_mediano").alias("maior"),
        F.min("preco_m2_mediano").alias("menor"),
        (F.max("preco_m2_mediano") / null_if_zero(F.min("preco_m2_mediano"))).alias("razao"),
    )


def heuristic_baselines(df: DataFrame, group: str) -> DataFrame:
    """Metrics of three rules: median price, area x R$/m2, area x group R$/m2."""
    rows = staged(df.select(K.TARGET, "Area_m2", group), "baselines")  # read for the medians, then scored
    everyone = F.lit(None).cast(rows.schema[group].dataType)
    kinds = [("preco", everyone, F.col(K.TARGET)), ("m2", everyone, F.col("_m2")), ("m2 do grupo", F.col(group), F.col("_m2"))]
    cells = F.array(*[F.struct(F.lit(k).alias("_kind"), g.alias("_g"), v.cast("double").alias("_x")) for k, g, v in kinds])
    # The three rules' medians come from one run.
    medians = exact_quantiles(price_per_m2(rows).select(F.inline(cells)), "_x", {"m": 0.5}, ["_kind", "_g"])
    medians = staged(medians.select("_kind", "_g", "m"), "medians")
    overall, overall_m2 = (medians.where(F.col("_kind") == k).select("m").scalar() for k in ("preco", "m2"))
    by_group = medians.where(F.col("_kind") == "m2 do grupo").select(F.col("_g").alias(group), F.col("m").alias("_g_m2"))
    rows = attach(rows, by_group, [group])
    rules = F.array(
        F.struct(F.lit("mediana global").alias("regra"), overall.alias("previsto")),
        F.struct(F.lit("area x m2 global").alias("regra"), (F.col("Area_m2") * overall_m2).alias("previsto")),
        F.struct(
            F.lit("area x m2 do bairro").alias("regra"),
            (F.col("Area_m2") * F.coalesce(F.col("_g_m2"), overall_m2)).alias("previsto"),
        ),
    )
    return regression_metrics(rows.select(K.TARGET, F.inline(rules)), K.TARGET, "previsto", ["regra"])


def correlation_matrix(df: DataFrame, columns) -> DataFrame:
    """Pearson, long form, every ordered pair, over the rows that have both values.

    Each task adds up one matrix of products, shifted by the columns' means; matrices are summed by
    cell and the pairs read off them, so the plan does not grow with the number of columns. A pair without
    spread or rows is missing.
    """
    import numpy as np
    import pyarrow as pa

    names = list(columns)
    rows = df.select(*[F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(names)])
    means = rows.agg(F.array(*[F.coalesce(F.avg(f"c{i}"), F.lit(0.0)) for i in range(len(names))])).first()[0]

    def products(batches):
        total = np.zeros((4, len(names), len(names)))
        for batch in batches:
            x = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns], axis=1) - means
            known = ~np.isnan(x)
            x, known = np.where(known, x, 0.0), known.astype(float)
            total += np.stack([known.T @ known, x.T @ known, (x * x).T @ known, x.T @ x])
        a, b = np.indices(total.shape[1:])
        cells = {"a": a.ravel(), "b": b.ravel(), "n": total[0].ravel(), "sa": total[1].ravel(), "sb": total[1].T.ravel(), "qa": total[2].ravel(), "qb": total[2].T.ravel(), "p": total[3].ravel()}
        yield pa.RecordBatch.from_pydict({k: np.ascontiguousarray(v) for k, v in cells.items()})

    parts = rows.mapInArrow(products, "a bigint, b bigint, n double, sa double, sb double, qa double, qb double, p double")
    sums = parts.groupBy("a", "b").agg(*[F.sum(c).alias(c) for c in ("n", "sa", "sb", "qa", "qb", "p")])
    spread = F.sqrt(F.expr("(n * qa - sa * sa) * (n * qb - sb * sb)"))
    label = F.array(*[F.lit(c) for c in names])
    return sums.select(
        F.element_at(label, F.col("a").cast("int") + 1).alias("coluna_a"), F.element_at(label, F.col("b").cast("int") + 1).alias("coluna_b"),
        (F.expr("n * p - sa * sb") / F.when(spread > 0, spread)).alias("r"),
    )


def within_group_rank_correlation(df: DataFrame, value: str, group: str, features, minimum: int = 10) -> DataFrame:
    """Spearman correlation of the within-group residual with each feature, over
    groups with enough rows."""
    means = df.where(F.col(value).isNotNull()).groupBy(group).agg(F.avg(value).alias("_mean"), F.count(value).alias("_n"))
    means = means.where(F.col("_n") >= minimum).select(F.col(group).alias("_g"), "_mean")
    residual = (F.col(value) - F.col("_mean")).alias("_res")
    rows = staged(df.join(means, df[group] == means["_g"]).select(residual, *features), "residuals")
    out = None
    for f in features:  # plan-time list of columns
        one = rows.select("_res", F.col(f).cast("double").alias("_f")).dropna()
        ranked = with_average_rank(with_average_rank(one, "_res", "_ra"), "_f", "_rb")
        r = ranked.agg(F.lit(f).alias("atributo"), F.count("*").alias("n"), F.corr("_ra", "_rb").alias("spearman"))
        out = r if out is None else out.unionByName(r)
    return out


def variance_decomposition(df: DataFrame, value: str, group: str) -> DataFrame:
    """Population variance of a value split into between and within groups."""
    per_group = df.where(F.col(value).isNotNull()).groupBy(group).agg(
        F.count(value).alias("_n"), F.avg(value).alias("_m"), F.var_pop(value).alias("_v")
    )
    # Var(all) = E[var in group] + Var(group means), weighted by group size; the
    # mean is taken out first so that large means do not cancel.
    grand = per_group.agg((F.sum(F.col("_n") * F.col("_m")) / F.sum("_n")).alias("g")).scalar()
    gap = F.col("_m") - grand
    return per_group.agg(
        (F.sum(F.col("_n") * gap * gap) / F.sum("_n")).alias("entre"),
        (F.sum(F.col("_n") * F.col("_v")) / F.sum("_n")).alias("dentro"),
    ).select(
        (F.col("entre") + F.col("dentro")).alias("total"),
        "entre",
        "dentro",
        (F.col("entre") / null_if_zero(F.col("entre") + F.col("dentro"))).alias("fracao_entre"),
    )


# --- leaderboards ----------------------------------------------------------
def _scaled(column: str, bounds: Column, lower_is_better: bool, degenerate) -> Column:
    low, high = bounds[f"{column}_lo"], bounds[f"{column}_hi"]
    share = (F.col(column) - low) / F.when(high > low, high - low)
    share = 1 - share if lower_is_better else share
    return F.coalesce(share, F.lit(degenerate)) if degenerate is not None else share


def _bounds(board: DataFrame, columns) -> Column:
    return board.agg(
        F.struct(
            *[f(c).alias(f"{c}_{s}") for c in columns for f, s in ((F.min, "lo"), (F.max, "hi"))]
        ).alias("b")
    ).scalar()


def combined_score(board: DataFrame, rmse: str = "rmse", r2: str = "r2") -> DataFrame:
    """0.6 x scaled RMSE + 0.4 x scaled R2 among rows with both; equal values score 1."""
    valid = staged(board.where(F.col(rmse).isNotNull() & F.col(r2).isNotNull()), "board")
    bounds = _bounds(valid, [rmse, r2])
    return valid.withColumns(
        {
            "rmse_score": _scaled(rmse, bounds, True, 1.0),
            "r2_score": _scaled(r2, bounds, False, 1.0),
        }
    ).withColumn("combined_score", 0.6 * F.col("rmse_score") + 0.4 * F.col("r2_score"))


def select_best(board: DataFrame, name: str, rmse: str = "rmse", r2: str = "r2") -> DataFrame:
    return combined_score(board, rmse, r2).orderBy(F.desc("combined_score"), name).limit(1)


def composite_rank(board: DataFrame, smaller=("rmse", "mae", "mape"), larger=("r2", "accuracy_10pct", "accuracy_20pct")) -> DataFrame:
    """Mean of the scaled metrics; a metric equal everywhere has no score and is
    left out of the mean."""
    board = staged(board, "board")  # read for its bounds and for its rows
    bounds = _bounds(board, [*smaller, *larger])
    scores = {f"{c}_score": _scaled(c, bounds, True, None) for c in smaller}
    scores |= {f"{c}_score": _scaled(c, bounds, False, None) for c in larger}
    present = sum((F.col(s).isNotNull().cast("int") for s in scores), F.lit(0))
    total = sum((F.coalesce(F.col(s), F.lit(0.0)) for s in scores), F.lit(0.0))
    return board.withColumns(scores).withColumn("score_composto", total / null_if_zero(present))


def best_per_metric(board: DataFrame, name: str, smaller=("rmse", "mae", "mape"), larger=("r2", "accuracy_10pct", "accuracy_20pct")) -> DataFrame:
    """Winning row of each metric; ties go to the first name."""
    picks = []
    for columns, label in ((smaller, "menor"), (larger, "maior")):
        for c in columns:
            goal = F.col(c) if label == "menor" else -F.col(c)
            first = F.min(F.when(F.col(c).isNotNull(), F.struct(goal.alias("g"), F.col(name).alias("w"), F.col(c).alias("v"))))
            picks.append((c, label, first))
    wide = board.agg(*[p.alias(f"p{i}") for i, (_, _, p) in enumerate(picks)])
    return wide.select(
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(c).alias("metrica"),
                        F.col(f"p{i}.w").alias("modelo"),
                        F.col(f"p{i}.v").alias("valor"),
                        F.lit(label).alias("criterio"),
                    )
                    for i, (c, label, _) in enumerate(picks)
                ]
            )
        )
    )


def ranked_board(board: DataFrame, metric: str, name: str) -> DataFrame:
    """Leaderboard with its position. A board has one row per fitted model, so its
    order in one task is bounded by the number of models."""
    return board.withColumn("posicao", F.row_number().over(Window.orderBy(metric, name)))
