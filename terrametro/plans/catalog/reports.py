"""Metrics, distributions, dictionaries and leaderboards."""

from pyspark.sql import functions as F

from ... import constants as K
from ...operators import metrics as M
from ...sources.staging import staged
from ...operators.quantiles import exact_quantiles
from ..bindings import LISTINGS_SQL, PREDICTED_SQL, UNIQUE_SQL, listings, pois, POIS_SQL, predicted, table
from ..registry import query, r, rounded, shared
from .cleaning import PREPARED_SQL, prepared, unique


def unique_staged(spark, sf):
    """Reports read the deduplicated listings several times."""
    columns = [K.URL, K.TARGET, "Area_m2", "Quartos", "Banheiros", "Vagas_Garagem", "Latitude", "Longitude", "Bairro", "Tipo_Imovel"]
    return shared(spark, sf, "unique", lambda: staged(unique(spark, sf).select(*columns), "unique"))


def scored(spark, sf):
    return predicted(unique_staged(spark, sf))


# e: one row per scored listing with its errors
_ERR = f"""e AS (SELECT *, Valor_Anuncio AS y, Valor_Anuncio - previsto AS res, abs(Valor_Anuncio - previsto) AS ae,
 (previsto - Valor_Anuncio) / nullif(Valor_Anuncio, 0) AS re, abs((previsto - Valor_Anuncio) / nullif(Valor_Anuncio, 0)) * 100 AS pe
 FROM ({PREDICTED_SQL}))"""
_FIT = f"""count(*) AS n, {r('avg(ae)', 'mae')}, {r('sqrt(avg(res * res))', 'rmse')}, {r('1 - avg(res * res) / nullif(var_pop(y), 0)', 'r2')}"""


def _hit(t):
    return r(f"avg(CASE WHEN pe <= {t} THEN 100.0 WHEN pe IS NOT NULL THEN 0.0 END)", f"accuracy_{t}pct")


@query("regression_metrics", "A7",
       f"WITH {_ERR} SELECT {_FIT}, {r('avg(CASE WHEN pe <= 20 THEN 1.0 ELSE 0.0 END)', 'dentro_20pct')}, {r('quantile_cont(pe / 100, 0.5)', 'mdape')} FROM e")
def _(spark, sf):
    return rounded(M.regression_metrics(scored(spark, sf), K.TARGET, "previsto"))


@query("regression_metrics_by_neighbourhood", "A7 A23",
       f"WITH {_ERR} SELECT Bairro, {_FIT}, {r('avg(CASE WHEN pe <= 20 THEN 1.0 ELSE 0.0 END)', 'dentro_20pct')}, {r('quantile_cont(pe / 100, 0.5)', 'mdape')} FROM e GROUP BY 1")
def _(spark, sf):
    return rounded(M.regression_metrics(scored(spark, sf), K.TARGET, "previsto", ["Bairro"]))


_BANDS = "CASE " + " ".join(
    f"WHEN y >= {lo}" + (f" AND y < {hi}" if hi is not None else "") + f" THEN '{n}'" for n, lo, hi in K.PRICE_BANDS) + " END"


@query("metrics_by_price_band", "A8",
       f"WITH {_ERR} SELECT {_BANDS} AS faixa, count(*) AS n, {r('quantile_cont(abs(re), 0.5)', 'mdape')}, {r('quantile_cont(re, 0.5)', 'vies_mediano')} FROM e GROUP BY 1")
def _(spark, sf):
    return rounded(M.metrics_by_price_band(scored(spark, sf), K.TARGET, "previsto"))


def _quartile_sql(close):
    names = ["Q1 (0-25%)", "Q2 (25-50%)", "Q3 (50-75%)", "Q4 (75-100%)"]
    arms = " ".join(
        f"WHEN y >= b[{i + 1}] AND y {'<=' if close and i == 3 else '<'} b[{i + 2}] THEN '{n}'" for i, n in enumerate(names))
    lo = "CASE faixa " + " ".join(f"WHEN '{n}' THEN any_value(b[{i + 1}])" for i, n in enumerate(names)) + " END"
    hi = "CASE faixa " + " ".join(f"WHEN '{n}' THEN any_value(b[{i + 2}])" for i, n in enumerate(names)) + " END"
    return f"""WITH {_ERR}, q AS (SELECT quantile_cont(y, [0, 0.25, 0.5, 0.75, 1]) AS b FROM e),
    f AS (SELECT *, CASE {arms} END AS faixa FROM e, q)
    SELECT faixa, {_FIT}, {r('avg(pe)', 'mape')}, {r('avg(pe)', 'mean_error_pct')}, {_hit(10)}, {_hit(20)}, {_hit(30)},
    {r(lo, 'min_valor')}, {r(hi, 'max_valor')}, {r('quantile_cont(ae, 0.5)', 'medae')} FROM f WHERE faixa IS NOT NULL GROUP BY faixa"""


@query("metrics_by_quartile", "A9", _quartile_sql(False))
def _(spark, sf):
    return rounded(M.metrics_by_quartile(scored(spark, sf), K.TARGET, "previsto"))


@query("metrics_by_quartile_closed", "A9", _quartile_sql(True))
def _(spark, sf):
    return rounded(M.metrics_by_quartile(scored(spark, sf), K.TARGET, "previsto", close_last=True))


@query("hit_rate_metrics", "A10",
       f"""WITH {_ERR} SELECT {_FIT}, {r('avg(pe)', 'mape')}, {', '.join(_hit(t) for t in K.HIT_TOLERANCES)}, {r('quantile_cont(ae, 0.5)', 'medae')},
       {', '.join(r(f'quantile_cont(pe, {p / 100})', f'error_pct_q{p}') for p in (25, 50, 75, 95, 99))} FROM e""")
def _(spark, sf):
    return rounded(M.hit_rate_metrics(scored(spark, sf), K.TARGET, "previsto"))


@query("error_distribution", "A11",
       f"WITH {_ERR} " + " UNION ALL ".join(
           f"""SELECT '{name}' AS medida, count({c}) AS n, {r(f'avg({c})', 'mean')}, {r(f'stddev_samp({c})', 'std')}, {r(f'max({c})', 'max')},
           {r(f'skewness({c})', 'skewness')}, {r(f'kurtosis({c})', 'kurtosis')},
           {', '.join(r(f'quantile_cont({c}, {p / 100})', f'q{p}') for p in (25, 50, 75, 95, 99))} FROM e"""
           for name, c in (("erro_absoluto", "ae"), ("erro_percentual", "pe"), ("residual", "res"))))
def _(spark, sf):
    return rounded(M.error_distribution(scored(spark, sf), K.TARGET, "previsto"))


@query("largest_absolute_errors", "K3",
       f"WITH {_ERR} SELECT URL_Anuncio, {r('ae', 'erro_absoluto', 2)} FROM e ORDER BY ae DESC, URL_Anuncio LIMIT 10")
def _(spark, sf):
    return rounded(M.largest_errors(scored(spark, sf), K.TARGET, "previsto", [K.URL]).select(K.URL, "erro_absoluto"), 2)


@query("largest_percentage_errors", "K3",
       f"WITH {_ERR} SELECT URL_Anuncio, {r('pe', 'erro_percentual')} FROM e WHERE pe IS NOT NULL ORDER BY pe DESC, URL_Anuncio LIMIT 10")
def _(spark, sf):
    return rounded(M.largest_errors(scored(spark, sf), K.TARGET, "previsto", [K.URL], relative=True).select(K.URL, "erro_percentual"))


@query("interpolated_price_quantiles", "A4",
       f"SELECT count(Valor_Anuncio) AS n, {', '.join(r(f'quantile_cont(Valor_Anuncio, {p / 100})', f'q{p}') for p in (25, 50, 75, 95, 99))} FROM ({LISTINGS_SQL})")
def _(spark, sf):
    return rounded(exact_quantiles(listings(spark, sf), K.TARGET, {f"q{p}": p / 100 for p in (25, 50, 75, 95, 99)}))


@query("area_quantiles_by_neighbourhood", "A4",
       f"SELECT Bairro, count(Area_m2) AS n, {', '.join(r(f'quantile_cont(Area_m2, {p / 100})', f'q{p}') for p in (25, 50, 75, 95, 99))} FROM ({LISTINGS_SQL}) GROUP BY 1")
def _(spark, sf):
    return rounded(exact_quantiles(listings(spark, sf), "Area_m2", {f"q{p}": p / 100 for p in (25, 50, 75, 95, 99)}, ["Bairro"]))


_DICT = ["Valor_Anuncio", "Area_m2", "Quartos", "Banheiros", "Vagas_Garagem", "Latitude", "Bairro", "Tipo_Imovel"]
_KINDS = dict(zip(_DICT, ["double", "double", "int", "int", "int", "double", "string", "string"]))


def _dict_sql():
    parts = []
    for c in _DICT:
        num = _KINDS[c] != "string"
        m = (lambda f: r(f"{f}(CAST({c} AS DOUBLE))", "v").rsplit(" AS ", 1)[0]) if num else (lambda f: "CAST(NULL AS DOUBLE)")
        med = f"round(quantile_cont(CAST({c} AS DOUBLE), 0.5), 4)" if num else "CAST(NULL AS DOUBLE)"
        parts.append(
            f"SELECT '{c}' AS coluna, '{_KINDS[c]}' AS tipo, count(*) AS linhas, count({c}) AS nao_nulos, {m('min')} AS minimo, {m('max')} AS maximo, "
            f"{m('avg')} AS media, {m('stddev_samp')} AS desvio, round(100.0::DOUBLE * count({c}) / count(*), 4) AS pct_nao_nulos, "
            f"count(DISTINCT {c}) AS unicos, {med} AS mediana, CASE WHEN count(DISTINCT {c}) <= 20 THEN "
            f"array_to_string(list_slice(list_sort(list(DISTINCT {c}) FILTER ({c} IS NOT NULL)), 1, 10), ', ') END AS exemplos FROM u")
    return f"WITH u AS ({UNIQUE_SQL}) " + " UNION ALL ".join(parts)


@query("data_dictionary", "A12 A14", _dict_sql())
def _(spark, sf):
    return rounded(M.data_dictionary(unique_staged(spark, sf), _DICT))


@query("share_by_category", "A13",
       f"SELECT coalesce(Tipo_Imovel, '?') AS Tipo_Imovel, count(*) AS n, {r('count(*) * 100.0 / sum(count(*)) OVER ()', 'pct')}, "
       "CASE Tipo_Imovel WHEN 'Apartamento' THEN 1 WHEN 'Casa' THEN 2 WHEN 'Flat' THEN 3 END AS ordem "
       f"FROM ({LISTINGS_SQL}) GROUP BY Tipo_Imovel")
def _(spark, sf):
    return rounded(M.share_by_category(listings(spark, sf), "Tipo_Imovel", K.RESIDENTIAL_TYPES))


@query("pois_per_category", "A13", f"SELECT categoria, count(*) AS n, {r('count(*) * 100.0 / sum(count(*)) OVER ()', 'pct')} FROM ({POIS_SQL}) GROUP BY 1")
def _(spark, sf):
    return rounded(M.share_by_category(pois(spark, sf), "categoria"))


@query("distinct_counts", "A14",
       " UNION ALL ".join(f"SELECT '{c}' AS coluna, count(DISTINCT {c}) AS unicos FROM lineitem" for c in ("l_partkey", "l_suppkey", "l_extendedprice")))
def _(spark, sf):
    return M.distinct_counts(table(spark, sf, "lineitem"), ["l_partkey", "l_suppkey", "l_extendedprice"])


@query("price_per_m2_by_neighbourhood", "A16",
       f"SELECT Bairro, count(Valor_Anuncio / nullif(Area_m2, 0)) AS n, {r('quantile_cont(Valor_Anuncio / nullif(Area_m2, 0), 0.5)', 'preco_m2_mediano')} FROM ({LISTINGS_SQL}) GROUP BY 1")
def _(spark, sf):
    return rounded(M.median_price_per_m2(listings(spark, sf), ["Bairro"]))


@query("price_per_m2_spread", "A16",
       f"""WITH m AS (SELECT Bairro, quantile_cont(Valor_Anuncio / nullif(Area_m2, 0), 0.5) AS v FROM ({LISTINGS_SQL}) GROUP BY 1)
       SELECT {r('max(v)', 'maior')}, {r('min(v)', 'menor')}, {r('max(v) / min(v)', 'razao')} FROM m""")
def _(spark, sf):
    return rounded(M.price_per_m2_spread(listings(spark, sf), "Bairro"))


def _baseline_sql(head, source):
    fit = f"count(*) AS n, {r('avg(abs(y - p))', 'mae')}, {r('sqrt(avg((y - p) * (y - p)))', 'rmse')}, {r('1 - avg((y - p) * (y - p)) / var_pop(y)', 'r2')}, " \
          f"{r('avg(CASE WHEN abs(p - y) / y <= 0.2 THEN 1.0 ELSE 0.0 END)', 'dentro_20pct')}, {r('quantile_cont(abs(p - y) / y, 0.5)', 'mdape')}"
    return f"""{head} vs AS (SELECT Valor_Anuncio AS y, Area_m2, Bairro, Valor_Anuncio / nullif(Area_m2, 0) AS m2 FROM {source}),
    vg AS (SELECT quantile_cont(y, 0.5) AS m, quantile_cont(m2, 0.5) AS m2 FROM vs), vb AS (SELECT Bairro AS k, quantile_cont(m2, 0.5) AS bm FROM vs GROUP BY 1),
    vt AS (SELECT 'mediana global' AS regra, y, vg.m AS p FROM vs, vg UNION ALL SELECT 'area x m2 global', y, Area_m2 * vg.m2 FROM vs, vg
      UNION ALL SELECT 'area x m2 do bairro', y, Area_m2 * coalesce(bm, vg.m2) FROM vs LEFT JOIN vb ON vs.Bairro IS NOT DISTINCT FROM vb.k, vg)
    SELECT regra, {fit} FROM vt WHERE p IS NOT NULL GROUP BY regra"""


@query("heuristic_baselines", "A17", _baseline_sql(f"WITH u AS ({UNIQUE_SQL}),", "u"))
def _(spark, sf):
    return rounded(M.heuristic_baselines(unique_staged(spark, sf), "Bairro"))


@query("heuristic_baselines_on_training_set", "A17 F1 F3 W1 A1", _baseline_sql(PREPARED_SQL.rstrip() + ",", "p"))
def _(spark, sf):
    return rounded(M.heuristic_baselines(staged(prepared(spark, sf)), "Bairro"))


_CORR = ["Valor_Anuncio", "Area_m2", "Quartos", "Banheiros"]


@query("correlation_matrix", "A18",
       f"WITH l AS ({LISTINGS_SQL}) " + " UNION ALL ".join(
           f"SELECT '{a}' AS coluna_a, '{b}' AS coluna_b, {r(f'corr({a}, {b})', 'r')} FROM l" for a in _CORR for b in _CORR))
def _(spark, sf):
    return rounded(M.correlation_matrix(listings(spark, sf), _CORR))


_FEATURES = ["Area_m2", "Latitude", "Quartos"]


@query("within_group_rank_correlation", "A19",
       f"""WITH u AS (SELECT *, ln(Valor_Anuncio / nullif(Area_m2, 0)) AS v FROM ({UNIQUE_SQL})),
       g AS (SELECT Bairro AS k, avg(v) AS m FROM u WHERE v IS NOT NULL GROUP BY 1 HAVING count(v) >= 10),
       s AS (SELECT u.*, v - m AS res FROM u JOIN g ON u.Bairro = g.k WHERE v IS NOT NULL) """ + " UNION ALL ".join(
           f"""SELECT '{f}' AS atributo, count(*) AS n, {r('corr(ra, rb)', 'spearman')} FROM (SELECT
           rank() OVER (ORDER BY res) + (count(*) OVER (PARTITION BY res) - 1) / 2.0 AS ra,
           rank() OVER (ORDER BY {f}) + (count(*) OVER (PARTITION BY {f}) - 1) / 2.0 AS rb FROM s WHERE {f} IS NOT NULL)""" for f in _FEATURES))
def _(spark, sf):
    area = F.col("Area_m2")
    rows = unique_staged(spark, sf).withColumn("v", F.ln(F.col(K.TARGET) / F.when(area != 0, area)))
    return rounded(M.within_group_rank_correlation(rows, "v", "Bairro", _FEATURES))


@query("variance_decomposition", "A20",
       f"""WITH u AS (SELECT Bairro, ln(Valor_Anuncio / nullif(Area_m2, 0)) AS v FROM ({UNIQUE_SQL})),
       g AS (SELECT count(v) AS n, avg(v) AS m, var_pop(v) AS w FROM u WHERE v IS NOT NULL GROUP BY Bairro),
       t AS (SELECT var_pop(v) AS total FROM u), d AS (SELECT sum(n * w) / sum(n) AS dentro FROM g)
       SELECT {r('total', 'total')}, {r('total - dentro', 'entre')}, {r('dentro', 'dentro')}, {r('(total - dentro) / total', 'fracao_entre')} FROM t, d""")
def _(spark, sf):
    area = F.col("Area_m2")
    rows = unique_staged(spark, sf).withColumn("v", F.ln(F.col(K.TARGET) / F.when(area != 0, area)))
    return rounded(M.variance_decomposition(rows, "v", "Bairro"))


# A leaderboard: one "model" per property type and neighbourhood.
_BOARD_SQL = f"""SELECT concat(Tipo_Imovel, '/', coalesce(Bairro, '?')) AS modelo, Tipo_Imovel AS tipo,
 sqrt(avg(res * res)) AS rmse, avg(ae) AS mae, 1 - avg(res * res) / nullif(var_pop(y), 0) AS r2, avg(pe) AS mape,
 avg(CASE WHEN pe <= 10 THEN 100.0 ELSE 0.0 END) AS accuracy_10pct, avg(CASE WHEN pe <= 20 THEN 100.0 ELSE 0.0 END) AS accuracy_20pct
 FROM e GROUP BY Tipo_Imovel, Bairro"""


def board(spark, sf):
    out = M.hit_rate_metrics(scored(spark, sf), K.TARGET, "previsto", ["Tipo_Imovel", "Bairro"])
    return out.select(
        F.concat("Tipo_Imovel", F.lit("/"), F.coalesce("Bairro", F.lit("?"))).alias("modelo"), F.col("Tipo_Imovel").alias("tipo"),
        "rmse", "mae", "r2", "mape", "accuracy_10pct", "accuracy_20pct",
    )


_SMALL, _LARGE = ["rmse", "mae", "mape"], ["r2", "accuracy_10pct", "accuracy_20pct"]


def _score(c, lower):
    s = f"({c} - min({c}) OVER ()) / nullif(max({c}) OVER () - min({c}) OVER (), 0)"
    return f"1 - {s}" if lower else s


@query("combined_model_score", "A21",
       f"""WITH {_ERR}, b AS ({_BOARD_SQL}) SELECT modelo, {r(f'coalesce({_score("rmse", True)}, 1)', 'rmse_score')}, {r(f'coalesce({_score("r2", False)}, 1)', 'r2_score')},
       {r(f'0.6 * coalesce({_score("rmse", True)}, 1) + 0.4 * coalesce({_score("r2", False)}, 1)', 'combined_score')} FROM b WHERE r2 IS NOT NULL""")
def _(spark, sf):
    return rounded(M.combined_score(board(spark, sf)).select("modelo", "rmse_score", "r2_score", "combined_score"))


@query("select_best_model", "A21",
       f"""WITH {_ERR}, b AS ({_BOARD_SQL}), c AS (SELECT modelo, 0.6 * coalesce({_score("rmse", True)}, 1) + 0.4 * coalesce({_score("r2", False)}, 1) AS s FROM b WHERE r2 IS NOT NULL)
       SELECT modelo, {r('s', 'combined_score')} FROM c ORDER BY s DESC, modelo LIMIT 1""")
def _(spark, sf):
    return rounded(M.select_best(board(spark, sf), "modelo").select("modelo", "combined_score"))


@query("composite_model_rank", "A21 K1",
       f"""WITH {_ERR}, b AS ({_BOARD_SQL}), c AS (SELECT modelo, {', '.join(f'{_score(m, m in _SMALL)} AS {m}_score' for m in _SMALL + _LARGE)} FROM b)
       SELECT modelo, {', '.join(r(f'{m}_score', f'{m}_score') for m in _SMALL + _LARGE)},
       {r('list_avg([' + ', '.join(f'{m}_score' for m in _SMALL + _LARGE) + '])', 'score_composto')} FROM c""")
def _(spark, sf):
    out = M.composite_rank(board(spark, sf))
    return rounded(out.select("modelo", *[f"{m}_score" for m in _SMALL + _LARGE], "score_composto"))


@query("best_model_per_metric", "A22",
       f"WITH {_ERR}, b AS ({_BOARD_SQL}) " + " UNION ALL ".join(
           f"(SELECT '{m}' AS metrica, modelo, {r(m, 'valor')}, '{'menor' if m in _SMALL else 'maior'}' AS criterio FROM b WHERE {m} IS NOT NULL "
           f"ORDER BY {m} {'' if m in _SMALL else 'DESC'}, modelo LIMIT 1)" for m in _SMALL + _LARGE))
def _(spark, sf):
    return rounded(M.best_per_metric(board(spark, sf), "modelo"))


@query("mean_metric_by_kind", "A23", f"WITH {_ERR}, b AS ({_BOARD_SQL}) SELECT tipo, {r('avg(rmse)', 'rmse')} FROM b GROUP BY 1")
def _(spark, sf):
    return rounded(board(spark, sf).groupBy("tipo").agg(F.avg("rmse").alias("rmse")))


@query("ranked_leaderboard", "W4 K1",
       f"WITH {_ERR}, b AS ({_BOARD_SQL}) SELECT modelo, {r('rmse', 'rmse')}, CAST(row_number() OVER (ORDER BY rmse, modelo) AS INT) AS posicao FROM b")
def _(spark, sf):
    return rounded(M.ranked_board(board(spark, sf), "rmse", "modelo").select("modelo", "rmse", "posicao"))
