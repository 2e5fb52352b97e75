"""Encoding, scaling, profiles, feature assembly, labels and node-table scoring."""

from pyspark.sql import functions as F

from ... import constants as K
from ...operators import features as X, scoring as P
from ...sources.staging import staged
from ..bindings import LISTINGS_BARE_SQL, LISTINGS_SQL, UNIQUE_SQL, listings, table
from ..registry import query, r, rounded
from .cleaning import REQUESTS_SQL, requests
from .reports import unique_staged

CONTEXT = ["Vagas_Garagem", "Latitude", "Longitude"]
MODEL = ["Area_m2", "Quartos", "Banheiros", "densidade_comodos", *CONTEXT, "ausente"]


@query("one_hot_levels", "M1", f"SELECT DISTINCT Tipo_Imovel, Tipo_Imovel = (SELECT min(Tipo_Imovel) FROM ({LISTINGS_SQL})) AS omitido FROM ({LISTINGS_SQL})")
def _(spark, sf):
    return X.category_levels(listings(spark, sf), "Tipo_Imovel")


@query("one_hot_long_form", "M1",
       f"SELECT URL_Anuncio, concat('Bairro_', Bairro) AS coluna, 1 AS valor FROM ({LISTINGS_SQL}) WHERE Bairro > (SELECT min(Bairro) FROM ({LISTINGS_SQL}))")
def _(spark, sf):
    return X.dummies_long(listings(spark, sf), K.URL, "Bairro")


@query("one_hot_vectors", "M1",
       f"""WITH l AS (SELECT URL_Anuncio, Tipo_Imovel FROM ({LISTINGS_SQL})), v AS (SELECT Tipo_Imovel, row_number() OVER (ORDER BY Tipo_Imovel DESC) - 1 AS i,
       count(*) OVER () AS n FROM (SELECT DISTINCT Tipo_Imovel FROM l))
       SELECT URL_Anuncio, CAST(CASE WHEN i = n - 1 THEN -1 ELSE i END AS INT) AS posicao FROM l JOIN v USING (Tipo_Imovel)""")
def _(spark, sf):
    from pyspark.ml.functions import vector_to_array

    rows = listings(spark, sf).select(K.URL, "Tipo_Imovel")
    encoded = X.fit_features(rows, [], ["Tipo_Imovel"]).transform(rows)
    at = F.array_position(vector_to_array("features"), 1.0).cast("int") - 1
    return encoded.select(K.URL, at.alias("posicao"))


_DUMMIES = {"Bairro_A": "peca % 3 = 1", "Bairro_B": "peca % 3 = 2", "Bairro_C": "peca % 9 = 3"}


@query("category_from_dummies", "M2",
       f"SELECT URL_Anuncio, CASE WHEN peca % 3 = 2 THEN 'B' WHEN peca % 9 = 3 THEN 'C' ELSE 'A' END AS bairro FROM ({LISTINGS_BARE_SQL})")
def _(spark, sf):
    rows = listings(spark, sf, False).select(K.URL, *[F.expr(e).cast("int").alias(n) for n, e in _DUMMIES.items()])
    return X.from_dummies(rows, list(_DUMMIES), "Bairro_", "bairro")


@query("label_encoding", "M3 C28",
       f"""WITH l AS ({LISTINGS_SQL}), v AS (SELECT Bairro, row_number() OVER (ORDER BY Bairro) - 1 AS c FROM (SELECT DISTINCT Bairro FROM l WHERE Bairro IS NOT NULL AND linha = 'F' AND Bairro <> 'Centro'))
       SELECT URL_Anuncio, CAST(coalesce(c, 0) AS INT) AS Bairro_encoded FROM l LEFT JOIN v USING (Bairro)""")
def _(spark, sf):
    rows = listings(spark, sf)
    labels = X.label_table(rows.where("linha = 'F' AND Bairro <> 'Centro'"), "Bairro")
    return X.encode_labels(rows.select(K.URL, "Bairro"), labels, "Bairro").drop("Bairro")


_SCALE = ["Area_m2", "Quartos", "Banheiros"]


@query("scaler_statistics", "M4",
       f"WITH l AS (SELECT *, 1 AS fixa FROM ({LISTINGS_BARE_SQL})) " + " UNION ALL ".join(
           f"SELECT '{c}' AS coluna, {r(f'avg({c})', 'media')}, {r(f'coalesce(nullif(stddev_pop({c}), 0), 1)', 'escala')} FROM l" for c in [*_SCALE, "fixa"]))
def _(spark, sf):
    return rounded(X.scaler_table(listings(spark, sf, False).withColumn("fixa", F.lit(1)), [*_SCALE, "fixa"]))


@query("standardised_features", "M4",
       f"WITH l AS ({LISTINGS_BARE_SQL}), t AS (SELECT * FROM l WHERE linha = 'F') SELECT URL_Anuncio, " + ", ".join(
           r(f"({c} - (SELECT avg({c}) FROM t)) / (SELECT stddev_pop({c}) FROM t)", c, 5) for c in _SCALE) + " FROM l")
def _(spark, sf):
    rows = listings(spark, sf, False)
    out = X.standardise(rows.select(K.URL, *_SCALE), _SCALE, rows.where("linha = 'F'"))
    return rounded(out, 5)


_KEY = ["Area_m2", "Quartos", "Banheiros"]


@query("property_groups", "W3",
       f"SELECT Area_m2, Quartos, Banheiros, count(*) AS n, count(*) AS n_grupo FROM ({LISTINGS_BARE_SQL}) GROUP BY 1, 2, 3")
def _(spark, sf):
    rows = X.property_group(listings(spark, sf, False), _KEY)
    sizes = rows.groupBy("imovel", *_KEY).agg(F.count("*").alias("n"))
    total = rows.groupBy("imovel").agg(F.count("*").alias("n_grupo"))
    return sizes.join(total, "imovel").drop("imovel")


def _uniform_sql(key, salt):
    return f"CAST(('0x' || substr(md5('{salt}' || {key}), 1, 8)) AS BIGINT) / 4294967296.0::DOUBLE"


@query("group_split", "M5", f"SELECT URL_Anuncio, {_uniform_sql('CAST(peca AS VARCHAR)', 'split:42:')} < 0.2 AS teste FROM ({LISTINGS_BARE_SQL})")
def _(spark, sf):
    return X.group_split(listings(spark, sf, False), "peca").select(K.URL, "teste")


@query("cross_validation_folds", "M6",
       f"SELECT URL_Anuncio, CAST(floor({_uniform_sql('URL_Anuncio', 'fold:42:')} * 5) AS INT) AS dobra FROM ({LISTINGS_BARE_SQL})")
def _(spark, sf):
    return X.assign_fold(listings(spark, sf, False), K.URL).select(K.URL, "dobra")


@query("nested_training_samples", "M12",
       " UNION ALL ".join(f"SELECT {s} AS fracao, count(*) AS n FROM ({LISTINGS_BARE_SQL}) WHERE {_uniform_sql('URL_Anuncio', 'draw:0:')} < {s}::DOUBLE" for s in ("0.25", "0.5")).replace("0.25 AS", "0.25::DOUBLE AS").replace("0.5 AS", "0.5::DOUBLE AS"))
def _(spark, sf):
    rows = listings(spark, sf, False)
    parts = [X.nested_sample(rows, K.URL, s).agg(F.lit(s).alias("fracao"), F.count("*").alias("n")) for s in (0.25, 0.5)]
    return parts[0].unionByName(parts[1])


@query("feature_defaults", "A5",
       f"WITH u AS ({UNIQUE_SQL}) " + " UNION ALL ".join(f"SELECT '{c}' AS atributo, {r(f'quantile_cont(CAST({c} AS DOUBLE), 0.5)', 'mediana', 6)} FROM u" for c in ["Area_m2", *CONTEXT]))
def _(spark, sf):
    return rounded(X.feature_defaults(unique_staged(spark, sf), ["Area_m2", *CONTEXT]), 6)


_PROFILE_SQL = f"WITH u AS ({UNIQUE_SQL}), k AS (SELECT Bairro FROM u WHERE Bairro IS NOT NULL GROUP BY 1 HAVING count(*) >= 1500) " + " UNION ALL ".join(
    f"SELECT Bairro, '{c}' AS atributo, {r(f'quantile_cont(CAST({c} AS DOUBLE), 0.5)', 'mediana', 6)} FROM u WHERE Bairro IN (SELECT Bairro FROM k) GROUP BY 1" for c in CONTEXT)


def _profiles(spark, sf, minimum=1500):
    return X.neighbourhood_profiles(unique_staged(spark, sf), CONTEXT, minimum=minimum)


@query("neighbourhood_profiles", "A6",
       _PROFILE_SQL.replace(">= 1500", ">= (SELECT count(*) / 26 FROM u)").replace("count(*) / 26", "floor(count(*) / 26)"))
def _(spark, sf):
    rows = unique_staged(spark, sf)
    return rounded(X.neighbourhood_profiles(rows, CONTEXT, minimum=rows.agg(F.floor(F.count("*") / 26).alias("m")).scalar()), 6)


@query("normalise_requests", "C27",
       f"""SELECT l_orderkey, CASE WHEN l_partkey % 4 = 0 THEN 0 ELSE l_quantity END AS area, CASE WHEN l_partkey % 5 = 0 THEN 0 ELSE l_linenumber END AS quartos,
       0 AS banheiros, CASE WHEN l_partkey % 3 = 0 THEN 'apartamento' ELSE 'casa' END AS tipo, 'Morada do Sol' AS bairro, 'Teresina' AS cidade FROM lineitem""")
def _(spark, sf):
    rows = table(spark, sf, "lineitem").selectExpr(
        "l_orderkey", "CASE WHEN l_partkey % 4 = 0 THEN 'abc' ELSE concat(' ', l_quantity, ' m2') END AS area",
        "CASE WHEN l_partkey % 5 = 0 THEN NULL ELSE concat(l_linenumber, '.9 q') END AS quartos", "'' AS banheiros",
        "CASE WHEN l_partkey % 3 = 0 THEN '' ELSE 'CASA' END AS tipo", "' MORADA  DO sol ' AS bairro", "'teresina' AS cidade")
    return P.normalise_requests(rows)


_ASKED = "CASE l_partkey % 4 WHEN 0 THEN upper(concat('fatima', '')) WHEN 1 THEN 'joquei-clube' WHEN 2 THEN concat('BRAND ', l_partkey % 40) ELSE ' - ' END"


def _asks(spark, sf):
    return table(spark, sf, "lineitem").select("l_orderkey", F.expr(_ASKED).alias("bairro"))


@query("resolve_neighbourhood", "J12",
       f"""SELECT l_orderkey, q.bairro, k.Bairro AS bairro_modelo FROM (SELECT l_orderkey, {_ASKED} AS bairro FROM lineitem) q
       LEFT JOIN (SELECT DISTINCT Bairro FROM ({LISTINGS_SQL}) WHERE Bairro IS NOT NULL) k
       ON regexp_replace(lower(strip_accents(q.bairro)), '[^a-z0-9]', '', 'g') = regexp_replace(lower(strip_accents(k.Bairro)), '[^a-z0-9]', '', 'g')""")
def _(spark, sf):
    return P.resolve_neighbourhood(_asks(spark, sf), listings(spark, sf).select("Bairro").dropna())


def _scoring_inputs(spark, sf):
    rows = requests(spark, sf)
    known = listings(spark, sf).select("Bairro").dropna().distinct()
    profiles = staged(X.neighbourhood_profiles(unique_staged(spark, sf), CONTEXT, minimum=rows.agg(F.floor(F.count("*") / 36).alias("m")).scalar()))
    defaults = X.feature_defaults(unique_staged(spark, sf), CONTEXT)
    return rows, known, profiles, defaults


def _assembled(spark, sf):
    return P.assemble_features(*_scoring_inputs(spark, sf), MODEL)


_ASSEMBLED_SQL = f"""WITH u AS ({UNIQUE_SQL}), q AS ({REQUESTS_SQL}), lim AS (SELECT floor(count(*) / 36) AS m FROM q),
 k AS (SELECT Bairro, {', '.join(f'quantile_cont(CAST({c} AS DOUBLE), 0.5) AS p_{c}' for c in CONTEXT)} FROM u WHERE Bairro IS NOT NULL GROUP BY 1 HAVING count(*) >= (SELECT m FROM lim)),
 d AS (SELECT {', '.join(f'quantile_cont(CAST({c} AS DOUBLE), 0.5) AS d_{c}' for c in CONTEXT)} FROM u),
 n AS (SELECT DISTINCT Bairro AS bairro_modelo FROM u WHERE Bairro IS NOT NULL),
 a AS (SELECT q.*, bairro_modelo, k.Bairro IS NOT NULL AS tem_perfil, greatest(area, 1) AS Area_m2, greatest(area, 1) AS a1, {', '.join(f'coalesce(p_{c}, d_{c}, 0) AS {c}' for c in CONTEXT)}
  FROM q LEFT JOIN n ON q.bairro = n.bairro_modelo LEFT JOIN k ON n.bairro_modelo = k.Bairro, d)"""


@query("assemble_request_features", "J11 M14",
       _ASSEMBLED_SQL + f""" SELECT pedido, bairro_modelo, tem_perfil, Area_m2, CAST(quartos AS DOUBLE) AS v_quartos, CAST(banheiros AS DOUBLE) AS v_banheiros,
       {r('(quartos + banheiros) / a1', 'densidade_comodos', 9)}, {', '.join(r(c, c, 6) for c in CONTEXT)}, 0.0::DOUBLE AS ausente FROM a""")
def _(spark, sf):
    out = _assembled(spark, sf)
    return out.select(
        "pedido", "bairro_modelo", "tem_perfil", "Area_m2", F.col("Quartos").cast("double").alias("v_quartos"),
        F.col("Banheiros").cast("double").alias("v_banheiros"), F.round("densidade_comodos", 9).alias("densidade_comodos"),
        *[F.round(c, 6).alias(c) for c in CONTEXT], "ausente")


@query("confidence_label", "M16",
       _ASSEMBLED_SQL + """ SELECT pedido, CASE WHEN bairro_modelo IS NULL THEN 'baixa' WHEN NOT tem_perfil OR lower(tipo) NOT IN ('apartamento', 'casa') THEN 'média'
       WHEN Area_m2 < 20 OR Area_m2 > 1000 THEN 'média' ELSE 'alta' END AS confianca FROM a""")
def _(spark, sf):
    out = _assembled(spark, sf)
    label = P.confidence(F.col("bairro_modelo"), F.col("tem_perfil"), F.col("tipo"), F.col("Area_m2"))
    return out.select("pedido", label.alias("confianca"))


@query("fallback_price", "M17",
       f"""SELECT pedido, round(CASE WHEN p IS NULL OR p <= 0 THEN area * 5000 ELSE p END, 2) AS preco_estimado,
       CASE WHEN p IS NULL THEN 'baixa' WHEN p <= 0 THEN 'média' ELSE 'alta' END AS confianca FROM
       (SELECT *, CASE pedido % 3 WHEN 0 THEN NULL WHEN 1 THEN -1.0::DOUBLE ELSE area * 4000 END AS p FROM ({REQUESTS_SQL}))""")
def _(spark, sf):
    p = F.expr("CASE pedido % 3 WHEN 0 THEN NULL WHEN 1 THEN CAST(-1 AS DOUBLE) ELSE area * 4000 END")
    rows = requests(spark, sf).withColumns({"previsto": p, "confianca": F.lit("alta")})
    return P.with_fallback(rows).select("pedido", "preco_estimado", "confianca")


_EXPECTED = ["Area_m2", "Quartos", "Banheiros", "Latitude", "score_comercial", "FipeZap_m2", "desconhecida"]


@query("legacy_scoring_features", "M18",
       f"""SELECT pedido, greatest(area, 1) AS Area_m2, CAST(quartos AS DOUBLE) AS v_quartos, CAST(coalesce(banheiros, 1) AS DOUBLE) AS v_banheiros, -5.0892::DOUBLE AS Latitude,
       0.5::DOUBLE AS score_comercial, 5000.0::DOUBLE AS FipeZap_m2, 0.0::DOUBLE AS desconhecida,
       CASE WHEN area < 20 OR quartos = 0 THEN 'média' ELSE 'alta' END AS confianca FROM ({REQUESTS_SQL})""")
def _(spark, sf):
    rows = requests(spark, sf).withColumn("confianca", P.legacy_confidence(F.col("area"), F.col("quartos")))
    out = P.legacy_features(rows, _EXPECTED)
    return out.select("pedido", "Area_m2", F.col("Quartos").alias("v_quartos"), F.col("Banheiros").alias("v_banheiros"), *_EXPECTED[3:], "confianca")


# An ensemble derived from part: tree t splits once on area at p_size + a fraction that
# 32-bit rounding moves, then on rooms.
def _nodes(spark, sf):
    t = table(spark, sf, "part").select(F.col("p_partkey").alias("tree"), (F.col("p_size") * 8).alias("cut"), "p_retailprice")
    row = lambda node, left, right, feature, threshold, value: F.struct(
        (F.col("tree") * 5 + node).alias("node"), left.alias("left"), right.alias("right"), F.lit(feature).alias("feature"),
        threshold.alias("threshold"), value.alias("value"))
    none, zero, p = F.lit(-1).cast("bigint"), F.lit(0.0), F.col("p_retailprice")
    at = lambda n: F.col("tree") * 5 + n
    nodes = F.array(
        row(0, at(1), at(2), 0, F.col("cut").cast("double"), zero),
        row(1, none, none, -1, zero, p),
        row(2, at(3), at(4), 1, F.lit(3.0), zero),
        row(3, none, none, -1, zero, p * 2),
        row(4, none, none, -1, zero, p * 3),
    )
    return t.select("tree", F.inline(nodes)).withColumn("weight", F.lit(1.0))


@query("score_flat_node_table", "M15",
       f"""WITH t AS (SELECT p_size * 8 AS cut, p_retailprice AS p FROM part),
       q AS (SELECT DISTINCT Area_m2, Quartos FROM ({LISTINGS_BARE_SQL}) WHERE Area_m2 IS NOT NULL AND Quartos IS NOT NULL),
       s AS (SELECT Area_m2, Quartos, 1000 + 0.1 * sum(CASE WHEN Area_m2 <= cut THEN p WHEN Quartos <= 3 THEN p * 2 ELSE p * 3 END) AS v FROM q, t GROUP BY 1, 2)
       SELECT URL_Anuncio, {r('v', 'previsto', 3)} FROM ({LISTINGS_BARE_SQL}) l JOIN s ON l.Area_m2 = s.Area_m2 AND l.Quartos = s.Quartos""")
def _(spark, sf):
    rows = listings(spark, sf, False).select(K.URL, "Area_m2", "Quartos").dropna()
    nodes, names = _nodes(spark, sf), ["Area_m2", "Quartos"]
    out = P.score_each_vector_once(rows, names, lambda v: P.score_node_table(v, nodes, names, 1000.0, 0.1))
    return rounded(out.select(K.URL, "previsto"), 3)


@query("score_requests", "M14 M15 M16 M17 C27",
       _ASSEMBLED_SQL + """, t AS (SELECT p_size * 8 AS cut, p_retailprice AS p FROM part),
       s AS (SELECT Area_m2, quartos, sum(CASE WHEN Area_m2 <= cut THEN p WHEN quartos <= 3 THEN p * 2 ELSE p * 3 END) AS v
         FROM (SELECT DISTINCT Area_m2, quartos FROM a WHERE area IS NOT NULL AND quartos IS NOT NULL AND banheiros IS NOT NULL), t GROUP BY 1, 2),
       e AS (SELECT a.*, v FROM a LEFT JOIN s ON a.area IS NOT NULL AND a.banheiros IS NOT NULL AND a.Area_m2 = s.Area_m2 AND a.quartos = s.quartos)
       SELECT pedido, round(coalesce(v, area * 5000), 2) AS preco_estimado, CASE WHEN v IS NULL OR bairro_modelo IS NULL THEN 'baixa'
       WHEN NOT tem_perfil OR lower(tipo) NOT IN ('apartamento', 'casa') THEN 'média' WHEN Area_m2 < 20 OR Area_m2 > 1000 THEN 'média' ELSE 'alta' END AS confianca FROM e""")
def _(spark, sf):
    """Every request against a node table of one tree per part."""
    nodes, names = _nodes(spark, sf), ["Area_m2", "Quartos"]
    rows, known, profiles, defaults = _scoring_inputs(spark, sf)

    def score(df):
        return P.score_each_vector_once(df, names, lambda v: P.score_node_table(v, nodes, names, 0.0, 1.0))

    return P.score_requests(rows, known, profiles, defaults, MODEL, score).select("pedido", "preco_estimado", "confianca")


@query("node_table_problems", "M19",
       """SELECT p_partkey AS tree, p_partkey * 5 + 2 AS node, 'child out of range' AS regra FROM part WHERE p_partkey % 3 = 0
       UNION ALL SELECT p_partkey, p_partkey * 5 + 4, 'unreachable' FROM part WHERE p_partkey % 3 = 0""")
def _(spark, sf):
    broken = F.when((F.col("tree") % 3 == 0) & (F.col("node") == F.col("tree") * 5 + 2), F.lit(-7).cast("bigint")).otherwise(F.col("right"))
    return P.node_table_problems(_nodes(spark, sf).withColumn("right", broken))
