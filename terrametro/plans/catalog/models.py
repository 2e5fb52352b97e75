"""Training, comparison and export. Fits are not expressible in SQL: rows only.

All use the default 200 trees, the parameter search 300 to 1,200. Models of one query (segments, folds, shares,
feature sets, trials) are boosted side by side.
"""

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from ... import constants as K
from ...operators import cleaning as C, features as X, scoring as P, spatial as S, training as T
from ...sources.staging import scratch_path, staged
from ..bindings import INGEST, LISTINGS_BARE_SQL, LISTINGS_SQL, POIS_SQL, listings, pois, table
from ..registry import query, r, shared
from .cleaning import PREPARED_SQL, prepared
from .geography import CITY_SECTORS_SQL, METRES_SQL, SECTOR_HIT_SQL, city_sectors

NUMERIC = ["Area_m2", "Quartos", "Banheiros", "Vagas_Garagem", "Latitude", "Longitude", "Densidade_Comodos"]
CATEGORICAL = ["Tipo_Imovel", "Bairro"]
#: Training sizes of the published curve as shares of its largest.
CURVE_SHARES = [n / 3677 for n in (100, 200, 400, 800, 1200, 1800, 2500, 3677)]


POI = [f"poi_dist_{c}" for c in K.POI_CATEGORIES]
CENSUS = ["populacao_setor", "renda_media_responsavel"]
_PREPARED_ROWS_SQL = PREPARED_SQL + f"SELECT * FROM p WHERE Valor_Anuncio >= {K.PRICE_FLOOR}"
_PLACES_SQL = f"SELECT DISTINCT Longitude AS px, Latitude AS py FROM ({LISTINGS_BARE_SQL}) WHERE Latitude IS NOT NULL"
_NEAREST_SQL = ", ".join(f"min(CASE WHEN categoria = '{c}' THEN m END) AS poi_dist_{c}" for c in K.POI_CATEGORIES)
_ENRICHED_SQL = f"""SELECT l.*, {", ".join(POI)}, {", ".join(CENSUS)} FROM ({LISTINGS_SQL}) l
 LEFT JOIN (SELECT px AS wx, py AS wy, {_NEAREST_SQL} FROM (SELECT px, py, categoria, {METRES_SQL.format(x="px", y="py")} AS m
   FROM ({_PLACES_SQL}), ({POIS_SQL}) p) GROUP BY 1, 2) w ON Longitude = wx AND Latitude = wy
 LEFT JOIN (SELECT px AS hx, py AS hy, min(CD_SETOR) AS hs FROM ({_PLACES_SQL}), ({CITY_SECTORS_SQL}) WHERE {SECTOR_HIT_SQL} GROUP BY 1, 2) h
   ON Longitude = hx AND Latitude = hy
 LEFT JOIN ({CITY_SECTORS_SQL}) c ON hs = c.CD_SETOR"""


def enriched_rows(spark, sf):
    """The training table with nearest points and census columns, staged once."""

    def build():
        city = city_sectors(spark, sf)

        def enrich(sales):
            rows = S.enrich_with_pois(sales, pois(spark, sf), radii=())
            rows = S.locate_in_sectors(rows, city, "Longitude", "Latitude", cell=0.01)
            # One row a sector, so that no sale is multiplied.
            census = city.groupBy("cd_setor").agg(*[F.min(c).alias(c) for c in CENSUS])
            return rows.join(census, "cd_setor", "left").drop("cd_setor")

        return staged(C.prepare_training_set(listings(spark, sf), INGEST, extra=[*POI, *CENSUS], enrich=enrich), "enriched")

    return shared(spark, sf, "enriched", build)


@query("prepare_enriched_training_set", "F14 J1 J3 J4",
       PREPARED_SQL.replace(f"({LISTINGS_SQL})", f"({_ENRICHED_SQL})") + f"""SELECT Valor_Anuncio, {r('Area_m2', 'Area_m2')}, Tipo_Imovel, Bairro,
       {', '.join(r(c, c, 3) for c in [*POI, *CENSUS])} FROM p""")
def _(spark, sf):
    rows = enriched_rows(spark, sf)
    return rows.select(K.TARGET, F.round("Area_m2", 4).alias("Area_m2"), "Tipo_Imovel", "Bairro", *[F.round(c, 3).alias(c) for c in [*POI, *CENSUS]])


def training_rows(spark, sf):
    """The whole training table with its property group and split, staged once."""
    T.ensure_checkpoint_dir(spark, scratch_path(spark, "checkpoints"))

    def build():
        rows = X.property_group(prepared(spark, sf).where(F.col(K.TARGET) >= K.PRICE_FLOOR))
        return staged(X.group_split(rows, "imovel"), "training")

    return shared(spark, sf, "training", build)


def _split(spark, sf):
    rows = training_rows(spark, sf)
    return rows.where(~F.col("teste")), rows.where("teste")


def _full_model(spark, sf):
    """The model with every default, fitted once for the queries that look at it."""
    return shared(spark, sf, "full model", lambda: T.fit_price_model(_split(spark, sf)[0], NUMERIC, CATEGORICAL))


@query("train_and_evaluate_boosted_trees", "M7 M5 A7")
def _(spark, sf):
    return T.evaluate(_full_model(spark, sf), _split(spark, sf)[1])


@query("compare_regressors", "M8 A10")
def _(spark, sf):
    train, test = _split(spark, sf)
    return T.compare_models(train, test, NUMERIC, CATEGORICAL, T.candidate_models(train=train))


@query("train_by_segment", "M9 F8 M6")
def _(spark, sf):
    return T.train_by_segment(training_rows(spark, sf), "Tipo_Imovel", NUMERIC, "teste", folds=5, key="imovel")


@query("cross_validated_errors", "M6")
def _(spark, sf):
    return T.cross_validate(training_rows(spark, sf), NUMERIC, CATEGORICAL, "imovel", 5)


@query("random_parameter_search", "M10")
def _(spark, sf):
    train, test = _split(spark, sf)
    return T.random_search(train, test, NUMERIC, trials=30)


@query("compare_feature_sets", "M11")
def _(spark, sf):
    sets = {
        "base": (NUMERIC[:4], []), "base + posicao": (NUMERIC, []), "base + posicao + bairro": (NUMERIC, CATEGORICAL),
        "base + poi": (NUMERIC[:4] + POI, []), "base + censo": (NUMERIC[:4] + CENSUS, []),
        "tudo": (NUMERIC + POI + CENSUS, CATEGORICAL),
    }
    rows = X.property_group(enriched_rows(spark, sf).where(F.col(K.TARGET) >= K.PRICE_FLOOR))
    # A place outside every sector, or unknown, has no value; the median stands in.
    rows = C.impute_medians(X.group_split(rows, "imovel"), [*POI, *CENSUS])
    return T.compare_feature_sets(staged(rows, "feature-sets"), sets, "teste", key="imovel")


@query("learning_curve", "M12")
def _(spark, sf):
    train, test = _split(spark, sf)
    return T.learning_curve(train, test, "imovel", CURVE_SHARES, 5, NUMERIC)


@query("top_feature_importances", "M13 K2")
def _(spark, sf):
    return T.top_importances(T.feature_importance(_full_model(spark, sf), _split(spark, sf)[0]))


def _exported(spark, sf):
    model, path = _full_model(spark, sf), scratch_path(spark, "model")
    model.stages[-1].write().save(path)
    return model, T.flat_node_table(spark, path), training_rows(spark, sf)


@query("export_flat_node_table", "S13 M19")
def _(spark, sf):
    return _exported(spark, sf)[1]


@query("exported_scores_agree_with_model", "M15 S13", f"SELECT count(*) AS linhas, 0 AS divergentes, 0 AS problemas FROM ({_PREPARED_ROWS_SQL})")
def _(spark, sf):
    """Node-table scores against the model's own, on every training and test row. Features are rounded to 32 bits
    before both, since only the node table's rule rounds."""
    model, nodes, rows = _exported(spark, sf)
    rows = rows.withColumns({c: F.col(c).cast("float").cast("double") for c in NUMERIC})
    names = [f"f{i}" for i in range(model.stages[-1].numFeatures)]
    vector = vector_to_array("features")
    rows = model.transform(rows).select(F.col("previsto").alias("modelo"), *[vector[i].alias(c) for i, c in enumerate(names)])
    both = P.score_node_table(rows, nodes, names, 0.0, 1.0)
    apart = F.abs(F.col("previsto") - F.col("modelo")) > 1e-6 * F.abs("modelo") + 0.01
    out = both.agg(F.count("*").alias("linhas"), F.count_if(apart).cast("int").alias("divergentes"))
    problems = P.node_table_problems(nodes).agg(F.count("*").cast("int").alias("p")).scalar()
    return out.withColumn("problemas", problems)


@query("saved_artifacts_round_trip", "S12", "SELECT count(*) > 0 AS ok FROM lineitem")
def _(spark, sf):
    train, test = _split(spark, sf)
    model = _full_model(spark, sf)
    path = scratch_path(spark, "artifacts")
    context = ["Latitude", "Longitude"]
    T.save_artifacts(model, X.neighbourhood_profiles(train, context), X.feature_defaults(train, context), path)
    again, profiles, defaults = T.load_artifacts(spark, path)
    sums = [m.transform(test).agg(F.round(F.sum("previsto"), 2).alias("s")).scalar() for m in (model, again)]
    counts = [d.agg(F.count("*").alias("n")).scalar() for d in (profiles, defaults)]
    ok = (sums[0] == sums[1]) & (counts[0] > 0) & (counts[1] == len(context))
    return table(spark, sf, "lineitem").agg(F.count("*").alias("n")).select(((F.col("n") > 0) & ok).alias("ok"))


_CLASSES = {"Bairro_": "Bairro", "Tipo_Imovel_": "Tipo_Imovel"}


@query("class_labels_from_indicators", "C28 M1", " UNION ALL ".join(
    f"SELECT DISTINCT '{prefix}' AS prefixo, trim(replace({c}, '_', ' ')) AS classe FROM ({LISTINGS_SQL}) WHERE {c} > (SELECT min({c}) FROM ({LISTINGS_SQL}))" for prefix, c in _CLASSES.items()))
def _(spark, sf):
    """Class names read off the names of the indicator columns that encoding makes (no first level)."""
    rows = listings(spark, sf)
    names = {p: [r[0] for r in X.dummies_long(rows, K.URL, c).select("coluna").distinct().orderBy("coluna").collect()] for p, c in _CLASSES.items()}
    found = [(p, label) for p, columns in names.items() for label in X.class_labels(columns, list(_CLASSES))]
    return spark.createDataFrame(found, "prefixo string, classe string")
