"""Operators against brute force on small, skewed fixtures."""

import difflib
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from terrametro import constants as K
from terrametro.functions import geo as G, numbers as N, text as T
from terrametro.operators import celltree, cleaning as C, dedup as D, enrich as E, extract as X, features as FT, scoring as P, spatial as S
from terrametro.operators.quantiles import exact_quantiles
from terrametro.operators.ranks import with_average_rank
from terrametro.sources import readers as R, sinks as W

PROBS = {"q0": 0.0, "q1": 0.25, "q5": 0.5, "q99": 0.99, "q100": 1.0}


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], list(values))
    return row.select(column.alias("v")).first()["v"]


def test_quantiles_match_numpy_under_skew(spark):
    rng = np.random.default_rng(1)
    hot = np.concatenate([np.full(3000, 7.0), rng.lognormal(3, 4, 5000), [1e12, -5.0]])
    rows = [("hot", float(v)) for v in hot] + [("one", 3.0), (None, 1.0), (None, 2.0), ("hot", None), ("hot", float("nan")), ("none", None)]
    df = spark.createDataFrame(rows, "k string, v double")
    got = {r["k"]: r for r in exact_quantiles(df, "v", PROBS, ["k"]).collect()}
    assert set(got) == {"hot", "one", None}
    for name, p in PROBS.items():
        assert got["hot"][name] == pytest.approx(np.quantile(hot, p), rel=1e-12)
        assert got[None][name] == pytest.approx(1 + p)
    assert got["hot"]["n"] == len(hot) and got["one"]["q5"] == 3.0
    overall = exact_quantiles(df.where("k = 'hot'"), "v", PROBS).first()
    assert overall["q5"] == pytest.approx(np.quantile(hot, 0.5), rel=1e-12)


def test_average_ranks_match_pandas(spark):
    values = [float(random.Random(2).choice([1, 1, 1, 2, 3, 5]) + i % 7) for i in range(500)]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double")
    got = with_average_rank(df, "v", "r").orderBy("i").toPandas()["r"].to_numpy()
    assert np.allclose(got, pd.Series(values).rank().to_numpy())


@pytest.fixture(scope="module")
def places(spark):
    """A third of the listings and of the points share one place; many sit in one cell."""
    rng = np.random.default_rng(3)
    lat, lon = -5.1 + rng.random(300) * 0.06, -42.8 + rng.random(300) * 0.06
    lat[:100], lon[:100] = -5.09, -42.79
    plat, plon = -5.09 + rng.random(240) * 0.001, -42.79 + rng.random(240) * 0.001
    plat[:80], plon[:80] = -5.0901, -42.7901
    plat[200:], plon[200:] = -5.12 + rng.random(40) * 0.1, -42.82 + rng.random(40) * 0.1
    kinds = np.where(np.arange(240) % 5 == 0, "bancos", "escolas")
    listings = pd.DataFrame({"id": range(301), "Latitude": [*lat, None], "Longitude": [*lon, -42.8]})
    pois = pd.DataFrame({"categoria": kinds, "lat": plat, "lon": plon})
    return listings, pois


@pytest.mark.parametrize("leaf", [2, 256])
def test_poi_features_match_brute_force(spark, places, leaf):
    listings, pois = places
    df = spark.createDataFrame([tuple(None if pd.isna(v) else float(v) for v in r) for r in listings.to_numpy()], "id double, Latitude double, Longitude double")
    out = S.enrich_with_pois(df, spark.createDataFrame(pois), categories=("bancos", "escolas", "pracas"), leaf=leaf)
    got = out.orderBy("id").toPandas()
    kx = K.METRES_PER_DEGREE * np.cos(np.radians(K.LAT_REFERENCE))
    for kind in ("bancos", "escolas"):
        mine = pois[pois.categoria == kind]
        d = np.hypot(
            (listings.Longitude.to_numpy()[:300, None] - mine.lon.to_numpy()) * kx,
            (listings.Latitude.to_numpy(dtype=float)[:300, None] - mine.lat.to_numpy()) * K.METRES_PER_DEGREE,
        )
        assert np.allclose(got[f"poi_dist_{kind}"][:300], d.min(axis=1))
        for r in K.POI_RADII_M:
            assert (got[f"poi_n{r}m_{kind}"][:300] == (d <= r).sum(axis=1)).all()
    assert got["poi_dist_pracas"].isna().all() and (got["poi_n500m_pracas"][:300] == 0).all()
    assert got.filter(like="poi_").iloc[300].isna().all()


def test_crowded_cells_are_cut_on_both_sides(spark):
    """Many listings in one small place and as many points in another: settled by weights, hardly compared."""
    listings = spark.range(20_000).select((F.col("id") % 200 * 1e-2).alias("qx"), (F.col("id") / 200).cast("int").cast("double").alias("qy"))
    points = listings.select(F.lit("bancos").alias("category"), (F.col("qx") + 300).alias("px"), F.col("qy").alias("py"))
    rows = celltree.position_features(listings, points, (500,), nearest=False).groupBy("qx", "qy").agg(F.sum("n500").alias("n"))
    assert rows.agg(F.count("*"), F.min("n"), F.max("n")).first()[:] == (20_000, 20_000, 20_000)
    empty = celltree.position_features(listings.limit(0), points.limit(0), (500,))
    assert empty.count() == 0 and empty.columns == ["qx", "qy", "category", "dist", "n500"]


def test_a_position_is_answered_by_one_row(spark, monkeypatch):
    """All categories together, also of cells with several blocks of positions and of points; copies of points count."""
    rng = np.random.default_rng(5)
    places, at = rng.random((300, 2)) * 3000, rng.random((120, 2)) * 3000
    at[:20] = at[0]
    kinds = np.where(np.arange(120) % 3 == 0, "bancos", "escolas")
    queries = spark.createDataFrame(pd.DataFrame(places, columns=["qx", "qy"])).unionByName(spark.createDataFrame(pd.DataFrame(places[:50], columns=["qx", "qy"])))
    points = spark.createDataFrame(pd.DataFrame({"category": [*kinds, "outros"], "px": [*at[:, 0], 1.0], "py": [*at[:, 1], 1.0]}))
    d = np.hypot(places[:, None, 0] - at[:, 0], places[:, None, 1] - at[:, 1])
    for block, leaf in ((4096, 4096), (7, 50_000), (7, 40)):
        monkeypatch.setattr(celltree, "BLOCK", block)
        got = celltree.position_table(queries, points, ["escolas", "bancos", "pracas"], (500, 2000), leaf=leaf).toPandas()
        assert len(got) == 300
        got = got.set_index(["qx", "qy"]).loc[[tuple(p) for p in places]]
        for i, kind in enumerate(("escolas", "bancos")):
            assert np.allclose(got[f"dist_{i}"], d[:, kinds == kind].min(axis=1))
            for r in (500, 2000):
                assert (got[f"n{r}_{i}"].to_numpy() == (d[:, kinds == kind] <= r).sum(axis=1)).all()
        assert got["dist_2"].isna().all() and (got["n500_2"] == 0).all()



def test_a_position_is_put_together_only_where_its_cell_meets_several_blocks(spark, monkeypatch):
    """Answers of cells that meet one block of points are rows at once: no shuffle by position stands above the comparison."""
    rng = np.random.default_rng(4)
    queries = spark.createDataFrame(pd.DataFrame(rng.random((80, 2)) * 900, columns=["qx", "qy"]))
    points = spark.createDataFrame(pd.DataFrame({"category": "escolas", "px": rng.random(60) * 900, "py": rng.random(60) * 900}))

    def plan(df):
        return df._jdf.queryExecution().optimizedPlan().toString()

    def above(df):
        return plan(df).split("MapInArrow")[0]

    once = celltree.position_table(queries, points, ["escolas"], (500,))
    assert "Aggregate" not in above(once) and once.count() == 80
    monkeypatch.setattr(celltree, "BLOCK", 7)
    often = celltree.position_table(queries, points, ["escolas"], (500,))
    assert "Aggregate" in above(often)
    one, other = (d.orderBy("qx", "qy").toPandas() for d in (once, often))
    assert len(other) == 80 and one.equals(other[one.columns])


def test_far_points_are_found(spark):
    df = spark.createDataFrame([(0, -5.0, -42.0)], "id int, Latitude double, Longitude double")
    pois = spark.createDataFrame([("bancos", 40.0, 100.0), ("bancos", -6.0, -40.0)], "categoria string, lat double, lon double")
    got = S.enrich_with_pois(df, pois, categories=("bancos",), radii=()).first()["poi_dist_bancos"]
    assert got == pytest.approx(np.hypot(2 * K.METRES_PER_DEGREE * np.cos(np.radians(K.LAT_REFERENCE)), K.METRES_PER_DEGREE))


def test_boundary_points_are_outside(spark):
    ring = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in ((0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0))])
    sectors = spark.range(1).select(F.lit("b").alias("cd_setor"), ring.alias("ring"))
    sectors = sectors.unionByName(sectors.withColumn("cd_setor", F.lit("a")))
    pts = spark.createDataFrame([(2.0, 2.0), (4.0, 2.0), (0.0, 0.0), (9.0, 9.0), (None, 1.0)], "x double, y double")
    got = {(r["x"], r["y"]): r["cd_setor"] for r in S.locate_in_sectors(pts, sectors, "x", "y", cell=1.0).collect()}
    assert got == {(2.0, 2.0): "a", (4.0, 2.0): None, (0.0, 0.0): None, (9.0, 9.0): None, (None, 1.0): None}


def test_keep_first_and_upsert(spark):
    df = spark.createDataFrame([(None, 2), (None, 1), ("a", 3), ("a", 2)], "k string, v int")
    assert sorted(map(tuple, D.keep_first(df, ["k"], ["v"]).collect()), key=str) == [("a", 2), (None, 1)]
    new = spark.createDataFrame([("a", 9), ("a", 8), ("b", 1)], "k string, v int")
    got = {tuple(r) for r in W.upsert(D.keep_first(df, ["k"], ["v"]), new, "k", ["v"]).collect()}
    assert got == {(None, 1), ("a", 9), ("b", 1)}


def test_missing_columns_are_named(spark):
    with pytest.raises(ValueError, match="Bairro"):
        R.require_columns(spark.range(1), ["id", "Bairro"])


def test_text_rules(spark):
    t = F.col("t")
    keys = ["Fátima", "FATIMA", "São João", "Jóquei-Clube", "", None]
    rows = spark.createDataFrame([(k,) for k in keys], "t string").select(T.match_key(t).alias("k")).collect()
    assert [r["k"] for r in rows] == ["fatima", "fatima", "saojoao", "joqueiclube", "", ""]
    assert one(spark, T.title_case(t), t="d'água ß-são 2nd") == "d'água ß-são 2nd".title()
    assert one(spark, T.title_case_words(t), t="MORADA  DO sol") == "Morada do Sol"
    assert one(spark, N.decimal_ptbr(t), t="R$ 360.000,00") == 360000.0
    assert one(spark, N.decimal_point_only(t), t="R$ 360.000,00") is None
    assert one(spark, N.strict_double(t), t="5d") is None
    a, b = "rua doutor joão", "rua dr joao"
    assert one(spark, T.block_similarity(F.col("a"), F.col("b")), a=a, b=b) == pytest.approx(difflib.SequenceMatcher(None, a, b).ratio())


def test_ellipsoid_distance_known_value(spark):
    # One degree of longitude on the equator of the WGS84 ellipsoid.
    got = one(spark, G.ellipsoid_distance(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0)), x=1)
    assert got == pytest.approx(np.pi / 180 * G.WGS84_MAJOR_M, abs=1e-6)


def test_confidence_labels(spark):
    cases = [(90, "Fátima"), (200, "Centro"), (45, "Jóquei"), (350, "Ininga"), (60, "fatima"), (120, "desconhecido"), (15, "Centro"), (1200, "Ininga")]
    want = ["alta", "alta", "alta", "alta", "alta", "baixa", "média", "média"]
    known = spark.createDataFrame([("Fátima",), ("Centro",), ("Jóquei",), ("Ininga",)], "Bairro string")
    profiles = known.select("Bairro", F.lit("Latitude").alias("atributo"), F.lit(-5.0).alias("mediana"))
    defaults = spark.createDataFrame([("Latitude", -5.1)], "atributo string, mediana double")
    asked = spark.createDataFrame([(i, float(a), 2, 1, "Apartamento", b) for i, (a, b) in enumerate(cases)], "i int, area double, quartos int, banheiros int, tipo string, bairro string")
    out = P.assemble_features(asked, known, profiles, defaults, ["Area_m2", "Quartos", "Latitude", "nada"])
    out = out.withColumn("c", P.confidence(F.col("bairro_modelo"), F.col("tem_perfil"), F.col("tipo"), F.col("Area_m2"))).orderBy("i").collect()
    assert [r["c"] for r in out] == want
    assert out[0]["Latitude"] == -5.0 and out[5]["Latitude"] == -5.1 and out[0]["nada"] == 0.0


def test_node_table_passes_agree(spark):
    rows = []
    for t in range(6):
        b = t * 3
        rows += [(t, b, b + 1, b + 2, 0, 0.1 * t, 0.0, 1.0), (t, b + 1, -1, -1, -1, 0.0, 1.0 + t, 1.0), (t, b + 2, -1, -1, -1, 0.0, -1.0, 1.0)]
    nodes = spark.createDataFrame(rows, "tree int, node int, left int, right int, feature int, threshold double, value double, weight double")
    x = spark.createDataFrame([(v / 20,) for v in range(20)] + [(0.1,)], "f double")
    whole = P.score_node_table(x, nodes, ["f"], 10.0, 0.5).toPandas()
    parts = P.score_node_table(x, nodes, ["f"], 10.0, 0.5, max_nodes=6).toPandas()
    assert np.allclose(whole["previsto"], parts["previsto"])
    # 0.1 in 32 bits lies above 0.1, so tree 1 sends it right.
    want = 10 + 0.5 * sum((1 + t) if float(np.float32(0.1)) <= 0.1 * t else -1 for t in range(6))
    assert whole["previsto"].iloc[-1] == pytest.approx(want)
    assert P.node_table_problems(nodes).count() == 0


def test_group_mean_then_overall_mean(spark):
    rows = [("a", 10.0), ("a", None), ("b", None), (None, 40.0), (None, None)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = sorted(r["v"] for r in C.impute_by_group_mean(df, ["v"], "g").collect())
    assert got == [10.0, 10.0, 20.0, 20.0, 40.0]


def test_unseen_levels_have_no_indicator(spark):
    train = spark.createDataFrame([("A", 1.0), ("B", 2.0), ("C", 3.0)], "k string, v double")
    model = FT.fit_features(train, ["v"], ["k"])
    rows = model.transform(spark.createDataFrame([("A", 1.0), ("C", 1.0), ("Z", 1.0)], "k string, v double")).collect()
    assert [r["features"].toArray().tolist() for r in rows] == [[1.0, 0.0, 0.0], [1.0, 1.0, 0.0], [1.0, 0.0, 0.0]]


def test_ads_are_found_at_any_depth(spark):
    payload = '{"a":[{"id":1,"price":2,"title":"x"},{"id":1,"price":3,"title":"y"}],"b":{"c":{"listId":9,"priceValue":"1","subject":"z","id":5}},"d":{"id":0,"price":1,"title":"t"}}'
    pages = spark.createDataFrame([(1, payload), (2, "not json")], "p int, payload string")
    got = X.find_ads(pages, "p").orderBy("pos").collect()
    assert [(r["p"], r["pos"]) for r in got] == [(1, 0), (1, 1)]
    assert '"listId": 9' in got[0]["ad"] and '"title": "y"' in got[1]["ad"]


def test_ad_fields_try_their_aliases(spark):
    ad = '{"id":7,"title":"t","price":0,"priceValue":"R$ 1.500,50","usableAreas":[],"realEstate":{"usableArea":"80 m²","bedrooms":3},"address":{"suburb":"Horto"},"properties":[{"name":"GARAGE","value":"2"}],"slug":"s"}'
    row = X.ads_to_listings(spark.createDataFrame([(ad,)], "ad string"), "Portal", "https://busca?q=").first()
    assert (row["Valor_Anuncio"], row["Area_m2"], row["Quartos"], row["Vagas_Garagem"]) == (1500.5, 80.0, 3, 2)
    assert (row["Bairro"], row["URL_Anuncio"], row["Tipo_Negocio"], row["Tipo_Imovel"]) == ("Horto", "https://busca?q=s", "Aluguel", "Imóvel")


def test_ads_of_a_page_have_no_cap_and_no_depth_limit(spark):
    import json

    many = json.dumps({"ads": [{"listId": i, "price": 1, "title": "t"} for i in range(1, 101)]})
    pages = spark.createDataFrame([("a", many), ("b", '{"x": not json')], "p string, payload string")
    assert X.find_ads(pages, "p").count() == 100
    assert X.find_ads(pages, "p", cap=60).count() == 60
    deep = {"listId": 7, "price": 1, "title": "t"}
    for _ in range(10_000):
        deep = {"x": deep}
    assert sum(1 for _ in X._objects(deep)) == 10_001


def test_pages_whose_payload_does_not_parse_are_told(spark):
    script, assigned = '<script id="__NEXT_DATA__">%s</script>', "<script>window.__NUXT__=%s;</script>"
    pages = {
        1: (script % '{"a":1}', "parsed"), 2: (script % '{"a":', "broken"), 3: (script % '{"a":' + assigned % '{"b":2}', "parsed"), 4: ("<p>x</p>", "none"), 5: (script % "  ", "none"),
        6: (None, "none"), 7: ("", "none"), 8: (assigned % "function(){}", "broken"), 9: (script % ('{"x":' * 10_000 + "1" + "}" * 10_000), "broken"), 10: (script % "null", "parsed"),
    }
    rows = spark.createDataFrame([(k, html) for k, (html, _) in pages.items()], "k int, html string")
    got = {r.k: (r.status, r.payload) for r in rows.select("k", X.page_payload_status(F.col("html")).alias("status"), X.page_payload(F.col("html")).alias("payload")).collect()}
    assert {k: status for k, (status, _) in got.items()} == {k: status for k, (_, status) in pages.items()}
    assert all(status == "parsed" or payload == "{}" for status, payload in got.values())


def test_no_local_folder_on_a_cluster():
    from types import SimpleNamespace

    from terrametro.sources.staging import shared_folder

    conf = {"spark.master": "spark://host:7077"}
    with pytest.raises(ValueError):
        shared_folder(SimpleNamespace(conf=SimpleNamespace(get=lambda k, d=None: conf.get(k, d))))


def test_equal_streets_are_told_apart_by_neighbourhood(spark):
    rows = spark.createDataFrame(
        [(1, "Rua Alfa, 1, Centro", "Centro"), (2, "Rua Alfa, 1, Ininga", "Ininga"), (3, "Rua Alfa, 9, Ininga", None), (4, "Rua Alfa, 1, Outro", None)],
        "id int, Endereco_Completo string, Bairro string")
    known = spark.createDataFrame(
        [("Rua Alfa", "1", "CENTRO", -5.08, -42.80), ("Rua Alfa", "1", "ininga", -5.06, -42.79)],
        "street string, number string, area string, lat double, lon double")
    cache = spark.createDataFrame([], "address string, lat double, lon double, precision string")
    got = {r["id"]: (r["Latitude"], r["geo_precision"]) for r in E.geocode_addresses(rows, cache, known).collect()}
    assert got == {1: (-5.08, "rua_numero"), 2: (-5.06, "rua_numero"), 3: (-5.06, "rua"), 4: (-5.08, "rua_numero")}


def test_nearest_point_is_found_at_any_distance(spark):
    rows = spark.createDataFrame([(1, -5.09, -42.80), (2, 80.0, 170.0)], "id int, Latitude double, Longitude double")
    points = spark.createDataFrame([("escolas", 9.91, -42.80)], "categoria string, lat double, lon double")
    for radii in ((10,), K.POI_RADII_M):
        got = {r["id"]: r["poi_dist_escolas"] for r in S.enrich_with_pois(rows, points, radii=radii).collect()}
        assert got[1] == pytest.approx(15 * 111_320) and got[2] > 2e7


def test_keys_never_read_alike_and_marks_fold_in_every_script(spark):
    rows = spark.createDataFrame([(1, "a|b", "c"), (2, "a", "b|c"), (3, None, "x"), (4, "\\N", "x"), (5, "-", "x"), (6, "a|b", "c")], "id int, a string, b string")
    keys = {r["id"]: r["imovel"] for r in FT.property_group(rows, ["a", "b"]).collect()}
    assert len(set(keys.values())) == 5 and keys[1] == keys[6]
    assert one(spark, T.folded(F.col("t")), t="  ЙОД Ñandú ") == "иод nandu"


def test_requests_are_scored_end_to_end(spark):
    asked = spark.createDataFrame(
        [(1, 50.0, 2, 1, "casa", "CENTRO"), (2, None, 2, 1, "casa", "Centro"), (3, 50.0, 2, 1, "sala", "Centro"), (4, 0.5, 2, 1, "casa", "Lugar Nenhum")],
        "id int, area double, quartos int, banheiros int, tipo string, bairro string")
    known = spark.createDataFrame([("Centro",)], "Bairro string")
    profiles = spark.createDataFrame([("Centro", "Latitude", -5.0)], "Bairro string, atributo string, mediana double")
    defaults = spark.createDataFrame([("Latitude", -5.1)], "atributo string, mediana double")
    out = P.score_requests(asked, known, profiles, defaults, ["Area_m2", "Quartos", "Latitude"], lambda df: df.withColumn("previsto", F.col("Area_m2") * 100))
    got = {r["id"]: (r["preco_estimado"], r["confianca"]) for r in out.collect()}
    assert got == {1: (5000.0, "alta"), 2: (None, "baixa"), 3: (5000.0, "média"), 4: (100.0, "baixa")}


def test_unknown_areas_leave_the_training_set(spark):
    cols = "Valor_Anuncio double, Area_m2 double, Quartos int, Banheiros int, Vagas_Garagem int, Latitude double, Longitude double, Tipo_Negocio string, Tipo_Imovel string, Bairro string, extra double"
    row = (100_000.0, None, 1, 1, 1, -5.0, -42.0, "Venda", "Casa", "Centro", 7.0)
    assert C.prepare_training_set(spark.createDataFrame([row] * 3, cols), ["Valor_Anuncio"]).count() == 0
    known = spark.createDataFrame([row, (90_000.0, 30.0, *row[2:])], cols)
    out = C.prepare_training_set(known, ["Valor_Anuncio"], extra=["extra", "missing"]).collect()
    assert {r["Area_m2"] for r in out} == {30.0} and {r["extra"] for r in out} == {7.0}


def test_letters_in_common_bound_the_block_ratio(spark):
    pairs = [("rua joao pereira", "rua joao perreira"), ("abc", "cba"), ("", ""), ("", "a"), ("aab", "abb"), ("rua $1", "rua .")]
    rows = spark.createDataFrame(pairs, "a string, b string").select("a", "b", T.letters_in_common(F.col("a"), F.col("b")).alias("r")).collect()
    for r in rows:
        assert r.r == pytest.approx(difflib.SequenceMatcher(None, r.a, r.b).quick_ratio())


def test_correlations_are_pairwise_over_known_values(spark):
    import numpy as np
    import pandas as pd

    from terrametro.operators import metrics as M

    rng = np.random.default_rng(3)
    data = pd.DataFrame(rng.random((200, 12)) + 1e6, columns=[f"x{i}" for i in range(12)])
    data["x1"] += 0.5 * data["x0"]
    data["x2"] = 7.0
    data.loc[::3, "x3"] = np.nan
    data["x4"] = np.nan
    rows = spark.createDataFrame(data.astype(object).where(data.notna(), None).astype(object), ", ".join(f"x{i} double" for i in range(12))).repartition(5)
    got = {(r.coluna_a, r.coluna_b): r.r for r in M.correlation_matrix(rows, data.columns).collect()}
    want = data.corr()
    assert len(got) == 144
    for (a, b), r in got.items():
        if "x2" in (a, b) or "x4" in (a, b):
            assert r is None
        else:
            assert r == pytest.approx(want.loc[a, b], abs=1e-6)


def test_only_the_latest_snapshot_is_opened(spark, tmp_path):
    from terrametro.sources import readers as R

    for day, text in (("20240101", "not json at all"), ("20240301", '[{"lat": -5.0, "lon": -42.0}]'), ("20240201", "[")):
        (tmp_path / f"pois_{day}.json").write_text(text)
    out = R.read_latest_snapshot(spark, str(tmp_path / "pois_*"), "lat double, lon double")
    assert [tuple(r) for r in out.collect()] == [(-5.0, -42.0)]
    assert [f.rsplit("/", 1)[1] for f in out.inputFiles()] == ["pois_20240301.json"]
    with pytest.raises(Exception):
        R.read_latest_snapshot(spark, str(tmp_path / "none_*"), "lat double")


def test_large_ensembles_are_scored_without_coming_to_the_driver(spark, monkeypatch):
    rows = []
    for t in range(40):
        b = t * 3
        rows += [(t, b, b + 1, b + 2, t % 2, 0.1 * t, 0.0, 0.5), (t, b + 1, -1, -1, -1, 0.0, 1.0 + t, 0.5), (t, b + 2, -1, -1, -1, 0.0, -1.0, 0.5)]
    schema = "tree int, node int, left int, right int, feature int, threshold double, value double, weight double"
    nodes = spark.createDataFrame(rows, schema)
    x = spark.createDataFrame([(i, i / 7, None if i % 5 == 0 else float(i % 3)) for i in range(30)] * 2, "id int, f double, g double")
    whole = P.score_node_table(x, nodes, ["f", "g"], 10.0, 0.5).orderBy("id").toPandas()
    # Neither nodes nor a row per tree are collected: what is fetched does not grow with the ensemble.
    monkeypatch.setattr(type(nodes), "toPandas", lambda self: pytest.fail("fetched"))
    monkeypatch.setattr(type(nodes), "collect", lambda self: pytest.fail("fetched"))
    monkeypatch.setattr(P, "BLOCK_VECTORS", 7)
    apart = P.score_node_table(x, nodes, ["f", "g"], 10.0, 0.5, max_nodes=24)
    monkeypatch.undo()
    apart = apart.orderBy("id").toPandas()
    assert len(apart) == 60 and np.allclose(whole["previsto"], apart["previsto"])
    lost = nodes.withColumn("value", F.when(~((F.col("tree") == 3) & (F.col("node") == 10)), F.col("value")))
    found = [P.score_node_table(x, lost, ["f", "g"], 10.0, 0.5, max_nodes=m).orderBy("id", "f").toPandas()["previsto"] for m in (1000, 24)]
    assert found[0].isna().any() and not found[0].isna().all() and (found[0].isna() == found[1].isna()).all()


def _plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_fields_of_cards_and_pages_are_read_once(spark):
    card = ('<section class="ad-card"><a class="l" href="/i/7">x</a><span class="ad-price-big">R$ 1234,50</span><p class="ad-location"> Centro &amp; Sul </p>'
            '<i class="feature-1">120 m2</i><i class="feature-2">3 Quartos</i><i class="feature-3">2 banheiros</i></section>')
    cards = spark.createDataFrame([(1, card), (2, card.replace("R$ 1234,50", "")), (3, "<section></section>"), (4, None)], "pagina int, card string").repartition(2)
    out = X.parse_simple_cards(cards, "venda")
    # Behind the filter as well as in the result, and at every mention, the expressions used to be evaluated anew.
    assert _plan(out).count("[^\\\"']*price") == 1 and _plan(out).count("[^\\\"']*feature") == 1
    [row] = out.collect()
    assert (row["ID_Imovel"], row["Valor_Anuncio"], row["Bairro"], row["Area_m2"], row["Quartos"], row["Banheiros"]) == ("7", 1234.5, "Centro & Sul", None, 3, 2)
    pages = spark.createDataFrame([("/imovel/comprar/x/5/", "<h1>Casa</h1><ul><li>3 Dormitórios</li></ul><h2>R$&nbsp;1.000,00</h2>"), ("/imovel/comprar/x/6/", "<p>nada</p>")], "url string, html string").repartition(2)
    details = X.parse_detail_pages(pages)
    assert _plan(details).count("<!doctype") == 1
    assert [(r["ID_Imovel"], r["Valor_Anuncio"], r["Quartos"]) for r in details.collect()] == [("5", 1000.0, 3)]


def test_listings_are_deduplicated_on_narrow_rows(spark, tmp_path):
    from terrametro.plans.catalog.cleaning import unique

    line = "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp"
    import datetime

    day = datetime.datetime(2020, 1, 1)
    rows = [(1, 1, 1, 1, 5.0, 10.0, 0.0, 0.1, "A", "F", day), (1, 1, 1, 1, 5.0, 9.0, 0.0, 0.1, "A", "F", day), (1, 1, 1, 2, 5.0, 8.0, 0.0, 0.1, "A", "F", day),
            (None, 1, 1, 1, 5.0, 7.0, 0.0, 0.1, "A", "F", day), (1, 1, 1, None, 5.0, 6.0, 0.0, 0.1, "A", "F", day), (2, 9, 1, 1, 5.0, 5.0, 0.0, 0.1, "A", "F", day)]
    spark.createDataFrame(rows, line).write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(1, "Brand#1", "PROMO", "n")], "p_partkey bigint, p_brand string, p_type string, p_name string").write.parquet(f"{tmp_path}/part.parquet")
    out = unique(spark, str(tmp_path))
    got = sorted(((r["URL_Anuncio"], r["Valor_Anuncio"], r["Bairro"]) for r in out.collect()), key=str)
    assert got == [("1-1", 108.0, "Fátima"), ("1-2", 96.0, "Fátima"), (None, 72.0, "Fátima")]  # missing URLs are one key
    window = _plan(out).split("Window", 1)[1]
    assert "Latitude" not in window and "URL_Anuncio" not in window


def _lines(spark, folder, rows):
    line = "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp"
    spark.createDataFrame(rows, line).write.parquet(f"{folder}/lineitem.parquet")


def test_listings_are_deduplicated_before_their_parts_join(spark, tmp_path):
    import datetime

    from terrametro.plans.catalog.cleaning import unique

    day = datetime.datetime(2020, 1, 1)

    def line(order, number, part, price):
        return (order, part, 1, number, 5.0, price, 0.0, 0.1, "A", "F", day)

    # Of one URL the first listing has an unknown part, or none; one URL has unknown parts only; some have no URL.
    rows = [line(1, 1, 7, 1.0), line(1, 1, 8, 2.0), line(1, 1, None, 0.5), line(2, 1, 7, 1.0), line(3, 4, 8, 3.0), line(None, 4, 8, 4.0), line(5, None, 8, 5.0), line(5, None, 7, 0.1)]
    _lines(spark, tmp_path, rows)
    parts = [(8, "Brand#1", "PROMO", "a"), (8, "Brand#1", "PROMO", "b"), (9, "Brand#1", "PROMO", "c"), (None, "Brand#1", "PROMO", "d")]
    spark.createDataFrame(parts, "p_partkey bigint, p_brand string, p_type string, p_name string").write.parquet(f"{tmp_path}/part.parquet")
    out = unique(spark, str(tmp_path))
    got = sorted(((r["URL_Anuncio"], r["Valor_Anuncio"], r["Quartos"]) for r in out.collect()), key=str)
    assert got == [("1-1", 24.0, 1), ("3-4", 36.0, 4), (None, 48.0, 4)]
    assert _plan(out).index("Join Inner") < _plan(out).index("Window [row_number()")  # read from the top: the part joins last


def test_enrichment_meets_deduplicated_sales_only(spark):
    columns = "URL_Anuncio string, Tipo_Negocio string, Valor_Anuncio double, Area_m2 double, Quartos int, Banheiros int, Vagas_Garagem int, Latitude double, Longitude double, Tipo_Imovel string, Bairro string, situacao string"
    rest = (50.0, 2, 1, 1, -5.1, -42.8, "Casa", "Centro", "x")
    rows = [("a", "Venda", 100.0, *rest), ("a", "Venda", 90.0, *rest), ("b", "Aluguel", 100.0, *rest), ("c", "Venda", 95.0, *rest)]
    met = []

    def enrich(sales):
        met.append(sales)
        return sales.withColumn("metros", F.col("Latitude") * -1000)

    out = C.prepare_training_set(spark.createDataFrame(rows, columns), ["Valor_Anuncio"], extra=["metros"], enrich=enrich)
    assert met[0].count() == 2 and not {"URL_Anuncio", "situacao"} & set(met[0].columns)
    assert sorted((r["Valor_Anuncio"], r["metros"]) for r in out.collect()) == [(90.0, 5100.0), (95.0, 5100.0)]


def test_quartile_edges_are_taken_once(spark):
    """The edges stand in the plan as numbers: no subquery runs the quantiles again for each place that names one."""
    from terrametro.operators import metrics as M

    df = spark.createDataFrame([(float(y), float(y + 1)) for y in range(1, 9)], "y double, p double")
    board = M.metrics_by_quartile(df, "y", "p")
    assert "scalar-subquery" not in board._jdf.queryExecution().analyzed().toString()
    got = {r["faixa"]: (r["n"], r["min_valor"], r["max_valor"], r["medae"]) for r in board.collect()}
    assert got == {"Q1 (0-25%)": (2, 1.0, 2.75, 1.0), "Q2 (25-50%)": (2, 2.75, 4.5, 1.0), "Q3 (50-75%)": (2, 4.5, 6.25, 1.0), "Q4 (75-100%)": (1, 6.25, 8.0, 1.0)}
    assert M.metrics_by_quartile(df.where("y < 0"), "y", "p").count() == 0
