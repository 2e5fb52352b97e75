"""Sources, schema contracts, sinks, set operations and small sorts."""

from pyspark.sql import functions as F

from ... import constants as K
from ...operators import dedup as D
from ...sources import readers as R, sinks as W
from ...sources.staging import scratch_path
from ..bindings import LISTINGS_BARE_SQL, LISTINGS_SQL, POIS_SQL, listings, pois, table
from ..registry import query


@query("align_listing_schema", "S6 S5",
       f"""SELECT '' AS ID_Imovel, Tipo_Negocio, '' AS Tipo_Imovel, Area_m2, Quartos, Banheiros, Vagas_Garagem, Valor_Anuncio, '' AS Bairro,
       '' AS CEP, URL_Anuncio, '' AS Data_Coleta, '' AS Descricao, 'Desconhecida' AS Fonte, '' AS Endereco_Completo, '' AS Endereco_Geocode
       FROM ({LISTINGS_BARE_SQL})""")
def _(spark, sf):
    rows = R.require_columns(listings(spark, sf, False), [K.URL, K.TARGET])
    return R.align_schema(rows, K.RAW_COLUMNS_WITH_SOURCE)


@query("union_of_sources", "S7 U1",
       f"""SELECT 'A' AS Fonte, URL_Anuncio, Valor_Anuncio, CAST(NULL AS DOUBLE) AS Latitude FROM ({LISTINGS_BARE_SQL}) WHERE linha = 'F'
       UNION ALL SELECT 'B', URL_Anuncio, Valor_Anuncio, Latitude FROM ({LISTINGS_BARE_SQL}) WHERE linha <> 'F'""")
def _(spark, sf):
    rows = listings(spark, sf, False)
    a = rows.where("linha = 'F'").select(K.URL, K.TARGET)
    b = rows.where("linha <> 'F'").select(K.URL, K.TARGET, "Latitude")
    return R.union_sources({"A": a, "B": b})


_PAIR = "SELECT URL_Anuncio, max(Valor_Anuncio) AS preco FROM ({l}) WHERE {w} GROUP BY 1"
_STORED, _FRESH = "peca % 3 <> 0", "peca % 4 = 0"


def _keyed(rows, condition):
    return rows.where(condition).groupBy(K.URL).agg(F.max(K.TARGET).alias("preco"))


@query("upsert_by_url", "S9 U2",
       f"""WITH o AS ({_PAIR.format(l=LISTINGS_BARE_SQL, w=_STORED)}), n AS ({_PAIR.format(l=LISTINGS_BARE_SQL, w=_FRESH)})
       SELECT URL_Anuncio, preco FROM n UNION ALL SELECT URL_Anuncio, preco FROM o WHERE URL_Anuncio NOT IN (SELECT URL_Anuncio FROM n)""")
def _(spark, sf):
    rows = listings(spark, sf, False)
    return W.upsert(_keyed(rows, _STORED), _keyed(rows, _FRESH), K.URL, ["preco"])


@query("urls_not_yet_stored", "J6 U3",
       f"SELECT DISTINCT URL_Anuncio FROM ({LISTINGS_BARE_SQL}) WHERE URL_Anuncio NOT IN (SELECT URL_Anuncio FROM ({LISTINGS_BARE_SQL}) WHERE {_STORED})")
def _(spark, sf):
    rows = listings(spark, sf, False)
    return D.not_yet_stored(rows.select(K.URL).distinct(), rows.where(_STORED), K.URL)


@query("first_new_urls", "K4",
       f"""SELECT DISTINCT URL_Anuncio FROM ({LISTINGS_BARE_SQL}) WHERE URL_Anuncio NOT IN (SELECT URL_Anuncio FROM ({LISTINGS_BARE_SQL}) WHERE {_STORED})
       ORDER BY 1 LIMIT 100""")
def _(spark, sf):
    rows = listings(spark, sf, False)
    return D.first_new_urls(rows.select(K.URL).distinct(), rows.where(_STORED), K.URL, [K.URL], 100)


@query("known_neighbourhoods", "K6", f"SELECT DISTINCT Bairro FROM ({LISTINGS_SQL}) WHERE Bairro IS NOT NULL ORDER BY 1")
def _(spark, sf):
    return listings(spark, sf).select("Bairro").dropna().distinct().orderBy("Bairro")


@query("csv_round_trip", "S1 S8",
       f"SELECT URL_Anuncio, Valor_Anuncio, Quartos, Descricao FROM (SELECT *, concat('linha 1', chr(10), '\"aspas\", ', peca) AS Descricao FROM ({LISTINGS_BARE_SQL}))")
def _(spark, sf):
    path = scratch_path(spark, "csv")
    columns = [K.URL, K.TARGET, "Quartos", "Descricao"]
    text = F.concat(F.lit('linha 1\n"aspas", '), F.col("peca"))
    rows = listings(spark, sf, False).withColumn("Descricao", text).select(*columns)
    rows.write.options(header=True, escape='"').mode("overwrite").csv(path)
    return R.read_listings(spark, path, columns)


@query("census_csv_round_trip", "S2", "SELECT CAST(n_nationkey AS VARCHAR) AS CD_SETOR, concat('São ', n_name) AS NM FROM nation")
def _(spark, sf):
    path = scratch_path(spark, "census")
    rows = table(spark, sf, "nation").selectExpr("CAST(n_nationkey AS STRING) AS CD_SETOR", "concat('São ', n_name) AS NM", "'x' AS outra")
    rows.write.options(header=True, sep=";", encoding="ISO-8859-1").mode("overwrite").csv(path)
    return R.read_census(spark, path, ["CD_SETOR", "NM"])


@query("append_and_overwrite", "S8", "SELECT s_suppkey, CAST(count(*) AS BIGINT) AS n FROM (SELECT * FROM supplier UNION ALL SELECT * FROM supplier) GROUP BY 1")
def _(spark, sf):
    path = scratch_path(spark, "sink")
    rows = table(spark, sf, "supplier").select("s_suppkey")
    W.save_listings(rows, path, append=False)
    W.save_listings(rows, path, append=True)
    return spark.read.parquet(path).groupBy("s_suppkey").agg(F.count("*").alias("n"))


@query("latest_poi_snapshot", "S3", f"SELECT categoria, lat, lon, nome FROM ({POIS_SQL})")
def _(spark, sf):
    # Two dated snapshots written in parts; the older one holds some of the points.
    path = scratch_path(spark, "pois")
    points = pois(spark, sf)
    for day, part in (("20240101", points.where("length(categoria) > 7")), ("20240301", points)):
        part.write.mode("overwrite").json(f"{path}/pois_{day}")
    return R.read_latest_snapshot(spark, f"{path}/pois_*", name=r"pois_\d+", array_files=False)


_TAGGED = """CASE s_suppkey % 5 WHEN 0 THEN map('shop','mall','name',s_name) WHEN 1 THEN map('amenity','pharmacy','shop','supermarket')
 WHEN 2 THEN map('leisure','park','name',s_name) WHEN 3 THEN map('amenity','cafe') ELSE map('amenity','bank') END"""


@query("tag_raw_pois", "S4",
       """SELECT CASE k WHEN 0 THEN 'shoppings' WHEN 1 THEN 'farmacias' WHEN 2 THEN 'pracas' ELSE 'bancos' END AS categoria,
       lat, lon, CASE WHEN k IN (0, 2) THEN s_name ELSE '' END AS nome FROM (SELECT s_name, s_suppkey % 5 AS k,
         CASE WHEN s_suppkey % 3 = 0 THEN CASE WHEN s_suppkey % 7 = 0 THEN NULL ELSE CAST(-5.5 AS DOUBLE) END ELSE CAST(-s_suppkey AS DOUBLE) END AS lat,
         CAST(-42.5 AS DOUBLE) AS lon FROM supplier) WHERE k <> 3 AND lat IS NOT NULL""")
def _(spark, sf):
    rows = table(spark, sf, "supplier").select(
        F.expr("CASE WHEN s_suppkey % 3 = 0 THEN CAST(0 AS DOUBLE) ELSE CAST(-s_suppkey AS DOUBLE) END").alias("lat"),
        F.lit(-42.5).alias("lon"),
        F.expr("CASE WHEN s_suppkey % 7 <> 0 THEN named_struct('lat', CAST(-5.5 AS DOUBLE), 'lon', CAST(-42.5 AS DOUBLE)) END").alias("center"),
        F.expr(_TAGGED).alias("tags"),
    )
    return R.tag_pois(rows)


@query("segmented_dataset", "S11", f"SELECT URL_Anuncio, Valor_Anuncio, Tipo_Imovel FROM ({LISTINGS_SQL}) WHERE Tipo_Imovel = 'Casa'")
def _(spark, sf):
    path = scratch_path(spark, "segments")
    W.write_segments(listings(spark, sf).select(K.URL, K.TARGET, "Tipo_Imovel"), path, "Tipo_Imovel")
    return R.null_nans(W.read_segment(spark, path, "Tipo_Imovel", "Casa"))


@query("list_segments", "S11", f"SELECT DISTINCT Tipo_Imovel FROM ({LISTINGS_SQL})")
def _(spark, sf):
    path = scratch_path(spark, "segments")
    W.write_segments(listings(spark, sf).select(K.URL, "Tipo_Imovel"), path, "Tipo_Imovel")
    return W.list_segments(spark, path, "Tipo_Imovel")


@query("nan_to_null", "S1", "SELECT l_orderkey, CASE WHEN l_partkey % 3 = 0 THEN NULL ELSE l_quantity END AS q FROM lineitem")
def _(spark, sf):
    q = F.when(F.col("l_partkey") % 3 == 0, F.lit(float("nan"))).otherwise(F.col("l_quantity"))
    return R.null_nans(table(spark, sf, "lineitem").select("l_orderkey", q.alias("q")))

