"""Number and text expressions over listing fields and documents."""

from pyspark.sql import functions as F

from ...constants import MISSING_CATEGORY
from ...functions import numbers as N, text as T
from ..bindings import LISTINGS_SQL, listings, table
from ..registry import ptbr_number, query, r, title_sql

LI = "FROM lineitem"


def _li(spark, sf):
    return table(spark, sf, "lineitem")


@query("integer_from_digits", "C1",
       f"SELECT l_orderkey, CAST(concat(l_orderkey, l_linenumber) AS BIGINT) AS n {LI}")
def _(spark, sf):
    text = F.concat(F.lit("cód. "), F.col("l_orderkey"), F.lit("/"), F.col("l_linenumber"))
    return _li(spark, sf).select("l_orderkey", N.whole_from_digits(text).alias("n"))


@query("decimal_without_thousands_rule", "C2",
       f"SELECT l_orderkey, CASE WHEN v < 1000 THEN v END AS n FROM (SELECT l_orderkey, CASE WHEN l_partkey % 2 = 0 THEN l_discount ELSE l_extendedprice END AS v {LI})")
def _(spark, sf):
    text = F.concat(F.lit(" R$ "), ptbr_number(F.expr("CASE WHEN l_partkey % 2 = 0 THEN l_discount ELSE l_extendedprice END")))
    return _li(spark, sf).select("l_orderkey", N.decimal_point_only(text).alias("n"))


@query("decimal_ptbr", "C3 C4", f"SELECT l_orderkey, l_extendedprice AS n, CAST(trunc(l_extendedprice) AS INT) AS inteiro {LI}")
def _(spark, sf):
    text = F.concat(F.lit("R$ "), ptbr_number(F.col("l_extendedprice")), F.lit(" à vista"))
    value = N.decimal_ptbr(text)
    return _li(spark, sf).select("l_orderkey", value.alias("n"), N.truncated(value).alias("inteiro"))


@query("decimal_by_locale", "C5", f"SELECT l_orderkey, l_extendedprice AS virgula, l_tax + 0.0 AS ponto {LI}")
def _(spark, sf):
    comma = F.concat(F.lit(" "), ptbr_number(F.col("l_extendedprice")))
    point = F.format_string("%.2f", F.abs("l_tax"))
    return _li(spark, sf).select(
        "l_orderkey", N.decimal_locale(comma, ",").alias("virgula"), (N.decimal_locale(point, ".") + 0.0).alias("ponto")
    )


@query("numeric_coercion", "C6",
       f"""SELECT l_orderkey, CASE l_partkey % 6 WHEN 0 THEN NULL WHEN 1 THEN CAST(1000 AS DOUBLE) WHEN 2 THEN NULL
       WHEN 3 THEN NULL WHEN 4 THEN CAST(-0.5 AS DOUBLE) ELSE CAST(l_partkey AS DOUBLE) END AS n {LI}""")
def _(spark, sf):
    text = F.expr("CASE l_partkey % 6 WHEN 0 THEN 'abc' WHEN 1 THEN ' 1e3 ' WHEN 2 THEN '5d' WHEN 3 THEN '' WHEN 4 THEN '-.5' ELSE CAST(l_partkey AS STRING) END")
    return _li(spark, sf).select("l_orderkey", N.strict_double(text).alias("n"))


_MESSY = """CASE p_partkey % 8 WHEN 0 THEN '' WHEN 1 THEN ' nan ' WHEN 2 THEN 'none' WHEN 3 THEN 'Nan' WHEN 4 THEN 'None'
 WHEN 5 THEN NULL WHEN 6 THEN concat(' ', p_name, '-Norte ') ELSE upper(p_name) END"""


@query("valid_text", "C7",
       f"SELECT p_partkey, coalesce(trim(t) NOT IN ('', 'nan', 'none', 'Nan'), false) AS valido FROM (SELECT p_partkey, {_MESSY} AS t FROM part)")
def _(spark, sf):
    return table(spark, sf, "part").select("p_partkey", T.is_valid_text(F.expr(_MESSY)).alias("valido"))


@query("geocode_cache_key", "C8",
       f"""SELECT p_partkey, CASE WHEN coalesce(trim(t) NOT IN ('', 'nan', 'none', 'Nan'), false)
       THEN replace(replace(lower(trim(t)), ' ', '_'), '-', '') END AS chave FROM (SELECT p_partkey, {_MESSY} AS t FROM part)""")
def _(spark, sf):
    return table(spark, sf, "part").select("p_partkey", T.cache_key(F.expr(_MESSY)).alias("chave"))


@query("postcode_format", "C9",
       """SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN '' WHEN p_partkey % 3 = 1 THEN d ELSE concat(substr(d8, 1, 5), '-', substr(d8, 6, 3)) END AS cep,
       CASE WHEN p_partkey % 3 = 0 THEN '' WHEN p_partkey % 3 = 1 THEN concat('CEP ', d) ELSE concat(substr(d8, 1, 5), '-', substr(d8, 6, 3)) END AS cep_bruto
       FROM (SELECT p_partkey, concat(p_partkey % 7, p_partkey) AS d, lpad(CAST(p_partkey * 37 AS VARCHAR), 8, '6') AS d8 FROM part)""")
def _(spark, sf):
    raw = F.expr("""CASE p_partkey % 3 WHEN 0 THEN NULL WHEN 1 THEN concat('CEP ', p_partkey % 7, p_partkey)
        ELSE concat(substr(lpad(CAST(p_partkey * 37 AS STRING), 8, '6'), 1, 2), '.', substr(lpad(CAST(p_partkey * 37 AS STRING), 8, '6'), 3)) END""")
    return table(spark, sf, "part").select("p_partkey", T.postcode(raw).alias("cep"), T.postcode(raw, keep_raw=True).alias("cep_bruto"))


@query("neighbourhood_from_location", "C10",
       f"SELECT URL_Anuncio, CASE WHEN peca % 4 = 3 THEN 'Teresina' WHEN Bairro IS NULL THEN '' ELSE replace(Bairro, '-', ' ') END AS bairro FROM ({LISTINGS_SQL})")
def _(spark, sf):
    text = F.expr("""CASE peca % 4 WHEN 0 THEN concat('Rua 13 - ', Bairro, ' - Teresina - PI, 64.000-123')
        WHEN 1 THEN concat(Bairro, ', TERESINA, PI, 64000-123') WHEN 2 THEN concat('Av. X,  120, ', Bairro, ', 45, pi')
        ELSE 'Teresina' END""")
    return listings(spark, sf).select("URL_Anuncio", T.neighbourhood_from_location(F.coalesce(text, F.lit("")), "Teresina").alias("bairro"))


@query("neighbourhood_from_address", "C11",
       f"""SELECT URL_Anuncio, CASE WHEN Bairro IS NULL OR peca % 4 = 3 THEN '' ELSE {title_sql('Bairro')} END AS bairro FROM ({LISTINGS_SQL})""")
def _(spark, sf):
    text = F.expr("""CASE peca % 4 WHEN 0 THEN concat('Rua A, 12, ', upper(Bairro), ', TERESINA/PI') WHEN 1 THEN concat('Rua A/B, ', upper(Bairro), ', TERESINA/PI, Brasil')
        WHEN 2 THEN concat('Rua A, 9, ', Bairro, ', TERESINA') ELSE 'Rua A' END""")
    return listings(spark, sf).select("URL_Anuncio", T.neighbourhood_from_address(F.coalesce(text, F.lit(""))).alias("bairro"))


@query("split_address", "C12",
       f"""SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN concat('Rua Desembargador João ', n) WHEN 1 THEN concat('Avenida Doutora ', n) ELSE concat('Praça ', n) END AS rua,
       CASE p_partkey % 3 WHEN 2 THEN '' ELSE CAST(p_partkey + 1000 AS VARCHAR) END AS numero,
       CASE p_partkey % 3 WHEN 2 THEN '' ELSE p_brand END AS bairro
       FROM (SELECT p_partkey, p_brand, {title_sql('p_name')} AS n FROM part)""")
def _(spark, sf):
    text = F.expr("""CASE p_partkey % 3 WHEN 0 THEN concat('R. Des.  João ', p_name, ', ', translate(format_number(p_partkey + 1000, 0), ',', '.'), ', ', upper(p_brand), ', TERESINA/PI')
        WHEN 1 THEN concat('av. Dra. ', p_name, ', nº ', p_partkey + 1000, ', ', p_brand) ELSE concat('Pç. ', p_name) END""")
    parts = T.split_address(text)
    return table(spark, sf, "part").select(
        "p_partkey", parts["street"].alias("rua"), parts["number"].alias("numero"), parts["area"].alias("bairro")
    )


@query("match_key_of_documents", "C13",
       r"""SELECT doc_id, md5(regexp_replace(lower(strip_accents(text)), '[^\p{L}\p{N}]', '', 'g')) AS chave,
       md5(regexp_replace(lower(strip_accents(text)), '[^a-z0-9]', '', 'g')) AS chave_ascii FROM documents""")
def _(spark, sf):
    text = F.col("text")
    return table(spark, sf, "documents").select(
        "doc_id", F.md5(T.match_key(text)).alias("chave"), F.md5(T.match_key(text, ascii_only=True)).alias("chave_ascii")
    )


@query("accent_folded_documents", "C14 C25",
       "SELECT doc_id, md5(trim(lower(strip_accents(text)), ' ')) AS dobrado, CAST(length(text) AS INT) AS tamanho FROM documents")
def _(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5(T.folded(F.col("text"))).alias("dobrado"), F.length("text").alias("tamanho"))


@query("title_case_documents", "C15", f"SELECT doc_id, md5({title_sql('text')}) AS titulo FROM documents")
def _(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5(T.title_case(F.col("text"))).alias("titulo"))


@query("title_case_with_small_words", "C15",
       """SELECT p_partkey, array_to_string(list_transform(list_filter(string_split(lower(t), ' '), lambda w: w <> ''),
       lambda w, i: CASE WHEN i > 1 AND w IN ('do','da','dos','das','de') THEN w ELSE upper(w[1]) || w[2:] END), ' ') AS nome
       FROM (SELECT p_partkey, concat('dos ', p_name, '  DA ', p_type, ' de-sul') AS t FROM part)""")
def _(spark, sf):
    text = F.expr("concat('dos ', p_name, '  DA ', p_type, ' de-sul')")
    return table(spark, sf, "part").select("p_partkey", T.title_case_words(text).alias("nome"))


@query("category_text", "C15 C16",
       f"SELECT URL_Anuncio, coalesce({title_sql('trim(Bairro)')}, 'Nan') AS Bairro FROM ({LISTINGS_SQL})")
def _(spark, sf):
    return listings(spark, sf).select("URL_Anuncio", T.category_text(F.col("Bairro"), MISSING_CATEGORY).alias("Bairro"))


_NAMES = "SELECT p_partkey, p_name AS a, CASE p_partkey % 3 WHEN 0 THEN concat(p_name, 's') WHEN 1 THEN reverse(p_name) ELSE '' END AS b FROM part"


@query("street_similarity_by_edits", "C17",
       f"""SELECT p_partkey, {r('1 - levenshtein(a, b) / CAST(greatest(length(a), length(b)) AS DOUBLE)', 'semelhanca', 6)} FROM ({_NAMES})""")
def _(spark, sf):
    rows = table(spark, sf, "part").selectExpr("p_partkey", "p_name AS a", "CASE p_partkey % 3 WHEN 0 THEN concat(p_name, 's') WHEN 1 THEN reverse(p_name) ELSE '' END AS b")
    return rows.select("p_partkey", F.round(T.edit_similarity(F.col("a"), F.col("b")), 6).alias("semelhanca"))


@query("street_match_by_blocks", "C17")
def _(spark, sf):
    rows = table(spark, sf, "part").selectExpr("p_partkey", "p_name AS a", "CASE p_partkey % 3 WHEN 0 THEN concat(p_name, 's') WHEN 1 THEN reverse(p_name) ELSE '' END AS b")
    return rows.select("p_partkey", T.street_matches(F.col("a"), F.col("b"), 0.75).alias("confere"))


@query("deal_label", "C18",
       f"SELECT l_orderkey, CASE l_returnflag WHEN 'A' THEN 'Venda' WHEN 'N' THEN 'Venda' ELSE 'Aluguel' END AS negocio {LI}")
def _(spark, sf):
    text = F.expr("CASE l_returnflag WHEN 'A' THEN 'À VENDA' WHEN 'N' THEN 'vender' END")
    return _li(spark, sf).select("l_orderkey", T.deal_label(text).alias("negocio"))


@query("known_type_in_documents", "X14",
       """SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'Casa' WHEN doc_id % 4 = 1 THEN 'Galpão' WHEN doc_id % 4 = 2 THEN '' ELSE 'Terreno' END AS tipo FROM documents""")
def _(spark, sf):
    # The invented prose holds none of the vocabulary; it is added at the very end.
    extra = F.expr("CASE doc_id % 4 WHEN 0 THEN ' loja e CASA' WHEN 1 THEN ' galpão.' WHEN 2 THEN ' casarão' ELSE ' sala, terreno' END")
    return table(spark, sf, "documents").select("doc_id", T.known_type(F.concat("text", extra)).alias("tipo"))


@query("relative_errors", "C26",
       f"""SELECT l_orderkey, (l_extendedprice - q) / nullif(q, 0) AS erro FROM
       (SELECT l_orderkey, l_extendedprice, CASE WHEN l_partkey % 7 = 0 THEN 0 ELSE l_quantity * 1500 END AS q {LI})""")
def _(spark, sf):
    actual = F.expr("CASE WHEN l_partkey % 7 = 0 THEN 0 ELSE l_quantity * 1500 END")
    return _li(spark, sf).select("l_orderkey", N.relative_error(actual, F.col("l_extendedprice")).alias("erro"))
