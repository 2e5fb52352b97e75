"""The operators bound to their tables, with oracle SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from . import bpe, chat, decontam, divergence, exact, html, licenses, lm, minhash, pii, repair, simhash, toxicity
from .common import in_bucket, table

QUERIES: dict = {}
ORACLE: dict = {}


def _query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLE[name] = sql
        return fn

    return add


@_query("op1_simhash_near_dedup")
def op1(spark, sf):
    return simhash.simhash_groups(table(spark, sf, "documents"), words=4, max_bits=4)


@_query("op8_exact_dedup", """
WITH t AS (SELECT doc_id, coalesce(text, '') AS body FROM documents),
g AS (SELECT doc_id, body, max(doc_id) OVER (PARTITION BY body) AS keep_id, count(*) OVER (PARTITION BY body) AS group_size FROM t)
SELECT doc_id, keep_id, CAST(group_size AS BIGINT) AS group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, sha256(body) AS text_sha256 FROM g""")
def op8(spark, sf):
    return exact.exact_duplicates(table(spark, sf, "documents"), keep="largest")


@_query("op3_toxicity")
def op3(spark, sf):
    docs, held_out = table(spark, sf, "documents"), in_bucket("doc_id", 5, 0)
    model = toxicity.fit_toxicity(docs.where(~held_out), table(spark, sf, "labels"))
    scored = docs.select("doc_id", held_out.alias("held_out"), toxicity.score_column(docs["text"], model, spark).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


@_query("op7_byte_bpe")
def op7(spark, sf):
    docs = table(spark, sf, "documents")
    tokens = bpe.read_ranks(spark, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    coded = docs.select("doc_id", bpe.encode_column(docs["text"], tokens, public_tokenizers.PATTERN, spark).alias("coded"))
    ids = F.col("coded.ids")
    return coded.select(
        "doc_id", F.size(ids).cast("long").alias("n_tokens"), F.sha2(F.concat_ws(",", ids.cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("coded.decoded", 256).alias("decoded_sha256"),
    )


_WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"


@_query("op9_benchmark_decontamination", f"""
WITH items AS (SELECT CAST(item_id AS VARCHAR) AS item_id, {_WORDS} AS w FROM benchmark),
spans AS (SELECT item_id, w, least(10, len(w)) AS span FROM items WHERE len(w) > 0),
windows AS (SELECT DISTINCT item_id, span, array_to_string(w[s:s + span - 1], ' ') AS phrase FROM (SELECT item_id, w, span, unnest(range(1, len(w) - span + 2)) AS s FROM spans)),
docs AS (SELECT doc_id, {_WORDS} AS w FROM documents),
places AS (SELECT doc_id, span, s, array_to_string(w[s:s + span - 1], ' ') AS phrase FROM
  (SELECT doc_id, w, span, unnest(range(1, len(w) - span + 2)) AS s FROM docs, (SELECT DISTINCT span FROM windows))),
found AS (SELECT doc_id, item_id, s, span FROM places JOIN windows USING (span, phrase)),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + span)) AS p FROM found) GROUP BY 1),
item AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id, ',' ORDER BY item_id) AS ids FROM found GROUP BY 1),
words AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS pos FROM docs),
often AS (SELECT word, count(*) AS n FROM words GROUP BY 1),
phrases AS (SELECT phrase, span, string_split(phrase, ' ') AS w FROM (SELECT DISTINCT phrase, span FROM windows)),
parts AS (SELECT phrase, span, unnest(w) AS word, unnest(range(0, span)) AS off FROM phrases),
anchors AS (SELECT phrase, span, word, off FROM (SELECT phrase, span, word, off, row_number() OVER (PARTITION BY phrase ORDER BY coalesce(n, 0), off) AS k FROM parts LEFT JOIN often USING (word)) WHERE k = 1),
begins AS (SELECT DISTINCT doc_id, phrase, span, pos - off AS s FROM anchors JOIN words USING (word)),
close AS (SELECT DISTINCT doc_id, phrase FROM (SELECT doc_id, phrase, span, s FROM begins JOIN parts USING (phrase, span) JOIN words USING (doc_id, word)
  WHERE abs(pos - s - off) <= 2 GROUP BY doc_id, phrase, span, s HAVING count(DISTINCT off) = span)),
near AS (SELECT doc_id, count(DISTINCT item_id) AS n_near FROM close JOIN windows USING (phrase) GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated, CAST(coalesce(n_near, 0) AS BIGINT) AS n_near
  FROM docs LEFT JOIN hit USING (doc_id) LEFT JOIN item USING (doc_id) LEFT JOIN near USING (doc_id)""")
def op9(spark, sf):
    found = decontam.benchmark_hits(table(spark, sf, "documents"), table(spark, sf, "benchmark"), window=10, slop=2)
    return found.select(
        "doc_id", "n_words", F.size("hits").cast("long").alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", F.array_sort("items")), 256).alias("items_sha256"), (F.size("hits") > 0).alias("contaminated"),
        F.size("near").cast("long").alias("n_near"),
    )


@_query("op6_html_main_text")
def op6(spark, sf):
    return html.main_texts(table(spark, sf, "pages"))


#: The key of the registered query; a user brings a secret one.
DEMO_KEY = b"surrogate key of the registered query"


@_query("op10_pii_surrogates")
def op10(spark, sf):
    return pii.replace_personal_data(table(spark, sf, "documents"), DEMO_KEY)


@_query("op2_chat_rotation", r"""
WITH d AS (SELECT DISTINCT conv_id, turn, coalesce(role, 'unknown') AS role, replace(replace(coalesce(text, ''), '<|', '<\|'), '|>', '|\>') AS said FROM conversations),
t AS (SELECT conv_id, turn, role, said, said || '<|im_end|>' AS body, (row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, said) - 1) // 512 AS part FROM d),
s AS (SELECT DISTINCT conv_id, role AS speaker FROM t WHERE role <> 'system'),
r AS (SELECT t.conv_id, speaker, part, turn, role, said, body, role = speaker AS own, '<|im_start|>' || CASE WHEN role = 'system' THEN 'system' WHEN role = speaker THEN 'assistant'
    ELSE 'user name=' || regexp_replace(role, '\s+', '_', 'g') END || chr(10) AS head FROM t JOIN s ON t.conv_id IS NOT DISTINCT FROM s.conv_id),
o AS (SELECT *, coalesce(sum(length(head) + length(body) + 1) OVER (PARTITION BY conv_id, speaker, part ORDER BY turn NULLS FIRST, role, said ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos FROM r)
SELECT conv_id, speaker, CAST(part AS BIGINT) AS part, count(*) AS n_turns, count(*) FILTER (WHERE own) AS n_own,
  string_agg(head || body || chr(10), '' ORDER BY turn NULLS FIRST, role, said) AS text,
  coalesce(string_agg(CAST(pos + length(head) AS BIGINT) || '-' || CAST(pos + length(head) + length(body) AS BIGINT), ',' ORDER BY turn NULLS FIRST, role, said) FILTER (WHERE own), '') AS mask
FROM o GROUP BY conv_id, speaker, part""")
def op2(spark, sf):
    return chat.rotate(table(spark, sf, "conversations"))


_TEMPLATE_ROWS, _OTHER_IDF = licenses.weights()
_TEMPLATE_SQL = ", ".join(f"({k}, '{licence}', '{term}', {idf!r}, {weight!r})" for k, licence, term, idf, weight in _TEMPLATE_ROWS)
_TRIGGER_SQL = licenses.TRIGGER.removeprefix("(?i)")
_DENIED_SQL = licenses.DENIED.removeprefix("(?i)").replace("'", "''")


@_query("op4_license_scan", rf"""
WITH tpl(template, licence, term, idf, weight) AS (VALUES {_TEMPLATE_SQL}),
files AS (SELECT CASE WHEN length(coalesce(text, '')) < 400 THEN concat_ws('/', coalesce(source, '_'), coalesce(lang, '_'), 'LICENSE-' || doc_id)
    ELSE concat_ws('/', coalesce(source, '_'), coalesce(lang, '_'), doc_id // 64, 'doc_' || doc_id || '.txt') END AS path, text FROM documents WHERE doc_id IS NOT NULL),
said AS (SELECT DISTINCT path, statement FROM (SELECT path, unnest(string_split(regexp_replace(text, '([.;!?])\s+', '' || chr(10), 'g'), chr(10))) AS statement FROM files)
    WHERE regexp_matches(statement, '{_TRIGGER_SQL}', 'i') AND NOT regexp_matches(statement, '{_DENIED_SQL}', 'i')),
terms AS (SELECT statement, term, count(*) AS tf FROM (SELECT statement, unnest(regexp_extract_all(lower(statement), '{licenses.TERM}')) AS term FROM (SELECT DISTINCT statement FROM said)) GROUP BY 1, 2),
valued AS (SELECT statement, term, tf * coalesce(idf, {_OTHER_IDF!r}) AS value FROM terms LEFT JOIN (SELECT DISTINCT term, idf FROM tpl) USING (term)),
norms AS (SELECT statement, sqrt(sum(value * value)) AS norm FROM valued GROUP BY 1),
cosine AS (SELECT statement, licence, round(sum(value * weight) / any_value(norm), 6) AS score FROM valued JOIN tpl USING (term) JOIN norms USING (statement) GROUP BY statement, template, licence),
own AS (SELECT path, licence, score FROM (SELECT path, licence, score, row_number() OVER (PARTITION BY path ORDER BY score DESC, licence) AS k
    FROM said JOIN cosine USING (statement) WHERE score >= {licenses.LEAST}) WHERE k = 1),
given AS (SELECT above, licence AS given FROM (SELECT regexp_extract(path, '^(.*?)/?[^/]*$', 1) AS above, licence, row_number() OVER (PARTITION BY regexp_extract(path, '^(.*?)/?[^/]*$', 1) ORDER BY score DESC, licence) AS k
    FROM own WHERE regexp_matches(regexp_extract(path, '[^/]*$'), '^(un)?(licen[cs]e|copying|notice)([.-].*)?$', 'i')) WHERE k = 1),
places AS (SELECT DISTINCT path, regexp_extract(path, '^(.*?)/?[^/]*$', 1) AS directory FROM files),
near AS (SELECT path, above, given FROM (SELECT path, above, given, row_number() OVER (PARTITION BY path ORDER BY length(above) DESC) AS k
    FROM places JOIN given ON above = directory OR above = '' OR starts_with(directory, above || '/')) WHERE k = 1)
SELECT path, coalesce(licence, given) AS licence, score, CASE WHEN licence IS NOT NULL THEN 'own' WHEN given IS NOT NULL THEN 'inherited' ELSE 'none' END AS how,
  CASE WHEN licence IS NULL THEN above END AS inherited_from FROM places LEFT JOIN own USING (path) LEFT JOIN near USING (path)""")
def op4(spark, sf):
    """Documents as files: source, language and id make the path; short ones are licence files."""
    docs = table(spark, sf, "documents").where("doc_id IS NOT NULL")
    place = F.concat_ws("/", F.coalesce("source", F.lit("_")), F.coalesce("lang", F.lit("_")))
    long = F.concat_ws("/", place, F.floor(F.col("doc_id") / 64).cast("string"), F.concat(F.lit("doc_"), "doc_id", F.lit(".txt")))
    path = F.when(F.length(F.coalesce("text", F.lit(""))) < 400, F.concat(place, F.lit("/LICENSE-"), "doc_id")).otherwise(long)
    return licenses.file_licences(docs.select(path.alias("path"), "text"))


@_query("op5_lm_scoring")
def op5(spark, sf):
    return lm.score_texts(table(spark, sf, "documents"), ~in_bucket("doc_id", 7, 2))




@_query("op11_minhash_near_dedup")
def op11(spark, sf):
    return minhash.near_duplicates(table(spark, sf, "documents"), words=5, percent=85)


@_query("op12_conversation_repair")
def op12(spark, sf):
    return repair.repair(table(spark, sf, "conversations"))


_LETTERS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"


@_query("op13_source_divergence", f"""
WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, {_LETTERS} AS w FROM documents),
t AS (SELECT id, lang, source, unnest(w) AS term FROM d),
v AS (SELECT lang, term, count(*) AS total FROM t GROUP BY 1, 2 HAVING count(DISTINCT id) >= 3),
c AS (SELECT lang, source, term, count(*) AS n FROM t JOIN v USING (lang, term) GROUP BY 1, 2, 3),
l AS (SELECT lang, count(*) AS terms, sum(total) AS lang_total FROM v GROUP BY 1),
g AS (SELECT lang, source, coalesce(sum(n), 0) AS total FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN c USING (lang, source) GROUP BY 1, 2),
p AS (SELECT lang, source, term, coalesce(n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(n, 0) + 1)) // (g.total + terms)::HUGEINT AS p,
  1 + (1000000000::HUGEINT * (v.total + 1)) // (lang_total + terms)::HUGEINT AS q FROM g JOIN l USING (lang) JOIN v USING (lang) LEFT JOIN c USING (lang, source, term)),
pair AS (SELECT a.lang, a.source, b.source AS item, coalesce(sum((x.p - y.p) * (x.p - y.p) // y.p), 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN p x ON x.lang = a.lang AND x.source = a.source LEFT JOIN p y ON y.lang = b.lang AND y.source = b.source AND y.term = x.term WHERE x.term IS NULL OR y.term IS NOT NULL GROUP BY 1, 2, 3),
term AS (SELECT lang, source, term AS item, (p - q) * (p - q) // q AS value FROM p WHERE n > 0 AND p > q),
r AS (SELECT lang, source, 'pair' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM pair
  UNION ALL SELECT lang, source, 'term', item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) FROM term)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM r WHERE part = 'pair' OR rank <= 200""")
def op13(spark, sf):
    return divergence.source_divergence(table(spark, sf, "documents"), least_docs=3, top=200)
