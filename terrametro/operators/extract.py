"""Crawled pages to raw listings."""

import json

from pyspark.sql import Column, DataFrame, functions as F

from .. import constants as K
from ..functions.html import attribute_of, element, elements, markup_text, once, unescape, visible_text
from ..functions.numbers import decimal_ptbr, truncated, truthy_number, whole_from_digits
from ..functions.text import (
    deal_label,
    known_type,
    neighbourhood_from_address,
    neighbourhood_from_location,
    postcode,
)

NUMBER = r"([\d.,]+)"
DETAIL_NUMBERS = {
    "Area_m2": r"(?iu)Área\s*(?:Útil|Constru[ií]da)?\s*:?\s*([\d.,]+)\s*m",
    "Quartos": r"(?iu)(\d+)\s*Dormit",
    "Suites": r"(?iu)(\d+)\s*Su[ií]te",
    "Banheiros": r"(?iu)(\d+)\s*Banheiro",
    "Vagas_Garagem": r"(?iu)(\d+)\s*Garagem",
    "Valor_Anuncio": r"R\$\s*([\d.,]+)",
}
DETAIL_LINK = r"/imovel/(?:comprar|alugar)/[^\"'/]+/\d+"
SCRIPT_ADDRESS = r"(?i)var\s+address\s*=\s*\"([^\"]+)\""


# --- plain detail pages ----------------------------------------------------
def labelled_number(text: Column, name: str) -> Column:
    """First number after (or before) its label, pt-BR notation; NULL without one."""
    value = decimal_ptbr(F.regexp_extract(text, DETAIL_NUMBERS[name], 1))
    return value if name in ("Area_m2", "Valor_Anuncio") else truncated(value)


def script_address(html: Column) -> Column:
    return F.trim(F.regexp_extract(html, SCRIPT_ADDRESS, 1))


def id_from_url(url: Column) -> Column:
    return F.regexp_extract(url, r"/(\d+)/?$", 1)


def deal_from_url(url: Column) -> Column:
    return F.when(url.contains("/comprar/"), "comprar").otherwise("alugar")


def description(html: Column, minimum: int = 60) -> Column:
    """Social-card description, else the longest paragraph of more than `minimum`
    characters, else empty."""
    social = [
        F.trim(unescape(attribute_of(html, "meta", "content", rf"\b{attr}\s*=\s*[\"']{name}[\"']")))
        for attr, name in (("property", "og:description"), ("name", "twitter:description"))
    ]
    readable = F.regexp_replace(html, r"(?is)<(script|style)\b[^>]*>.*?</\1\s*>", " ")
    paragraphs = F.transform(elements(readable, "p"), markup_text)
    longest = F.array_max(
        F.transform(
            F.filter(paragraphs, lambda p: F.length(p) > minimum),
            # Position breaks ties: the first of the longest.
            lambda p, i: F.struct(F.length(p).alias("n"), (-i).alias("at"), p.alias("t")),
        )
    )
    return F.coalesce(*[once(s, lambda t: F.when(t != "", t)) for s in social], longest["t"], F.lit(""))


def _computed(rows: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Adds columns as generated ones: a later filter on them stays above and does not evaluate them again."""
    return rows.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def parse_detail_pages(pages: DataFrame) -> DataFrame:
    """Detail pages (url, html) to raw listings; pages without price, area and rooms
    are dropped."""
    html, url = F.col("html"), F.col("url")
    rows = _computed(pages, {"_text": visible_text(html)})
    text = F.col("_text")
    rows = _computed(rows, {name: labelled_number(text, name) for name in DETAIL_NUMBERS})
    useful = F.col("Valor_Anuncio").isNotNull() | F.col("Area_m2").isNotNull() | F.col("Quartos").isNotNull()
    rows = rows.where(useful).withColumns({"Endereco_Completo": script_address(html), "Descricao": description(html)})
    rows = rows.withColumns(
        {
            "ID_Imovel": id_from_url(url),
            "Tipo_Negocio": deal_from_url(url),
            "Tipo_Imovel": known_type(text),
            "Bairro": neighbourhood_from_address(F.col("Endereco_Completo")),
            "CEP": F.lit(""),
            "Descricao_Length": F.length("Descricao"),
            "URL_Anuncio": url,
        }
    )
    first = ["Endereco_Completo", "Descricao", "ID_Imovel", "Tipo_Negocio", "Tipo_Imovel", *DETAIL_NUMBERS, "Bairro", "CEP", "Descricao_Length", "URL_Anuncio"]
    return rows.select(*[c for c in pages.columns if c not in ("html", "url", *first)], *first)


def harvest_links(pages: DataFrame, page: str, pattern: str = DETAIL_LINK, base_url: str = "") -> DataFrame:
    """Distinct links of all pages with the page and place where each came first."""
    found = pages.select(F.col(page), F.posexplode(F.regexp_extract_all("html", F.lit(f"({pattern})"), F.lit(1))).alias("pos", "link"))
    first = found.groupBy("link").agg(F.min(F.struct(page, "pos")).alias("_at"))
    url = F.concat(F.lit(base_url), F.col("link"), F.lit("/")) if base_url else F.col("link")
    return first.select(url.alias("url"), F.col(f"_at.{page}").alias(page), F.col("_at.pos").alias("pos"))


def absolute_url(href: Column, base_url: str) -> Column:
    """`//host` and `/path` links completed; anything not http is NULL."""
    full = (
        F.when(href.startswith("//"), F.concat(F.lit("https:"), href))
        .when(href.startswith("/"), F.concat(F.lit(base_url), href))
        .otherwise(href)
    )
    return F.when(full.startswith("http"), full)


def anchor_links(pages: DataFrame, page: str, base_url: str, where: str = "") -> DataFrame:
    """Distinct absolute links of the anchors whose tag matches `where`, first place."""
    tags = F.regexp_extract_all("html", F.lit(rf"(?is)<a\b(?=[^>]*{where})[^>]*\bhref\s*=\s*[\"']([^\"']+)[\"']"), F.lit(1))
    found = pages.select(F.col(page), F.posexplode(tags).alias("pos", "href"))
    found = found.withColumn("url", absolute_url(F.col("href"), base_url)).where(F.col("url").isNotNull())
    first = found.groupBy("url").agg(F.min(F.struct(page, "pos")).alias("_at"))
    return first.select("url", F.col(f"_at.{page}").alias(page), F.col("_at.pos").alias("pos"))


def page_count(html: Column) -> Column:
    """Largest number among the pagination links; NULL without one."""
    block = element(html, "pagination", tag="ul")
    texts = F.transform(elements(block, "a"), markup_text)
    numbers = F.filter(texts, lambda t: t.rlike(r"^\d+$"))
    return F.array_max(F.transform(numbers, lambda t: t.try_cast("int")))


# --- embedded payloads -----------------------------------------------------
def page_payload(html: Column) -> Column:
    """JSON text of the page's data script, else of the global assignment; `{}` when
    neither can be parsed."""
    return F.coalesce(*[once(text, lambda t: F.when(_parses(t), t)) for text in _payload_texts(html)], F.lit("{}"))


def page_payload_status(html: Column) -> Column:
    """"parsed" where `page_payload` finds a payload, "broken" where a page has a data script or assignment with
    text but none that parses (cut off, no JSON, or nested deeper than the parser goes), else "none"."""
    texts = _payload_texts(html)
    parsed = F.coalesce(_parses(texts[0]), F.lit(False)) | F.coalesce(_parses(texts[1]), F.lit(False))
    given = F.coalesce(F.trim(texts[0]) != "", F.lit(False)) | F.coalesce(F.trim(texts[1]) != "", F.lit(False))
    return F.when(parsed, "parsed").when(given, "broken").otherwise("none")


def _payload_texts(html: Column) -> list[Column]:
    script = F.regexp_extract(html, r"(?is)<script\b[^>]*\bid\s*=\s*[\"']__NEXT_DATA__[\"'][^>]*>(.*?)</script\s*>", 1)
    assigned = F.regexp_extract(html, r"(?is)window\.__NUXT__=(.*?);?\s*</script\s*>", 1)
    return [script, assigned]


def _parses(text: Column) -> Column:
    return (F.trim(text) != "") & F.try_parse_json(text).isNotNull()


def _objects(tree):
    """Every object of a JSON tree; later siblings first, each before its own parts."""
    waiting = [tree]
    while waiting:
        node = waiting.pop()
        if isinstance(node, dict):
            yield node
            waiting.extend(v for v in node.values() if isinstance(v, (dict, list)))
        elif isinstance(node, list):
            waiting.extend(v for v in node if isinstance(v, (dict, list)))


def _first_set(node, names):
    return next((node[n] for n in names if node.get(n)), None)


AD_ID = ["listId", "ad_id", "id"]
AD_PRICE = ["price", "priceValue", "price_total"]
AD_TITLE = ["title", "subject"]


def _ads_of_page(payload: str, cap: int | None):
    try:
        tree = json.loads(payload)
    except (ValueError, RecursionError):
        return
    seen = set()
    for node in _objects(tree):
        ad_id = _first_set(node, AD_ID)
        if ad_id is None or _first_set(node, AD_PRICE) is None or _first_set(node, AD_TITLE) is None:
            continue
        marker = json.dumps(ad_id, sort_keys=True)
        if marker in seen:
            continue
        seen.add(marker)
        yield json.dumps(node, ensure_ascii=False)
        if cap is not None and len(seen) >= cap:
            return


def find_ads(pages: DataFrame, page: str, payload: str = "payload", cap: int | None = None) -> DataFrame:
    """Ad objects anywhere in a page's payload: (page, pos, ad JSON); with `cap`, the first
    so many a page (K.MAX_ADS_PER_PAGE is the site's page size). The walk is per page, in Arrow batches;
    all field work on the ads is native."""
    kind = dict(pages.dtypes)[page]

    def walk(batches):
        import pandas as pd

        for batch in batches:
            rows = [
                (key, pos, ad)
                for key, text in zip(batch[page], batch[payload])
                for pos, ad in enumerate(_ads_of_page(text or "{}", cap))
            ]
            yield pd.DataFrame(rows, columns=[page, "pos", "ad"])

    return pages.select(page, payload).mapInPandas(walk, f"`{page}` {kind}, pos int, ad string")


def _get(node: Column, path: str) -> Column:
    return F.try_variant_get(node, path, "variant")


def _text(node: Column) -> Column:
    return F.try_variant_get(node, "$", "string")


def _kind(node: Column) -> Column:
    return F.schema_of_variant(node)


def _truthy(node: Column) -> Column:
    kind, text = _kind(node), _text(node)
    return F.coalesce(
        F.when(kind == "VOID", False)
        .when(kind == "STRING", text != "")
        .when(kind == "BOOLEAN", text == "true")
        .when(kind.startswith("ARRAY"), text != "[]")
        .when(kind.startswith("OBJECT"), text != "{}")
        .otherwise(F.try_variant_get(node, "$", "double") != 0),
        F.lit(False),
    )


def _present(node: Column) -> Column:
    return F.when(_kind(node) != "VOID", node)


def _first(*nodes: Column) -> Column:
    """First truthy value, else the last one as it is."""
    return F.coalesce(*[F.when(_truthy(n), n) for n in nodes[:-1]], _present(nodes[-1]))


def _number(node: Column) -> Column:
    """Numbers as they are, texts in pt-BR notation."""
    return F.when(_kind(node) == "STRING", decimal_ptbr(_text(node))).otherwise(F.try_variant_get(node, "$", "double"))


def property_attribute(ad: Column, names) -> Column:
    """Value of the first (name, value) pair with one of the names, any case."""
    pairs = F.try_variant_get(ad, "$.properties", "array<variant>")
    wanted = [n.lower() for n in names]
    hits = F.filter(pairs, lambda p: F.coalesce(F.lower(F.try_variant_get(p, "$.name", "string")).isin(wanted), F.lit(False)))
    return _get(F.try_element_at(hits, F.lit(1)), "$.value")


def _is_object(node: Column) -> Column:
    return F.coalesce(_kind(node).startswith("OBJECT"), F.lit(False))


ROOM_NAMES = {
    "Quartos": ["bedrooms", "rooms", "bedroom"],
    "Banheiros": ["bathrooms", "bathroom"],
    "Vagas_Garagem": ["parkingSpaces", "garages", "garage"],
}
AREA_PATHS = ["usableAreas", "usableArea", "realEstate.usableArea", "real_estate_data.usable_area", "size"]
AREA_NAMES = ["usable_area", "usableAreas", "usableArea", "size", "building_size"]


def ads_to_listings(ads: DataFrame, source: str = K.DEFAULT_SOURCE, search_url: str = "") -> DataFrame:
    """Ad objects to raw listings with price and area; every field tries its aliases
    in order.

    Values used several times get a column of their own, a step at a time: written as
    one expression the aliases would multiply.
    """
    keep = [c for c in ads.columns if c != "ad"]
    ad, col = F.col("_ad"), F.col

    def first(*paths):
        return _first(*[_get(ad, f"$.{p}") for p in paths])

    nodes = {
        "_loc": first("location", "address"),
        "_det": first("locationDetails", "realEstate.address"),
        "_business": first("business", "category.business"),
        "_label": first("category.label", "category.name"),
        "_kind": first("properties.property_type", "type"),
        "_link": first("url", "permalink", "adLink"),
        "_slug": first("friendly_url", "slug"),
        "_id": first("listId", "id", "ad_id"),
        "_about": first("description", "body"),
        "_price": first("price", "priceValue", "pricing.price"),
        "_area": first(*AREA_PATHS),
        "_listed_area": _present(property_attribute(ad, AREA_NAMES)),
    }
    for name, aliases in ROOM_NAMES.items():
        for i, n in enumerate(aliases):
            nodes[f"_{name}{i}"] = first(n, f"realEstate.{n}", f"real_estate_data.{n}")
        nodes[f"_{name}{len(aliases)}"] = _present(property_attribute(ad, aliases))
    rows = ads.withColumn("_ad", F.try_parse_json("ad")).select(*keep, "_ad", *[e.alias(n) for n, e in nodes.items()])

    price, area, business, loc, det = col("_price"), col("_area"), col("_business"), col("_loc"), col("_det")
    inner = F.coalesce(_first(_get(price, "$.value"), _get(price, "$.amount")), _present(_get(price, "$.label")))
    element_or_area = F.when(_kind(area).startswith("ARRAY"), _get(area, "$[0]")).otherwise(area)
    rows = rows.withColumns(
        {
            "_price": F.when(_is_object(price), inner).otherwise(price),
            "_area": F.coalesce(_present(element_or_area), col("_listed_area")),
            "_business": F.when(_is_object(business), _first(_get(business, "$.label"), _get(business, "$.name"))).otherwise(business),
            "_loc": F.when(_is_object(loc), loc),
            "_det": F.when(_is_object(det), det),
            "_parts": F.when(
                _kind(loc) == "STRING",
                F.filter(F.transform(F.split(_text(loc), ","), lambda p: F.trim(p)), lambda p: p != ""),
            ),
        }
    )

    def place(path, part=None):
        text = F.coalesce(_text(_get(det, f"$.{path}")), _text(_get(loc, f"$.{path}")))
        if part:
            text = F.coalesce(text, F.when(F.size("_parts") >= 2, F.try_element_at("_parts", F.lit(part))))
        return F.nullif(text, F.lit(""))

    rows = rows.withColumns(
        {
            "_bairro": F.coalesce(place("neighbourhood", 2), place("suburb"), place("addressComponents.neighbourhood")),
            "_city": place("city", 1),
            "_post": F.coalesce(place("zip_code"), place("postal_code"), place("addressComponents.zipCode")),
        }
    )

    def rooms(name):
        found = [truncated(_number(col(f"_{name}{i}"))) for i in range(len(ROOM_NAMES[name]) + 1)]
        return F.coalesce(*found, F.lit(0)).alias(name)

    def text_of(node):
        return F.when(_truthy(node), _text(node))

    out = rows.select(
        *keep,
        _text(col("_id")).alias("ID_Imovel"),
        deal_label(text_of(business)).alias("Tipo_Negocio"),
        F.coalesce(text_of(col("_label")), text_of(col("_kind")), F.lit("Imóvel")).alias("Tipo_Imovel"),
        _number(area).alias("Area_m2"),
        *[rooms(name) for name in ROOM_NAMES],
        _number(price).alias("Valor_Anuncio"),
        F.coalesce(F.trim("_bairro"), col("_city"), F.lit("")).alias("Bairro"),
        postcode(col("_post"), keep_raw=True).alias("CEP"),
        F.coalesce(text_of(col("_link")), F.concat(F.lit(search_url), text_of(col("_slug")))).alias("URL_Anuncio"),
        F.coalesce(F.trim(_text(col("_about"))), F.lit("")).alias("Descricao"),
        F.lit(source).alias("Fonte"),
    )
    return out.where(truthy_number(F.col("Valor_Anuncio")) & truthy_number(F.col("Area_m2")))


# --- cards and labelled details --------------------------------------------
def split_cards(pages: DataFrame, page: str, card_class: str) -> DataFrame:
    """One row per card block of a result page, in page order (`pos` from 0)."""
    opening = rf"(?is)(?=<\w+\b[^>]*\bclass\s*=\s*[\"'][^\"']*(?<![\w-]){card_class}(?![\w-]))"
    starts_with_card = F.col("html").rlike(rf"(?is)^<\w+\b[^>]*\bclass\s*=\s*[\"'][^\"']*(?<![\w-]){card_class}(?![\w-])")
    blocks = once(F.split("html", opening), lambda b: F.when(starts_with_card, b).otherwise(F.slice(b, 2, 1 << 30)))
    return pages.select(F.col(page), F.posexplode(blocks).alias("pos", "card"))


def parse_simple_cards(cards: DataFrame, deal: str) -> DataFrame:
    """Cards hinted by class fragments; cards without link and price are dropped.

    A price in full pt-BR notation is unreadable under this source's number rule.
    """
    from ..functions.numbers import decimal_point_only

    html = F.col("card")
    features = F.transform(
        F.regexp_extract_all(html, F.lit(r"(?is)<(\w+)\b[^>]*class\s*=\s*[\"'][^\"']*feature[^\"']*[\"'][^>]*>(.*?)</\1\s*>"), F.lit(2)),
        lambda f: F.lower(markup_text(f)),
    )

    def last(values):
        return F.try_element_at(values, F.lit(-1))

    is_area = lambda t: t.contains("m²") | t.contains("m2")
    is_room = lambda t: ~is_area(t) & t.contains("quarto")
    is_bath = lambda t: ~is_area(t) & ~t.contains("quarto") & t.contains("banheiro")
    url = attribute_of(html, "a", "href", r"\bhref\s*=\s*[\"'][^\"']*/i/")

    def text_of(hint):
        return markup_text(element(html, hint, substring=True))

    usable = (F.coalesce(F.col("URL_Anuncio"), F.lit("")) != "") & truthy_number(F.col("Valor_Anuncio"))
    rows = _computed(cards, {"URL_Anuncio": url, "Valor_Anuncio": decimal_point_only(text_of("price"))}).where(usable)
    rows = _computed(rows, {"_features": features})
    features, url = F.col("_features"), F.col("URL_Anuncio")
    return rows.select(
        *[c for c in cards.columns if c != "card"],
        url,
        F.element_at(F.split(url, "/"), -1).alias("ID_Imovel"),
        F.lit(deal.capitalize()).alias("Tipo_Negocio"),
        "Valor_Anuncio",
        text_of("location").alias("Bairro"),
        decimal_point_only(last(F.filter(features, is_area))).alias("Area_m2"),
        whole_from_digits(last(F.filter(features, is_room))).alias("Quartos"),
        whole_from_digits(last(F.filter(features, is_bath))).alias("Banheiros"),
        F.coalesce(text_of("description"), F.lit("")).alias("Descricao"),
    )


def parse_listing_cards(cards: DataFrame) -> DataFrame:
    """Result-page cards to (id, url, price text, type, area name, postcode, features)."""
    html = F.col("card")
    rows = _computed(cards, {"_heading": element(html, "title", tag="h2"), "_address": markup_text(element(html, "property-address", tag="h3"))})
    rows = _computed(rows, {"_link": attribute_of(F.col("_heading"), "a", "href")})
    link, address = F.col("_link"), F.col("_address")
    code = F.regexp_replace(markup_text(element(html, "properties-cod")), r"\D", "")
    from_url = F.regexp_extract(link, r"/(\d+)/?$", 1)
    features = F.transform(elements(element(html, "facilities-list"), "li"), markup_text)
    return rows.select(
        *[c for c in cards.columns if c != "card"],
        F.coalesce(*[once(c, lambda t: F.when(t != "", t)) for c in (code, from_url)]).alias("id"),
        F.trim(link).alias("detail_url"),
        markup_text(F.col("_heading")).alias("title"),
        markup_text(element(html, "property-price")).alias("price"),
        markup_text(element(html, "property-tipo")).alias("tipo_imovel"),
        markup_text(element(html, ["property-tag", "bairro"])).alias("bairro"),
        address.alias("raw_address"),
        postcode(address).alias("cep"),
        F.coalesce(features, F.array().cast("array<string>")).alias("features"),
    )


def parse_listing_details(pages: DataFrame, city: str = K.DEFAULT_CITY) -> DataFrame:
    """Detail pages (url, html) to the fields their labelled blocks carry."""
    html = F.col("html")

    def block(start, stop):
        return F.regexp_extract(html, rf"(?is){start}(.*?){stop}", 1)

    heading = block(r"class=\"[^\"]*heading-properties[^\"]*\"", r"(?:class=\"[^\"]*imovel-informacoes|id=\"|$)")
    code = F.regexp_replace(markup_text(F.regexp_extract(heading, r"(?is)<small\b.*?<strong\b[^>]*>(.*?)</strong>", 1)), r"\D", "")
    kind = markup_text(F.regexp_extract(heading, r"(?is)pull-right.*?<h3\b.*?<span\b[^>]*>(.*?)</span>", 1))
    place = markup_text(F.regexp_extract(heading, r"(?is)pull-left.*?<p\b[^>]*>(.*?)</p>", 1))
    located = block(r"id=\"localizacao\"", r"(?:id=\"|$)")
    address = markup_text(F.regexp_extract(located, r"(?is)main-title-2.*?<p\b[^>]*>(.*?)</p>", 1))
    map_address = script_address(html)
    about = markup_text(F.regexp_extract(html, r"(?is)id=\"descricao\".*?class=\"[^\"]*conteudo[^\"]*\"[^>]*>(.*?)</div>", 1))
    info = elements(block(r"class=\"[^\"]*imovel-informacoes[^\"]*\"[^>]*>", "</ul>"), "li")
    labelled = F.transform(
        info,
        lambda li: F.struct(
            markup_text(F.regexp_extract(li, r"(?is)pull-left[^>]*>(.*?)</", 1)).alias("label"),
            markup_text(F.regexp_extract(li, r"(?is)pull-right[^>]*>(.*?)</", 1)).alias("value"),
        ),
    )
    deals = F.filter(labelled, lambda s: F.lower(s["label"]).contains("venda") | F.lower(s["label"]).contains("aluguel"))
    deal = F.try_element_at(deals, F.lit(1))
    features = F.transform(elements(block(r"class=\"[^\"]*properties-condition[^\"]*\"[^>]*>", "</ul>"), "li"), markup_text)

    def some(text):
        return once(text, lambda t: F.when(t != "", t))

    def area(text):
        return some(neighbourhood_from_location(text, city))

    from ..functions.text import title_case

    return pages.select(
        F.col("url").alias("detail_url"),
        some(code).alias("id"),
        some(kind).alias("tipo_imovel"),
        F.coalesce(area(address), area(place), area(map_address)).alias("bairro"),
        about.alias("descricao"),
        F.coalesce(some(title_case(deal["label"])), F.lit("Venda")).alias("business"),
        deal["value"].alias("price"),
        some(address).alias("Endereco_Completo"),
        some(map_address).alias("Endereco_Geocode"),
        features.alias("features"),
    )


def fields_from_features(texts: Column) -> dict[str, Column]:
    """Rooms, baths, garages and area out of labelled list items.

    The last readable item of a kind wins, except for the area, where the first
    non-zero one does. An item feeds only the first kind it fits.
    """

    def whole(t):
        return truncated(decimal_ptbr(t))

    def fits(t, words):
        hit = F.lit(False)
        for w in words:
            hit = hit | F.lower(t).contains(w)
        return hit

    kinds = {"Quartos": ("quarto", "dormit"), "Banheiros": ("banheiro",), "Vagas_Garagem": ("garagem", "vaga")}
    out, left = {}, texts

    def taker(words):
        return lambda t: fits(t, words) & whole(t).isNotNull()

    def leaver(taken):
        return lambda t: ~taken(t)

    for name, words in kinds.items():
        taken = taker(words)
        out[name] = whole(F.try_element_at(F.filter(left, taken), F.lit(-1)))
        left = F.filter(left, leaver(taken))
    sized = F.filter(left, lambda t: fits(t, ("área", "area", "m²", "m2", "terreno")))
    areas = F.filter(F.transform(sized, decimal_ptbr), lambda a: a.isNotNull())
    nonzero = F.filter(areas, lambda a: a != 0)
    out["Area_m2"] = F.coalesce(F.try_element_at(nonzero, F.lit(1)), F.try_element_at(areas, F.lit(-1)))
    return out


def merge_card_and_detail(cards: DataFrame, details: DataFrame, source: str = K.DEFAULT_SOURCE) -> DataFrame:
    """Listing per card and its detail page, the first non-empty value of each field;
    without price or area the listing is dropped."""
    d = details.select("detail_url", *[F.col(c).alias(f"d_{c}") for c in details.columns if c != "detail_url"])
    rows = cards.join(d, "detail_url")

    def pick(*names):
        return F.coalesce(*[F.when(F.col(n) != "", F.col(n)) for n in names])

    texts = F.concat(F.coalesce("d_features", F.array().cast("array<string>")), F.col("features"))
    fields = fields_from_features(F.col("_texts"))
    rows = rows.withColumn("_texts", texts)
    out = rows.select(
        pick("d_id", "id").alias("ID_Imovel"),
        F.coalesce(pick("d_business"), F.lit("Venda")).alias("Tipo_Negocio"),
        F.coalesce(pick("d_tipo_imovel", "tipo_imovel"), F.lit("Imóvel")).alias("Tipo_Imovel"),
        *[fields[n].alias(n) for n in ("Area_m2", "Quartos", "Banheiros", "Vagas_Garagem")],
        decimal_ptbr(pick("d_price", "price")).alias("Valor_Anuncio"),
        F.coalesce(pick("bairro", "d_bairro"), F.lit("")).alias("Bairro"),
        F.coalesce("cep", F.lit("")).alias("CEP"),
        F.col("detail_url").alias("URL_Anuncio"),
        F.coalesce("d_descricao", F.lit("")).alias("Descricao"),
        F.col("d_Endereco_Completo").alias("Endereco_Completo"),
        F.col("d_Endereco_Geocode").alias("Endereco_Geocode"),
        F.lit(source).alias("Fonte"),
    )
    return out.where(truthy_number(F.col("Valor_Anuncio")) & F.col("Area_m2").isNotNull())
