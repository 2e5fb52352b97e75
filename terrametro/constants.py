"""Fixed values of the listing domain.

These are vocabularies, thresholds and coordinates that results depend on, so
they are stated literally here and nowhere else.
"""

# Canonical raw-listing schema.
RAW_COLUMNS = [
    "ID_Imovel", "Tipo_Negocio", "Tipo_Imovel", "Area_m2", "Quartos", "Banheiros",
    "Vagas_Garagem", "Valor_Anuncio", "Bairro", "CEP", "URL_Anuncio", "Data_Coleta",
    "Descricao", "Endereco_Completo",
]
RAW_COLUMNS_WITH_GEO = [
    "ID_Imovel", "Tipo_Negocio", "Tipo_Imovel", "Area_m2", "Quartos", "Suites",
    "Banheiros", "Vagas_Garagem", "Valor_Anuncio", "Bairro", "CEP", "Latitude",
    "Longitude", "geo_precision", "Endereco_Completo", "Descricao",
    "Descricao_Length", "URL_Anuncio", "Data_Coleta",
]
RAW_COLUMNS_WITH_SOURCE = [
    "ID_Imovel", "Tipo_Negocio", "Tipo_Imovel", "Area_m2", "Quartos", "Banheiros",
    "Vagas_Garagem", "Valor_Anuncio", "Bairro", "CEP", "URL_Anuncio", "Data_Coleta",
    "Descricao", "Fonte", "Endereco_Completo", "Endereco_Geocode",
]

REQUIRED_NUMERIC = [
    "Valor_Anuncio", "Area_m2", "Quartos", "Banheiros", "Vagas_Garagem",
    "Latitude", "Longitude",
]
REQUIRED_CATEGORICAL = ["Tipo_Imovel", "Bairro"]
COUNT_COLUMNS = ["Quartos", "Banheiros", "Vagas_Garagem"]
ENGINEERED = ["Densidade_Comodos", "Preco_m2", "Total_Dependencias"]
OPTIONAL_COLUMNS = [
    "Descricao", "Descricao_Length", "FipeZap_m2", "FipeZap_Diferenca_m2",
    "URL_Anuncio", "Data_Coleta",
]

URL = "URL_Anuncio"
TARGET = "Valor_Anuncio"
PROPERTY_KEY = ["Area_m2", "Quartos", "Banheiros", "Latitude", "Longitude"]

# The price index difference is price / area - index; price per m2 is price / area.
# Both give the target away.
LEAKAGE_COLUMNS = ["FipeZap_Diferenca_m2", "Preco_m2"]

SALE_WORDS = ["venda", "comprar", "vender"]
PRICE_FLOOR = 50_000.0
IQR_FACTOR = 1.5
MIN_PROFILE_ROWS = 3
MIN_SEGMENT_ROWS = 30
MAX_ADS_PER_PAGE = 60
MISSING_CATEGORY = "Nan"

PRICE_BANDS = [
    ("<250k", 0.0, 250_000.0),
    ("250-450k", 250_000.0, 450_000.0),
    ("450-800k", 450_000.0, 800_000.0),
    ("800k-1,2M", 800_000.0, 1_200_000.0),
    (">1,2M", 1_200_000.0, None),
]
PLAUSIBLE_RENT = (300.0, 25_000.0)
RESIDENTIAL_TYPES = ["Apartamento", "Casa", "Flat"]

DEFAULT_TYPE = "Outros"
DEFAULT_CITY = "Teresina"
DEFAULT_SOURCE = "Desconhecida"
LOCATION_COLUMNS = ["latitude", "longitude", "rua", "numero", "bairro_link"]
UNTRUSTED_LOCATION_SOURCE = "olx"

KNOWN_TYPES = [
    "Apartamento", "Casa", "Terreno", "Flat", "Sala", "Loja", "Galpão",
    "Sobrado", "Kitnet", "Ponto", "Lote", "Cobertura", "Sítio", "Chácara",
]

# --- geography -------------------------------------------------------------
POI_TAGS = {
    "farmacias": ("amenity", "pharmacy"),
    "escolas": ("amenity", "school"),
    "mercados": ("shop", "supermarket"),
    "hospitais": ("amenity", "hospital"),
    "shoppings": ("shop", "mall"),
    "restaurantes": ("amenity", "restaurant"),
    "bancos": ("amenity", "bank"),
    "pracas": ("leisure", "park"),
}
POI_CATEGORIES = list(POI_TAGS)
POI_RADII_M = (500, 1000, 2000)

LAT_REFERENCE = -5.09
METRES_PER_DEGREE = 111_320.0

CITY_BOX = (-5.30, -42.95, -4.90, -42.60)  # lat min, lon min, lat max, lon max
CITY_SQUARE = (-5.089205, -42.801637)
CITY_CENTROID = (-5.0892, -42.8016)

REFERENCE_POINTS = {
    "farmacias": (-5.082138, -42.806885),
    "escolas": (-5.068953, -42.783498),
    "mercados": (-5.083777, -42.772114),
    "hospitais": (-5.059088, -42.80188),
}
INVALID_DISTANCE_M = 9999.0
SCORE_NEAR_M, SCORE_MID_M = 800, 1500

NEIGHBOURHOOD_COORDS = {
    "Fátima": (-5.077965, -42.788315),
    "Jóquei Clube": (-5.057399, -42.793197),
    "Ininga": (-5.045485, -42.780154),
    "Morada do Sol": (-5.038217, -42.786225),
    "Ilhotas": (-5.080778, -42.818173),
    "Centro": (-5.090205, -42.812948),
    "Piçarra": (-5.105407, -42.805934),
    "Horto": (-5.037838, -42.802402),
    "Noivos": (-5.071928, -42.781216),
    "Santa Isabel": (-5.064422, -42.725183),
    "Uruguai": (-5.070633, -42.736927),
    "Socopo": (-5.062049, -42.703742),
}
NEIGHBOURHOOD_CENTROIDS = {
    "centro": (-5.0892, -42.8016),
    "fatima": (-5.0808, -42.7906),
    "jockey": (-5.0731, -42.7889),
    "joquei": (-5.0731, -42.7889),
    "horto": (-5.0686, -42.7770),
    "ininga": (-5.0540, -42.7860),
    "noivos": (-5.0838, -42.7721),
    "morada do sol": (-5.0567, -42.7700),
    "sao cristovao": (-5.0620, -42.7980),
    "piçarra": (-5.1050, -42.8050),
    "picarra": (-5.1050, -42.8050),
    "ilhotas": (-5.0980, -42.8030),
    "cabral": (-5.0930, -42.8090),
    "marquês": (-5.0760, -42.7990),
    "marques": (-5.0760, -42.7990),
    "vermelha": (-5.0680, -42.8090),
}
PRECISION_LEVELS = ["rua_numero", "rua", "bairro", "cidade", "none", "?"]

NEIGHBOURHOOD_FACTORS = {
    "Fátima": 1.18,
    "Jóquei Clube": 1.12,
    "Morada do Sol": 1.08,
    "Ininga": 1.05,
    "Horto": 1.05,
    "Noivos": 1.04,
    "Horto Florestal": 1.06,
    "Centro": 0.95,
    "Ilhotas": 1.02,
    "Piçarra": 0.98,
}

CENSUS_COLUMNS = [
    "cd_setor", "ibge_bairro", "area_setor_km2", "populacao_setor",
    "densidade_populacional", "media_moradores", "renda_media_responsavel",
]

# --- addresses -------------------------------------------------------------
STREET_ABBREVIATIONS = {
    "R": "Rua", "Av": "Avenida", "Avn": "Avenida", "Tv": "Travessa",
    "Pç": "Praça", "Pc": "Praça", "Des": "Desembargador", "Dr": "Doutor",
    "Dra": "Doutora", "Profa": "Professora", "Prof": "Professor",
    "Sta": "Santa", "Sto": "Santo", "Mons": "Monsenhor", "Cel": "Coronel",
    "Gen": "General", "Pe": "Padre", "Sen": "Senador", "Pres": "Presidente",
}
MIN_STREET_SIMILARITY = 0.75
TITLE_SMALL_WORDS = ["do", "da", "dos", "das", "de"]
INVALID_TEXTS = ["", "nan", "none", "Nan"]

# --- scoring ---------------------------------------------------------------
FALLBACK_PRICE_M2 = 5000.0
RELIABLE_AREA = (20, 1000)
RELIABLE_TYPES = ["apartamento", "casa"]
LEGACY_DEFAULTS = {
    "Latitude": -5.0892,
    "Longitude": -42.8014,
    "distancia_farmacias": 500.0,
    "distancia_escolas": 800.0,
    "distancia_mercados": 600.0,
    "distancia_hospitais": 1500.0,
    "score_comercial": 0.5,
    "FipeZap_m2": 5000.0,
    "FipeZap_Diferenca_m2": 0.0,
}
GBT_DEFAULTS = {
    "maxIter": 200, "stepSize": 0.1, "maxDepth": 5, "subsamplingRate": 0.9,
    "minInstancesPerNode": 2,
}
HIT_TOLERANCES = (5, 10, 15, 20, 25, 30)
SEED = 42
TEST_SHARE = 0.2
