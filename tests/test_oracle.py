"""Registered queries against DuckDB at the smallest scale.

A representative few by default; every query with TERRAMETRO_ALL_QUERIES=1.
"""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
FEW = [
    "keep_first_with_missing_urls", "price_within_iqr_fences", "impute_by_neighbourhood_mean", "prepare_training_set",
    "title_case_documents", "split_address", "nearest_poi_per_category", "pois_within_radii", "poi_features_with_split_cells", "census_features_by_position",
    "geocode_address_ladder", "resolve_coordinates", "metrics_by_price_band", "error_distribution", "data_dictionary",
    "composite_model_rank", "upsert_by_url", "csv_round_trip", "one_hot_vectors", "assemble_request_features",
    "score_flat_node_table", "score_requests", "prepare_enriched_training_set", "visible_page_text", "listings_from_page_payloads", "page_payload_status", "merge_cards_with_details",
    "stream_upsert_by_url", "stream_dedup_within_watermark",
]
ALL = os.environ.get("TERRAMETRO_ALL_QUERIES") == "1"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return con


def _plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else value + 0.0
    return value


def _sorted(rows):
    return sorted(rows, key=lambda r: [(v is None, str(v)) for v in r])


def test_every_query_is_registered_once():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(FEW) <= set(entry.oracle_sql())


def test_flagship(spark):
    rows = entry.entry(spark).collect()
    assert {r["regra"] for r in rows} == {"mediana global", "area x m2 global", "area x m2 do bairro"}


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()) if ALL else FEW)
def test_matches_oracle(spark, duck, name):
    df = entry.queries()[name](spark, FOLDER)
    columns = sorted(df.columns)
    got = _sorted([tuple(_plain(r[c]) for c in columns) for r in df.collect()])
    cursor = duck.execute(entry.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    place = [names.index(c) for c in columns]
    want = _sorted([tuple(_plain(r[i]) for i in place) for r in cursor.fetchall()])
    assert len(got) == len(want)
    for g, w in zip(got, want):
        assert g == pytest.approx(w, rel=1e-9, abs=1e-9) if all(isinstance(v, float) for v in g) else g == w
