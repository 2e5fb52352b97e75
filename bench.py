"""Headline queries, timed. Prints one JSON line.

The session is warmed up with one query; tables that queries share are staged again
for every run, so a time is the whole cost of a query, its planning included.
"""

import json
import os
import statistics
import sys
import time

from terrametro.plans import catalog  # noqa: F401
from terrametro.plans.registry import QUERIES, forget_shared
from terrametro.session import local_session

HEADLINE = [
    "keep_first_listing_per_url",
    "price_within_iqr_fences",
    "impute_by_neighbourhood_mean",
    "prepare_training_set",
    "census_features_by_position",
    "nearest_poi_per_category",
    "pois_within_radii",
    "price_index_enrichment",
    "regression_metrics",
    "metrics_by_price_band",
    "heuristic_baselines",
    "score_flat_node_table",
]


def timed(spark, name: str, folder: str) -> float:
    forget_shared()
    start = time.perf_counter()
    QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    spark = local_session(os.environ.get("BENCH_CPUS", "8"))
    seconds = {}
    timed(spark, "regression_metrics", folder)
    for name in sys.argv[1:] or HEADLINE:
        seconds[name] = round(statistics.median(timed(spark, name, folder) for _ in range(runs)), 3)
    scale = os.path.basename(folder.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": scale}))


if __name__ == "__main__":
    main()
