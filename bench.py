"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

--scenario NAME (may repeat) times these alone, --runs N each N times (the mean counts, least and most are given), --slow adds SLOW.
"""

from __future__ import annotations

import argparse
import json
import os
import statistics
import tempfile
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
SCANS = ("classify_best", "classify_counts", "radius_search", "radius_join", "bbox_search", "filter_key_value", "filter_address", "tile_tags", "way_geometry", "way_point", "relation_point", "direct_search", "direct_category", "direct_search_fuzzy", "near_batch")


#: Whole catalogue queries of an index that is made for each.
SLOW = ("postings", "index_search", "index_near", "edit_neighbours", "multi_line_point", "way_simplified")


def timed(make: Callable[[], DataFrame]) -> float:
    start = time.perf_counter()
    make().write.format("noop").mode("overwrite").save()
    return round(time.perf_counter() - start, 3)


def main() -> None:
    options = argparse.ArgumentParser()
    options.add_argument("--scenario", action="append")
    options.add_argument("--runs", type=int, default=1)
    options.add_argument("--slow", action="store_true")
    asked_for = options.parse_args()
    wanted = lambda name: not asked_for.scenario or name in asked_for.scenario
    spread: dict[str, list[float]] = {}

    def several(name: str, make: Callable[[], DataFrame]) -> float:
        runs = [timed(make) for _ in range(max(1, asked_for.runs))]
        if len(runs) > 1:
            spread[name] = [min(runs), max(runs)]
        return round(statistics.mean(runs), 3)

    spark = SparkSession.builder.master(f"local[{CPUS}]").config("spark.sql.shuffle.partitions", CPUS).config("spark.driver.memory", "12g").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    from placemill.config import Params
    from placemill.operators import ontology
    from placemill.plans import catalog, engine
    from placemill.plans.service import Index
    from placemill.sources import adapters
    from placemill.streaming import publish

    times: dict[str, float] = {}
    timed(lambda: catalog.QUERIES["classify_best"](spark, SF_DIR))  # compiles code
    for name in filter(wanted, SCANS + (SLOW if asked_for.slow else ())):
        times[name] = several(name, lambda name=name: catalog.QUERIES[name](spark, SF_DIR))
    # an index is built once, then asked: text, category, radius, box, address
    objects, levels, known = adapters.objects(spark, SF_DIR), ontology.level_map(ontology.built_in(spark)), engine.Ontology.of(ontology.built_in(spark))
    start = time.perf_counter()
    index = Index.read(spark, publish.publish(objects, tempfile.mkdtemp(prefix="spark-bench-", dir="/tmp"), "v1", catalog.CONF, levels))
    times["index_build"] = round(time.perf_counter() - start, 3)
    lat, lon = adapters.CENTRE
    asked = {"text": Params(query="museum"), "two_words": Params(query="castles er"), "key": Params(key="amenity"), "radius": Params(lat=lat, lon=lon, radius="1km"), "box": Params(min_lat=lat - 0.0045, max_lat=lat + 0.0045, min_lon=lon - 0.0066, max_lon=lon + 0.0066), "address": Params(city="nation_3", street="main")}
    for name, p in asked.items():
        if not wanted(f"index_{name}"):
            continue
        find = lambda p=p: engine.index_search(index.features, index.postings, index.statistics, p, catalog.CONF, known, index.tables)
        timed(find)
        times[f"index_{name}"] = several(f"index_{name}", find)
    times["scheduling_floor"] = timed(lambda: spark.range(1))
    spark.stop()
    print(json.dumps({"metric": "total of headline queries", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(SF_DIR.rstrip("/"))} | ({"spread": spread} if spread else {})))


if __name__ == "__main__":
    main()
