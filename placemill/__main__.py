"""Entry points: python -m placemill build ROOT VERSION FILE, update OLD NEW CHANGES, search PATH q=..., tile FILE LAT LON; for spark-submit as well."""

from __future__ import annotations

import argparse
import json
import sys
from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import SparkSession

from placemill.config import Config
from placemill.operators import ontology, tiles
from placemill.plans.engine import Ontology
from placemill.plans.service import Index, SearchError, Service
from placemill.sources import map_objects
from placemill.streaming import publish


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="placemill")
    out.add_argument("--config", help="a TOML file")
    out.add_argument("--ontology", help="a CSV file of id, level, label, key, value in place of the built-in one")
    commands = out.add_subparsers(dest="command", required=True)
    build = commands.add_parser("build", help="an index version from a map file")
    build.add_argument("root")
    build.add_argument("version")
    build.add_argument("file")
    build.add_argument("--importance", help="a table of importance by wiki id")
    build.add_argument("--ranked", action="store_true", help="with lists by impact, for pages of searches by filters alone")
    update = commands.add_parser("update", help="the next version of an index from a table of changes")
    for name in ("old", "new", "changes"):
        update.add_argument(name)
    update.add_argument("--ranked", action="store_true")
    search = commands.add_parser("search", help="a request against an index: q=..., key=..., lat=..., limit=...")
    search.add_argument("path")
    search.add_argument("--ranked", action="store_true")
    search.add_argument("args", nargs="*")
    tile = commands.add_parser("tile", help="what the tiles of an archive hold at a point")
    tile.add_argument("file")
    tile.add_argument("lat", type=float)
    tile.add_argument("lon", type=float)
    tile.add_argument("--layer", default="")
    tile.add_argument("--zooms", help="least,most")
    tile.add_argument("--list-layers", action="store_true")
    return out


def main(argv: Sequence[str] | None = None, spark: SparkSession | None = None) -> object:
    """Runs a command; prints its result as JSON and returns it."""
    a = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("placemill").getOrCreate()
    conf = Config.from_toml(Path(a.config).read_text(), Config.trimmed() if a.command == "build" else None) if a.config else Config.trimmed() if a.command == "build" else Config()
    known = Ontology.fitting(ontology.read_ontology(spark, a.ontology)) if a.ontology else Ontology.built_in()
    levels = known.levels if known.table is None else known.table
    if a.command == "build":
        importance = ontology.read_importance(spark, a.importance) if a.importance else None
        path = publish.publish(map_objects.from_file(spark, a.file, conf), a.root, a.version, conf, levels, importance=importance, ranked=a.ranked)
        out: object = {"path": path, "counts": [r.asDict() for r in spark.read.parquet(f"{path}/counts").collect()]}
    elif a.command == "update":
        out = {"path": publish.update(spark, a.old, a.new, spark.read.parquet(a.changes), conf, levels, a.ranked)}
    elif a.command == "search":
        service = Service(indexes={"index": Index.read(spark, a.path, conf.geometry_mode.startswith("geoshape"), a.ranked)}, conf=conf, ontology=known)
        try:
            out = service.search(dict(x.split("=", 1) for x in a.args))
        except SearchError as e:
            out = e.payload
    else:
        zooms = tuple(int(z) for z in a.zooms.split(",")) if a.zooms else None
        found = tiles.list_layers(spark, a.file, a.lat, a.lon, zooms) if a.list_layers else tiles.inspect(spark, a.file, a.lat, a.lon, zooms, a.layer)
        out = {"header": tiles.header(spark, a.file).first().asDict(), "rows": [r.asDict(recursive=True) for r in found.collect()]}  # one point's tiles
    print(out if isinstance(out, str) else json.dumps(out, default=str, ensure_ascii=False))
    return out


if __name__ == "__main__":
    main(sys.argv[1:])
