"""A service over named sources: routing by mode, totals, formats, and versions that are swapped while it runs."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from placemill.config import Config, Params
from placemill.operators import tiles
from placemill.operators.lookups import Lookups
from placemill.plans import engine


class SearchError(Exception):
    def __init__(self, code: str, text: str, status: int):
        super().__init__(text)
        self.payload = {"error": text, "code": code, "status": status}


@dataclass(frozen=True)
class Index:
    features: DataFrame
    postings: DataFrame
    statistics: DataFrame
    tables: Lookups = field(default_factory=Lookups)

    @staticmethod
    def read(spark: SparkSession, path: str, shapes: bool = False, ranked: bool = False) -> Index:
        """shapes: the index was built in a mode of shapes; ranked: with lists by impact."""
        table = lambda name: spark.read.parquet(f"{path}/{name}")
        return Index(table("features"), table("postings"), table("statistics"), Lookups(table("neighbours"), table("names"), table("shapes") if shapes else None, *((table("ranked"), table("blocks")) if ranked else ())))


@dataclass
class Service:
    """Sources by name: indexes, object tables (direct scans) and tile-feature tables. Names are taken in order where none is given."""

    indexes: Mapping[str, Index] = field(default_factory=dict)
    objects: Mapping[str, DataFrame] = field(default_factory=dict)
    tiles: Mapping[str, DataFrame] = field(default_factory=dict)
    conf: Config = field(default_factory=Config)
    ontology: engine.Ontology = field(default_factory=engine.Ontology)

    def _route(self, mode: str, name: str) -> tuple[str, str]:
        found = {"pbf": self.objects, "pmtiles": self.tiles, "index": self.indexes}
        if mode and mode not in found:
            raise SearchError("bad_mode", f"unknown mode {mode}", 400)
        for kind in [mode] if mode else ["index", "pbf", "pmtiles"]:
            if name in found[kind] or (not name and found[kind]):
                return kind, name or min(found[kind])
        raise SearchError("no_source", f"no source for mode {mode or 'any'}" + (f" named {name}" if name else ""), 400)

    def hits(self, p: Params, mode: str = "", name: str = "") -> DataFrame:
        """All hits, lazily and unordered."""
        kind, name = self._route(mode, name)
        if kind == "index":
            i = self.indexes[name]
            return engine.exact_first(i.features, i.postings, i.statistics, p, self.conf, self.ontology, i.tables)
        rows = self.objects[name] if kind == "pbf" else tiles.objects(self.tiles[name], self.conf.languages)
        return engine.direct_all(rows, p, self.conf, self.ontology, repeated=kind == "pmtiles")

    def page(self, hits: DataFrame, p: Params, mode: str = "", name: str = "") -> DataFrame:
        """The page of hits; from lists by impact where an index has them."""
        kind, name = self._route(mode, name)
        best = None
        if kind == "index":
            i = self.indexes[name]
            best = engine.best_page(i.features, i.postings, i.statistics, p, self.conf, self.ontology, i.tables)
        return engine.page(hits, p) if best is None else best

    def search(self, args: Mapping[str, str]) -> dict | str:
        """A request's arguments to a result: a page with the total of all hits, or, with format=text, both as plain text."""
        p = Params.from_query(args, self.conf.languages)
        hits = self.hits(p, args.get("mode", ""), args.get("index", ""))
        if args.get("format") == "text":
            return "\n\n".join(r["block"] for r in engine.text_block(engine.page(hits, p), engine.totals(hits)).orderBy("rank").collect())
        total = engine.totals(hits).first()["total"]
        page = [r.asDict(recursive=True) for r in self.page(hits, p, args.get("mode", ""), args.get("index", "")).orderBy("rank").collect()]  # at most 1000
        return {"from": p.offset, "limit": p.page_size, "total": total, "returned": len(page), "hits": page}

    def swap(self, **sources: Mapping) -> None:
        """Replace sources by new versions; searches that run go on with the old ones."""
        for kind, named in sources.items():
            setattr(self, kind, {**getattr(self, kind), **named})

    def capabilities(self) -> dict:
        kinds = {"index": sorted(self.indexes), "pbf": sorted(self.objects), "pmtiles": sorted(self.tiles)}
        return {"modes": [k for k, v in kinds.items() if v], "default_mode": next((k for k, v in kinds.items() if v), None), "sources": kinds, "languages": list(self.conf.languages), "geometry_mode": self.conf.geometry_mode, "formats": ["json", "text"]}

    def health(self) -> dict:
        return {"status": "ok" if any((self.indexes, self.objects, self.tiles)) else "empty", "sources": len(self.indexes) + len(self.objects) + len(self.tiles)}
