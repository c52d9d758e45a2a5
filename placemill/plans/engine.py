"""Search over objects (direct modes) and over features and postings (index mode). A search is one lazy DataFrame."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from placemill.config import Config, Params
from placemill.functions import geo, shapes, text
from placemill.functions.frames import once
from placemill.operators import classify, filters, names, ranking
from placemill.operators.lookups import EVERY, Lookups, down_to, frontier, listed, near_terms, touching
from placemill.operators.ontology import with_levels

NEAR_M = 5000
#: Terms of a query and cells of a window that become a list in the scan.
MAX_TERMS, MAX_CELLS = 2_000, 1_000
#: Shares in which radius_counts deals the positions of a cell to tasks.
SHARES = 8
#: Features are fetched by cells if the hits are at most one in so many.
SELECTIVE = 50
#: A search without a text goes down lists by impact where its rarest filter has more features than this, and its page ends within so many hits.
LONG, DEEP = 100_000, 2_000
#: Rows of lists whose blocks are looked up to place a cut; beyond that the lists are read to their ends.
WIDE = 1 << 22
#: (field, boost) of the three ways in which a word meets a name; the last allows one edit.
_NAME = (("{}", 5.0, False), ("{}_edge_ngram", 1.0, False), ("{}", 0.5, True))


@dataclass(frozen=True)
class Ontology:
    """The parts of an ontology that are compiled into a search: levels by "key=value", tags by lower-cased label.

    A large ontology stays a table instead: its levels are joined to the objects, and a search looks its own text up in it.
    """

    levels: Mapping[str, int] = field(default_factory=dict)
    tags: Mapping[str, Sequence[tuple[str, str]]] = field(default_factory=dict)
    table: DataFrame | None = None
    found: dict[str, list[tuple[str, str]]] = field(default_factory=dict)

    @staticmethod
    def of(table: DataFrame) -> Ontology:
        from placemill.operators.ontology import MAX_LITERAL, level_map

        rows = table.select("label", "osm_key", "osm_value").limit(MAX_LITERAL + 1).collect()
        if len(rows) > MAX_LITERAL:
            raise ValueError(f"more than {MAX_LITERAL} labels: take Ontology.joined, or match many queries by operators.ontology.label_matches")
        return Ontology(level_map(table), Ontology._tags(rows))

    @staticmethod
    def joined(table: DataFrame) -> Ontology:
        return Ontology(table=table)

    @staticmethod
    def fitting(table: DataFrame) -> Ontology:
        """Compiled if the table is small, joined if not."""
        from placemill.operators.ontology import MAX_LITERAL

        return Ontology.of(table) if table.limit(MAX_LITERAL + 1).count() <= MAX_LITERAL else Ontology.joined(table)

    @staticmethod
    def built_in() -> Ontology:
        """The ontology that comes with the code, without a job."""
        from placemill.operators.ontology import built_in_rows

        levels: dict[str, int] = {}
        for _, level, _, key, value in built_in_rows():
            levels[f"{key}={value}"] = min(level, levels.get(f"{key}={value}", level))
        return Ontology(levels, Ontology._tags([r[2:] for r in built_in_rows()]))

    @staticmethod
    def _tags(rows: Sequence[tuple[str, str, str]]) -> dict[str, list[tuple[str, str]]]:
        tags: dict[str, list[tuple[str, str]]] = {}
        for label, key, value in rows:
            tags.setdefault(label.lower(), []).append((key, value))
        return tags

    def named(self, query: str) -> list[tuple[str, str]]:
        q = query.strip().lower()
        if self.table is not None:
            return self._looked_up(q)
        return list(self.tags.get(q) or (self.tags.get(q[:-1]) if q.endswith("s") else None) or [])


    def _looked_up(self, q: str) -> list[tuple[str, str]]:
        """Distinct tags of the label, or of the label without a final s; what is compiled into a search is bounded."""
        from placemill.operators.ontology import MAX_LITERAL

        if q not in self.found:
            for label in (q, q[:-1]) if q.endswith("s") else (q,):
                own = self.table.filter(F.lower("label") == label).select("osm_key", "osm_value").distinct()
                rows = own.orderBy("osm_key", "osm_value").limit(MAX_LITERAL + 1).collect()
                if len(rows) > MAX_LITERAL:
                    raise ValueError(f"the label {label} has more than {MAX_LITERAL} tags")
                if rows:
                    break
            self.found[q] = [tuple(r) for r in rows]
        return self.found[q]


def page(hits: DataFrame, p: Params) -> DataFrame:
    """Best first, ties by id, with rank from 1."""
    top = hits.orderBy(F.desc("score"), "id").offset(p.offset).limit(p.page_size)
    rank = F.row_number().over(W.orderBy(F.desc("score"), "id"))  # over one page
    return top.withColumn("rank", (rank + p.offset).cast("int"))


def numbered(hits: DataFrame, by: str) -> DataFrame:
    """All hits with rank from 1, the greatest of the column first, ties by id. Not for one page alone: ranges of the column are numbered in parallel and shifted by the rows before them.

    The hits are evaluated twice.
    """
    held = hits.withColumn("_range", F.floor(F.coalesce(F.col(by), F.lit(float("-inf"))) * 16))
    before = F.sum("count").over(W.orderBy(F.desc("_range"))) - F.col("count")  # over one row for each range
    shifts = held.groupBy("_range").count().select("_range", before.alias("_before"))
    own = F.row_number().over(W.partitionBy("_range").orderBy(F.desc(by), "id"))
    return held.withColumn("_own", own).join(F.broadcast(shifts), "_range").withColumn("rank", (F.col("_own") + F.col("_before")).cast("int")).drop("_range", "_own", "_before")


def deduplicated(hits: DataFrame) -> DataFrame:
    """One hit per id, the best; of equal scores the one with the greatest fields."""
    rest = [c for c in hits.columns if c not in ("id", "score")]
    return hits.groupBy("id").agg(F.max(F.struct("score", *rest)).alias("h")).select("id", "h.*").select(*hits.columns)


def direct_hits(objects: DataFrame, p: Params, conf: Config = Config(), ontology: Ontology = Ontology(), repeated: bool = False) -> DataFrame:
    """All objects that pass, with score: spatial filter first, then text, then class and fields. repeated: ids may occur several times, as in tiles."""
    lone = F.size("coords") == 1
    rows = objects
    if p.has_radius or p.has_box:
        if {"kind", "parts"} <= set(objects.columns):
            rows = rows.filter(shapes.coarse(F.col("kind"), F.col("parts"), p))
            rows = rows.filter(shapes.precise(F.col("kind"), F.col("parts"), p)) if conf.pmtiles_post_process else rows
        elif {"lat", "lon"} <= set(objects.columns):
            rows = rows.filter(filters.spatial_point(F.col("lat"), F.col("lon"), p))
        else:
            one = F.get(F.col("coords"), 0)
            rows = rows.filter(F.when(lone, filters.spatial_point(one["lat"], one["lon"], p)).otherwise(filters.spatial_shape(F.col("coords"), p)))
    plain = names.plain_name(F.col("tags"), conf.languages)
    renamed = F.map_concat(F.map_filter("tags", lambda k, _: k != "name"), F.map_filter(F.create_map(F.lit("name"), names.full_name(plain, F.col("tags"))), lambda _, v: v != ""))
    rows = once(rows, own=renamed)
    rows = rows.filter(filters.direct_text(F.col("own"), p))
    rows, levels = (rows, ontology.levels) if ontology.table is None else (with_levels(rows, ontology.table), F.col("levels"))
    rows = once(rows, classes=classify.classify(F.col("tags"), conf.importance, levels)).filter(F.size("classes") > 0).drop("tags").withColumnRenamed("own", "tags")
    rows = rows.filter(filters.direct_fields(F.col("tags"), F.col("classes"), p))
    tags, classes, q = F.col("tags"), F.col("classes"), F.lit(p.query)
    rank = names.tag(tags, "importance").try_cast("double")
    first = F.get(classes, 0)
    rows = rows.withColumn("importance", F.when(rank > 0, F.when(rank <= 20, 20 - rank).otherwise(rank)).otherwise(F.coalesce(rank, first["importance"])))
    known = names.name_values(tags, p.langs or conf.languages)
    if p.query:
        category = F.array_max(F.transform(classes, lambda c: ranking.category_match(q, c["key"], c["value"], ontology.named(p.query))))
        tier = F.array_max(F.transform(classes, lambda c: ranking.entity_tier(c["key"])))
        # without the flags every row that is left holds the query; what folding can make equal to it is short
        held = not p.prefix and not p.fuzzy
        values = text.short_enough(F.map_values(tags), p.query) if held else F.map_values(tags)
        rows = once(rows, values=text.folded(values), known=text.folded(known)).transform(lambda r: once(r, s_base=text.best_match(F.col("values"), p.query, held), s_name=text.best_match(F.col("known"), p.query), s_category=category, s_tier=tier, s_exact=text.exact_match(F.col("known"), q)))
        score = ranking.shared_score(q, F.col("s_base"), F.col("s_name"), F.col("s_category"), F.col("s_tier"), F.col("importance"), F.col("s_exact"), F.size("known") > 0)
    else:
        score = F.greatest(F.col("importance"), F.lit(0.0)) * 1000
    keep = ["id", "lat", "lon"] if {"lat", "lon"} <= set(objects.columns) else ["id"]
    by_language = [names.tag(tags, f"name:{x}").alias(f"name:{x}") for x in p.langs]
    far = [geo.haversine_m(F.col("lat"), F.col("lon"), F.lit(p.lat), F.lit(p.lon)).alias("distance")] if p.has_radius and len(keep) > 1 else []
    out = rows.select(*keep, *by_language, *far, names.tag(tags, "name").alias("name"), first["key"].alias("key"), first["value"].alias("value"), F.col("importance"), F.round(score, 6).alias("score"), names.short_address(tags).alias("address"), names.phone(tags).alias("phone"))
    return deduplicated(out) if repeated else out


def _reference(hits: DataFrame) -> tuple[float, float] | None:
    best = hits.filter("lat is not null and lon is not null").orderBy(F.desc("score"), "id").select("lat", "lon").first()
    return (best["lat"], best["lon"]) if best else None


def direct_all(objects: DataFrame, p: Params, conf: Config = Config(), ontology: Ontology = Ontology(), repeated: bool = False) -> DataFrame:
    """All hits; "X near Y" finds Y first and then X around it, with the other filters kept."""
    if p.near:
        what, where = p.near
        at = _reference(direct_hits(objects, Params(query=where, fuzzy=p.fuzzy, prefix=p.prefix, langs=p.langs), conf, ontology, repeated))
        if at is None:
            return direct_hits(objects, replace(p, query=what), conf, ontology, repeated).filter(F.lit(False))
        p = replace(p, query=what, lat=at[0], lon=at[1], radius=p.radius or f"{NEAR_M}m", min_lat=None, max_lat=None, min_lon=None, max_lon=None)
    return direct_hits(objects, p, conf, ontology, repeated)


def direct_search(objects: DataFrame, p: Params, conf: Config = Config(), ontology: Ontology = Ontology(), repeated: bool = False) -> DataFrame:
    """A page of direct_all."""
    return page(direct_all(objects, p, conf, ontology, repeated), p)


# --- index mode --------------------------------------------------------------------------------------------------


def _name_clauses(words: Sequence[str], name: str) -> list[tuple[str, str, float, bool]]:
    return [(f.format(name), w, boost, fuzzy) for w in words for f, boost, fuzzy in _NAME]


def clauses(query: str, ontology: Ontology, place_intent: bool, several: bool = True) -> list[tuple[int, float, list[list[tuple[str, str, float, bool]]]]]:
    """(number, boost, parts) of each reading of the query; several: more than the one as a whole. A part is met by any of its clauses (field, term, boost, one edit); a reading by all of its parts."""
    folded = text.fold_now(query)
    words = [w for w in text.words_now(folded) if w not in text.STOP_WORDS]
    kinds = ontology.named(query)
    whole = _name_clauses(words, "name") + _name_clauses(words, "search_names")
    if len(folded.split()) == 1 and not place_intent:
        whole += [(f, folded, b, False) for f, b in (("value", 7.0), ("values", 6.0), ("key", 2.0), ("keys", 1.5))]
    category = lambda found: [(f, v.lower(), b, False) for _, v in found for f, b in (("value", 8.0), ("values", 7.0))]
    out = [(0, 1.0, [whole + category(kinds)])]
    terms = query.split()
    if len(terms) > 1 and several:
        each = [_name_clauses([w for w in text.words_now(text.fold_now(t)) if w not in text.STOP_WORDS], "name") for t in terms]
        if kinds:
            out.append((1, 1.0, [category(kinds)]))
        out.append((2, 0.9, each))
        if first := ontology.named(terms[0]):
            out.append((3, 0.9, [category(first), [c for e in each[1:] for c in e]]))
        out.append((4, 0.8, each))
    return [(n, b, parts) for n, b, parts in out if all(parts)]


def asked_fields(p: Params, ontology: Ontology) -> set[str]:
    """Fields of the postings that a search may look at."""
    said = {f for q in p.near or (p.query,) for _, _, parts in clauses(q, ontology, False) for part in parts for f, *_ in part}
    return said | {f for fields in filters.field_terms(p) for f, _ in fields}


@dataclass(frozen=True)
class Found:
    """id, cell, base of what the postings hold, and the most hits that it can be of so many features."""

    hits: DataFrame
    most: int
    of: int


def base_scores(posts: DataFrame, stats: DataFrame, query: str, ontology: Ontology = Ontology(), place_intent: bool = True, several: bool = True, tables: Lookups = Lookups(), exact: bool = False) -> Found:
    """Relevance of what the postings hold, over all readings of the query. Parts of a reading are counted, so a reading needs all of them.

    The terms that the query meets are looked up first: by equality, and within one edit by their keys where the index has these. While they are few,
    as they are for words, they become a plain list, so that the scan of the postings skips all row groups without them.
    exact: the words of names alone, as they are.
    """
    spark = posts.sparkSession
    readings = [(0, 1.0, [[("name", w, 1.0, False) for w in text.standard_words(text.fold_now(query))]])] if exact else clauses(query, ontology, place_intent, several)
    rows = [(n, boost, i, len(parts), *c) for n, boost, parts in readings for i, part in enumerate(parts) for c in part]
    asked = spark.createDataFrame(rows, "reading int, weight double, part int, parts int, field string, word string, boost double, fuzzy boolean")
    own = stats.filter(F.col("field").isin(*sorted({r[4] for r in rows})))
    if tables.neighbours is None:
        near = (F.abs(F.octet_length("term") - F.octet_length("word")) <= 1) & text.within_one_edit(F.col("term"), F.col("word"))
        # once more with the words as literals, which go down to the terms before these are counted
        edited = lambda w: F.octet_length("term").between(len(w.encode()) - 1, len(w.encode()) + 1) & text.within_one_edit(F.col("term"), F.lit(w))
        some = [(F.col("field") == f) & (edited(w) if fuzzy else F.col("term") == w) for f, w, fuzzy in sorted({(r[4], r[5], r[7]) for r in rows})]
        own = own.filter(reduce(Column.__or__, some)) if some else own
        terms = own.join(F.broadcast(asked), "field").filter(F.when(F.col("fuzzy"), near).otherwise(F.col("term") == F.col("word")))
    else:
        same = own.filter(F.col("term").isin(*sorted({r[5] for r in rows}))).join(F.broadcast(asked.filter("not fuzzy")), "field").filter("term = word")
        terms = same.unionByName(near_terms(tables.neighbours, asked.filter("fuzzy"), {(r[4], r[5]) for r in rows if r[7]})) if any(r[7] for r in rows) else same
    few = terms.limit(MAX_TERMS + 1).collect()
    most, of = 1 << 62, max((r["n_docs"] for r in few), default=0)
    if len(few) <= MAX_TERMS:
        most = sum({(r["field"], r["term"]): r["df"] for r in few}.values())
        terms = F.broadcast(spark.createDataFrame(few, terms.schema))
        posts = posts.filter(F.col("field").isin(*sorted({r["field"] for r in few})) & F.col("term").isin(*sorted({r["term"] for r in few}))) if few else posts.limit(0)
    found = posts.join(terms, ["field", "term"])
    weight = F.sqrt("tf") * (1 + F.ln(F.col("n_docs") / (F.col("df") + 1))) / F.sqrt("field_len") * F.col("boost")
    part = found.groupBy("id", "cell", "reading", "weight", "parts", "part").agg(F.sum(weight).alias("s"))
    whole = part.groupBy("id", "cell", "reading", "weight", "parts").agg(F.sum("s").alias("s"), F.count("*").alias("n")).filter("n = parts")
    return Found(whole.groupBy("id", "cell").agg(F.sum(F.col("s") * F.col("weight")).alias("base")), most, of)


def filtered_ids(posts: DataFrame, p: Params) -> DataFrame:
    """id, cell of the features that the postings show to pass all key, value, address and contact filters."""
    asked = filters.field_terms(p)
    alternatives = [(n, f, terms) for n, fields in enumerate(asked) for f, terms in fields if terms]
    if {n for n, *_ in alternatives} != set(range(len(asked))):
        return posts.select("id", "cell").limit(0)  # a filter without a word
    met = lambda f, terms: (F.col("field") == f) & F.col("term").isin(*terms)
    of = F.coalesce(*[F.when(met(f, terms), n) for n, f, terms in alternatives])
    some = posts.filter(listed([(f, terms) for _, f, terms in alternatives]))
    return some.select("id", "cell", of.alias("n")).groupBy("id", "cell").agg(F.count_distinct("n").alias("n")).filter(F.col("n") == len(asked)).select("id", "cell")


def best_filtered(ranked: DataFrame, blocks: DataFrame, stats: DataFrame, p: Params, long: int = LONG) -> DataFrame | None:
    """id, cell of the hits up to the page's end of a search by filters alone, in the order of their scores; None where reading whole lists is as well.

    Blocks of the rarest filter's lists, the greatest impacts first, give an impact down to which these hold rows enough. All lists are cut there:
    a feature has one impact, so what passes all filters above the cut is just the best hits. If they don't fill the page, the cut moves down eightfold,
    at last to the lists' ends. Bounded by the page, not by the lists.
    """
    asked, need = filters.field_terms(p) or [[(EVERY, ("",))]], p.offset + p.page_size
    if need > DEEP or not all(any(terms for _, terms in fields) for fields in asked):
        return None
    asked = [[(f, terms) for f, terms in fields if terms] for fields in asked]
    sizes = [0] * len(asked)
    for r in stats.filter(listed([x for fields in asked for x in fields])).select("field", "term", "df").collect() if asked[0][0][0] != EVERY else []:  # the terms of a request
        for n, fields in enumerate(asked):
            sizes[n] += r["df"] * any(f == r["field"] and r["term"] in terms for f, terms in fields)
    rarest = min(range(len(asked)), key=sizes.__getitem__)
    if asked[0][0][0] != EVERY and sizes[rarest] <= long:
        return None
    rows = need
    while True:
        edge = frontier(blocks, asked[rarest], rows) if rows <= WIDE else None
        of = F.array_compact(F.array(*[F.when(listed(fields), n) for n, fields in enumerate(asked)]))
        some = ranked.filter(listed([x for fields in asked for x in fields]) & down_to(edge)).select("id", "cell", "impact", F.explode(of).alias("n"))
        passed = some.groupBy("id", "cell", "impact").agg(F.count_distinct("n").alias("n")).filter(F.col("n") == len(asked))
        top = passed.orderBy(F.desc("impact"), "id").limit(need).select("id", "cell").collect()  # at most DEEP
        if edge is None or len(top) == need:
            return ranked.sparkSession.createDataFrame(top, "id string, cell long")
        rows *= 8


def _fetched(features: DataFrame, hits: DataFrame, selective: bool) -> DataFrame:
    """The features of hits (id, cell). Few cells become a list in the scan of the features, which skips all others."""
    if selective and "cell" in features.columns:
        cells = [r["cell"] for r in hits.select("cell").distinct().limit(MAX_CELLS + 1).collect()]
        if len(cells) <= MAX_CELLS:
            features = features.filter(F.col("cell").isin(*cells)) if cells else features.filter(F.lit(False))
    return features.join(hits.drop("cell"), "id")


def index_hits(features: DataFrame, posts: DataFrame, stats: DataFrame, p: Params, conf: Config = Config(), ontology: Ontology = Ontology(), tables: Lookups = Lookups(), exact: bool = False) -> DataFrame:
    """All features that match, with base and final score. Filters hold for every kind of query, and ranking is global.

    Words and filters are answered by postings, and only the features of their hits are read. exact: only features whose name is the query.
    """
    q = F.lit(p.query)
    rows, by_shape = features, not conf.geometry_mode.startswith("geopoint")
    if (p.has_radius or p.has_box) and by_shape and conf.geometry_mode != "no-geo" and tables.shapes is not None:
        rows = touching(tables.shapes, geo.Window(p.min_lat, p.max_lat, p.min_lon, p.max_lon) if p.has_box and not p.has_radius else geo.Window.around(p.lat, p.lon, p.radius_m))
    if (p.has_radius or p.has_box) and conf.geometry_mode.startswith("geopoint"):
        rows = rows.filter(_cells(p))
    if (p.has_radius or p.has_box) and conf.geometry_mode != "no-geo":
        if conf.geometry_mode.startswith("geopoint"):
            lat, lon = F.col("geom.lat"), F.col("geom.lon")
            one = replace(p, min_lat=None) if p.has_radius else p
            rows = rows.filter(filters.spatial_point(lat, lon, one))
        else:
            rows = rows.filter(filters.spatial_shape(F.col("geom.coords"), p))
    spatial = p.has_radius or p.has_box
    if p.query.strip():
        found = base_scores(posts, stats, p.query, ontology, p.place_intent, not p.fuzzy and not p.prefix, tables, exact)
        hits = found.hits.join(filtered_ids(posts, p).select("id"), "id") if filters.field_terms(p) else found.hits
        if exact:
            hits = hits.join(tables.names.filter(F.col("folded") == text.fold_now(p.query.strip())).select("id"), "id", "left_semi")
        rows = _fetched(rows, hits, tables.names is not None and not spatial and SELECTIVE * found.most <= found.of)
    elif filters.field_terms(p):
        rows = _fetched(rows, filtered_ids(posts, p), tables.names is not None and not spatial).withColumn("base", F.lit(1.0))
    else:
        rows = rows.withColumn("base", F.lit(1.0))
    seen = F.col("names") if conf.store_secondary_names else F.map_filter("names", lambda k, v: F.lit(False))
    known = F.filter(F.concat(F.array("name"), F.map_values(seen)), lambda v: v != "")
    if conf.store_metadata:
        key, value, importance = F.col("key"), F.col("value"), F.col("importance")
        category = F.array_max(F.transform(F.concat(F.array("value"), "values"), lambda v: ranking.category_match(q, key, v, ontology.named(p.query))))
        tier = F.array_max(F.transform(F.concat(F.array("key"), "keys"), lambda k: ranking.entity_tier(k)))
    else:
        key, value, importance, category, tier = F.lit(""), F.lit(""), F.lit(0.0), F.lit(0.0), F.lit(0)
    rows = once(rows, known=text.folded(known)).transform(lambda r: once(r, s_name=text.best_match(F.col("known"), p.query), s_category=category, s_tier=tier, s_exact=text.exact_match(F.col("known"), q)))
    score = ranking.shared_score(q, F.col("base"), F.col("s_name"), F.col("s_category"), F.col("s_tier"), importance, F.col("s_exact"), F.size("known") > 0)
    at = [(F.col(f"geom.{c}") if conf.store_geometry else F.lit(None).cast("double")).alias(c) for c in ("lat", "lon")]
    by_language = [F.coalesce(F.try_element_at("names", F.lit(f"name:{x}")), F.lit("")).alias(f"name:{x}") for x in p.langs]
    far = [geo.haversine_m(F.col("geom.lat"), F.col("geom.lon"), F.lit(p.lat), F.lit(p.lon)).alias("distance")] if p.has_radius and conf.store_geometry and conf.geometry_mode.startswith("geopoint") else []
    return rows.select("id", "name", *by_language, *far, key.alias("key"), value.alias("value"), importance.alias("importance"), *at, F.round("base", 6).alias("base"), F.round(score, 6).alias("score"), "display_address")


def _cells(p: Params) -> Column:
    """The grid cells of the window, as a list or a range, so that the scan skips files and row groups of others."""
    from placemill.operators.features import GRID_ZOOM
    from placemill.operators.tiles import tile_range

    window = geo.Window.around(p.lat, p.lon, p.radius_m) if p.has_radius else geo.Window(p.min_lat, p.max_lat, p.min_lon, p.max_lon)
    window = geo.Window(max(window.min_lat, -85.0), min(window.max_lat, 85.0), window.min_lon, window.max_lon)
    if window.min_lat > window.max_lat or window.min_lon > window.max_lon or max(abs(window.min_lat), abs(window.max_lat)) >= 85.0:
        return F.lit(True)
    x1, y1, x2, y2 = tile_range(window, GRID_ZOOM)
    if (x2 - x1 + 1) * (y2 - y1 + 1) > MAX_CELLS:
        return F.col("cell").between((x1 << GRID_ZOOM) + y1, (x2 << GRID_ZOOM) + y2)
    return F.col("cell").isin(*[(x << GRID_ZOOM) + y for x in range(x1, x2 + 1) for y in range(y1, y2 + 1)])


def index_all(features: DataFrame, posts: DataFrame, stats: DataFrame, p: Params, conf: Config = Config(), ontology: Ontology = Ontology(), tables: Lookups = Lookups()) -> DataFrame:
    """All hits; "X near Y" finds Y first and then X around it, with the other filters kept."""
    if p.near:
        what, where = p.near
        at = _reference(index_hits(features, posts, stats, Params(query=where, langs=p.langs), conf, ontology, tables))
        rest = replace(p, query=what, min_lat=None, max_lat=None, min_lon=None, max_lon=None)
        if at is None:
            return index_hits(features, posts, stats, rest, conf, ontology, tables).filter(F.lit(False))
        p = replace(rest, lat=at[0], lon=at[1], radius=p.radius or f"{NEAR_M}m")
    return index_hits(features, posts, stats, p, conf, ontology, tables)


def exact_first(features: DataFrame, posts: DataFrame, stats: DataFrame, p: Params, conf: Config = Config(), ontology: Ontology = Ontology(), tables: Lookups = Lookups()) -> DataFrame:
    """All hits; for a short text that asks for a place, those alone that have it as their name, where these fill the page.

    Where they don't, they are among all hits already, and need no merging in.
    """
    if p.place_intent and tables.names is not None:
        need = p.offset + p.page_size
        same = tables.names.filter(F.col("folded") == text.fold_now(p.query.strip()))
        if same.limit(need).count() == need:
            hits = index_hits(features, posts, stats, p, conf, ontology, tables, exact=True)
            if not (p.has_radius or p.has_box) or hits.limit(need).count() == need:
                return hits
    return index_all(features, posts, stats, p, conf, ontology, tables)


def best_page(features: DataFrame, posts: DataFrame, stats: DataFrame, p: Params, conf: Config = Config(), ontology: Ontology = Ontology(), tables: Lookups = Lookups(), long: int = LONG) -> DataFrame | None:
    """The page of a search by filters alone, read from the heads of lists by impact; None where these don't serve."""
    if p.query.strip() or p.has_radius or p.has_box or tables.ranked is None or tables.blocks is None or not conf.store_metadata:
        return None
    best = best_filtered(tables.ranked, tables.blocks, stats, p, long)
    if best is None:
        return None
    few = _fetched(features, best, True).select(*features.columns)
    return page(index_hits(few, posts, stats, Params(langs=p.langs), conf, ontology), p)


def index_search(features: DataFrame, posts: DataFrame, stats: DataFrame, p: Params, conf: Config = Config(), ontology: Ontology = Ontology(), tables: Lookups = Lookups()) -> DataFrame:
    """A page of exact_first. A search by filters alone reads the best of its lists where the index has these by impact."""
    best = best_page(features, posts, stats, p, conf, ontology, tables)
    return page(exact_first(features, posts, stats, p, conf, ontology, tables), p) if best is None else best


def exact_names(features: DataFrame, queries: DataFrame) -> DataFrame:
    """qid, id: features whose name is the query, folded. queries: qid, query."""
    asked = queries.select("qid", text.fold(text.trim(F.col("query"))).alias("folded")).filter("folded <> ''")
    return asked.join(features.select("id", text.fold(text.trim(F.col("name"))).alias("folded")), "folded").select("qid", "id")


# --- many queries at once ----------------------------------------------------------------------------------------


def window_cells(radius_m: int, zoom: int, at: tuple[str, str] = ("lat", "lon")) -> Column:
    """The grid cells that a radius around a position touches."""
    lat, lon = F.col(at[0]), F.col(at[1])
    up = F.lit(radius_m / 111_000)
    side = F.lit(float(radius_m)) / (F.cos(F.radians(lat)) * F.lit(6_367_000 * 3.141592653589793 / 180))
    (x1, y1), (x2, y2) = geo.tile_xy(lon - side, lat + up, zoom), geo.tile_xy(lon + side, lat - up, zoom)
    return F.flatten(F.transform(F.sequence(x1, x2), lambda x: F.transform(F.sequence(y1, y2), lambda y: x * (1 << zoom) + y)))


def radius_join(left: DataFrame, right: DataFrame, radius_m: int, left_id: str, right_id: str, zoom: int = 11, at: tuple[str, str] = ("lat", "lon")) -> DataFrame:
    """Pairs within the radius: both sides are dealt to grid cells, the left to every cell that its window touches.

    Cells are much wider than the radius where the caller picks the zoom so; a dense cell is a hot key of an equi-join, which Spark can split.
    """
    lat, lon = F.col(at[0]), F.col(at[1])
    a = left.select(F.col(left_id).alias("left_id"), lat.alias("lat1"), lon.alias("lon1"), F.explode(window_cells(radius_m, zoom, at)).alias("cell"))
    x, y = geo.tile_xy(lon, lat, zoom)
    b = right.select(F.col(right_id).alias("right_id"), lat.alias("lat2"), lon.alias("lon2"), (x * (1 << zoom) + y).alias("cell"))
    d = geo.haversine_m(F.col("lat1"), F.col("lon1"), F.col("lat2"), F.col("lon2"))
    return a.join(b, "cell").withColumn("metres", d).filter(F.col("metres") <= radius_m).select("left_id", "right_id", "metres")


def radius_counts(left: DataFrame, right: DataFrame, radius_m: int, left_id: str, zoom: int = 13, at: tuple[str, str] = ("lat", "lon")) -> DataFrame:
    """left_id, n, nearest_m: how many of the right lie within the radius of each of the left that has any, as radius_join has them, without a row for each pair.

    What lies at one position is one row with its number, on both sides, so the work follows the positions that occur and not the pairs.
    """
    lat, lon = at
    a = left.select(F.col(lat).alias("lat1"), F.col(lon).alias("lon1")).distinct()
    b = right.groupBy(F.col(lat).alias("lat2"), F.col(lon).alias("lon2")).agg(F.count("*").alias("n"))
    x, y = geo.tile_xy(F.col("lon2"), F.col("lat2"), zoom)
    share = F.pmod(F.xxhash64("lat1", "lon1"), F.lit(SHARES))
    spread = a.select("lat1", "lon1", share.alias("share"), F.explode(window_cells(radius_m, zoom, ("lat1", "lon1"))).alias("cell"))
    b = b.select("*", (x * (1 << zoom) + y).alias("cell"), F.explode(F.sequence(F.lit(0), F.lit(SHARES - 1)).cast("array<long>")).alias("share"))
    # the number is explicit: AQE would choose a few by the size of the inputs
    n = max(int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")), 4 * left.sparkSession.sparkContext.defaultParallelism)
    pairs = spread.repartition(n, "cell", "share").join(b.repartition(n, "cell", "share"), ["cell", "share"])
    met = pairs.withColumn("m", geo.haversine_m(F.col("lat1"), F.col("lon1"), F.col("lat2"), F.col("lon2"))).filter(F.col("m") <= radius_m)
    found = met.groupBy("lat1", "lon1").agg(F.sum("n").alias("n"), F.min("m").alias("nearest_m"))
    own = left.select(F.col(left_id).alias("left_id"), F.col(lat).alias("lat1"), F.col(lon).alias("lon1"))
    return own.join(found, ["lat1", "lon1"]).select("left_id", "n", "nearest_m")


def near_batch(queries: DataFrame, features: DataFrame, radius_m: int = NEAR_M, zoom: int = 11) -> DataFrame:
    """qid, ref_id, n_hits, nearest_m for queries of the form "X near Y": Y is the most important feature with that word in its name, X all within the radius that have it."""
    what, where = text.near_parts(F.col("query"))
    asked = queries.select("qid", text.fold(what).alias("what"), text.fold(where).alias("where")).filter("what is not null")
    own = features.select("id", "lat", "lon", "importance", F.array_distinct(text.tokens(text.fold(F.col("name")))).alias("named"))
    words = own.select("id", "lat", "lon", "importance", F.explode("named").alias("word"))
    wheres = asked.select("qid", "what", F.explode(F.array_distinct(text.tokens(F.col("where")))).alias("word"))
    # the best feature of each word first, so that a query meets one row for a word, however common it is
    best = F.max(F.struct(F.round("importance", 6).alias("importance"), "id", "lat", "lon"))
    refs = wheres.join(words.groupBy("word").agg(best.alias("r")), "word").groupBy("qid", "what").agg(F.max("r").alias("r"))
    refs = refs.select("qid", "what", F.col("r.id").alias("ref_id"), F.col("r.lat").alias("lat"), F.col("r.lon").alias("lon"))
    # queries that ask for the same words around the same feature are one question, however many they are
    asked = refs.withColumn("words", F.array_sort(F.array_distinct(text.tokens(F.col("what")))))
    questions = asked.groupBy("words", "ref_id").agg(F.max(F.struct("lat", "lon")).alias("at"))
    whats = questions.select("words", "ref_id", F.col("at.lat").alias("lat1"), F.col("at.lon").alias("lon1")).withColumn("cell", F.explode(window_cells(radius_m, zoom, ("lat1", "lon1"))))
    whats = whats.select("*", F.explode("words").alias("word"))
    # a feature counts at the first of its places that is a hit, with the first of the words there: so hits are added up as they come, and no list of them is held to tell them apart
    spots = own.filter("lat is not null and lon is not null").groupBy("id").agg(F.array_sort(F.collect_set(F.struct("lat", "lon", "named"))).alias("spots"))
    spots = spots.select("id", "spots", F.posexplode("spots").alias("nth", "spot")).select("id", "spot.*", F.slice("spots", F.lit(1), F.col("nth")).alias("earlier"))
    x, y = geo.tile_xy(F.col("lon"), F.col("lat"), zoom)
    spots = spots.select("*", (x * (1 << zoom) + y).alias("cell"), F.explode("named").alias("word"))
    away = lambda lat, lon: geo.haversine_m(lat, lon, F.col("lat1"), F.col("lon1"))
    hits = whats.join(spots, ["word", "cell"]).withColumn("m", away(F.col("lat"), F.col("lon"))).filter(F.col("m") <= radius_m)
    met = F.exists("earlier", lambda e: (away(e["lat"], e["lon"]) <= radius_m) & F.arrays_overlap(e["named"], "words"))
    first = F.col("id").isNotNull() & (F.get(F.array_intersect("words", "named"), F.lit(0)) == F.col("word")) & ~met
    found = hits.groupBy("words", "ref_id").agg(F.count_if(first).alias("n_hits"), F.min("m").alias("nearest_m"))
    return asked.select("qid", "ref_id", "words").join(found, ["words", "ref_id"]).select("qid", "ref_id", "n_hits", "nearest_m")


def text_block(hits: DataFrame, total: DataFrame) -> DataFrame:
    """rank, block: hits as plain text, and a last row with the totals. total: one row with the number of all hits."""
    line = lambda label, c: F.when(c != "", F.concat(F.lit(f"{label}: "), c))
    address = F.col("address" if "address" in hits.columns else "display_address")
    parts = [F.concat(F.lit("id: "), "id"), F.format_string("score: %.6f", "score"), line("name", F.col("name")), line("key", F.col("key")), line("value", F.col("value")), F.format_string("importance: %.6f", "importance"), F.when(F.col("lat").isNotNull(), F.format_string("lat: %.5f", "lat")), F.when(F.col("lon").isNotNull(), F.format_string("lon: %.5f", "lon")), line("address", address)]
    parts += [line("phone", F.col("phone"))] if "phone" in hits.columns else []
    blocks = hits.select("rank", F.array_join(F.filter(F.array(*parts), lambda x: x.isNotNull()), "\n").alias("block"))
    counts = hits.agg(F.count("*").alias("returned")).join(total, F.lit(True))  # one row each
    return blocks.unionByName(counts.select(F.lit(1_000_000_000).alias("rank"), F.format_string("---\ntotal: %d\nreturned: %d", "total", "returned").alias("block")))


def totals(hits: DataFrame) -> DataFrame:
    return hits.agg(F.count("*").alias("total"))


def as_json(hits: DataFrame) -> DataFrame:
    return hits.select("rank", F.to_json(F.struct(*[c for c in hits.columns if c != "rank"])).alias("json"))
