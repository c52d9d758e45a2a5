"""The feature table and its postings: what an index build writes."""

from __future__ import annotations

from collections.abc import Callable, Collection, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placemill.config import Config
from placemill.functions import geo, text
from placemill.functions.frames import once, opened
from placemill.operators import classify, geometry, lookups, names, ontology

GRID_ZOOM = 10
FIELDS = {"name": "standard", "name_edge_ngram": "edge_ngram", "search_names": "standard", "search_names_edge_ngram": "edge_ngram", "key": "keyword", "value": "keyword", "keys": "keyword", "values": "keyword"}
#: Fields of address and contact that filters ask for.
WORDED, WHOLE = ("addr:street", "addr:city", "addr:country"), ("addr:housenumber", "addr:postcode", "addr:floor", "addr:unit", "level")
CONTACT = ("phone", "wheelchair", "opening_hours", "display_address")
#: Fields whose lists an index may also hold by impact: those of filters.
LISTS = ("key", "value", "keys", "values", *WORDED, *WHOLE, "phone", "wheelchair", "opening_hours")
FIELDS |= dict.fromkeys(WORDED, "standard") | dict.fromkeys((*WHOLE, *CONTACT), "keyword")


def _placed(objects: DataFrame) -> DataFrame:
    return objects.filter((F.size("tags") > 0) & (F.size("coords") > 0))


def _asked(rows: DataFrame, conf: Config) -> DataFrame:
    if conf.nodes_only and "entity_type" in rows.columns:
        rows = rows.filter("entity_type = 'node'")
    return rows.filter(names.has_name(F.col("tags"), conf.languages)) if conf.only_named else rows


def kept(objects: DataFrame, conf: Config) -> DataFrame:
    """The objects that build makes features of, as they are."""
    return _asked(_placed(objects).filter(F.size(classify.known_keys(F.col("tags"))) > 0), conf)


def build(objects: DataFrame, conf: Config, levels: Mapping[str, int] | DataFrame | None = None) -> DataFrame:
    """Features of tagged, located objects. Objects without tags, class, coordinates, or (only_named) name are left out.

    levels: the ontology's, compiled into the expressions, or an ontology of any size, which is joined.
    """
    tags = F.col("tags")
    rows = _placed(objects)
    rows, known = (ontology.with_levels(rows, levels), F.col("levels")) if isinstance(levels, DataFrame) else (rows, levels)
    rows = once(rows, classes=classify.classify(tags, conf.importance, known)).filter(F.size("classes") > 0)
    rows = _asked(rows, conf)
    rows = geometry.locate(once(opened(rows, classify.best(F.col("classes")), "key", "value", "importance", "ont_level"), plain=names.plain_name(tags, conf.languages)), conf.geometry_mode, conf.simplification_tolerance)
    none = F.array().cast("array<string>")
    lists = [none, none] if conf.disable_key_value else [F.transform("classes", lambda c: c["key"]), F.transform("classes", lambda c: c["value"])]
    centre = F.get(F.col("coords"), 0)
    # where searches look for a feature: at its point, if it has one
    at = [F.col(f"geom.{c}") if conf.geometry_mode.startswith("geopoint") else centre[c] for c in ("lon", "lat")]
    x, y = geo.tile_xy(*at, GRID_ZOOM)
    kept = [names.address(tags) if conf.store_address else F.map_filter(tags, lambda k, v: F.lit(False)), names.display_address(tags) if conf.store_address else F.lit("")]
    contact = [c if conf.store_contact_info else F.lit("") for c in (names.phone(tags), names.tag(tags, "wheelchair"), names.tag(tags, "opening_hours"))]
    return rows.select(
        "id",
        "entity_type",
        "osm_id",
        names.full_name(F.col("plain"), tags).alias("name"),
        names.other_names(tags, conf.languages, not conf.disable_alt_names).alias("names"),
        "key",
        "value",
        lists[0].alias("keys"),
        lists[1].alias("values"),
        (F.lit(0.0) if conf.disable_importance else F.col("importance")).alias("importance"),
        "tags",
        kept[0].alias("address"),
        kept[1].alias("display_address"),
        contact[0].alias("phone"),
        contact[1].alias("wheelchair"),
        contact[2].alias("opening_hours"),
        "geom",
        centre["lat"].alias("lat"),
        centre["lon"].alias("lon"),
        (x * (1 << GRID_ZOOM) + y).alias("cell"),
    )


def _one(f: Callable[[Column], Column]) -> Callable[[Column], Column]:
    """Of one argument, as transform() would pass a place to a second one."""
    return lambda c: f(c)


def _analysed(features: DataFrame, analyzer: str, folded: bool, fields: Collection[str] | None) -> DataFrame:
    """id, cell, field, terms: a row for each field of a feature."""
    kinds = {f: k for f, k in (FIELDS | {"name": analyzer}).items() if fields is None or f in fields}
    name, others = (text.fold(F.col("name")), F.transform(F.map_values("names"), text.fold)) if folded else (F.col("name"), F.map_values("names"))
    source = {"name_edge_ngram": F.array(name), "name": F.array(name), "search_names": others, "search_names_edge_ngram": others, "key": F.array("key"), "value": F.array("value"), "keys": F.col("keys"), "values": F.col("values")}
    source |= {f: F.array(F.coalesce(F.try_element_at("address", F.lit(f)), F.lit(""))) for f in (*WORDED, *WHOLE)} | {f: F.array(f) for f in CONTACT}
    each = F.array(*[F.struct(F.lit(f).alias("field"), F.flatten(F.transform(source[f], _one(text.ANALYZERS[k]))).alias("terms")) for f, k in kinds.items()])
    return features.select("id", "cell", F.explode(each).alias("f")).select("id", "cell", "f.field", "f.terms")


def postings(features: DataFrame, analyzer: str = "standard", folded: bool = True, fields: Collection[str] | None = None) -> DataFrame:
    """field, term, id, cell, tf, field_len: one row for each term of a field of a feature. Names are folded as queries are, unless told otherwise. fields: these alone."""
    each = _analysed(features, analyzer, folded, fields)
    flat = each.select("id", "cell", "field", F.size("terms").alias("field_len"), F.explode("terms").alias("term")).filter("term <> ''")
    return flat.groupBy("field", "term", "id").agg(F.first("cell").alias("cell"), F.count("*").alias("tf"), F.max("field_len").alias("field_len"))


def documents(features: DataFrame, analyzer: str = "standard", folded: bool = True, fields: Collection[str] | None = None) -> DataFrame:
    """field, n_docs: what statistics() counts in the postings of the features, from a row for each field instead of each term."""
    some = _analysed(features, analyzer, folded, fields).filter(F.exists("terms", lambda t: t != ""))
    return some.groupBy("field").agg(F.count_distinct("id").alias("n_docs"))


def statistics(posts: DataFrame, docs: DataFrame | None = None) -> DataFrame:
    """field, term, df, and the field's number of documents. docs: these numbers, where they are to be had for less."""
    terms = posts.groupBy("field", "term").agg(F.count("*").alias("df"))
    docs = posts.groupBy("field").agg(F.count_distinct("id").alias("n_docs")) if docs is None else docs
    return terms.join(F.broadcast(docs), "field")


def write(features: DataFrame, posts: DataFrame, path: str, shapes: bool = False, stats: DataFrame | None = None, ranked: bool = False) -> None:
    """An index is tables sorted so that row groups can be skipped: features by grid cell, postings by field and term, their statistics, terms
    within one edit by key, whole names, (shapes) features by the cells that their shapes touch, and (ranked) the lists of filters by impact, with their blocks.

    Ranges over (cell, id), (field, term, id) and (key, term) split a crowded cell or a common term among tasks. stats: those of the postings, where they are known.
    """
    spark = features.sparkSession
    features.repartitionByRange("cell", "id").sortWithinPartitions("cell", "id").write.mode("overwrite").parquet(f"{path}/features")
    posts.repartitionByRange("field", "term", "id").sortWithinPartitions("field", "term").write.mode("overwrite").partitionBy("field").parquet(f"{path}/postings")
    stored = spark.read.schema(posts.schema).parquet(f"{path}/postings")
    (statistics(stored) if stats is None else stats).sortWithinPartitions("field", "term").write.mode("overwrite").partitionBy("field").parquet(f"{path}/statistics")
    lookups.neighbours(spark.read.schema("term string, df long, n_docs long, field string").parquet(f"{path}/statistics")).repartitionByRange("field", "key", "term").sortWithinPartitions("field", "key").write.mode("overwrite").partitionBy("field").parquet(f"{path}/neighbours")
    lookups.whole_names(features).repartitionByRange("folded", "id").sortWithinPartitions("folded").write.mode("overwrite").parquet(f"{path}/names")
    if shapes:
        lookups.by_cell(features).repartitionByRange("at", "id").sortWithinPartitions("at").write.mode("overwrite").parquet(f"{path}/shapes")
    if ranked:
        lists = lookups.ranked(features, stored, LISTS)
        # small row groups, so that the head of a long list is a small part of its file
        lists.write.mode("overwrite").option("parquet.block.size", 4 << 20).partitionBy("field").parquet(f"{path}/ranked")
        held = spark.read.schema(lists.schema).parquet(f"{path}/ranked")
        lookups.blocks(held).repartitionByRange("field", "term", "least").sortWithinPartitions("field", "term").write.mode("overwrite").partitionBy("field").parquet(f"{path}/blocks")
