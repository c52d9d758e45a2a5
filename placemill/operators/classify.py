"""Classification of tag maps, and importance."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placemill.config import Importance
from placemill.functions.geo import let

# Keys that classify an object, in order.
KEYS = (
    "place amenity shop tourism leisure historic natural railway aeroway highway boundary landuse building office man_made "
    "craft military healthcare public_transport power industrial emergency aerialway bridge club government information "
    "junction parking playground ruins social_facility sport studio traffic_calming cuisine religion attraction brewery "
    "castle_type consulate crossing denomination denotation diplomatic garden:type harbour:category healthcare:speciality "
    "military_service operator:type power_supply recycling_type residential sanitary_dump_station service shelter_type "
    "social_facility:for surface theatre:type toilets:access tower:type aerodrome:type vending waterway water artwork_type "
    "building:use clothes fuel route waste internet_access wheelchair addr:housenumber addr:street addr:postcode addr:city "
    "brand operator ref int_ref nat_ref reg_ref official_name loc_name reg_name addr:suburb addr:neighbourhood "
    "addr:district addr:state addr:province"
).split()
# Importance of a key; 0.5 for the others. Of places, that of the value; 2.0 for the others.
OF_KEY = {
    2.0: "amenity boundary",
    1.5: "shop tourism leisure historic natural waterway water railway building office man_made craft military healthcare cuisine religion",
    1.2: "public_transport power industrial emergency attraction brewery consulate route artwork_type",
    1.0: "highway aerialway bridge club government information junction residential parking playground ruins social_facility sport studio traffic_calming vending building:use clothes fuel waste internet_access wheelchair addr:housenumber addr:street addr:postcode addr:city addr:suburb addr:neighbourhood addr:district addr:state addr:province brand operator ref int_ref nat_ref reg_ref official_name loc_name reg_name",
    0.8: "castle_type crossing denomination denotation diplomatic garden:type harbour:category healthcare:speciality military_service operator:type power_supply recycling_type sanitary_dump_station service shelter_type social_facility:for surface theatre:type toilets:access tower:type aerodrome:type",
}
OF_PLACE = {4.0: "city town", 3.0: "village hamlet", 2.5: "suburb quarter neighbourhood"}


def _lookup(table: Mapping[float, str], of: Column, default: float) -> Column:
    out = F
    for n, names in table.items():
        out = out.when(of.isin(*names.split()), n)
    return out.otherwise(default)


def default_importance(key: Column, value: Column) -> Column:
    return F.when(key == "place", _lookup(OF_PLACE, value, 2.0)).otherwise(_lookup(OF_KEY, key, 0.5))


def fits_pattern(key: Column, value: Column, pattern: str) -> Column:
    """x: key or value; k=v: both, with * or nothing for any."""
    if "=" not in pattern:
        return (key == pattern) | (value == pattern)
    k, v = pattern.split("=", 1)
    return (F.lit(True) if k in ("", "*") else key == k) & (F.lit(True) if v in ("", "*") else value == v)


def _tag(tags: Column, key: str) -> Column:
    return F.coalesce(F.try_element_at(tags, F.lit(key)), F.lit(""))


def known_keys(tags: Column) -> Column:
    """The keys among the tags that classify the object, in the order of KEYS."""
    fresh = F.array_intersect(F.array(*[F.lit(k) for k in KEYS]), F.map_keys(tags))
    return F.filter(fresh, lambda k: ~F.element_at(tags, k).isin("", "yes", "no"))


def classify(tags: Column, weights: Importance, levels: Mapping[str, int] | Column | None = None) -> Column:
    """array<struct<key, value, importance, ont_level>> in the order of KEYS. levels: least ontology level by "key=value", as a mapping or a column of maps."""
    level_map = levels if isinstance(levels, Column) else F.create_map(*[F.lit(x) for kv in levels.items() for x in kv]) if levels else None
    population, more = _tag(tags, "population"), F.lit(0.0)
    if weights.population_boost_weight > 0:
        n = F.when(population.rlike(r"^[+-]?[0-9]+\z"), population.try_cast("long"))
        more = more + F.coalesce(F.when(n > -1, F.ln(n + 1.0)), F.lit(0.0)) * weights.population_boost_weight
    more = more + F.when(_tag(tags, "capital") == "yes", weights.capital_boost).otherwise(0.0)
    more = more + F.when((_tag(tags, "wikipedia") != "") | (_tag(tags, "wikidata") != ""), weights.wikipedia_boost).otherwise(0.0)

    def one(k: Column) -> Column:
        v = F.element_at(tags, k)
        key = F.when(k == "highway", "street").otherwise(k)
        score = default_importance(k, v) * (weights.default if weights.default not in (0.0, 1.0) else 1.0)
        boosted = F
        for i, pattern in enumerate(weights.boosts):
            boosted = boosted.when(fits_pattern(key, v, pattern), 1000.0 + (len(weights.boosts) - i) * 10.0)
        score = (boosted.otherwise(score) if weights.boosts else score) + more
        level = F.coalesce(F.try_element_at(level_map, F.concat(k, F.lit("="), v)), F.lit(-1)) if level_map is not None else F.lit(-1)
        # a level outside 0 to 6 changes nothing
        score = score * F.when(level.between(0, 6), 1.0 + 0.1 * level).otherwise(1.0)
        return F.struct(key.alias("key"), v.alias("value"), score.alias("importance"), level.alias("ont_level"))

    return F.transform(known_keys(tags), one)


def best(classes: Column) -> Column:
    """The most important one; ties go to the higher level, then to the first."""
    ranked = F.transform(classes, lambda c, i: F.struct(c["importance"].alias("importance"), c["ont_level"].alias("ont_level"), (-i).alias("at"), c["key"].alias("key"), c["value"].alias("value")))
    return let(F.array_max(ranked), lambda top: F.struct(*[top[k].alias(k) for k in ("key", "value", "importance", "ont_level")]))


def add_importance_table(features: DataFrame, by_id: DataFrame, by_language: DataFrame, languages: tuple[str, ...]) -> DataFrame:
    """Adds ten times the score of the object's wikidata id, in the first of the languages that it has a name in, else at all."""
    name_in = F.coalesce(*[F.when(_tag(F.col("tags"), f"name:{x}") != "", F.lit(x)) for x in languages], F.lit(languages[0] if languages else None).cast("string"))
    keyed = features.withColumn("_qid", F.nullif(_tag(F.col("tags"), "wikidata"), F.lit(""))).withColumn("_lang", name_in)
    one = by_language.select(F.col("wikidata_id").alias("_qid"), F.col("language").alias("_lang"), F.col("score").alias("_own"))
    two = by_id.select(F.col("wikidata_id").alias("_qid"), F.col("score").alias("_any"))
    joined = keyed.join(one, ["_qid", "_lang"], "left").join(two, "_qid", "left")
    boost = F.greatest(F.coalesce("_own", "_any", F.lit(0.0)), F.lit(0.0)) * 10
    return joined.withColumn("importance", F.col("importance") + boost).drop("_qid", "_lang", "_own", "_any")
