"""The ranking policy that all search modes share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from placemill.functions import text

# Keys that say nothing about a category, and keys of the middle tier.
SILENT_KEYS = ("brand", "operator", "ref", "int_ref", "nat_ref", "reg_ref", "official_name", "loc_name", "reg_name", "wheelchair", "internet_access")
PRIMARY_KEYS = ("amenity", "shop", "tourism", "leisure", "historic", "natural", "healthcare", "public_transport", "railway", "aeroway", "office")


def entity_tier(key: Column) -> Column:
    return F.when(key == "place", 2).when(key.isin(*PRIMARY_KEYS), 1).otherwise(0)


def category_match(query: Column, key: Column, value: Column, named: list[tuple[str, str]] = ()) -> Column:
    """320 for the value, 140 for the key, 300 for a tag that the ontology gives for the query (named)."""
    q = text.fold(text.trim(query))
    score = F.when(text.trim(text.fold(value)) == q, 320.0).when(text.trim(text.fold(key)) == q, 140.0).otherwise(0.0)
    for k, v in named:
        score = F.greatest(score, F.when((key == k) & (value == v), 300.0).otherwise(0.0))
    return F.when((q == "") | F.startswith(key, F.lit("addr:")) | key.isin(*SILENT_KEYS), 0.0).otherwise(score)


def shared_score(query: Column, base: Column, name: Column, category: Column, tier: Column, importance: Column, exact: Column, named: Column) -> Column:
    """One score from the signals of a hit; a blank query ranks by importance alone."""
    place = F.when(exact | (name >= 300), 120_000.0).otherwise(0.0)
    primary = F.when(category > 0, 140_000.0).when(name > 0, 70_000.0).otherwise(0.0)
    secondary = F.when(category > 0, 60_000.0).when(name > 0, 15_000.0).otherwise(0.0)
    score = base + name * 1000 + category * 1000 + F.when(exact, 160_000.0).otherwise(0.0)
    score = score + F.when(tier == 2, place).when(tier == 1, primary).otherwise(secondary) + F.when(named, 0.0).otherwise(-160_000.0)
    score = score + F.when(importance > 0, F.log1p(importance) * 1000).otherwise(0.0)
    return F.when(text.trim(query) == "", base + F.greatest(importance, F.lit(0.0)) * 1000).otherwise(score)
