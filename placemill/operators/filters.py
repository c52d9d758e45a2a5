"""Predicates on objects: direct (on tags and classifications) and indexed (on features)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from placemill.config import Params
from placemill.functions import geo, text
from placemill.operators.names import first_of, tag


def _all(conditions: list[Column]) -> Column:
    return reduce(Column.__and__, conditions, F.lit(True))


def direct_text(tags: Column, p: Params) -> Column:
    """Any tag value matches the query."""
    if not p.query:
        return F.lit(True)
    return F.exists(F.map_values(tags), lambda v: text.direct_match(v, p.query, p.prefix, p.fuzzy))


def direct_fields(tags: Column, classes: Column, p: Params) -> Column:
    """Key, value, address and contact filters as direct modes read them."""
    has = lambda test: F.exists(classes, test)
    within = lambda key, q: F.contains(F.lower(tag(tags, key)), F.lit(q.lower()))
    out = []
    if p.key:
        out.append(has(lambda c: c["key"] == p.key))
    if p.value:
        out.append(has(lambda c: c["value"] == p.value))
    if p.keys:
        out.append(has(lambda c: c["key"].isin(*p.keys)))
    if p.values:
        out.append(has(lambda c: c["value"].isin(*p.values)))
    out += [within(k, q) for k, q in (("addr:street", p.street), ("addr:country", p.country), ("opening_hours", p.opening_hours)) if q]
    out += [tag(tags, k) == q for k, q in (("addr:housenumber", p.housenumber), ("addr:postcode", p.postcode), ("addr:floor", p.floor), ("addr:unit", p.unit), ("level", p.level), ("wheelchair", p.wheelchair)) if q]
    if p.city:
        settled = (tag(tags, "place") != "") | has(lambda c: c["value"].isin("city", "town", "village"))
        city = F.when((tag(tags, "addr:city") == "") & settled, tag(tags, "name")).otherwise(tag(tags, "addr:city"))
        out.append(F.contains(F.lower(city), F.lit(p.city.lower())))
    if p.phone:
        out.append(F.contains(first_of(tags, "phone"), F.lit(p.phone)) | F.contains(tag(tags, "contact:phone"), F.lit(p.phone)))
    return _all(out)


def indexed_fields(p: Params) -> Column:
    """The same filters on a feature table, as an index reads them: keywords and analysed words, case-insensitive."""
    low = lambda q: q.lower()
    addr = lambda k: F.coalesce(F.try_element_at(F.col("address"), F.lit(k)), F.lit(""))
    holds = lambda name, one, qs: F.lower(F.col(one)).isin(*qs) | F.arrays_overlap(F.transform(F.col(name), F.lower), F.array(*[F.lit(q) for q in qs]))
    out = []
    keys = [low(k) for k in (*p.keys, *([p.key] if p.key else []))]
    values = [low(v) for v in (*p.values, *([p.value] if p.value else []))]
    if keys:
        out.append(holds("keys", "key", keys))
    if values:
        out.append(holds("values", "value", values))
    for k, q in (("addr:street", p.street), ("addr:city", p.city), ("addr:country", p.country)):
        if q:
            out.append(F.arrays_overlap(text.standard(addr(k)), text.standard(F.lit(q))))
    for k, q in (("addr:housenumber", p.housenumber), ("addr:postcode", p.postcode), ("addr:floor", p.floor), ("addr:unit", p.unit), ("level", p.level)):
        if q:
            out.append(F.lower(addr(k)) == low(q))
    for k, q in (("phone", p.phone), ("wheelchair", p.wheelchair), ("opening_hours", p.opening_hours)):
        if q:
            out.append(F.lower(k) == low(q))
    return _all(out)


def field_terms(p: Params) -> list[list[tuple[str, tuple[str, ...]]]]:
    """indexed_fields by postings: for each filter the fields and terms of which a feature has to hold one."""
    low = lambda *qs: tuple(sorted({q.lower() for q in qs if q}))
    out = []
    for name, one, many in (("key", p.key, p.keys), ("value", p.value, p.values)):
        if terms := low(one, *many):
            out.append([(name, terms), (f"{name}s", terms)])
    out += [[(f, text.standard_words(q))] for f, q in (("addr:street", p.street), ("addr:city", p.city), ("addr:country", p.country)) if q]
    whole = (("addr:housenumber", p.housenumber), ("addr:postcode", p.postcode), ("addr:floor", p.floor), ("addr:unit", p.unit), ("level", p.level), ("phone", p.phone), ("wheelchair", p.wheelchair), ("opening_hours", p.opening_hours))
    return out + [[(f, low(q))] for f, q in whole if q]


def spatial_point(lat: Column, lon: Column, p: Params) -> Column:
    """A box overrides the radius's own window; the radius itself holds in any case."""
    out = []
    if p.has_box:
        out.append(geo.Window(p.min_lat, p.max_lat, p.min_lon, p.max_lon).holds(lat, lon))
    elif p.has_radius:
        out.append(geo.Window.around(p.lat, p.lon, p.radius_m).holds(lat, lon))
    if p.has_radius:
        out.append(geo.haversine_m(lat, lon, F.lit(p.lat), F.lit(p.lon)) <= p.radius_m)
    return _all(out)


def spatial_shape(coords: Column, p: Params) -> Column:
    if p.has_radius:
        return geo.near_shape(coords, p.lat, p.lon, p.radius_m)
    if p.has_box:
        window = geo.Window(p.min_lat, p.max_lat, p.min_lon, p.max_lon)
        return F.exists(coords, lambda c: window.holds(c["lat"], c["lon"])) | window.overlaps(geo.envelope(coords))
    return F.lit(True)
