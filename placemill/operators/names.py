"""Names, addresses and contact data from tag maps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Keys of other names, of addresses, and of addresses as they are shown, in order.
ALTERNATIVES = ("alt_name", "old_name", "short_name")
ADDRESS = ("addr:housenumber", "addr:street", "addr:city", "addr:postcode", "addr:country", "addr:state", "addr:district", "addr:suburb", "addr:neighbourhood", "addr:floor", "addr:unit", "level")
_DISPLAY = ("addr:housenumber", "addr:street", "addr:neighbourhood", "addr:suburb", "addr:district", "addr:city", "addr:state", "addr:postcode", "addr:country")


def tag(tags: Column, key: str) -> Column:
    """The tag's value, empty if it is absent."""
    return F.coalesce(F.try_element_at(tags, F.lit(key)), F.lit(""))


def first_of(tags: Column, *keys: str) -> Column:
    return F.coalesce(*[F.nullif(tag(tags, k), F.lit("")) for k in keys], F.lit(""))


def plain_name(tags: Column, languages: tuple[str, ...] = ()) -> Column:
    """The name, else that in the first language that has one, else the English one."""
    return first_of(tags, "name", *(f"name:{x}" for x in languages), "name:en")


def full_name(name: Column, tags: Column) -> Column:
    """With the first of brand, operator, religion and denomination that says something new, in brackets."""
    out = F
    for k in ("brand", "operator", "religion", "denomination"):
        v = tag(tags, k)
        out = out.when(~v.isin("", "yes", "no") & ~F.contains(F.lower(name), F.lower(v)), F.concat(name, F.lit(" ("), v, F.lit(")")))
    return F.when(name == "", name).otherwise(out.otherwise(name))


def has_name(tags: Column, languages: tuple[str, ...] = ()) -> Column:
    return first_of(tags, "name", *ALTERNATIVES, *(f"name:{x}" for x in languages)) != ""


def other_names(tags: Column, languages: tuple[str, ...] = (), alternatives: bool = True) -> Column:
    """Map of the other names, or of those in the languages alone."""
    keys = [f"name:{x}" for x in languages]
    if alternatives:
        keys += [*ALTERNATIVES, "brand", "operator", *(f"{a}:{x}" for a in ALTERNATIVES for x in languages)]
    return F.map_filter(tags, lambda k, v: k.isin(*keys) & (v != "")) if keys else F.map_filter(tags, lambda k, v: F.lit(False))


def name_values(tags: Column, languages: tuple[str, ...] = ()) -> Column:
    """The names that ranking looks at, without empty ones."""
    keys = ("name", *ALTERNATIVES, "brand", "operator", *(f"name:{x}" for x in languages))
    return F.filter(F.array(*[tag(tags, k) for k in keys]), lambda v: v != "")


def address(tags: Column) -> Column:
    return F.map_filter(tags, lambda k, v: k.isin(*ADDRESS))


def display_address(tags: Column) -> Column:
    """Every part that is there, joined."""
    return F.array_join(F.filter(F.array(*[F.try_element_at(tags, F.lit(k)) for k in _DISPLAY]), lambda v: v.isNotNull()), ", ")


def short_address(tags: Column) -> Column:
    """House number, street, city and postcode, without empty ones."""
    return F.array_join(F.filter(F.array(*[tag(tags, k) for k in ("addr:housenumber", "addr:street", "addr:city", "addr:postcode")]), lambda v: v != ""), ", ")


def phone(tags: Column) -> Column:
    return first_of(tags, "phone", "contact:phone")
