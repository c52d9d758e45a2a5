"""Configuration and search parameters."""

from __future__ import annotations

import re
import tomllib
from collections.abc import Mapping
from dataclasses import dataclass, field, fields, replace


@dataclass(frozen=True)
class Importance:
    boosts: tuple[str, ...] = ()
    default: float = 0.0
    population_boost_weight: float = 0.0
    capital_boost: float = 0.0
    wikipedia_boost: float = 0.0


@dataclass(frozen=True)
class Config:
    languages: tuple[str, ...] = ()
    importance: Importance = field(default_factory=Importance)
    geometry_mode: str = "geopoint"
    simplification_tolerance: float = 0.0
    name_analyzer: str = "standard"
    nodes_only: bool = False
    only_named: bool = False
    disable_alt_names: bool = False
    disable_importance: bool = False
    disable_key_value: bool = False
    store_metadata: bool = True
    store_geometry: bool = True
    store_secondary_names: bool = True
    store_contact_info: bool = True
    store_address: bool = True
    pmtiles_post_process: bool = False
    index_wikidata_redirects: bool = False

    @staticmethod
    def from_toml(text: str, base: Config | None = None) -> Config:
        """Known keys of a TOML text over a base; others are left alone."""
        raw, own = tomllib.loads(text), {f.name for f in fields(Config)}
        found = {k: tuple(v) if isinstance(v, list) else v for k, v in raw.items() if k in own and k != "importance"}
        weights = {k: tuple(v) if isinstance(v, list) else float(v) for k, v in raw.get("importance", {}).items() if k in {f.name for f in fields(Importance)}}
        return replace(base or Config(), **found, importance=Importance(**weights))

    @staticmethod
    def trimmed() -> Config:
        """What a command-line build starts from: named objects only, no alternative names, no key and value lists."""
        return Config(only_named=True, disable_alt_names=True, disable_key_value=True)


def _float(v: str | None) -> float | None:
    try:
        return float(v) if v else None
    except ValueError:
        return None


def listed(text: str) -> tuple[str, ...]:
    """A comma list, trimmed and without empty parts."""
    return tuple(x for part in text.split(",") if (x := part.strip()))


def split_address(street: str, number: str) -> tuple[str, str]:
    """Street and house number of a request, as functions.text.split_address has them for columns."""
    street, number = street.strip(), number.strip()
    lead = re.match(r"(\d[\w/-]*)[,\s]+(.+)\Z", street)
    tail = None if lead else re.match(r"(.+?)[,\s]+(\d[\w/-]*)\Z", street)
    found, rest = (lead[1], lead[2]) if lead else (tail[2], tail[1]) if tail else ("", "")
    if found and (not number or found.lower() == number.lower()):
        return rest.strip(), number or found
    return street, number


@dataclass(frozen=True)
class Params:
    query: str = ""
    limit: int = 0
    offset: int = 0
    fuzzy: bool = False
    prefix: bool = False
    key: str = ""
    value: str = ""
    keys: tuple[str, ...] = ()
    values: tuple[str, ...] = ()
    street: str = ""
    housenumber: str = ""
    postcode: str = ""
    city: str = ""
    country: str = ""
    floor: str = ""
    unit: str = ""
    level: str = ""
    phone: str = ""
    wheelchair: str = ""
    opening_hours: str = ""
    langs: tuple[str, ...] = ()
    lat: float | None = None
    lon: float | None = None
    radius: str = ""
    min_lat: float | None = None
    max_lat: float | None = None
    min_lon: float | None = None
    max_lon: float | None = None

    @staticmethod
    def from_query(args: Mapping[str, str], langs: tuple[str, ...] = ()) -> Params:
        """From the arguments of a request; what can't be read counts as absent."""

        def whole(v: str | None) -> int:
            return int(v) if v and re.fullmatch(r"[+-]?\d+", v) else 0

        out: dict = {f.name: args.get(f.name, "") for f in fields(Params) if f.type == "str"}
        out["query"] = args.get("q", "")
        out |= {k: _float(args.get(k)) for k in ("lat", "lon", "min_lat", "max_lat", "min_lon", "max_lon")}
        out |= {k: args.get(k) in ("1", "true") for k in ("fuzzy", "prefix")}
        out |= {k: tuple(args[k].split(",")) if args.get(k) else () for k in ("keys", "values")}
        out["langs"] = tuple(args["langs"].split(",")) if args.get("langs") else langs
        out["street"], out["housenumber"] = split_address(out["street"], out["housenumber"])
        return Params(**out, limit=whole(args.get("limit")), offset=max(0, whole(args.get("from"))))

    @property
    def page_size(self) -> int:
        return 100 if self.limit <= 0 else min(self.limit, 1000)

    @property
    def radius_m(self) -> int:
        m = re.match(r"\s*([+-]?\d+(?:\.\d*)?|\.\d+)", text := self.radius.lower())
        n = float(m[1]) if m else 0.0
        return int(n * 1000) if text.endswith("km") else int(n)

    @property
    def has_radius(self) -> bool:
        return self.lat is not None and self.lon is not None and self.radius != ""

    @property
    def has_box(self) -> bool:
        return None not in (self.min_lat, self.max_lat, self.min_lon, self.max_lon)

    @property
    def query_fields(self) -> int:
        return self.query.count(" ") + 1 if self.query else 0

    @property
    def near(self) -> tuple[str, str] | None:
        """X and Y of "X near Y"."""
        m = re.match(r"^(.+?)\s+(?:near|in|around|close\s+to)\s+(.+)\Z", self.query, re.IGNORECASE)
        if not m or not m[1].strip() or not m[2].strip() or len(m[1].split()) > 5:
            return None
        return m[1].strip(), m[2].strip()

    @property
    def place_intent(self) -> bool:
        """A short text without other filters than spatial ones."""
        others = (self.key, self.value, self.keys, self.values, self.street, self.housenumber, self.postcode, self.city, self.country, self.floor, self.unit, self.level, self.phone, self.wheelchair, self.opening_hours)
        return bool(self.query.strip()) and not self.near and self.query_fields <= 3 and not any(others)
