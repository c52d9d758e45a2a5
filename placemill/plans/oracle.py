"""Plain SQL for the catalogue's queries, written for another engine over the same tables."""

from __future__ import annotations

from placemill.functions.text import FOLD_ONE, FOLD_TWO, STOP_WORDS

_STOP = "'" + "','".join(STOP_WORDS) + "'"


def fold(x: str) -> str:
    out = f"translate(lower({x}), '{''.join(FOLD_ONE)}', '{''.join(FOLD_ONE.values())}')"
    for a, b in FOLD_TWO.items():
        out = f"replace({out}, '{a}', '{b}')"
    return out


def words(x: str) -> str:
    return rf"regexp_extract_all({x}, '[\p{{L}}\p{{Nd}}]+')"


def compact(x: str) -> str:
    return rf"regexp_replace({x}, '[^\p{{L}}\p{{Nd}}]', '', 'g')"


def some(items: str, test: str) -> str:
    return f"(len(list_filter({items}, lambda t: {test})) > 0)"


def matched(v: str, q: str) -> str:
    """v is folded already; q is a lower-case ASCII word."""
    return f"""CASE WHEN {v} = '' THEN 0.0 WHEN trim({v}) = '{q}' THEN 400.0 WHEN contains({v}, '{q}') THEN 300.0
 WHEN starts_with({compact(v)}, '{q}') OR {some(words(v), f"starts_with(t, '{q}')")} THEN 220.0
 WHEN levenshtein({compact(v)}, '{q}') <= 1 OR {some(words(v), f"levenshtein(t, '{q}') <= 1")} THEN 160.0 ELSE 0.0 END"""


POI = """poi AS (
 SELECT doc_id AS osm_id, CASE doc_id % 3 WHEN 0 THEN 'node' WHEN 1 THEN 'way' ELSE 'relation' END AS entity_type,
 trim(concat(split_part(split_part(text, chr(10), 1), ' ', 1), ' ', split_part(split_part(text, chr(10), 1), ' ', 2))) AS name,
 CASE doc_id % 8 WHEN 0 THEN 'place' WHEN 1 THEN 'amenity' WHEN 2 THEN 'shop' WHEN 3 THEN 'tourism' WHEN 4 THEN 'leisure' WHEN 5 THEN 'highway' WHEN 6 THEN 'historic' ELSE 'foo' END AS k,
 CASE doc_id % 8 WHEN 0 THEN (CASE WHEN doc_id % 16 = 0 THEN 'city' ELSE 'village' END) WHEN 1 THEN (CASE WHEN doc_id % 16 = 1 THEN 'restaurant' ELSE 'cafe' END)
  WHEN 2 THEN 'bakery' WHEN 3 THEN 'museum' WHEN 4 THEN 'park' WHEN 5 THEN 'primary' WHEN 6 THEN 'castle' ELSE 'bar' END AS v,
 lang, source AS brand, CAST(n_chars * 100 AS VARCHAR) AS population, concat('Q', doc_id % 200) AS wikidata,
 concat('Main Street ', doc_id % 30) AS street, CAST(doc_id % 200 + 1 AS VARCHAR) AS housenumber, CAST(doc_id % 20 + 9480 AS VARCHAR) AS postcode,
 concat('NATION_', doc_id % 25) AS city, CASE doc_id % 2 WHEN 0 THEN 'LI' ELSE 'CH' END AS country,
 CASE WHEN doc_id % 4 = 0 THEN concat('+423 ', doc_id % 1000) ELSE '' END AS phone, CASE WHEN doc_id % 4 = 1 THEN concat('+41 ', doc_id % 1000) ELSE '' END AS contact_phone,
 CASE doc_id % 3 WHEN 0 THEN 'yes' WHEN 1 THEN 'no' ELSE 'limited' END AS wheelchair, CASE WHEN doc_id % 5 = 0 THEN '24/7' ELSE 'Mo-Fr 09:00-17:00' END AS opening_hours,
 coalesce(text, '') AS description,
 CAST(4700000 + (doc_id * 7919) % 28000 AS DOUBLE) / 100000.0 AS lat, CAST(947000 + (doc_id * 104729) % 18000 AS DOUBLE) / 100000.0 AS lon
 FROM documents)"""
ID = "concat(entity_type, '/', osm_id)"

# every tag that can classify, with its place in the order of keys
KINDS = """kinds AS (
 SELECT osm_id, entity_type, population, p.pos, p.okey, CASE WHEN p.okey = 'highway' THEN 'street' ELSE p.okey END AS key, p.value
 FROM poi, LATERAL (SELECT unnest([
  {'pos': CASE k WHEN 'place' THEN 1 WHEN 'amenity' THEN 2 WHEN 'shop' THEN 3 WHEN 'tourism' THEN 4 WHEN 'leisure' THEN 5 WHEN 'historic' THEN 6 WHEN 'highway' THEN 10 ELSE 0 END, 'okey': k, 'value': v},
  {'pos': 73, 'okey': 'wheelchair', 'value': wheelchair}, {'pos': 74, 'okey': 'addr:housenumber', 'value': housenumber}, {'pos': 75, 'okey': 'addr:street', 'value': street},
  {'pos': 76, 'okey': 'addr:postcode', 'value': postcode}, {'pos': 77, 'okey': 'addr:city', 'value': city}, {'pos': 78, 'okey': 'brand', 'value': brand}]) AS p)
 WHERE p.pos > 0 AND p.value NOT IN ('', 'yes', 'no'))"""
LEVELS = """levels(okey, value, level) AS (VALUES ('place','city',2), ('place','village',3), ('amenity','restaurant',3), ('amenity','cafe',4), ('tourism','museum',3), ('leisure','park',4), ('historic','castle',3))"""
# weights: boosts city, shop=*, =museum; default 1.5; population 0.5; wiki 1.5
CLASSES = f"""{POI}, {KINDS}, {LEVELS}, classes AS (
 SELECT x.osm_id, x.entity_type, x.pos, x.key, x.value, coalesce(l.level, -1) AS ont_level,
 (CASE WHEN x.key = 'city' OR x.value = 'city' THEN 1030.0 WHEN x.key = 'shop' THEN 1020.0 WHEN x.value = 'museum' THEN 1010.0 ELSE 1.5 *
   CASE WHEN x.okey = 'place' THEN (CASE WHEN x.value = 'city' THEN 4.0 WHEN x.value = 'village' THEN 3.0 ELSE 2.0 END) WHEN x.okey = 'amenity' THEN 2.0
    WHEN x.okey IN ('shop', 'tourism', 'leisure', 'historic') THEN 1.5 ELSE 1.0 END END
  + ln(CAST(x.population AS BIGINT) + 1.0) * 0.5 + 1.5) * (CASE WHEN l.level IS NOT NULL THEN 1.0 + 0.1 * l.level ELSE 1.0 END) AS importance
 FROM kinds x LEFT JOIN levels l ON l.okey = x.okey AND l.value = x.value)"""
BEST = f"""{CLASSES}, best AS (
 SELECT osm_id, entity_type, key, value, importance, ont_level FROM (SELECT *, row_number() OVER (PARTITION BY osm_id ORDER BY importance DESC, ont_level DESC, pos) AS n FROM classes) WHERE n = 1)"""
HAVERSINE = "CAST(trunc(6371000.0 * 2 * atan2(sqrt({a}), sqrt(1 - ({a})))) AS INTEGER)"


def metres(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    dp, dl = f"((({lat2}) - ({lat1})) * (pi() / 180) / 2)", f"((({lon2}) - ({lon1})) * (pi() / 180) / 2)"
    a = f"sin({dp}) * sin({dp}) + cos(({lat1}) * (pi() / 180)) * cos(({lat2}) * (pi() / 180)) * sin({dl}) * sin({dl})"
    return HAVERSINE.format(a=a)


NAMED = f"""named AS (SELECT *, CASE WHEN name <> '' AND brand NOT IN ('', 'yes', 'no') AND NOT contains(lower(name), lower(brand)) THEN concat(name, ' (', brand, ')') ELSE name END AS full_name FROM poi)"""


def direct(q: str, where: str, test: str | None = None, page: str = "", more: str = "") -> str:
    """Hits of a one-word query over tags, scored, with rank."""
    v = "[full_name, v, brand, population, wikidata, street, housenumber, postcode, city, country, phone, contact_phone, wheelchair, opening_hours, description]"
    contains = test or f"contains(lower(t), '{q}')"
    cat = f"CASE WHEN {fold('c.value')} = '{q}' THEN 320.0 WHEN {fold('c.key')} = '{q}' THEN 140.0 WHEN '{q}' = c.ont THEN 300.0 ELSE 0.0 END"
    return f"""WITH {CLASSES}, {NAMED},
 kept AS (SELECT *, {ID} AS id, {v} AS vals FROM named WHERE {where}),
 hit AS (SELECT * FROM kept WHERE {some("list_filter(vals, lambda x: x <> '')", contains)}),
 sig AS (SELECT h.id, h.full_name AS name, list_max(list_transform(h.vals, lambda x: {matched(fold('x'), q)})) AS base,
   list_max(list_transform([h.full_name, h.brand], lambda x: {matched(fold('x'), q)})) AS name_score,
   {some("[h.full_name, h.brand]", f"{fold('trim(t)')} = '{q}'")} AS exact, h.osm_id FROM hit h),
 cls AS (SELECT c.osm_id, max(CASE WHEN starts_with(c.key, 'addr:') OR c.key IN ('brand', 'wheelchair') THEN 0.0 ELSE {cat} END) AS cat,
   max(CASE WHEN c.key = 'place' THEN 2 WHEN c.key IN ('amenity', 'shop', 'tourism', 'leisure', 'historic') THEN 1 ELSE 0 END) AS tier, arg_min(c.importance, c.pos) AS importance, arg_min(c.key, c.pos) AS key, arg_min(c.value, c.pos) AS value
   FROM (SELECT *, CASE WHEN key || '=' || value = 'amenity=restaurant' THEN 'restaurant' WHEN key || '=' || value = 'place=city' THEN 'city' WHEN key || '=' || value = 'historic=castle' THEN 'castle' ELSE '' END AS ont FROM classes) c GROUP BY c.osm_id),
 scored AS (SELECT s.id, s.name, c.key, round(c.importance, 6) AS importance, round(s.base + 1000 * s.name_score + 1000 * c.cat + CASE WHEN s.exact THEN 160000.0 ELSE 0.0 END
   + CASE c.tier WHEN 2 THEN (CASE WHEN s.exact OR s.name_score >= 300 THEN 120000.0 ELSE 0.0 END) WHEN 1 THEN (CASE WHEN c.cat > 0 THEN 140000.0 WHEN s.name_score > 0 THEN 70000.0 ELSE 0.0 END)
     ELSE (CASE WHEN c.cat > 0 THEN 60000.0 WHEN s.name_score > 0 THEN 15000.0 ELSE 0.0 END) END
   + ln(1 + c.importance) * 1000, 6) AS score{", " + more if more else ""} FROM sig s JOIN cls c ON c.osm_id = s.osm_id JOIN poi p ON p.osm_id = s.osm_id)
 SELECT {"* EXCLUDE (score), round(score, 6) AS score," if more else "id, name, key, importance, round(score, 4) AS score,"} CAST(row_number() OVER (ORDER BY score DESC, id) AS INTEGER) AS rank FROM scored ORDER BY score DESC, id {page or 'LIMIT 100'}"""


NODES = """nodes AS (SELECT p_partkey AS id, CAST(947000 + (p_partkey * 104729) % 18000 AS DOUBLE) / 100000.0 AS lon, CAST(4700000 + (p_partkey * 7919) % 28000 AS DOUBLE) / 100000.0 AS lat FROM part WHERE p_partkey % 10 <> 0)"""
WAYS = f"""{NODES}, refs AS (
 SELECT l_orderkey AS id, l_linenumber, l_partkey, l_suppkey, l_partkey AS ref, l_partkey % 7 = 0 AS own,
  CAST(947000 + ((l_partkey + 1) * 104729) % 18000 AS DOUBLE) / 100000.0 AS olon, CAST(4700000 + ((l_partkey + 1) * 7919) % 28000 AS DOUBLE) / 100000.0 AS olat FROM lineitem),
points AS (SELECT r.id, r.l_linenumber, r.l_partkey, r.l_suppkey, CASE WHEN r.own THEN r.olon ELSE n.lon END AS lon, CASE WHEN r.own THEN r.olat ELSE n.lat END AS lat
 FROM refs r LEFT JOIN nodes n ON n.id = r.ref WHERE r.own OR n.id IS NOT NULL),
pts AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY l_linenumber, l_partkey, l_suppkey) AS i, count(*) OVER (PARTITION BY id) AS n FROM points),
good AS (SELECT * FROM pts WHERE n >= 2)"""
SEGMENTS = f"""{WAYS}, seg AS (SELECT id, i, n, lon AS x1, lat AS y1, lead(lon) OVER w AS x2, lead(lat) OVER w AS y2, first_value(lon) OVER w AS fx, first_value(lat) OVER w AS fy FROM good WINDOW w AS (PARTITION BY id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
s AS (SELECT *, sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)) AS len FROM seg WHERE x2 IS NOT NULL)"""
CLOSED = f"closed AS (SELECT id FROM good GROUP BY id HAVING count(*) >= 4 AND arg_min(lon, i) = arg_max(lon, i) AND arg_min(lat, i) = arg_max(lat, i))"
R5 = "floor({x} * 100000.0 + 0.5) / 100000.0"

def tile(lon: str, lat: str, n: str) -> str:
    return f"CAST(trunc(({lon} + 180.0) / 360.0 * {n}) AS INTEGER) AS x, CAST(trunc((1.0 - ln(tan(radians({lat})) + 1.0 / cos(radians({lat}))) / pi()) / 2.0 * {n}) AS INTEGER) AS y"


# ways as lines of their customers' shapes
MULTI = f"""{SEGMENTS}, owned AS (SELECT o.o_custkey AS cust, s.* FROM s JOIN orders o ON o.o_orderkey = s.id),
sizes AS (SELECT cust, id, sum(len) AS total FROM owned GROUP BY cust, id),
longest AS (SELECT cust, id, total FROM (SELECT *, row_number() OVER (PARTITION BY cust ORDER BY total DESC, id) AS n FROM sizes) WHERE n = 1)"""
# segments in metres around the centre
FLAT = "flat AS (SELECT id, (x1 - 9.52) * kx AS x1, (y1 - 47.14) * ky AS y1, (x2 - 9.52) * kx AS x2, (y2 - 47.14) * ky AS y2, (x2 - x1) * kx AS dx, (y2 - y1) * ky AS dy FROM (SELECT *, 6371000 * pi() / 180 AS ky, 6371000 * pi() / 180 * cos(radians(47.14)) AS kx FROM s))"
MORE = "p.lat, p.lon, c.value, concat_ws(', ', p.housenumber, p.street, p.city, p.postcode) AS address, CASE WHEN p.phone <> '' THEN p.phone ELSE p.contact_phone END AS phone"
_SAID = r"(?i)^(.+?)\s+(near|in|around|close\s+to)\s+(.+)$"
_EDGES = r"^[\s\x{85}\p{Z}]+|[\s\x{85}\p{Z}]+$"
NEAR = rf"""WITH q AS (SELECT conv_id * 100 + turn AS qid, CASE WHEN (conv_id * 100 + turn) % 5 = 0 THEN regexp_replace(text, '^([^ ]+) ', '\1 near ') ELSE text END AS query FROM conversations WHERE role = 'user'),
near AS (SELECT *, what <> '' AND place <> '' AND len(regexp_extract_all(what, '\S+')) <= 5 AS ok FROM (SELECT qid, regexp_replace(regexp_extract(query, '{_SAID}', 1), '{_EDGES}', '', 'g') AS what, regexp_replace(regexp_extract(query, '{_SAID}', 3), '{_EDGES}', '', 'g') AS place FROM q))"""


def direct_near(what: str, where: str, radius_m: int) -> str:
    """The best hit of a place, and the hits of a text around it."""
    ref = lambda c: f"(SELECT {c} FROM ({direct(where, 'true', page='LIMIT 1', more=MORE)}))"
    return direct(what, metres("lat", "lon", ref("lat"), ref("lon")) + f" <= {radius_m}")


_KEYWORDS = "k.key, k.value, list(c.key ORDER BY c.pos) AS keys, list(c.value ORDER BY c.pos) AS vals"
# all postings: field, term, id, tf, field_len; other names are the brand alone
POSTS = f"""{BEST}, {NAMED}, feats AS (SELECT k.osm_id, any_value({ID.replace('entity_type', 'n.entity_type').replace('osm_id', 'n.osm_id')}) AS id, any_value(n.full_name) AS full_name, any_value(n.brand) AS brand, any_value(n.lat) AS lat, any_value(n.lon) AS lon, any_value(k.importance) AS importance, any_value(k.key) AS key, any_value(k.value) AS value, list(c.key ORDER BY c.pos) AS keys, list(c.value ORDER BY c.pos) AS vals, any_value(n.street) AS street, any_value(n.city) AS city, any_value(n.country) AS country, any_value(n.housenumber) AS housenumber, any_value(n.postcode) AS postcode, any_value(CASE WHEN n.phone <> '' THEN n.phone ELSE n.contact_phone END) AS phone, any_value(n.wheelchair) AS wheelchair, any_value(n.opening_hours) AS opening_hours
  FROM best k JOIN named n USING (osm_id) JOIN classes c USING (osm_id) GROUP BY k.osm_id),
 toks AS (SELECT id, {words(fold('full_name'))} AS nw, {words(fold('brand'))} AS bw, key, value, keys, vals, street, city, country, housenumber, postcode, phone, wheelchair, opening_hours FROM feats),
 each AS (SELECT id, 'name' AS field, list_filter(nw, lambda t: t NOT IN ({_STOP})) AS terms FROM toks UNION ALL SELECT id, 'search_names', list_filter(bw, lambda t: t NOT IN ({_STOP})) FROM toks
  UNION ALL SELECT id, 'name_edge_ngram', flatten(list_transform(nw, lambda t: list_transform(range(1, least(12, length(t)) + 1), lambda n: substring(t, 1, n)))) FROM toks
  UNION ALL SELECT id, 'search_names_edge_ngram', flatten(list_transform(bw, lambda t: list_transform(range(1, least(12, length(t)) + 1), lambda n: substring(t, 1, n)))) FROM toks
  UNION ALL SELECT id, 'key', [lower(key)] FROM toks UNION ALL SELECT id, 'value', [lower(value)] FROM toks
  UNION ALL SELECT id, 'keys', list_transform(keys, lambda x: lower(x)) FROM toks UNION ALL SELECT id, 'values', list_transform(vals, lambda x: lower(x)) FROM toks
  UNION ALL SELECT id, 'addr:street', list_filter({words('lower(street)')}, lambda t: t NOT IN ({_STOP})) FROM toks UNION ALL SELECT id, 'addr:city', list_filter({words('lower(city)')}, lambda t: t NOT IN ({_STOP})) FROM toks
  UNION ALL SELECT id, 'addr:country', list_filter({words('lower(country)')}, lambda t: t NOT IN ({_STOP})) FROM toks UNION ALL SELECT id, 'addr:housenumber', [housenumber] FROM toks UNION ALL SELECT id, 'addr:postcode', [postcode] FROM toks
  UNION ALL SELECT id, 'phone', [lower(phone)] FROM toks UNION ALL SELECT id, 'wheelchair', [wheelchair] FROM toks UNION ALL SELECT id, 'opening_hours', [lower(opening_hours)] FROM toks
  UNION ALL SELECT id, 'display_address', [lower(concat_ws(', ', housenumber, street, city, postcode, country))] FROM toks),
 posts AS (SELECT field, term, id, count(*) AS tf, CAST(any_value(n) AS INTEGER) AS field_len FROM (SELECT id, field, len(terms) AS n, unnest(terms) AS term FROM each) WHERE term <> '' GROUP BY field, term, id)"""


def index(query: tuple[str, ...], where: str = "true", end: str = "") -> str:
    """Ids that an index search of one or two plain words meets, with base, as its readings say."""
    name = lambda w, part: [(f.format("name"), w, b, z, part) for f, b, z in (("{}", 5.0, False), ("{}_edge_ngram", 1.0, False), ("{}", 0.5, True))]
    whole = [c for w in query for f in ("name", "search_names") for c in [(x[0].replace("name", f, 1), *x[1:]) for x in name(w, 0)]]
    readings = []
    known = {"museum": "museum", "castles": "castle", "castle": "castle"}
    category = lambda w, part: [(f, known[w], b, False, part) for f, b in (("value", 8.0), ("values", 7.0))]
    readings.append((0, 1.0, whole + (category(query[0], 0) if len(query) == 1 and query[0] in known else [])))
    if len(query) > 1:
        each = [c for i, w in enumerate(query) for c in name(w, i)]
        readings += [(2, 0.9, each), (4, 0.8, each)]
        if query[0] in known:
            readings.append((3, 0.9, category(query[0], 0) + [c for w in query[1:] for c in name(w, 1)]))
    rows = ", ".join(f"({n}, {wt}, {part}, {max(c[4] for c in cs) + 1}, '{f}', '{w}', {b}, {str(z).lower()})" for n, wt, cs in readings for f, w, b, z, part in cs)
    own = "[full_name, brand]"
    score = f"""round(base + 1000 * ns + 1000 * cat + CASE WHEN exact THEN 160000.0 ELSE 0.0 END + CASE tier WHEN 2 THEN (CASE WHEN exact OR ns >= 300 THEN 120000.0 ELSE 0.0 END)
   WHEN 1 THEN (CASE WHEN cat > 0 THEN 140000.0 WHEN ns > 0 THEN 70000.0 ELSE 0.0 END) ELSE (CASE WHEN cat > 0 THEN 60000.0 WHEN ns > 0 THEN 15000.0 ELSE 0.0 END) END + ln(1 + importance) * 1000, 2)"""
    q = " ".join(query)
    return f"""WITH {POSTS}, asked(reading, weight, part, parts, field, word, boost, fuzzy) AS (VALUES {rows}), docs AS (SELECT field, count(DISTINCT id) AS n_docs FROM posts GROUP BY field), df AS (SELECT field, term, count(*) AS df FROM posts GROUP BY field, term),
 terms AS (SELECT a.*, d.term, d.df, n.n_docs FROM asked a JOIN df d ON d.field = a.field AND (d.term = a.word OR (a.fuzzy AND levenshtein(d.term, a.word) <= 1)) JOIN docs n ON n.field = a.field),
 part AS (SELECT p.id, t.reading, t.weight, t.parts, t.part, sum(sqrt(p.tf) * (1 + ln(CAST(t.n_docs AS DOUBLE) / (t.df + 1))) / sqrt(p.field_len) * t.boost) AS s FROM posts p JOIN terms t ON t.field = p.field AND t.term = p.term GROUP BY ALL),
 whole AS (SELECT id, reading, weight, sum(s) AS s FROM part GROUP BY id, reading, weight, parts HAVING count(*) = parts), base AS (SELECT id, sum(s * weight) AS base FROM whole GROUP BY id),
 hit AS (SELECT k.id, k.full_name, k.lat, k.lon, k.key, k.value, k.importance, b.base, list_max(list_transform({own}, lambda x: {matched(fold('x'), q)})) AS ns, {some(own, f"{fold('trim(t)')} = '{q}'")} AS exact,
   list_max(list_transform(list_concat([k.value], k.vals), lambda v: CASE WHEN starts_with(k.key, 'addr:') OR k.key IN ('brand', 'wheelchair') THEN 0.0 WHEN lower(v) = '{q}' THEN 320.0 WHEN lower(k.key) = '{q}' THEN 140.0 WHEN '{q}' = 'castles' AND k.key = 'historic' AND v = 'castle' THEN 300.0 ELSE 0.0 END)) AS cat,
   list_max(list_transform(list_concat([k.key], k.keys), lambda x: CASE WHEN x = 'place' THEN 2 WHEN x IN ('amenity', 'shop', 'tourism', 'leisure', 'historic') THEN 1 ELSE 0 END)) AS tier FROM feats k JOIN base b USING (id) WHERE {where}),
 scored AS (SELECT id, full_name AS name, key, value, round(importance, 6) AS importance, round(base, 3) AS base, {score} AS score, lat, lon FROM hit)
 SELECT * {end or 'EXCLUDE (lat, lon) FROM scored'}"""


def index_near(what: str, where: str, radius_m: int) -> str:
    """The best hit of a place in the index, and the hits of a text around it."""
    ref = lambda c: f"(SELECT {c} FROM ({index((where,), end='FROM scored ORDER BY score DESC, id LIMIT 1')}))"
    return index((what,), metres("k.lat", "k.lon", ref("lat"), ref("lon")) + f" <= {radius_m}")


_TILE_VALUES = "list_filter([v, name, rank, housenumber, CASE WHEN layer = 'water' THEN 'water' END], lambda x: x <> '')"
TILE_SEARCH = f"""WITH {POI}, {LEVELS}, raw AS (SELECT osm_id, ['place','poi','transportation','water','landmark'][osm_id % 5 + 1] AS layer, v, name, CAST(osm_id % 30 AS VARCHAR) AS rank, housenumber, {metres('lat', 'lon', '47.14', '9.52')} AS distance FROM poi),
 t AS (SELECT *, CASE WHEN osm_id % 10 <> 0 THEN concat('pmtiles/', osm_id) ELSE concat('pmtiles/', layer, '-', osm_id) END AS id, {_TILE_VALUES} AS vals FROM raw WHERE layer <> 'landmark' AND distance <= 10000),
 hit AS (SELECT * FROM t WHERE {some('vals', "contains(lower(t), 'park')")}),
 tags AS (SELECT osm_id, u.pos, u.okey, u.value FROM hit, LATERAL (SELECT unnest(CASE layer WHEN 'place' THEN [{{'pos': 1, 'okey': 'place', 'value': v}}] WHEN 'poi' THEN [{{'pos': 2, 'okey': 'amenity', 'value': v}}, {{'pos': 3, 'okey': 'shop', 'value': v}}, {{'pos': 4, 'okey': 'tourism', 'value': v}}]
   WHEN 'transportation' THEN [{{'pos': 10, 'okey': 'highway', 'value': v}}] ELSE [{{'pos': 7, 'okey': 'natural', 'value': 'water'}}, {{'pos': 56, 'okey': 'water', 'value': v}}] END) AS u) UNION ALL SELECT osm_id, 74, 'addr:housenumber', housenumber FROM hit),
 cls AS (SELECT osm_id, pos, CASE okey WHEN 'highway' THEN 'street' ELSE okey END AS key, value, CASE WHEN okey LIKE 'addr:%' THEN 0.0 WHEN value = 'park' THEN 320.0 WHEN okey = 'park' THEN 140.0 ELSE 0.0 END AS cat, CASE WHEN okey = 'place' THEN 2 WHEN okey IN ('amenity', 'shop', 'tourism', 'natural') THEN 1 ELSE 0 END AS tier FROM tags),
 best AS (SELECT osm_id, max(cat) AS cat, max(tier) AS tier, arg_min(key, pos) AS key, arg_min(value, pos) AS value FROM cls GROUP BY osm_id),
 sig AS (SELECT id, name, key, value, distance, cat, tier, CASE WHEN osm_id % 30 = 0 THEN 0.0 WHEN osm_id % 30 <= 20 THEN 20.0 - osm_id % 30 ELSE osm_id % 30 END AS importance, list_max(list_transform(vals, lambda x: {matched(fold('x'), 'park')})) AS base, {matched(fold('name'), 'park')} AS ns, {fold('trim(name)')} = 'park' AS exact FROM hit JOIN best USING (osm_id)),
 scored AS (SELECT id, name, key, value, distance, importance, round(base + 1000 * ns + 1000 * cat + CASE WHEN exact THEN 160000.0 ELSE 0.0 END + CASE tier WHEN 2 THEN (CASE WHEN exact OR ns >= 300 THEN 120000.0 ELSE 0.0 END) WHEN 1 THEN (CASE WHEN cat > 0 THEN 140000.0 WHEN ns > 0 THEN 70000.0 ELSE 0.0 END)
   ELSE (CASE WHEN cat > 0 THEN 60000.0 WHEN ns > 0 THEN 15000.0 ELSE 0.0 END) END - CASE WHEN name = '' THEN 160000.0 ELSE 0.0 END + CASE WHEN importance > 0 THEN ln(1 + importance) * 1000 ELSE 0.0 END, 4) AS score FROM sig)
 SELECT *, CAST(row_number() OVER (ORDER BY score DESC, id) AS INTEGER) AS rank FROM scored ORDER BY score DESC, id LIMIT 100"""


SQL: dict[str, str] = {
    "normalize_text": f"WITH {POI} SELECT osm_id, {fold('name')} AS folded, {compact(fold('name'))} AS compacted FROM poi",
    "tokenize_text": f"WITH {POI} SELECT osm_id, array_to_string(list_filter({words('lower(description)')}, lambda t: t NOT IN ({_STOP})), '|') AS terms FROM poi",
    "edge_ngrams": f"WITH {POI} SELECT osm_id, array_to_string(flatten(list_transform({words('lower(name)')}, lambda t: list_transform(range(1, least(12, length(t)) + 1), lambda n: substring(t, 1, n)))), '|') AS terms FROM poi",
    "substring_ngrams": f"WITH {POI} SELECT osm_id, array_to_string(flatten(list_transform({words('lower(name)')}, lambda t: flatten(list_transform(range(2, least(15, length(t)) + 1), lambda n: list_transform(range(1, length(t) - n + 2), lambda i: substring(t, i, n)))))), '|') AS terms FROM poi",
    "keyword_terms": f"WITH {POI} SELECT osm_id, lower(city) AS term FROM poi",
    "byte_edit_distance": f"WITH {POI} SELECT a.osm_id, CAST(levenshtein(a.name, b.name) AS INTEGER) AS distance, levenshtein(a.name, {fold('a.name')}) <= 1 AS nearly FROM poi a JOIN poi b ON b.osm_id = a.osm_id + 1",
    "classify_all": f"WITH {CLASSES} SELECT osm_id, CAST(row_number() OVER (PARTITION BY osm_id ORDER BY pos) - 1 AS INTEGER) AS at, key, value, ont_level, round(importance, 6) AS importance FROM classes",
    "classify_best": f"WITH {BEST} SELECT osm_id, key, value, ont_level, round(importance, 6) AS importance FROM best",
    "classify_counts": f"WITH {BEST} SELECT key, count(*) AS n, round(max(importance), 6) AS top, round(avg(importance), 6) AS mean FROM best GROUP BY key",
    "boost_patterns": f"WITH {POI} SELECT osm_id, k = 'place' OR v = 'place' AS plain, k = 'amenity' AND v = 'cafe' AS both, k = 'shop' AS any_value, k = 'shop' AS no_value, v = 'castle' AS any_key, v = 'castle' AS no_key FROM poi",
    "ontology_levels": f"WITH {POI} SELECT k AS osm_key, v AS osm_value, CAST(min(length(population) % 7) AS INTEGER) AS level, array_to_string(list_sort(list(DISTINCT wikidata)), ',') AS qids FROM poi GROUP BY k, v HAVING count(DISTINCT wikidata) > 1",
    "ontology_label_lookup": f"WITH {POI}, o(label, k, val) AS (VALUES ('city','place','city'), ('museum','tourism','museum'), ('park','leisure','park'), ('castle','historic','castle'), ('restaurant','amenity','restaurant'), ('cafe','amenity','cafe'), ('village','place','village')) SELECT osm_id, o.k AS osm_key, o.val AS osm_value, osm_id % 2 = 0 AS plural FROM poi JOIN o ON o.label = poi.v",
    "wikidata_scores": "SELECT concat('Q', o_custkey % 200) AS wikidata_id, round(max(o_totalprice / 1e6), 9) AS score FROM orders GROUP BY 1",
    "wikidata_scores_by_language": "SELECT concat('Q', o_custkey % 200) AS wikidata_id, ['en','de','fr','es','it'][o_orderkey % 5 + 1] AS language, round(max(o_totalprice / 1e6), 9) AS score FROM orders GROUP BY 1, 2",
    "wikidata_redirects": "SELECT concat('Q', o_custkey % 200) AS wikidata_id, count(*) AS n_redirects, array_to_string(list_sort(list(concat('T', o_orderkey))), ',') AS titles FROM orders WHERE o_orderstatus = 'P' GROUP BY 1",
    "wikidata_boosted": f"WITH {BEST}, a AS (SELECT concat('Q', o_custkey % 200) AS q, max(o_totalprice / 1e6) AS s FROM orders GROUP BY 1), d AS (SELECT concat('Q', o_custkey % 200) AS q, max(o_totalprice / 1e6) AS s FROM orders WHERE o_orderkey % 5 = 1 GROUP BY 1) SELECT b.osm_id, round(b.importance + 10 * coalesce(d.s, a.s, 0), 6) AS importance FROM best b JOIN poi p USING (osm_id) LEFT JOIN a ON a.q = p.wikidata LEFT JOIN d ON d.q = p.wikidata",
    "redirect_names": f"WITH {BEST}, r AS (SELECT DISTINCT concat('Q', o_custkey % 200) AS q, concat('T', o_orderkey) AS title FROM orders WHERE o_orderstatus = 'P') SELECT b.osm_id, r.title FROM best b JOIN poi p USING (osm_id) JOIN r ON r.q = p.wikidata",
    "classify_joined": f"WITH {CLASSES}, own AS (SELECT k, v, CAST(min(length(population) % 7) AS INTEGER) AS level FROM poi WHERE osm_id % 3 > 0 GROUP BY k, v) SELECT c.osm_id, c.key, c.value, coalesce(own.level, -1) AS ont_level FROM classes c LEFT JOIN own ON own.v = c.value AND (CASE WHEN own.k = 'highway' THEN 'street' ELSE own.k END) = c.key",
    "plain_name": f"WITH {POI} SELECT osm_id, CASE WHEN osm_id % 4 = 0 THEN concat('de ', name) WHEN osm_id % 4 = 1 THEN concat('en ', name) WHEN osm_id % 4 = 2 THEN name ELSE '' END AS name FROM poi",
    "enhance_name": f"WITH {POI}, {NAMED} SELECT osm_id, full_name FROM named",
    "only_named": f"WITH {POI} SELECT osm_id FROM poi WHERE name <> ''",
    "other_names": f"WITH {POI} SELECT osm_id, CASE WHEN brand <> '' THEN concat('brand=', brand) ELSE '' END AS names FROM poi",
    "display_address": f"WITH {POI} SELECT osm_id, concat_ws(', ', housenumber, street, city, postcode, country) AS address, concat_ws(', ', housenumber, street, city, postcode) AS short FROM poi",
    "contact_fields": f"WITH {POI} SELECT osm_id, CASE WHEN phone <> '' THEN phone ELSE contact_phone END AS phone, wheelchair, opening_hours FROM poi",
    "filter_key_value": f"WITH {POI} SELECT osm_id FROM poi WHERE k = 'amenity' AND v = 'cafe'",
    "filter_multi_key": f"WITH {POI} SELECT osm_id FROM poi WHERE k IN ('shop', 'tourism') AND v IN ('bakery', 'museum')",
    "filter_address": f"WITH {POI} SELECT osm_id FROM poi WHERE k <> 'foo_' AND contains(lower(street), 'street 1') AND postcode = '9481' AND contains(lower(city), 'nation_') AND country = 'CH' AND contains(lower(country), 'ch')",
    "filter_contact": f"WITH {POI} SELECT osm_id FROM poi WHERE (contains(CASE WHEN phone <> '' THEN phone ELSE '' END, '+423') OR contains(contact_phone, '+423')) AND wheelchair = 'limited' AND contains(lower(opening_hours), '09:00')",
    "filter_indexed": f"WITH {BEST}, kv AS (SELECT osm_id, bool_or(lower(key) IN ('tourism', 'shop')) AS has_key FROM classes GROUP BY 1) SELECT p.osm_id FROM poi p JOIN kv USING (osm_id) WHERE has_key AND lower(postcode) = '9482' AND wheelchair = 'limited'",
    "radius_search": f"WITH {POI}, m AS (SELECT osm_id, {metres('lat', 'lon', '47.14', '9.52')} AS metres FROM poi) SELECT osm_id, metres FROM m WHERE metres <= 5000",
    "bbox_search": f"WITH {POI} SELECT osm_id FROM poi WHERE lat BETWEEN 47.1 AND 47.2 AND lon BETWEEN 9.5 AND 9.6",
    "radius_join": f"WITH {POI}, a AS (SELECT * FROM poi WHERE k = 'place'), b AS (SELECT * FROM poi WHERE k = 'amenity'), j AS (SELECT a.osm_id, {metres('a.lat', 'a.lon', 'b.lat', 'b.lon')} AS m FROM a, b) SELECT osm_id AS place_id, count(*) AS n, min(m) AS nearest_m FROM j WHERE m <= 3000 GROUP BY 1",
    "tile_of_point": f"WITH {POI} SELECT osm_id, CAST(trunc((lon + 180.0) / 360.0 * 16384) AS INTEGER) AS x, CAST(trunc((1.0 - ln(tan(radians(lat)) + 1.0 / cos(radians(lat))) / pi()) / 2.0 * 16384) AS INTEGER) AS y FROM poi",
    "tile_range": f"WITH {POI}, t AS (SELECT osm_id, trunc((lon + 180.0) / 360.0 * 4096) AS x, trunc((1.0 - ln(tan(radians(lat)) + 1.0 / cos(radians(lat))) / pi()) / 2.0 * 4096) AS y FROM poi) SELECT osm_id FROM t WHERE x BETWEEN trunc((9.5 + 180.0) / 360.0 * 4096) AND trunc((9.6 + 180.0) / 360.0 * 4096) AND y BETWEEN trunc((1.0 - ln(tan(radians(47.2)) + 1.0 / cos(radians(47.2))) / pi()) / 2.0 * 4096) AND trunc((1.0 - ln(tan(radians(47.1)) + 1.0 / cos(radians(47.1))) / pi()) / 2.0 * 4096)",
    "required_nodes": "SELECT DISTINCT ref FROM (SELECT l_partkey AS ref FROM lineitem WHERE l_partkey % 7 <> 0 UNION ALL SELECT o_orderkey % 200 + 1 FROM orders WHERE o_orderstatus = 'P')",
    "way_geometry": f"WITH {WAYS} SELECT id, count(*) AS n_points, round(sum(lon), 6) AS sum_lon, round(sum(lat * i), 5) AS weighted_lat FROM good GROUP BY id",
    "way_envelope": f"WITH {WAYS} SELECT id, {R5.format(x='min(lon)')} AS min_lon, {R5.format(x='max(lon)')} AS max_lon, {R5.format(x='min(lat)')} AS min_lat, {R5.format(x='max(lat)')} AS max_lat FROM good GROUP BY id",
    "way_centroid": f"WITH {SEGMENTS}, {CLOSED} SELECT id, round(CASE WHEN sum(len) > 0 THEN sum(len * (x1 + x2) / 2) / sum(len) ELSE min(fx) END, 7) AS lon, round(CASE WHEN sum(len) > 0 THEN sum(len * (y1 + y2) / 2) / sum(len) ELSE min(fy) END, 7) AS lat FROM s WHERE id NOT IN (SELECT id FROM closed) GROUP BY id",
    "way_midpoint": f"WITH {SEGMENTS}, {CLOSED}, c AS (SELECT *, sum(len) OVER (PARTITION BY id ORDER BY i) AS upto, sum(len) OVER (PARTITION BY id) / 2 AS half FROM s), h AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY i) AS r FROM c WHERE len > 0 AND upto >= half), f AS (SELECT id, min(fx) AS fx, min(fy) AS fy FROM s GROUP BY id) SELECT f.id, round(coalesce(x1 + (x2 - x1) * (half - (upto - len)) / len, f.fx), 7) AS lon, round(coalesce(y1 + (y2 - y1) * (half - (upto - len)) / len, f.fy), 7) AS lat FROM f LEFT JOIN (SELECT * FROM h WHERE r = 1) h ON h.id = f.id WHERE f.id NOT IN (SELECT id FROM closed)",
    "multi_line_point": f"""WITH {MULTI}, c AS (SELECT o.*, l.total / 2 AS half, sum(o.len) OVER (PARTITION BY o.cust ORDER BY o.i) AS upto FROM owned o JOIN longest l ON l.cust = o.cust AND l.id = o.id),
 h AS (SELECT *, row_number() OVER (PARTITION BY cust ORDER BY i) AS r FROM c WHERE len > 0 AND upto >= half), f AS (SELECT cust, min(fx) AS fx, min(fy) AS fy FROM c GROUP BY cust)
 SELECT f.cust AS id, round(coalesce(x1 + (x2 - x1) * (half - (upto - len)) / len, f.fx), 7) AS lon, round(coalesce(y1 + (y2 - y1) * (half - (upto - len)) / len, f.fy), 7) AS lat FROM f LEFT JOIN (SELECT * FROM h WHERE r = 1) h ON h.cust = f.cust""",
    "multi_shape_search": f"""WITH {MULTI}, {FLAT}, away AS (SELECT id, min(sqrt(pow(x1 + t * dx, 2) + pow(y1 + t * dy, 2))) AS m FROM (SELECT *, CASE WHEN dx * dx + dy * dy > 0 THEN greatest(0.0, least(1.0, -(x1 * dx + y1 * dy) / (dx * dx + dy * dy))) ELSE 0.0 END AS t FROM flat) GROUP BY id),
 env AS (SELECT o.o_custkey AS cust, min(g.lon) AS a, max(g.lon) AS b, min(g.lat) AS c, max(g.lat) AS d FROM good g JOIN orders o ON o.o_orderkey = g.id GROUP BY 1),
 best AS (SELECT z.cust, min(m) AS m FROM sizes z JOIN away w ON w.id = z.id GROUP BY z.cust)
 SELECT e.cust AS id, m <= 800 AS precise, round(m, 4) AS metres FROM env e JOIN best USING (cust) WHERE d >= 47.14 - 800 / 111000.0 AND c <= 47.14 + 800 / 111000.0
 AND b >= 9.52 - 800 / (6367000 * cos(radians(47.14)) * pi() / 180) AND a <= 9.52 + 800 / (6367000 * cos(radians(47.14)) * pi() / 180)""",
    "multi_polygon_point": f"""WITH {POI}, m AS (SELECT osm_id, lon, lat, 0.002 + 0.006 * (osm_id % 2) AS h, 0.03 * (osm_id % 3) AS away, osm_id % 3 > 0 AS two FROM poi),
 c AS (SELECT *, CASE WHEN two THEN away * 0.0004 / (0.0008 - 4 * h * h) ELSE 0.0 END AS shift FROM m)
 SELECT osm_id, round(lon + shift, 6) AS lon, round(lat, 6) AS lat, (shift > h AND shift < 0.01) OR (two AND abs(shift - away) < 0.01) AS held, true AS inside FROM c""",
    "relation_point_any": f"""WITH {NODES}, own AS (SELECT l_orderkey AS id, arg_min(olon, k) AS lon, arg_min(olat, k) AS lat FROM (SELECT l_orderkey, l_linenumber * 1000000000000 + l_partkey * 1000000 + l_suppkey AS k,
  CAST(947000 + ((l_partkey + 1) * 104729) % 18000 AS DOUBLE) / 100000.0 AS olon, CAST(4700000 + ((l_partkey + 1) * 7919) % 28000 AS DOUBLE) / 100000.0 AS olat FROM lineitem WHERE l_partkey % 7 = 0) GROUP BY 1),
 m AS (SELECT o.o_custkey AS id, o.o_orderkey AS pos, n.lon, n.lat FROM orders o JOIN nodes n ON n.id = o.o_orderkey % 200 + 1 WHERE o.o_orderstatus = 'P' UNION ALL SELECT o.o_custkey, o.o_orderkey, w.lon, w.lat FROM orders o JOIN own w ON w.id = o.o_orderkey % 200 + 1 WHERE o.o_orderstatus = 'O')
 SELECT id, arg_min(lon, pos) AS lon, arg_min(lat, pos) AS lat FROM m GROUP BY id""",
    "relation_point": f"WITH {NODES}, m AS (SELECT o.o_custkey AS id, o.o_orderkey AS pos, n.lon, n.lat FROM orders o JOIN nodes n ON n.id = o.o_orderkey % 200 + 1 WHERE o.o_orderstatus = 'P') SELECT id, arg_min(lon, pos) AS lon, arg_min(lat, pos) AS lat FROM m GROUP BY id",
    "text_match_score": f"WITH {POI} SELECT osm_id, {matched(fold('name'), 'the')} AS score FROM poi",
    "category_match_score": f"WITH {POI}, {KINDS} SELECT osm_id, max(CASE WHEN starts_with(key, 'addr:') OR key IN ('brand', 'wheelchair') THEN 0.0 WHEN value = 'museum' THEN 320.0 WHEN key = 'museum' THEN 140.0 ELSE 0.0 END) AS score FROM kinds GROUP BY osm_id",
    "direct_search": direct("the", metres("lat", "lon", "47.14", "9.52") + " <= 15000"),
    "direct_category": direct("restaurant", "true"),
    "direct_search_prefix": direct("thth", "true", f"contains(lower(t), 'thth') OR starts_with({compact('lower(t)')}, 'thth') OR {some(words('lower(t)'), 'starts_with(t, chr(116) || chr(104) || chr(116) || chr(104))').replace('lambda t: starts_with(t,', 'lambda u: starts_with(u,')}"),
    "direct_search_fuzzy": direct("cestle", "true", f"contains(lower(t), 'cestle') OR levenshtein({compact('lower(t)')}, 'cestle') <= 1 OR {some(words('lower(t)'), 'X').replace('lambda t: X', 'lambda u: levenshtein(u, ' + chr(39) + 'cestle' + chr(39) + ') <= 1')}"),
    "direct_page": direct("the", "true", page="LIMIT 20 OFFSET 15"),
    "exact_names": f"WITH {BEST}, {NAMED}, f AS (SELECT osm_id, {ID.replace('entity_type', 'n.entity_type')} AS id, {fold('trim(full_name)')} AS folded FROM named n JOIN best USING (osm_id)) SELECT a.osm_id AS qid, b.id FROM f a JOIN f b USING (folded) WHERE folded <> ''",
    "postings": f"WITH {POSTS} SELECT field, term, id, tf, field_len FROM posts",
    "term_stats": f"WITH {POSTS}, n AS (SELECT field, count(DISTINCT id) AS n_docs FROM posts GROUP BY field) SELECT field, term, count(*) AS df, min(n_docs) AS n_docs FROM posts JOIN n USING (field) GROUP BY field, term",
    "edit_neighbours": f"WITH {POSTS}, t AS (SELECT term, count(*) AS df FROM posts WHERE field = 'name' GROUP BY term) SELECT a.term AS word, b.term AS term, b.df FROM t a JOIN t b ON abs(strlen(a.term) - strlen(b.term)) <= 1 AND levenshtein(a.term, b.term) <= 1",
    "index_filters": f"WITH {POSTS} SELECT f.id FROM feats f WHERE (f.key IN ('tourism', 'shop') OR list_has_any(f.keys, ['tourism', 'shop'])) AND f.wheelchair = 'limited' AND list_has_any({words('lower(street)')}, ['main']) AND list_has_any({words('lower(city)')}, ['nation', '2'])",
    "index_exact_first": f"""WITH {POSTS}, n AS (SELECT {fold('trim(full_name)')} AS folded, count(*) AS n FROM feats WHERE full_name <> '' GROUP BY 1), top AS (SELECT folded FROM n ORDER BY n DESC, folded LIMIT 1)
 SELECT id, full_name AS name, CAST(row_number() OVER (ORDER BY importance DESC, id) AS INTEGER) AS rank FROM feats WHERE {fold('trim(full_name)')} = (SELECT folded FROM top)""",
    "index_best_filtered": f"""WITH {POSTS}, s AS (SELECT id, full_name AS name, round(1.0 + importance * 1000, 6) AS score FROM feats f
  WHERE (f.key IN ('tourism', 'shop') OR list_has_any(f.keys, ['tourism', 'shop'])) AND f.wheelchair = 'limited' AND list_has_any({words('lower(street)')}, ['main']))
 SELECT id, name, round(score, 2) AS score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (ORDER BY score DESC, id) AS rank FROM s) WHERE rank BETWEEN 6 AND 30""",
    "index_search": index(("museum",)),
    "index_near": index_near("castles", "thent", 20000),
    "index_multiword": index(("castles", "er"), "k.osm_id IN (SELECT osm_id FROM classes WHERE key = 'historic')"),
    "near_queries": f"{NEAR} SELECT qid, CASE WHEN ok THEN what END AS what, CASE WHEN ok THEN place END AS place FROM near",
    "query_fields": f"{NEAR} SELECT qid, CAST(CASE WHEN query = '' THEN 0 ELSE length(query) - length(replace(query, ' ', '')) + 1 END AS INTEGER) AS n FROM q",
    "split_address": f"WITH {POI} SELECT osm_id, 'Main St' AS street, CASE WHEN osm_id % 3 = 2 AND osm_id % 2 = 0 THEN '' ELSE CAST(osm_id AS VARCHAR) END AS number FROM poi WHERE osm_id % 3 <> 2 UNION ALL SELECT osm_id, 'Main St', CASE WHEN osm_id % 2 = 0 THEN '' ELSE CAST(osm_id AS VARCHAR) END FROM poi WHERE osm_id % 3 = 2",
    "parse_radius": f"WITH {POI} SELECT osm_id, CAST(CASE osm_id % 4 WHEN 0 THEN osm_id * 1000 WHEN 1 THEN osm_id WHEN 2 THEN osm_id ELSE 0 END AS INTEGER) AS metres FROM poi",
    "tile_layers": "WITH t AS (SELECT ['place','poi','transportation','water','landmark'][doc_id % 5 + 1] AS layer FROM documents) SELECT layer, count(*) AS n_features, 'class,housenumber,name,rank' AS keys FROM t GROUP BY 1",
    "tile_tags": f"""WITH {POI}, t AS (SELECT osm_id, ['place','poi','transportation','water','landmark'][osm_id % 5 + 1] AS layer, v, housenumber FROM poi)
 SELECT CASE WHEN osm_id % 10 <> 0 THEN concat('pmtiles/', osm_id) ELSE concat('pmtiles/', layer, '-', osm_id) END AS id,
 CASE WHEN layer = 'place' THEN v ELSE '' END AS place, CASE WHEN layer = 'poi' THEN v ELSE '' END AS amenity, CASE WHEN layer = 'transportation' THEN v ELSE '' END AS highway,
 CASE WHEN layer = 'water' THEN 'water' ELSE '' END AS natural_, CAST(osm_id % 30 AS VARCHAR) AS importance, housenumber FROM t WHERE layer <> 'landmark'""",
    "relation_stats": "WITH r AS (SELECT o_custkey AS id, count(*) AS n FROM orders GROUP BY 1) SELECT CASE id % 4 WHEN 0 THEN 'route' WHEN 1 THEN 'boundary' ELSE 'other' END AS kind, count(*) AS n, CAST(sum(CASE WHEN id % 4 = 0 OR id % 3 <> 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_unique, CAST(sum(n) AS BIGINT) AS members, round(avg(n), 6) AS mean_members FROM r GROUP BY 1",
    "route_types": "SELECT CASE id % 8 WHEN 0 THEN 'bus' ELSE 'train' END AS route, count(*) AS n FROM (SELECT DISTINCT o_custkey AS id FROM orders) WHERE id % 4 = 0 GROUP BY 1",
    "cache_gaps": "WITH l AS (SELECT concat(event_type, user_id) AS key, epoch(ts) - lag(epoch(ts)) OVER (PARTITION BY concat(event_type, user_id) ORDER BY ts) AS gap FROM events) SELECT key, count(*) AS n, CAST(sum(CASE WHEN gap <= 86400 THEN 1 ELSE 0 END) AS BIGINT) AS fresh FROM l GROUP BY 1",
    "log_buckets": "SELECT concat(event_type, user_id) AS key, CAST(floor(epoch(ts) / 86400) AS BIGINT) AS bucket, count(*) AS n FROM events GROUP BY 1, 2",
    "build_counts": f"WITH {CLASSES} SELECT entity_type, count(*) AS scanned, count(*) FILTER (osm_id IN (SELECT osm_id FROM classes)) AS imported, count(*) FILTER (osm_id NOT IN (SELECT osm_id FROM classes)) AS skipped FROM poi GROUP BY 1",
    "tile_at_point": f"WITH {POI}, z AS (SELECT unnest(range(6, 13)) AS z), f AS (SELECT z, ['place','poi','transportation','water','landmark'][osm_id % 5 + 1] AS layer, {tile('lon', 'lat', 'pow(2, z)')} FROM poi, z), a AS (SELECT z, {tile('9.52', '47.14', 'pow(2, z)')} FROM z) SELECT CAST(z AS INTEGER) AS z, x, y, layer, count(*) AS n_features FROM f JOIN a USING (z, x, y) GROUP BY ALL",
    "line_radius_search": f"WITH {SEGMENTS}, {CLOSED}, {FLAT}, near AS (SELECT id, min(sqrt(px * px + py * py)) AS m FROM (SELECT id, x1 + t * dx AS px, y1 + t * dy AS py FROM (SELECT *, CASE WHEN dx * dx + dy * dy > 0 THEN greatest(0.0, least(1.0, -(x1 * dx + y1 * dy) / (dx * dx + dy * dy))) ELSE 0.0 END AS t FROM flat)) GROUP BY id), inside AS (SELECT id FROM flat WHERE id IN (SELECT id FROM closed) GROUP BY id HAVING count(*) FILTER ((y1 > 0) <> (y2 > 0) AND 0 < x1 - y1 * (x2 - x1) / CASE WHEN y2 <> y1 THEN y2 - y1 END) % 2 = 1), d AS (SELECT id, CASE WHEN id IN (SELECT id FROM inside) THEN 0.0 ELSE m END AS m FROM near), v AS (SELECT id, bool_or({metres('lat', 'lon', '47.14', '9.52')} <= 500) AS v FROM good GROUP BY id) SELECT id, round(m, 2) AS metres FROM d JOIN v USING (id) WHERE v OR m <= 500",
    "way_geojson": f"WITH {WAYS}, {CLOSED}, t AS (SELECT id, string_agg('[' || CAST({R5.format(x='lon')} AS VARCHAR) || ',' || CAST({R5.format(x='lat')} AS VARCHAR) || ']', ',' ORDER BY i) AS c FROM good GROUP BY id) SELECT id, CASE WHEN id IN (SELECT id FROM closed) THEN concat('{{\"type\":\"Polygon\",\"coordinates\":[[', c, ']]}}') ELSE concat('{{\"type\":\"LineString\",\"coordinates\":[', c, ']}}') END AS geojson FROM t",
    "direct_near": direct_near("museum", "the", 20000),
    "text_output": f"WITH d AS ({direct('castle', 'true', page='LIMIT 25', more=MORE)}), n AS (SELECT count(*) AS total FROM ({direct('castle', 'true', page=' ')})) SELECT rank, concat_ws(chr(10), 'id: ' || id, printf('score: %.6f', score), CASE WHEN name <> '' THEN 'name: ' || name END, 'key: ' || key, 'value: ' || value, printf('importance: %.6f', importance), printf('lat: %.5f', lat), printf('lon: %.5f', lon), CASE WHEN address <> '' THEN 'address: ' || address END, CASE WHEN phone <> '' THEN 'phone: ' || phone END) AS block FROM d UNION ALL SELECT 1000000000, concat('---', chr(10), 'total: ', min(total), chr(10), 'returned: ', (SELECT count(*) FROM d)) FROM n",
    "json_output": f"SELECT rank, CAST(json_object('id', id, 'lat', lat, 'lon', lon, 'name', name, 'key', key, 'value', value, 'importance', importance, 'score', score, 'address', address, 'phone', phone) AS VARCHAR) AS json FROM ({direct('castle', 'true', page='LIMIT 25', more=MORE)})",
    "tile_search": TILE_SEARCH,
    "way_point": f"""WITH {SEGMENTS}, {CLOSED}, c AS (SELECT *, sum(len) OVER (PARTITION BY id ORDER BY i) AS upto, sum(len) OVER (PARTITION BY id) / 2 AS half FROM s),
 h AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY i) AS r FROM c WHERE len > 0 AND upto >= half), f AS (SELECT id, min(fx) AS fx, min(fy) AS fy, CASE WHEN sum(len) > 0 THEN sum(len * (x1 + x2) / 2) / sum(len) ELSE min(fx) END AS lx, CASE WHEN sum(len) > 0 THEN sum(len * (y1 + y2) / 2) / sum(len) ELSE min(fy) END AS ly FROM s GROUP BY id),
 line AS (SELECT f.id, coalesce(x1 + (x2 - x1) * (half - (upto - len)) / len, f.fx) AS lon, coalesce(y1 + (y2 - y1) * (half - (upto - len)) / len, f.fy) AS lat FROM f LEFT JOIN (SELECT * FROM h WHERE r = 1) h ON h.id = f.id WHERE f.id NOT IN (SELECT id FROM closed)),
 own AS (SELECT * FROM s WHERE id IN (SELECT id FROM closed)), area AS (SELECT id, sum(c) AS tw, sum((x1 - fx + x2 - fx) * c) AS sx, sum((y1 - fy + y2 - fy) * c) AS sy FROM (SELECT *, (x1 - fx) * (y2 - fy) - (x2 - fx) * (y1 - fy) AS c FROM own) GROUP BY id),
 centre AS (SELECT id, CASE WHEN abs(tw) > 1e-15 THEN fx + sx / (3 * tw) ELSE lx END AS cx, CASE WHEN abs(tw) > 1e-15 THEN fy + sy / (3 * tw) ELSE ly END AS cy, fx, fy FROM area JOIN f USING (id)),
 inside AS (SELECT id, count(*) FILTER ((y1 > cy) <> (y2 > cy) AND cx < x1 + (cy - y1) * (x2 - x1) / CASE WHEN y2 <> y1 THEN y2 - y1 END) % 2 = 1 AS held FROM own JOIN centre USING (id) GROUP BY id),
 tall AS (SELECT id, (hs[k] + coalesce(hs[k + 1], hs[k])) / 2 AS y FROM (SELECT id, hs, greatest(len(hs) // 2, 1) AS k FROM (SELECT id, list_sort(list(DISTINCT lat)) AS hs FROM good GROUP BY id))),
 crossing AS (SELECT id, y, list_sort(list(x1 + (y - y1) * (x2 - x1) / (y2 - y1))) AS xs FROM own JOIN tall USING (id) WHERE (y1 > y) <> (y2 > y) GROUP BY id, y),
 wide AS (SELECT id, y, list_max(list_transform(list_filter(range(1, len(xs)), lambda k: k % 2 = 1), lambda k: {{'w': xs[k + 1] - xs[k], 'x': (xs[k + 1] + xs[k]) / 2}})) AS m FROM crossing),
 ring AS (SELECT id, CASE WHEN held THEN cx ELSE coalesce(m.x, fx) END AS lon, CASE WHEN held THEN cy WHEN m IS NULL THEN fy ELSE y END AS lat FROM centre JOIN inside USING (id) LEFT JOIN wide USING (id))
 SELECT id, 'line' AS shape, round(lon, 7) AS lon, round(lat, 7) AS lat FROM line UNION ALL SELECT id, 'polygon', round(lon, 7), round(lat, 7) FROM ring""",
    "near_batch": f"""WITH {BEST}, {NAMED}, f AS (SELECT n.osm_id, concat(n.entity_type, '/', n.osm_id) AS id, n.full_name, n.lat, n.lon, round(b.importance, 6) AS imp FROM named n JOIN best b USING (osm_id)),
 w AS (SELECT DISTINCT id, lat, lon, imp, unnest({words(fold('full_name'))}) AS word FROM f),
 {NEAR.removeprefix('WITH ')}, asked AS (SELECT qid, {fold('what')} AS what, {fold('place')} AS place FROM near WHERE ok),
 pl AS (SELECT DISTINCT qid, what, unnest({words('place')}) AS word FROM asked),
 ref AS (SELECT * FROM (SELECT p.qid, p.what, w.id AS ref_id, w.lat AS rlat, w.lon AS rlon, row_number() OVER (PARTITION BY p.qid ORDER BY w.imp DESC, w.id DESC) AS r FROM pl p JOIN w USING (word)) WHERE r = 1),
 x AS (SELECT DISTINCT qid, ref_id, rlat, rlon, unnest({words('what')}) AS word FROM ref),
 hit AS (SELECT x.qid, x.ref_id, w.id, {metres('w.lat', 'w.lon', 'x.rlat', 'x.rlon')} AS m FROM x JOIN w USING (word))
 SELECT qid, ref_id, count(DISTINCT id) AS n_hits, min(m) AS nearest_m FROM hit WHERE m <= 5000 GROUP BY 1, 2""",
}
