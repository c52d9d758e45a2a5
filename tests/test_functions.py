"""Scalar functions and small operators on fixed cases."""

import math

import pytest
from pyspark.sql import functions as F

from placemill.config import Config, Importance, Params
from placemill.functions import geo, text
from placemill.operators import classify, filters, geometry, names, ontology, ranking, stats, tiles


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def tags(**kv):
    return F.create_map(*[F.lit(x) for k, v in kv.items() for x in (k.replace("__", ":"), v)]) if kv else F.create_map().cast("map<string,string>")


def test_folding_and_tokens(spark):
    assert one(spark, text.fold(F.lit("Élan ÖÄÜß Æþð ñø"))) == "elan oeaeuess aethd no"
    assert one(spark, text.compact(F.lit("a-b c.1"))) == "abc1" and one(spark, text.tokens(F.lit("a-b  c.1"))) == ["a", "b", "c", "1"]
    assert one(spark, text.trim(F.lit("  x y\t\n"))) == "x y"
    assert one(spark, text.standard(F.lit("The Inn at Vaduz"))) == ["inn", "vaduz"]
    assert one(spark, text.edge_ngrams(F.lit("Abc d"))) == ["a", "ab", "abc", "d"]
    assert one(spark, text.ngrams(F.lit("abc"))) == ["ab", "bc", "abc"]


@pytest.mark.parametrize(("a", "b", "near"), [("berlin", "brlin", True), ("münchen", "munchen", False), ("a", "abc", False), ("", "a", True), ("same", "same", True)])
def test_byte_edits(spark, a, b, near):
    assert one(spark, text.within_one_edit(F.lit(a), F.lit(b))) is near


@pytest.mark.parametrize(("value", "query", "score"), [("Vaduz", "vaduz", 400), ("Vaduz Post", "Vaduz", 300), ("St. Moritz", "stmo", 220), ("Berlin", "Brlin", 160), ("Berlin", "Paris", 0), ("", "x", 0), ("x", " ", 0)])
def test_text_match(spark, value, query, score):
    assert one(spark, text.text_match(F.lit(value), F.lit(query))) == score


@pytest.mark.parametrize(("found", "query", "prefix", "fuzzy", "hit"), [({"name": "McDonald's"}, "mcdonald", 0, 0, True), ({"name": "Fast Food", "alt_name": "Micky D"}, "micky", 0, 0, True), ({"name": "Fast Food", "description": "Cheap burgers"}, "burger", 0, 0, True), ({"name": "McDonald's"}, "burger", 0, 0, False), ({"name": "Berlin"}, "brlin", 0, 1, True), ({"name": "Berlin"}, "brlin", 0, 0, False), ({"name": "Mc.Donald's"}, "mcd", 1, 0, True), ({"name": "Mc.Donald's"}, "mcd", 0, 0, False)])
def test_direct_text(spark, found, query, prefix, fuzzy, hit):
    assert one(spark, filters.direct_text(tags(**found), Params(query=query, prefix=bool(prefix), fuzzy=bool(fuzzy)))) is hit


@pytest.mark.parametrize(("street", "number", "want"), [("Main St 123", "", ("Main St", "123")), ("123 Main St", "", ("Main St", "123")), ("Main St 123", "123", ("Main St", "123")), ("123 Main St", "123", ("Main St", "123")), ("Main St", "5", ("Main St", "5")), ("Main St 7", "5", ("Main St 7", "5"))])
def test_split_address(spark, street, number, want):
    s, n = text.split_address(F.lit(street), F.lit(number))
    assert (one(spark, s), one(spark, n)) == want


def test_params():
    p = Params.from_query({"q": "pizza near Vaduz", "limit": "5000", "from": "-3", "fuzzy": "true", "prefix": "yes", "keys": "a,b", "lat": "47.1", "lon": "x", "radius": "1.5km"}, ("de",))
    assert (p.page_size, p.offset, p.fuzzy, p.prefix, p.keys, p.lat, p.lon, p.radius_m, p.langs) == (1000, 0, True, False, ("a", "b"), 47.1, None, 1500, ("de",))
    assert p.near == ("pizza", "Vaduz") and Params().page_size == 100 and Params(radius="5mi").radius_m == 5
    assert [Params(query=q).query_fields for q in ("", "Berlin", "New York", "Restaurant in Berlin")] == [0, 1, 2, 3]
    assert Params(query="Vaduz").place_intent and not Params(query="Vaduz", city="x").place_intent and not p.place_intent


def test_near_columns(spark):
    what, where = text.near_parts(F.lit("Pizza  close  to  old town"))
    assert (one(spark, what), one(spark, where)) == ("Pizza", "old town")
    assert one(spark, text.near_parts(F.lit("a b c d e f near x"))[0]) is None


def test_config():
    c = Config.from_toml('languages = ["de"]\ngeometry_mode = "geopoint"\nunknown = 1\n[importance]\nboosts = ["city"]\ndefault = 1.5\n', Config.trimmed())
    assert c.languages == ("de",) and c.only_named and c.importance == Importance(boosts=("city",), default=1.5)


WEIGHTS = Importance(boosts=("city", "amenity=pharmacy", "*=big", "hospital"), default=1.0, population_boost_weight=1.0, capital_boost=2.0, wikipedia_boost=1.5)


@pytest.mark.parametrize(("found", "want"), [({"place": "city"}, 1040), ({"amenity": "pharmacy"}, 1030), ({"shop": "big"}, 1020), ({"healthcare": "hospital"}, 1010), ({"amenity": "restaurant"}, 2.0), ({"place": "city", "population": "1000"}, 1040 + math.log(1001)), ({"place": "town", "capital": "yes", "wikidata": "Q1"}, 4 + 3.5), ({"place": "city", "population": " 5"}, 1040), ({"foo": "bar"}, None), ({"amenity": "yes"}, None)])
def test_importance(spark, found, want):
    got = one(spark, classify.classify(tags(**found), WEIGHTS))
    assert (got[0]["importance"] == pytest.approx(want)) if want is not None else got == []


def test_classes_in_order_with_levels(spark):
    got = one(spark, classify.classify(tags(shop="bakery", highway="primary", historic="castle"), Importance(), {"historic=castle": 3}))
    assert [(c["key"], c["ont_level"]) for c in got] == [("shop", -1), ("historic", 3), ("street", -1)] and got[1]["importance"] == pytest.approx(1.5 * 1.3)
    assert one(spark, classify.best(classify.classify(tags(shop="bakery", tourism="museum"), Importance())))["key"] == "shop"


@pytest.mark.parametrize(("found", "want"), [({"name": "Mart", "brand": "Coop"}, "Mart (Coop)"), ({"name": "Coop City", "brand": "coop"}, "Coop City"), ({"name": "X", "operator": "yes", "religion": "christian"}, "X (christian)"), ({"name": "X"}, "X"), ({"brand": "Coop"}, "")])
def test_full_name(spark, found, want):
    t = tags(**found)
    assert one(spark, names.full_name(names.plain_name(t), t)) == want


def test_plain_name_and_address(spark):
    assert one(spark, names.plain_name(tags(name__fr="f", name__en="e"), ("de", "fr"))) == "f"
    assert one(spark, names.plain_name(tags(name__en="e"), ("de",))) == "e" and one(spark, names.plain_name(tags(x="1"))) == ""
    t = tags(addr__housenumber="1", addr__street="Main", addr__country="LI", contact__phone="+1")
    assert one(spark, names.display_address(t)) == "1, Main, LI" and one(spark, names.short_address(t)) == "1, Main" and one(spark, names.phone(t)) == "+1"


def coords(*points):
    return F.array(*[F.struct(F.lit(float(x)).alias("lon"), F.lit(float(y)).alias("lat")) for x, y in points])


SQUARE = ((0, 0), (10, 0), (10, 10), (0, 10), (0, 0))
HORSESHOE = ((0, 0), (10, 0), (10, 10), (8, 10), (8, 2), (2, 2), (2, 10), (0, 10), (0, 0))


def test_geometry(spark):
    p = lambda c: tuple(one(spark, c))
    assert p(geo.representative_point(coords(*SQUARE))) == (5, 5) and p(geo.representative_point(coords((0, 0), (10, 0)))) == (5, 0)
    assert p(geo.representative_point(coords((3, 4)))) == (3, 4) and p(geo.centroid(coords((0, 0), (10, 0), (10, 10)))) == (7.5, 2.5)
    x, y = p(geo.representative_point(coords(*HORSESHOE)))
    assert one(spark, geo.ring_holds(coords(*HORSESHOE), F.lit(x), F.lit(y))) and not one(spark, geo.ring_holds(coords(*HORSESHOE), F.lit(5.0), F.lit(6.0)))
    assert p(geo.representative_point(coords((1, 1), (1, 1)))) == (1, 1)
    assert [one(spark, geo.round5(F.lit(x))) for x in (12.3456789, 12.3456744, -12.3456789, 0.0)] == [12.34568, 12.34567, -12.34568, 0]
    assert one(spark, geo.shape_of(coords(*SQUARE))) == "polygon" and one(spark, geo.shape_of(coords((0, 0), (1, 1), (0, 0)))) == "line"


def test_line_within_radius(spark):
    line = coords((-0.02, 60), (0.02, 60))
    assert one(spark, geo.near_shape(line, 60.0, 0.0, 600)) and not one(spark, geo.near_shape(coords((-0.02, 60)), 60.0, 0.0, 600))
    assert one(spark, geo.planar_distance_m(coords((0.009, 60), (0.010, 60)), 60.0, 0.0)) == pytest.approx(one(spark, geo.haversine_m(F.lit(60.0), F.lit(0.009), F.lit(60.0), F.lit(0.0))), abs=30)
    box = Params(min_lat=59.999, max_lat=60.001, min_lon=-0.005, max_lon=0.005)
    assert one(spark, filters.spatial_shape(line, box)) and one(spark, geo.planar_distance_m(coords(*SQUARE), 5.0, 5.0)) == 0


def test_located_and_simplified(spark):
    wavy = coords(*[(i, 0.001 * (i % 2)) for i in range(20)])
    assert len(one(spark, geometry.located(wavy, "geoshape-simplified", 0.01)["coords"])) == 2
    ring = one(spark, geometry.located(coords(*SQUARE), "geoshape-simplified", 100.0)["coords"])
    assert len(ring) >= 4 and ring[0] == ring[-1]
    assert one(spark, geometry.geojson(geometry.located(coords(*SQUARE), "geopoint"))) == '{"type":"Point","coordinates":[5.0,5.0]}'
    assert one(spark, geometry.located(coords(*SQUARE), "no-geo")) is None
    with pytest.raises(ValueError):
        geometry.located(coords(*SQUARE), "cube")


def test_category_and_score(spark):
    m = lambda q, k, v, named=(): one(spark, ranking.category_match(F.lit(q), F.lit(k), F.lit(v), list(named)))
    assert m("Museum", "tourism", "museum") == 320 and m("shop", "shop", "x") == 140 and m("x", "brand", "x") == 0 and m("x", "addr:city", "x") == 0 and m("inns", "tourism", "hotel", [("tourism", "hotel")]) == 300
    score = lambda base, name, cat, tier, imp, exact, named=True: one(spark, ranking.shared_score(F.lit("Vaduz"), F.lit(base), F.lit(name), F.lit(cat), F.lit(tier), F.lit(imp), F.lit(exact), F.lit(named)))
    assert score(400.0, 400.0, 0.0, 2, 13.0, True) == pytest.approx(683039.057, abs=1e-3)
    assert score(300.0, 300.0, 0.0, 1, 19.0, False) == pytest.approx(373295.732, abs=1e-3)
    assert score(0.0, 0.0, 320.0, 1, 5.0, False) > score(0.0, 300.0, 0.0, 2, 15.0, False)
    assert one(spark, ranking.shared_score(F.lit(" "), F.lit(1.0), F.lit(0.0), F.lit(0.0), F.lit(0), F.lit(2.0), F.lit(False), F.lit(True))) == 2001


def test_ontology_files(spark, tmp_path):
    (tmp_path / "o.csv").write_text("# comment\nQ1, 2, City, place, city\nQ2,9,Far,place,far\nQ3,1,short\nQ4,3,Town,place,town\n")
    o = ontology.read_ontology(spark, str(tmp_path / "o.csv"))
    assert sorted((r["qid"], r["level"], r["osm_value"]) for r in o.collect()) == [("Q1", 2, "city"), ("Q4", 3, "town")]
    assert [tuple(r) for r in ontology.label_matches(spark.createDataFrame([(1, " CITYS ")], "id int, query string"), o).select("id", "osm_value", "plural").collect()] == [(1, "city", True)]
    (tmp_path / "w.tsv").write_text("language\ttype\ttitle\timportance\twikidata_id\nen\ta\tBerlin\t0.9\tQ64\nen\tr\tBerlin_\t0.8\tBerlin_Q64\n\n# x\nde\tr\tBerlino\t0.95\tQ64\nde\tshort\n")
    w = ontology.read_importance(spark, str(tmp_path / "w.tsv"))
    assert w.count() == 2 and [tuple(r) for r in ontology.importance_scores(w)[0].collect()] == [("Q64", 0.95)] and ontology.redirects(w).first()["titles"] == ["Berlino"]
    assert len(ontology.level_map(ontology.built_in(spark))) == 34 - 1 + 0 or ontology.level_map(ontology.built_in(spark))["boundary=administrative"] == 1


def test_log_reports(spark):
    log = spark.createDataFrame([("a", t) for t in (0, 30, 61, 90, 200)] + [("b", 0)], "key string, s long").select("key", F.timestamp_seconds("s").alias("ts"))
    assert {tuple(r) for r in stats.log_buckets(log, 60).collect()} == {("a", 0, 2), ("a", 1, 2), ("a", 3, 1), ("b", 0, 1)}
    assert {tuple(r) for r in stats.cache_gaps(log, 60).collect()} == {("a", 5, 3), ("b", 1, 0)}


def test_tile_tags(spark):
    row = lambda layer, **p: {k: v for k, v in spark.range(1).select(F.lit(layer).alias("layer"), tags(**p).alias("props"), F.lit(1).alias("fid"), F.lit(5).alias("at"), F.lit(1.0).alias("lat"), F.lit(2.0).alias("lon")).transform(tiles.objects).first()["tags"].items() if k not in p}
    assert row("poi", **{"class": "cafe", "rank": "3", "name": "X"}) == {"amenity": "cafe", "shop": "cafe", "tourism": "cafe", "importance": "3"}
    assert row("water", subclass="lake") == {"natural": "water", "water": "lake"} and row("housenumber", **{"class": "h", "housenumber": "4"}) == {"amenity": "address", "addr:housenumber": "4"}
    assert row("building", **{"class": "b"}) == {"building": "yes"} and row("transportation", **{"class": "primary"}) == {"highway": "primary"}


@pytest.mark.parametrize("query", ["cestle", "castle", "a", "st. peter", "münster", "éa", "x1", "--", "", " the "])
def test_patterns_of_known_queries_match_as_columns_do(spark, query):
    """A query that the driver holds is searched for by patterns; the same query as a column is compared word by word."""
    import random

    r = random.Random(query)
    words = ["castle", "castl", "cestle", "acastle", "cast1e", "xcastlex", "stpeter", "peter", "muenster", "munster", "müenster", "éa", "ea", "éb", "x", "x1", "x12", "th", "the", "日本"]
    texts = ["".join(w + r.choice([" ", "-", ".", "", "  ", "\n"]) for w in r.choices(words, k=r.randrange(4))) for _ in range(400)] + ["", "  ", "..."]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").withColumn("f", text.folded(F.array("t")))
    got = rows.select("t", text.best_match(F.col("f"), query).alias("now"), text.best_match(F.col("f"), F.lit(query)).alias("column"))
    assert [x for x in got.collect() if x["now"] != x["column"]] == []
    q = query.lower()
    c = "".join(text.words_now(q))
    v = F.lower("t")
    plain = lambda test: (F.col("t") != "") & F.lit(q != "") & (F.contains(v, F.lit(q)) | (F.lit(c != "") & (test(text.compact(v)) | F.exists(text.tokens(v), test))))
    both = rows.select("t", text.direct_match(F.col("t"), query, prefix=True).alias("a"), plain(lambda w: F.startswith(w, F.lit(c))).alias("b"), text.direct_match(F.col("t"), query, fuzzy=True).alias("c"), plain(lambda w: text.within_one_edit(w, F.lit(c))).alias("d"))
    assert [x for x in both.collect() if x["a"] != x["b"] or x["c"] != x["d"]] == []


def test_white_space_is_trimmed_alike(spark):
    every = [chr(c) + "x" + chr(c) for c in (*range(0x21), 0x85, 0xA0, 0x1680, 0x180E, *range(0x2000, 0x2030), 0x205F, 0x3000, 0xFEFF)]
    rows = spark.createDataFrame([(t,) for t in every], "t string").select("t", text.trim(F.col("t")).alias("s"), F.regexp_replace(F.regexp_replace("t", r"^[\s\x{85}\p{Z}]+", ""), r"[\s\x{85}\p{Z}]+\z", "").alias("p")).collect()
    assert all(x["s"] == x["p"] == text.trim_now(x["t"]) for x in rows)
