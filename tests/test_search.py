"""Searches over small tables, sources and the service."""

import struct
import zlib

import pytest
from pyspark.sql import functions as F

from placemill.config import Config, Importance, Params, listed, split_address
from placemill.operators import features, ontology, stats
from placemill.plans import engine
from placemill.plans.service import Index, SearchError, Service
from placemill.sources import osm_pbf
from placemill.streaming import publish

ROWS = [
    ("node/1", {"name": "Berlin", "place": "city", "addr:street": "Unter den Linden", "addr:housenumber": "1", "addr:postcode": "10117", "addr:city": "Berlin", "addr:country": "DE", "phone": "+49 30 123456", "wheelchair": "limited", "opening_hours": "24/7"}, 52.52, 13.40),
    ("node/2", {"name": "Munich", "place": "city", "addr:postcode": "80331", "addr:city": "Munich", "addr:country": "DE", "level": "0"}, 48.13, 11.58),
    ("node/3", {"name": "Restaurant Alpha", "amenity": "restaurant", "addr:street": "Friedrichstr", "addr:housenumber": "10", "addr:postcode": "10117", "addr:city": "Berlin", "addr:country": "DE", "addr:floor": "1", "addr:unit": "A"}, 52.53, 13.41),
    ("node/4", {"name": "Cafe Beta", "amenity": "cafe"}, 52.54, 13.42),
    ("node/5", {"name": "Shop Gamma", "shop": "bakery", "addr:postcode": "80331", "addr:country": "DE"}, 48.14, 11.59),
    ("node/6", {"foo": "bar"}, 52.5, 13.4),
    ("node/7", {"name": "München Haus", "building": "house"}, 10.0, 10.0),
]
CONF = Config(languages=("en",), importance=Importance(boosts=("city",)))


@pytest.fixture(scope="module")
def objects(spark):
    df = spark.createDataFrame([(i, i.split("/")[0], int(i.split("/")[1]), t, lat, lon) for i, t, lat, lon in ROWS], "id string, entity_type string, osm_id long, tags map<string,string>, lat double, lon double")
    return df.withColumn("coords", F.array(F.struct("lon", "lat")))


@pytest.fixture(scope="module")
def index(spark, objects, tmp_path_factory):
    path = publish.publish(objects, str(tmp_path_factory.mktemp("index")), "v1", CONF, view="live_features")
    return Index.read(spark, path)


@pytest.fixture(scope="module")
def names(spark):
    return engine.Ontology.of(ontology.built_in(spark))


def ids(df):
    return [r["id"] for r in df.orderBy("rank").collect()]


CASES = [
    (dict(postcode="10117"), {1, 3}), (dict(key="amenity"), {3, 4}), (dict(keys=("amenity", "shop")), {3, 4, 5}), (dict(value="restaurant"), {3}), (dict(values=("restaurant", "cafe")), {3, 4}),
    (dict(min_lat=52.4, max_lat=52.6, min_lon=13.3, max_lon=13.5), {1, 3, 4}), (dict(lat=52.52, lon=13.40, radius="1km"), {1}), (dict(lat=52.52, lon=13.40, radius="50km"), {1, 3, 4}),
    (dict(street="Friedrichstr"), {3}), (dict(housenumber="1"), {1}), (dict(city="berlin"), {1, 3}), (dict(country="de"), {1, 2, 3, 5}), (dict(floor="1"), {3}), (dict(unit="A"), {3}), (dict(level="0"), {2}), (dict(phone="+49 30 123456"), {1}), (dict(opening_hours="24/7"), {1}), (dict(wheelchair="limited"), {1}),
]


@pytest.mark.parametrize(("p", "want"), CASES)
def test_filters_in_both_modes(objects, index, names, p, want):
    wanted = {f"node/{n}" for n in want}
    assert set(ids(engine.direct_search(objects, Params(**p), CONF, names))) == wanted
    assert set(ids(engine.index_search(index.features, index.postings, index.statistics, Params(**p), CONF, names))) == wanted


def test_pages_and_order(objects, index, names):
    blank = lambda **p: engine.index_search(index.features, index.postings, index.statistics, Params(**p), CONF, names)
    assert [len(ids(blank(limit=2, offset=o))) for o in (0, 2, 4, 10)] == [2, 2, 2, 0] and set(ids(blank(limit=2))) == {"node/1", "node/2"}
    pages = ids(blank(limit=3)) + ids(blank(limit=3, offset=3))
    assert pages == ids(blank()) and [r["rank"] for r in blank(limit=2, offset=2).orderBy("rank").collect()] == [3, 4]
    assert ids(engine.direct_search(objects, Params(limit=1), CONF, names)) == [ids(engine.direct_search(objects, Params(), CONF, names))[0]]


def test_index_texts(index, names):
    find = lambda q, **p: ids(engine.index_search(index.features, index.postings, index.statistics, Params(query=q, **p), CONF, names))
    assert find("Brlin")[0] == "node/1" and find("Ber")[0] == "node/1" and find("münchen") == ["node/7"] and find("restaurants")[0] == "node/3"
    assert find("Restaurant Alpha")[0] == "node/3" and find("restaurant Alpha", key="shop") == [] and find("restaurant near Berlin")[0] == "node/3" and find("cafe near nowhere") == []
    assert find("zzzz") == []


def test_direct_texts(objects, names):
    find = lambda q, **p: ids(engine.direct_search(objects, Params(query=q, **p), CONF, names))
    assert find("berlin")[0] == "node/1" and find("brlin") == [] and find("brlin", fuzzy=True)[0] == "node/1" and find("restaurant near Berlin") == ["node/3"]
    assert find("restaurant near Berlin", radius="100m") == [] and find("x near nowhere") == []


def test_hidden_fields(index, names):
    shown = engine.index_search(index.features, index.postings, index.statistics, Params(query="berlin"), Config(languages=("en",), store_metadata=False, store_geometry=False), names).first()
    assert shown["key"] == "" and shown["importance"] == 0 and shown["lat"] is None


def test_build_filters(objects):
    named = features.build(objects.withColumn("tags", F.map_filter("tags", lambda k, v: k != "name")), Config(only_named=True, importance=Importance()))
    assert named.count() == 0 and features.build(objects, CONF).count() == 6
    bare = features.build(objects, Config(disable_importance=True, disable_key_value=True)).first()
    assert bare["importance"] == 0 and bare["keys"] == []


def test_outputs(objects, names):
    page = engine.direct_search(objects, Params(query="berlin"), CONF, names)
    blocks = [r["block"] for r in engine.text_block(page, engine.totals(objects)).orderBy("rank").collect()]
    assert blocks[0].startswith("id: node/1\nscore: ") and "\nlat: 52.52000" in blocks[0] and blocks[-1] == "---\ntotal: 7\nreturned: 2"
    assert '"id":"node/1"' in engine.as_json(page).orderBy("rank").first()["json"]


def test_service(objects, index, names):
    s = Service({"main": index}, {"raw": objects}, conf=CONF, ontology=names)
    first = s.search({"q": "berlin"})
    assert first["hits"][0]["id"] == "node/1" and first["total"] >= first["returned"] == len(first["hits"])
    assert s.search({"q": "berlin", "mode": "pbf"})["hits"][0]["id"] == "node/1" and s.capabilities()["default_mode"] == "index" and s.health()["sources"] == 2
    for bad in ({"mode": "pmtiles"}, {"mode": "x"}, {"index": "none", "mode": "index"}):
        with pytest.raises(SearchError) as e:
            s.search(bad)
        assert e.value.payload["status"] == 400
    s.swap(objects={"raw": objects.limit(0)})
    assert s.search({"q": "berlin", "mode": "pbf"})["hits"] == []


@pytest.fixture(scope="module")
def shops(spark):
    rows = [("node/1", "Restaurant Alpha", "amenity", "restaurant", 47.14, 9.52, "123", "Main St"), ("node/2", "Cafe Beta", "amenity", "cafe", 47.15, 9.53, "456", "Main St"), ("node/3", "Shop Gamma", "shop", "bakery", 47.16, 9.54, "789", "Side St"), ("node/4", "Hotel Delta", "tourism", "hotel", 47.17, 9.55, None, None), ("node/5", "Park Epsilon", "leisure", "park", 47.18, 9.56, None, None)]
    tags = [{"name": n, k: v} | ({"addr:housenumber": no, "addr:street": st, "addr:city": "Vaduz"} if no else {}) for _, n, k, v, _, _, no, st in rows]
    df = spark.createDataFrame([(r[0], "node", i, t, r[4], r[5]) for i, (r, t) in enumerate(zip(rows, tags, strict=True))], "id string, entity_type string, osm_id long, tags map<string,string>, lat double, lon double")
    return df.withColumn("coords", F.array(F.struct("lon", "lat")))


@pytest.mark.parametrize("mode", ["index", "pbf"])
def test_requests(spark, shops, names, tmp_path, mode):
    """House numbers written into the street, totals beside pages, distances and plain text."""
    s = Service({"main": Index.read(spark, publish.publish(shops, str(tmp_path), "v1", CONF))}, {"raw": shops}, conf=CONF, ontology=names)
    ask = lambda **a: s.search({"mode": mode, **a})
    for a in ({"housenumber": "123"}, {"street": "Main St 123"}, {"street": "123 Main St"}, {"street": "Main St 123", "housenumber": "123"}):
        assert [h["id"] for h in ask(**a)["hits"]] == ["node/1"], a
    n = 3 if mode == "index" else 2  # an index matches any of a street's words
    two = ask(street="Main St", limit="1")
    assert (two["total"], two["returned"], two["limit"]) == (n, 1, 1) and ask(street="Main St", **{"from": "5"}) == {"from": 5, "limit": 100, "total": n, "returned": 0, "hits": []}
    near = ask(lat="47.14", lon="9.52", radius="3km")["hits"]
    assert {h["id"]: h["distance"] for h in near} == {"node/1": 0, "node/2": 1344, "node/3": 2689}
    text = ask(q="cafe", format="text")
    assert text.startswith("id: node/2\nscore: ") and "\nname: Cafe Beta" in text and text.endswith("---\ntotal: 1\nreturned: 1")


def test_address_split():
    for street, number in (("Main St 123", ""), ("123 Main St", ""), ("Main St 123", "123"), ("123 Main St", "123")):
        assert split_address(street, number) == ("Main St", "123")
    assert split_address("Main St 123", "7") == ("Main St 123", "7") and split_address(" Main St ", "") == ("Main St", "") and listed(" a, ,b ") == ("a", "b")


def test_build_options(objects):
    some = features.build(objects, Config(store_address=False, store_contact_info=False, importance=Importance())).filter("id = 'node/1'").first()
    assert some["address"] == {} and (some["display_address"], some["phone"], some["opening_hours"]) == ("", "", "")
    ways = objects.withColumn("entity_type", F.when(F.col("osm_id") > 3, "way").otherwise("node"))
    assert features.build(ways, Config(nodes_only=True)).count() == 3
    counts = {r["entity_type"]: tuple(r)[1:] for r in stats.build_counts(ways, CONF).collect()}
    assert counts == {"node": (3, 3, 0), "way": (4, 3, 1)}


def test_importance_table_in_a_build(spark, objects, tmp_path):
    """The score in the object's language, else at all, ten times; none where importance is off or the id is unknown."""
    table = spark.createDataFrame([("en", "a", "B", 0.5, "Q64"), ("de", "a", "B", 0.9, "Q64"), ("de", "a", "M", 0.3, "Q1726")], "language string, type string, title string, importance double, wikidata_id string")
    known = F.create_map(F.lit("wikidata"), F.element_at(F.create_map(*[F.lit(x) for x in ("node/1", "Q64", "node/2", "Q1726", "node/3", "Q0")]), F.col("id")))
    some = objects.filter("osm_id < 4").withColumn("tags", F.map_concat("tags", known))
    read = lambda v, conf, **o: {r["osm_id"]: r["importance"] for r in spark.read.parquet(publish.publish(some, str(tmp_path), v, conf, **o) + "/features").collect()}
    plain, more = read("v1", CONF), read("v2", CONF, importance=table)
    assert {k: round(more[k] - plain[k], 9) for k in plain} == {1: 5.0, 2: 3.0, 3: 0.0}
    assert set(read("v3", Config(disable_importance=True), importance=table).values()) == {0.0}


def test_plans_of_the_index(index, names):
    """Terms and cells reach the scans as filters."""
    find = lambda **p: engine.index_all(index.features, index.postings, index.statistics, Params(**p), CONF, names)._jdf.queryExecution().toString()
    assert "In(term" in find(query="berlin").replace("EqualTo(term", "In(term") and "cell" in find(lat=52.52, lon=13.4, radius="1km").split("PushedFilters")[1]


def test_too_many_labels(spark):
    many = spark.range(ontology.MAX_LITERAL + 1).select(F.lit("Q1").alias("qid"), F.lit(1).alias("level"), F.concat(F.lit("l"), "id").alias("label"), F.lit("shop").alias("osm_key"), F.lit("bakery").alias("osm_value"))
    with pytest.raises(ValueError):
        engine.Ontology.of(many)
    assert engine.Ontology.of(many.limit(ontology.MAX_LITERAL)).named("L7") == [("shop", "bakery")]


def test_stream_of_objects(spark, objects, tmp_path, names):
    objects.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(objects.schema).parquet(str(tmp_path / "in"))
    q = publish.matching(stream, Params(query="e", lat=52.52, lon=13.4, radius="50km", key="amenity"), CONF).select("id").writeStream.format("memory").queryName("standing").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert {r["id"] for r in spark.table("standing").collect()} == {"node/3", "node/4"}


# --- files: written here, byte by byte ---


def _varint(n):
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def _zig(n):
    return (n << 1) ^ (n >> 63)


def _f(k, v):
    return _varint(k << 3) + _varint(v) if isinstance(v, int) else _varint(k << 3 | 2) + _varint(len(v)) + v


def _packed(ns):
    return b"".join(map(_varint, ns))


def _deltas(ns):
    return _packed([_zig(b - a) for a, b in zip([0, *ns], ns, strict=False)])


def test_pbf_reader(spark, tmp_path):
    strings = [b"", b"name", b"Vaduz", b"highway", b"primary", b"type", b"site", b"stop"]
    table = b"".join(_f(1, s) for s in strings)
    dense = _f(1, _deltas([7, 9])) + _f(8, _deltas([471_400_000, 471_500_000])) + _f(9, _deltas([95_200_000, -5])) + _f(10, _packed([1, 2, 0, 0]))
    way = _f(1, 20) + _f(2, _packed([3])) + _f(3, _packed([4])) + _f(8, _deltas([7, 9]))
    relation = _f(1, 30) + _f(2, _packed([5])) + _f(3, _packed([6])) + _f(8, _packed([7, 0])) + _f(9, _deltas([7, 20])) + _f(10, _packed([0, 1]))
    blocks = [_f(1, table) + _f(2, _f(2, dense)), _f(1, table) + _f(2, _f(3, way)) + _f(2, _f(4, relation))]
    raw = b""
    for kind, data in [(b"OSMHeader", b""), *[(b"OSMData", b) for b in blocks]]:
        blob = _f(2, len(data)) + _f(3, zlib.compress(data))
        head = _f(1, kind) + _f(3, len(blob))
        raw += struct.pack(">I", len(head)) + head + blob
    (tmp_path / "x.osm.pbf").write_bytes(raw)
    osm_pbf.register(spark)
    read = lambda kind: spark.read.format("osm_pbf").option("kind", kind).option("partitionBytes", 10).load(str(tmp_path / "x.osm.pbf"))
    nodes = {r["id"]: r for r in read("node").collect()}
    assert set(nodes) == {7, 9} and nodes[7]["tags"] == {"name": "Vaduz"} and nodes[7]["lat"] == pytest.approx(47.14) and nodes[9]["lon"] == pytest.approx(-5e-7) and nodes[9]["tags"] == {}
    way = read("way").first()
    assert way["id"] == 20 and [n["ref"] for n in way["nodes"]] == [7, 9] and way["tags"] == {"highway": "primary"}
    assert [tuple(m) for m in read("relation").first()["members"]] == [("node", 7, "stop"), ("way", 20, "")]


def test_dense_nodes_by_columns():
    """Tags of dense nodes by columns equal those read one node after the other, also where a value is empty or a key comes twice."""
    strings = ["", "a", "b", "c", "d"]
    for kv in ([1, 2, 0, 0, 3, 4, 1, 1, 0], [0, 0, 0], [], [1, 0, 0, 0, 2, 3, 0], [1, 2, 1, 3, 0, 0, 0]):
        want, rest = [], iter(kv)
        for _ in range(3):
            tags = {}
            while (k := next(rest, 0)) != 0:
                tags[strings[k]] = strings[next(rest)]
            want.append(tags)
        assert [dict(x) for x in osm_pbf._dense_tags(_packed(kv), 3, strings).to_pylist()] == want
    assert osm_pbf.sums(_deltas([5, -7, 1 << 60, 3])).tolist() == osm_pbf.running(_deltas([5, -7, 1 << 60, 3])) == [5, -7, 1 << 60, 3]


def test_radius_counts_are_those_of_the_pairs(spark):
    """Rows at one position are counted together, and none is lost."""
    at = lambda i: (47.0 + i % 5 / 100, 9.5 + i % 7 / 100)
    left = spark.createDataFrame([(i, *at(i)) for i in range(60)] + [(98, 47.9, 9.5), (99, None, 9.5)], "a long, lat double, lon double")
    right = spark.createDataFrame([(i, *at(3 * i)) for i in range(200)], "b long, lat double, lon double")
    pairs = engine.radius_join(left, right, 1500, "a", "b").groupBy("left_id").agg(F.count("*").alias("n"), F.min("metres").alias("nearest_m"))
    got = engine.radius_counts(left, right, 1500, "a")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, pairs.collect())) and got.count() == 60


def test_near_batch_adds_hits_up_as_they_come(spark):
    """Queries that say the same are one question, and a feature at several places or with several of the words is one hit, without a count of distinct ids."""
    rows = [("n/1", "Old Town", 47.0, 9.5, 5.0), ("n/2", "Blue Cafe", 47.01, 9.5, 1.0), ("n/2", "Cafe Bar", 47.02, 9.5, 1.0), ("n/3", "Cafe", 47.01, 9.51, 1.0), ("n/4", "Bar", 48.0, 9.5, 1.0), ("n/3", "Cafe", 48.0, 9.5, 1.0), ("n/5", "Bar", None, None, 1.0)]
    places = spark.createDataFrame(rows, "id string, name string, lat double, lon double, importance double")
    asked = spark.createDataFrame([(1, "cafe near town"), (2, "Cafe near old town"), (3, "blue bar near town"), (4, "cafe blue near town"), (5, "zoo near town")], "qid long, query string")
    got = engine.near_batch(asked, places)
    assert sorted((r["qid"], r["ref_id"], r["n_hits"]) for r in got.collect()) == [(1, "n/1", 2), (2, "n/1", 2), (3, "n/1", 1), (4, "n/1", 2)]
    assert "count(distinct" not in got._jdf.queryExecution().optimizedPlan().toString().lower()


def test_exact_names_beyond_a_page_by_importance(spark, tmp_path):
    """More than 1,000 features of one name and of several tiers: all are numbered, as the SQL has them."""
    import duckdb

    from placemill.plans import catalog, oracle

    docs = spark.range(1100).selectExpr("id as doc_id", "'Same name here' as text", "'en' as lang", "'src0' as source", "id + 10 as n_chars")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    duck = duckdb.connect()
    duck.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    want = {r[0]: r[2] for r in duck.execute(oracle.SQL["index_exact_first"]).fetchall()}
    got = {r["id"]: r["rank"] for r in catalog.index_exact_first(spark, str(tmp_path)).collect()}
    assert len(got) == 1100 and got == want


def test_searches_read_features_once_and_the_fields_they_ask_for(spark, sf):
    """Statistics and scores of the asked fields are those of the whole index; steps of a search start from built features, not from the objects."""
    from placemill.plans import catalog

    known = engine.Ontology.built_in()
    p = Params(query="castles er", key="historic")
    fields = engine.asked_fields(p, known)
    assert {"name", "search_names_edge_ngram", "value", "key", "keys"} <= fields and "display_address" not in fields
    f, posts, stats = catalog._index(catalog._kept(spark, sf), p)
    assert "documents.parquet" not in posts._jdf.queryExecution().toString() and {r["field"] for r in posts.select("field").distinct().collect()} <= fields
    whole = features.statistics(features.postings(f)).filter(F.col("field").isin(*fields))
    assert sorted(map(tuple, stats.collect())) == sorted(map(tuple, whole.select(*stats.columns).collect()))


def test_best_filtered_makes_the_asked_lists_once(spark, sf, monkeypatch):
    """The lists are held, so that their heads, blocks and page don't sort them anew, and are of the fields of the filters."""
    from placemill.operators import lookups
    from placemill.plans import catalog

    seen = []
    monkeypatch.setattr(lookups, "blocks", lambda t, real=lookups.blocks: seen.append(t) or real(t))
    assert catalog.index_best_filtered(spark, sf).count() > 0
    assert "Exchange" not in seen[0]._jdf.queryExecution().toString()
    assert {r["field"] for r in seen[0].select("field").distinct().collect()} == {"key", "keys", "addr:street", "wheelchair", lookups.EVERY}
