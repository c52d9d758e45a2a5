"""Tables beside an index: the same hits with them and without, and plans that read little."""

import random
import re

import pytest
from pyspark.sql import functions as F

from placemill.config import Config, Params
from placemill.functions import text
from placemill.operators import features, filters, lookups, ontology
from placemill.plans import catalog, engine
from placemill.plans.service import Index, Service
from placemill.sources import adapters
from placemill.streaming import publish


@pytest.fixture(scope="module")
def known(spark):
    return engine.Ontology.of(ontology.built_in(spark))


@pytest.fixture(scope="module")
def index(spark, sf, tmp_path_factory):
    path = publish.publish(adapters.objects(spark, sf), str(tmp_path_factory.mktemp("index")), "v1", catalog.CONF, ontology.level_map(ontology.built_in(spark)))
    return Index.read(spark, path)


def plan(df):
    return df._jdf.queryExecution().toString()


def _edit(r, b):
    i, c = r.randrange(len(b) + 1), bytes([r.choice(b"abc\xc3\xa9")])
    return [b[:i] + c + b[i:], b[: i - 1] + b[i:] if i else b, b[: i - 1] + c + b[i:] if i else b, b][r.randrange(4)]


def test_terms_within_one_edit_share_a_key(spark):
    r = random.Random(1)
    pairs = []
    for n in [1, 2, 3, 7, *range(44, 54), 200]:
        for _ in range(60):
            a = bytes(r.choice(b"abcdefg") for _ in range(n))
            pairs.append((a.decode(), _edit(r, a).decode("utf-8", "replace")))
    pairs += [("ab", "ba"), ("café", "cafe"), ("x" * 48, "x" * 49), ("é", "è"), ("short", "s" * 90)]
    df = spark.createDataFrame(pairs, "a string, b string").filter("b <> ''")
    k = df.select("a", "b", text.within_one_edit(F.col("a"), F.col("b")).alias("near"), F.arrays_overlap(lookups.edit_keys(F.col("a")), lookups.edit_keys(F.col("b"))).alias("share"), F.size(lookups.edit_keys(F.col("a"))).alias("n"))
    rows = k.collect()
    assert all(x["share"] for x in rows if x["near"]) and sum(x["near"] for x in rows) > 500
    assert not next(x for x in rows if x["b"] == "s" * 90)["share"] and all(x["n"] <= 60 for x in rows)


def test_keys_of_driver_and_columns_agree(spark):
    words = ["", "a", "castle", "münster", "日本", "x" * 47, "é" * 24, "x" * 48, "x" * 49, "ab" * 90]
    rows = spark.createDataFrame([(w,) for w in words], "w string").select("w", lookups.edit_keys(F.col("w")).alias("k")).collect()
    assert all(set(x["k"]) == lookups.edit_keys_now(x["w"]) for x in rows)


def test_words_of_driver_and_columns_agree(spark):
    """Folding and words of a query text, as the driver and as columns have them."""
    r = random.Random(2)
    letters = "aZ09 ,-ÄÖßéÆøñ́²Ⅷ日本Ωд_'\t " + "the of "
    texts = ["".join(r.choice(letters) for _ in range(r.randrange(25))) for _ in range(400)]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", text.fold(F.col("t")).alias("f"), text.tokens(F.col("t")).alias("w"), F.array_sort(F.array_distinct(text.standard(F.col("t")))).alias("s")).collect()
    for x in rows:
        assert (text.fold_now(x["t"]), text.words_now(x["t"]), list(text.standard_words(x["t"]))) == (x["f"], x["w"], x["s"])


@pytest.mark.parametrize("asked", [{"query": "museum"}, {"query": "castles er"}, {"query": "the"}, {"query": "thas"}, {"query": "bakery", "city": "NATION_3"}, {"street": "main", "postcode": "9482"}, {"key": "shop", "wheelchair": "yes"}, {"query": "park", "radius": "3km", "lat": 47.14, "lon": 9.52}, {"city": "--"}, {"query": "zzqq"}, {"country": "LI", "phone": "+423 4"}])
def test_tables_do_not_change_hits(index, known, asked):
    p = Params(**asked)
    run = lambda tables: sorted(engine.index_all(index.features, index.postings, index.statistics, p, catalog.CONF, known, tables).select("id", "score").collect())
    plain = run(lookups.Lookups())
    assert run(index.tables) == plain
    if not p.query:
        assert {x["id"] for x in plain} == {x["id"] for x in index.features.filter(filters.indexed_fields(p)).collect()}


def test_plans_read_few_terms_and_cells(index, known):
    asked = index.features.sparkSession.createDataFrame([("name", "castle")], "field string, word string")
    near = plan(lookups.near_terms(index.tables.neighbours, asked, {("name", "castle")}))
    assert re.search(r"PushedFilters: \[[^\]]*(In|Equal\w*|Or)\(key", near) and "BroadcastHashJoin" in near
    hits = plan(engine.filtered_ids(index.postings, Params(city="nation_3", street="main")))
    assert "addr:city" in hits and re.search(r"PushedFilters: \[[^\]]*In\(term", hits)
    address = engine.index_all(index.features, index.postings, index.statistics, Params(housenumber="17", postcode="9497"), catalog.CONF, known, index.tables)
    assert re.search(r"PushedFilters: \[[^\]]*(In|EqualTo)\(cell", plan(address)) or address.count() == 0


def test_rare_words_fetch_features_by_cell(index, known, monkeypatch):
    monkeypatch.setattr(engine, "SELECTIVE", 1)
    p = Params(query="castle")
    hits = engine.index_all(index.features, index.postings, index.statistics, p, catalog.CONF, known, index.tables)
    assert re.search(r"PushedFilters: \[[^\]]*In\(cell", plan(hits))
    assert sorted(hits.select("id").collect()) == sorted(engine.index_all(index.features, index.postings, index.statistics, p, catalog.CONF, known).select("id").collect())


def test_exact_names_fill_a_page(spark, tmp_path, known):
    """A short text that asks for a place: features of that name alone where they fill the page, else before all others that match."""
    tags = [{"place": "city", "name": "Aarau"}] * 3 + [{"amenity": "cafe", "name": "Aarau Cafe"}] * 4 + [{"shop": "bakery", "name": "aarau"}]
    objects = spark.createDataFrame([(f"node/{i}", "node", i, t, 47.0 + i / 100, 9.5, [(9.5, 47.0 + i / 100)]) for i, t in enumerate(tags)], "id string, entity_type string, osm_id long, tags map<string,string>, lat double, lon double, coords array<struct<lon:double,lat:double>>")
    index = Index.read(spark, publish.publish(objects, str(tmp_path), "v1", Config(), {}))
    service = Service(indexes={"a": index}, ontology=known)
    ids = lambda **args: [h["id"] for h in service.search(args)["hits"]]
    four = {"node/0", "node/1", "node/2", "node/7"}
    assert set(ids(q="Aarau", limit="4")) == four == set(ids(q=" AARAU ", limit="2")) | set(ids(q="aarau", limit="2", **{"from": "2"}))
    every = ids(q="aarau", limit="8")
    assert set(every[:4]) == four and len(every) == 8
    assert service.search({"q": "aarau", "limit": "4"})["total"] == 4
    assert ids(q="aarau", limit="2", lat="47.0", lon="9.5", radius="500m") == ["node/0"]


RING = "array<struct<lon:double,lat:double>>"


def _square(lon, lat, half):
    return [(lon - half, lat - half), (lon + half, lat - half), (lon + half, lat + half), (lon - half, lat + half), (lon - half, lat - half)]


def test_shapes_are_found_by_the_cells_that_they_touch(spark, tmp_path, known):
    """A large ring whose vertices are all far from the window, small ones, lines; each feature once."""
    r = random.Random(4)
    shapes = [_square(9.0, 47.0, 1.5), _square(9.5, 47.1, 0.001), [(8.0, 46.0), (10.5, 48.0)], _square(-170.0, -84.0, 30.0)] + [_square(r.uniform(7, 12), r.uniform(45, 49), 10 ** r.uniform(-4, 0)) for _ in range(60)]
    objects = spark.createDataFrame([(f"way/{i}", "way", i, {"leisure": "park", "name": f"p{i}"}, c) for i, c in enumerate(shapes)], f"id string, entity_type string, osm_id long, tags map<string,string>, coords {RING}")
    conf = Config(geometry_mode="geoshape-full")
    index = Index.read(spark, publish.publish(objects, str(tmp_path), "v1", conf, {}), shapes=True)
    assert index.tables.shapes.groupBy("id").count().agg(F.max("count")).first()[0] <= 4
    for p in (Params(lat=47.1, lon=9.5, radius="500m"), Params(min_lat=47.05, max_lat=47.3, min_lon=9.2, max_lon=9.8), Params(lat=47.0, lon=9.0, radius="90km"), Params(lat=0.0, lon=0.0, radius="1km"), Params(query="p1", lat=47.1, lon=9.5, radius="50km")):
        find = lambda tables, p=p: engine.index_all(index.features, index.postings, index.statistics, p, conf, known, tables)
        assert sorted(x["id"] for x in find(index.tables).collect()) == sorted(x["id"] for x in find(lookups.Lookups()).collect())
    small = engine.index_all(index.features, index.postings, index.statistics, Params(lat=47.1, lon=9.5, radius="500m"), conf, known, index.tables)
    assert {"way/0", "way/1"} <= {x["id"] for x in small.collect()} and re.search(r"PushedFilters: \[[^\]]*Or\([^\]]*at", plan(small))


def test_neighbours_hold_every_key_once(spark):
    stats = spark.createDataFrame([("name", t, 1, 9) for t in ("castle", "cafe", "aa", "a")] + [("key", "shop", 1, 9)], "field string, term string, df long, n_docs long")
    rows = lookups.neighbours(stats).collect()
    assert len(rows) == len({(x["key"], x["term"]) for x in rows}) and {x["field"] for x in rows} == {"name"}
    assert sum(x["term"] == "castle" for x in rows) == 7 and sum(x["term"] == "aa" for x in rows) == 2


def test_postings_follow_what_is_stored(spark, sf):
    """No address or contact in the postings where the configuration doesn't store them."""
    f = features.build(adapters.objects(spark, sf), Config(store_address=False, store_contact_info=False), {})
    assert {x["field"] for x in features.postings(f).select("field").distinct().collect()} == {"name", "name_edge_ngram", "search_names", "search_names_edge_ngram", "key", "value", "keys", "values"}


@pytest.fixture(scope="module")
def ranked(spark, tmp_path_factory):
    """An index with lists by impact in blocks of 16, many features with equal scores, and one class for most of them."""
    r = random.Random(5)
    rows = []
    for i in range(3000):
        tags = {"amenity" if r.random() < 0.8 else "shop": r.choice(["cafe", "bar"]), "name": f"N{i}", "addr:city": r.choice(["Vaduz", "Chur", "Bad Ragaz"]), "wheelchair": r.choice(["limited", "designated"]), "population": str(r.choice([0, 10, 10, 1000]))}
        rows.append((f"node/{i}", "node", i, tags, 47.0, 9.0, [(9 + r.random(), 47 + r.random())]))
    schema = "id string, entity_type string, osm_id long, tags map<string,string>, lat double, lon double, coords array<struct<lon:double,lat:double>>"
    before, lookups.BLOCK = lookups.BLOCK, 16
    path = publish.publish(spark.createDataFrame(rows, schema), str(tmp_path_factory.mktemp("ranked")), "v1", catalog.CONF, {}, ranked=True)
    yield Index.read(spark, path, ranked=True)
    lookups.BLOCK = before


@pytest.mark.parametrize("asked", [{"key": "amenity"}, {"keys": ("shop", "Amenity"), "city": "bad chur"}, {"key": "shop", "value": "bar", "city": "vaduz", "wheelchair": "limited"}, {"value": "cafe", "offset": 37}, {}, {"key": "nothing"}, {"city": "--"}, {"key": "amenity", "offset": 2950, "limit": 100}, {"wheelchair": "limited", "limit": 1}])
def test_pages_from_lists_by_impact(ranked, known, asked):
    p = Params(**{"limit": 20, **asked})
    rows = lambda df: [tuple(x) for x in df.orderBy("rank").collect()]
    best = engine.best_page(ranked.features, ranked.postings, ranked.statistics, p, catalog.CONF, known, ranked.tables, long=0)
    whole = rows(engine.page(engine.exact_first(ranked.features, ranked.postings, ranked.statistics, p, catalog.CONF, known), p))
    if best is None:
        assert p.key == "nothing" or p.city == "--" or p.offset + p.page_size > engine.DEEP
    else:
        assert rows(best) == whole
    assert rows(engine.index_search(ranked.features, ranked.postings, ranked.statistics, p, catalog.CONF, known, ranked.tables)) == whole
    assert Service({"i": ranked}, conf=catalog.CONF, ontology=known).search({"key": "amenity", "limit": "3"})["returned"] == 3


def test_lists_by_impact_are_read_from_their_heads(ranked):
    """Blocks of a list don't overlap, and what is read of it grows with the page, ties of the greatest impact or not."""
    lists = [("key", ("amenity",))]
    rows = ranked.tables.ranked.filter(lookups.listed(lists))
    at = {k: lookups.frontier(ranked.tables.blocks, lists, k) for k in (1, 20, 200)}
    read = {k: rows.filter(lookups.down_to(e)).count() for k, e in at.items()}
    assert all(k <= read[k] <= k + 16 for k in read) and read[200] < rows.count() / 3
    assert lookups.frontier(ranked.tables.blocks, [("value", ("bar",)), ("values", ("cafe",))], 1 << 20) is None
    blocks = ranked.tables.blocks.filter(lookups.listed(lists)).orderBy(F.desc("least"), "last_id").collect()
    assert all(a["least"] >= b["greatest"] for a, b in zip(blocks, blocks[1:])) and all(b["n"] <= 16 for b in blocks)
    seen = plan(rows.filter(lookups.down_to(at[20])))
    assert "GreaterThanOrEqual(impact" in seen and "PartitionFilters: [isnotnull(field" in seen


def test_rounds_go_on_until_the_page_is_full(ranked):
    """A filter that few of the rarest list's heads pass moves the cut down, to the end if need be."""
    p = Params(key="shop", value="bar", city="chur", wheelchair="designated", limit=60)
    best = engine.best_filtered(ranked.tables.ranked, ranked.tables.blocks, ranked.statistics, p, long=0)
    want = ranked.features.filter(filters.indexed_fields(p)).orderBy(F.desc(lookups.impact(F.col("importance"))), "id").limit(60)
    assert {x["id"] for x in best.collect()} == {x["id"] for x in want.collect()}
