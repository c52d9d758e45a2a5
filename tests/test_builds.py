"""Builds: counters of their own job, versions from changes, streams of changes, shapes of relations and simplification."""

import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from placemill.config import Config, Params
from placemill.operators import features, geometry, ontology, stats
from placemill.plans import engine
from placemill.plans.engine import Ontology
from placemill.plans.service import Index, Service
from placemill.streaming import publish

SCHEMA = "id string, entity_type string, osm_id long, tags map<string,string>, lat double, lon double, coords array<struct<lon:double,lat:double>>"
CONF = Config(languages=("en",))


def _object(i, r):
    tags = {r.choice(["amenity", "shop", "place"]): r.choice(["cafe", "bakery", "city"]), "name": " ".join(r.choice(["Alpha", "Beta", "Gamma", "Delta", "Münster"]) for _ in range(r.randrange(1, 4))), "addr:city": r.choice(["Vaduz", "Chur"])}
    if r.random() < 0.15:
        tags = {"foo": "bar"}  # of no class
    lat, lon = 47 + r.random(), 9 + r.random()
    return (f"node/{i}", r.choice(["node", "way"]), i, tags, lat, lon, [(lon, lat)])


def _tables(spark, path):
    read = lambda t, *c: sorted(map(tuple, spark.read.parquet(f"{path}/{t}").select(*c).collect()))
    return {"features": read("features", "id", "name", "cell", "display_address"), "postings": read("postings", "field", "term", "id", "cell", "tf", "field_len"), "statistics": read("statistics", "field", "term", "df", "n_docs"), "names": read("names", "folded", "id"), "neighbours": read("neighbours", "field", "key", "term", "df", "n_docs")}


def test_counts_come_with_the_build(spark, tmp_path):
    r = random.Random(1)
    rows = [_object(i, r) for i in range(80)]
    path = publish.publish(spark.createDataFrame(rows, SCHEMA), str(tmp_path), "v1", CONF, {})
    counts = {x["entity_type"]: (x["scanned"], x["imported"], x["skipped"]) for x in spark.read.parquet(f"{path}/counts").collect()}
    bad = sum("foo" in x[3] for x in rows)
    assert counts["all"] == (80, 80 - bad, bad) and counts["relation"] == (0, 0, 0)
    assert counts["node"][0] == sum(x[1] == "node" for x in rows) and counts["node"][1] + counts["way"][1] == 80 - bad
    assert not (tmp_path / "v1" / "built").exists()


def test_updates_equal_a_rebuild(spark, tmp_path):
    """Random changes in two batches, then in a stream: additions, deletions, changes of names, of class, and of ids that never were."""
    r = random.Random(2)
    now = {i: _object(i, r) for i in range(60)}
    path = publish.publish(spark.createDataFrame(list(now.values()), SCHEMA), str(tmp_path), "v1", CONF, {})
    for n in range(2):
        changes = []
        for seq in range(30):
            i, deleted = r.randrange(75), r.random() < 0.3
            changes.append((*_object(i, r), deleted, seq))
            now.pop(i, None)
            if not deleted:
                now[i] = changes[-1][:7]
        path = publish.update(spark, path, str(tmp_path / f"u{n}"), spark.createDataFrame(changes, SCHEMA + ", deleted boolean, seq int"), CONF, {})
    whole = publish.publish(spark.createDataFrame(list(now.values()), SCHEMA), str(tmp_path), "again", CONF, {})
    assert _tables(spark, path) == _tables(spark, whole)


def test_a_stream_of_changes_makes_versions(spark, tmp_path):
    r = random.Random(3)
    now = {i: _object(i, r) for i in range(20)}
    base = publish.publish(spark.createDataFrame(list(now.values()), SCHEMA), str(tmp_path), "base", CONF, {})
    schema = SCHEMA + ", deleted boolean"
    for n in range(2):
        changes = [(*_object(i, r), i % 4 == 0) for i in range(10 * n, 10 * n + 8)]
        for c in changes:
            now.pop(c[2], None)
            if not c[7]:
                now[c[2]] = c[:7]
        spark.createDataFrame(changes, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        publish.follow(stream, base, str(tmp_path), str(tmp_path / "check"), CONF, {}).awaitTermination()
    whole = publish.publish(spark.createDataFrame(list(now.values()), SCHEMA), str(tmp_path), "again", CONF, {})
    assert _tables(spark, str(tmp_path / "b1")) == _tables(spark, whole)


def test_relations_by_ways_with_positions(spark):
    members = spark.createDataFrame([(1, 0, "way", 10), (1, 1, "node", 5), (2, 0, "way", 11), (2, 1, "node", 5), (3, 0, "way", 11)], "id long, at long, type string, ref long")
    nodes = spark.createDataFrame([(5, 9.5, 47.5)], "id long, lon double, lat double")
    own = spark.createDataFrame([(10, 1, 5, 0.0, 0.0), (10, 2, 6, 8.0, 46.0), (10, 3, 6, 8.5, 46.5), (11, 1, 7, 0.0, 0.0)], "id long, at long, ref long, lon double, lat double")
    got = {x["id"]: (x["lon"], x["lat"]) for x in geometry.relation_points(members, nodes, geometry.own_points(own)).collect()}
    assert got == {1: (8.0, 46.0), 2: (9.5, 47.5)}


def _distance(p, a, b):
    d = b - a
    t = np.clip((p - a) @ d / (d @ d), 0, 1) if d @ d else 0
    return np.hypot(*(p - a - t * d))


def _plain_crosses(points):
    side = lambda p, q, r: np.sign((q[0] - p[0]) * (r[1] - p[1]) - (q[1] - p[1]) * (r[0] - p[0]))
    e = list(zip(points, points[1:], strict=False))
    return any(side(*e[i], e[j][0]) * side(*e[i], e[j][1]) < 0 and side(*e[j], e[i][0]) * side(*e[j], e[i][1]) < 0 for i in range(len(e)) for j in range(i))


@pytest.mark.parametrize("pairs", [4, 1 << 20])
def test_crossings_match_all_pairs(monkeypatch, pairs):
    monkeypatch.setattr(geometry, "_PAIRS", pairs)
    r = np.random.default_rng(0)
    seen = set()
    for n in (4, 5, 8, 20):
        for _ in range(60):
            ring = r.integers(0, 6 if n < 8 else 40, (n, 2)).astype(float) if n < 20 else np.cumsum(r.normal(size=(n, 2)), axis=0)
            ring = np.vstack([ring, ring[:1]])
            seen.add(got := geometry._crosses(ring))
            assert got == _plain_crosses(ring)
    assert seen == {True, False}


def test_simplified_shapes_keep_tolerance_and_topology(spark):
    """Every point that goes lies within the tolerance of what stays in its place; rings don't come to cross themselves."""
    r = np.random.default_rng(1)
    lines = [np.cumsum(r.normal(size=(60, 2)), axis=0) for _ in range(20)]
    angle = np.sort(r.uniform(0, 2 * np.pi, (20, 80)), axis=1)
    rings = [np.stack([np.cos(a), np.sin(a)], axis=1) * r.uniform(0.2, 3, (80, 1)) for a in angle]
    rings = [np.vstack([x, x[:1]]) for x in rings]
    rows = [(i, [tuple(map(float, p)) for p in s]) for i, s in enumerate(lines + rings)]
    df = spark.createDataFrame(rows, "i int, coords array<struct<lon:double,lat:double>>")
    got = {x["i"]: np.array([(c["lon"], c["lat"]) for c in x["s"]]) for x in df.select("i", geometry.simplifier(1.0)(F.col("coords")).alias("s")).collect()}
    for i, s in enumerate(lines + rings):
        at = [int(np.flatnonzero((s == p).all(axis=1))[0]) for p in got[i][:-1]] + [len(s) - 1]
        assert at == sorted(at) and at[0] == 0
        for a, b in zip(at, at[1:], strict=False):
            assert all(_distance(s[k], s[a], s[b]) <= 1.0 + 1e-9 for k in range(a, b))
        if i >= len(lines):
            assert len(got[i]) >= 4 and not _plain_crosses(got[i])
    assert sum(map(len, got.values())) < 0.7 * sum(map(len, lines + rings))


def test_a_ring_of_a_hundred_thousand_points(spark):
    n = 100_000
    a = np.linspace(0, 2 * np.pi, n, endpoint=False)
    ring = np.stack([np.cos(a), np.sin(a)], axis=1) * (1 + 0.01 * np.sin(400 * a))[:, None]
    ring = np.vstack([ring, ring[:1]])
    start = time.perf_counter()
    assert not geometry._crosses(ring)
    assert time.perf_counter() - start < 20
    df = spark.createDataFrame([([tuple(map(float, p)) for p in ring],)], "coords array<struct<lon:double,lat:double>>")
    assert 4 <= df.select(F.size(geometry.simplifier(0.001)(F.col("coords"))).alias("n")).first()["n"] < n / 10


def test_objects_of_a_map_are_built_and_searched(spark, tmp_path, monkeypatch, capsys):
    """From nodes, ways and relations to an index, and a search from the command line."""
    from placemill import __main__ as command
    from placemill.sources import map_objects

    tags = "tags map<string,string>"
    none: dict = {}
    nodes = spark.createDataFrame([(1, 9.5, 47.1, {"amenity": "cafe", "name": "Cafe Rhein"}), (2, 9.51, 47.11, none), (3, 9.52, 47.11, none), (4, 9.0, 47.0, none)], f"id long, lon double, lat double, {tags}")
    step = lambda ref, lon=0.0, lat=0.0: (ref, lon, lat)
    ways = spark.createDataFrame([(10, [step(2), step(3)], {"highway": "primary", "name": "Rheinstrasse"}), (11, [step(2), step(99)], {"highway": "primary", "name": "Short"}), (12, [step(98, 9.6, 47.2), step(3)], none)], f"id long, nodes array<struct<ref: long, lon: double, lat: double>>, {tags}")
    relations = spark.createDataFrame([(20, [("way", 12, ""), ("node", 3, "")], {"tourism": "museum", "name": "Rhein Museum"}), (21, [("node", 77, "")], {"tourism": "museum", "name": "Nowhere"})], f"id long, members array<struct<type: string, ref: long, role: string>>, {tags}")
    got = {x["id"]: [(c["lon"], c["lat"]) for c in x["coords"]] for x in map_objects.objects(nodes, ways, relations).collect()}
    assert got == {"node/1": [(9.5, 47.1)], "way/10": [(9.51, 47.11), (9.52, 47.11)], "relation/20": [(9.6, 47.2)]}
    assert [x["id"] for x in map_objects.objects(nodes, ways, relations, Config(nodes_only=True)).collect()] == ["node/1"]
    monkeypatch.setattr(map_objects, "read", lambda spark, path, kind: {"node": nodes, "way": ways, "relation": relations}[kind])
    built = command.main(["build", str(tmp_path), "v1", "x.osm.pbf"], spark)
    assert next(c for c in built["counts"] if c["entity_type"] == "all")["imported"] == 3
    found = command.main(["search", built["path"], "q=rhein", "limit=5"], spark)
    assert {h["id"] for h in found["hits"]} == {"node/1", "way/10", "relation/20"} and '"total": 3' in capsys.readouterr().out
    lists = command.main(["build", "--ranked", str(tmp_path), "lists", "x.osm.pbf"], spark)
    assert [h["id"] for h in command.main(["search", "--ranked", lists["path"], "key=amenity"], spark)["hits"]] == ["node/1"]
    spark.createDataFrame([("node/1", "node", 1, none, 47.1, 9.5, [(9.5, 47.1)], True)], SCHEMA + ", deleted boolean").write.parquet(str(tmp_path / "changes"))
    after = command.main(["update", built["path"], str(tmp_path / "v2"), str(tmp_path / "changes")], spark)
    assert {h["id"] for h in command.main(["search", after["path"], "q=rhein"], spark)["hits"]} == {"way/10", "relation/20"}
    assert command.main(["search", after["path"], "mode=pbf"], spark)["code"] == "no_source"


def test_redirects_are_other_names(spark, tmp_path):
    """A feature is found by a redirect's title; ids without redirects, and features without an id, stay as they are."""
    tags = [{"place": "city", "name": "Berlin", "wikidata": "Q64"}, {"place": "city", "name": "Bern", "wikidata": "Q70"}, {"place": "city", "name": "Biel"}, {"place": "city", "name": "Basel", "wikidata": ""}]
    rows = [(f"node/{i}", "node", i, t, 47.0, 9.0, [(9.0, 47.0)]) for i, t in enumerate(tags)]
    table = spark.createDataFrame([("de", "r", "Spree_Athen", 0.1, "Q64"), ("en", "r", "Spree_Athen", 0.1, "Q64"), ("en", "r", "Athens_of_the_Spree", 0.1, "Q64"), ("en", "a", "Bern", 0.1, "Q70")], "language string, type string, title string, importance double, wikidata_id string")
    objects = spark.createDataFrame(rows, SCHEMA)
    names = lambda v, **o: {r["osm_id"]: sorted(r["names"].values()) for r in spark.read.parquet(publish.publish(objects, str(tmp_path), v, Config(**o), {}, importance=table) + "/features").collect()}
    assert names("without") == {i: [] for i in range(4)}
    assert names("with", index_wikidata_redirects=True) == {0: ["Athens of the Spree", "Spree Athen"], 1: [], 2: [], 3: []}
    service = Service(indexes={"i": Index.read(spark, str(tmp_path / "with"))}, ontology=Ontology())
    assert [h["id"] for h in service.search({"q": "Spree Athen"})["hits"]] == ["node/0"]


def test_a_joined_ontology_equals_a_compiled_one(spark, monkeypatch):
    r = random.Random(5)
    objects = spark.createDataFrame([_object(i, r) for i in range(60)], SCHEMA)
    table = spark.createDataFrame([("Q1", 3, "Coffee", "amenity", "cafe"), ("Q2", 1, "city", "place", "city"), ("Q3", 5, "city", "place", "city"), ("Q4", 2, "Baker", "shop", "bakery"), ("Q5", 2, "coffee", "shop", "cafe")], "qid string, level int, label string, osm_key string, osm_value string")
    one, two = Ontology.of(table), Ontology.joined(table)
    rows = lambda df: sorted(map(str, df.collect()))
    for most in (ontology.MAX_BROADCAST, 1):
        monkeypatch.setattr(ontology, "MAX_BROADCAST", most)
        assert rows(features.build(objects, CONF, one.levels)) == rows(features.build(objects, CONF, table))
        for p in (Params(query="alpha"), Params(query="Coffees"), Params(key="place")):
            assert rows(engine.direct_all(objects, p, CONF, one)) == rows(engine.direct_all(objects, p, CONF, two))
    for q in ("coffee", " COFFEES", "citys", "none", ""):
        assert sorted(two.named(q)) == sorted(set(one.named(q)))
    assert Ontology.fitting(table).table is None
    monkeypatch.setattr(ontology, "MAX_LITERAL", 4)
    assert Ontology.fitting(table).table is not None


def test_fresh_queries_of_a_log(spark):
    """Against the plain definition: gaps between queries of a key in order of time; equal times, no time, and keys of one query."""
    r = random.Random(6)
    log = [(k, r.choice([None, r.randrange(400), r.randrange(4000)])) for k in "aab" for _ in range(60)] + [("c", 7)]
    frame = spark.createDataFrame(log, "key string, s long").select("key", F.timestamp_seconds("s").alias("ts"))
    for ttl in (0, 1, 30, 1000):
        want = set()
        for k in "abc":
            s = sorted(t for x, t in log if x == k and t is not None)
            want.add((k, sum(x == k for x, _ in log), sum(y - x <= ttl for x, y in zip(s, s[1:], strict=False))))
        assert {tuple(x) for x in stats.cache_gaps(frame, ttl).collect()} == want


def test_redirect_names_come_in_slices(spark):
    """The names that a build adds, from parallel slices of a common id's titles and not from one task, each once."""
    tags = [{"wikidata": "Q1"}, {"wikidata": "Q1"}, {"wikidata": "Q2"}, {"wikidata": "Q3"}, {"wikidata": ""}, {}]
    rows = spark.createDataFrame([(f"node/{i}", i, t, {}) for i, t in enumerate(tags)], "id string, osm_id long, tags map<string,string>, names map<string,string>")
    table = [("en", "r", f"a_{i % 7}", 0.1, "Q1") for i in range(9)] + [("en", "r", "b", 0.1, "Q2"), ("en", "a", "c", 0.1, "Q3"), ("en", "r", "d", 0.1, "Q4")]
    table = spark.createDataFrame(table, "language string, type string, title string, importance double, wikidata_id string")
    want = sorted(tuple(r) for r in ontology.add_redirects(rows, table).select("osm_id", F.explode(F.map_values("names"))).collect())
    assert len(want) == 15
    for most in (1, 3, 7, 1000):
        got = ontology.redirect_names(rows, table, most)
        assert sorted(tuple(r) for r in got.collect()) == want
    assert got.rdd.getNumPartitions() >= 16  # whatever AQE makes of so small an input


def test_redirect_names_of_a_common_id_are_many_tasks_work(spark):
    """An id of many features and few titles, or of few and many: spread, each pair once; rows without an id or a title, and titles that are equal as names."""
    from collections import Counter

    tags = [{"wikidata": "Q1"}] * 3000 + [{"wikidata": "Q2"}] * 3 + [{"wikidata": "Q3"}, {"wikidata": ""}, {}]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(tags)], "osm_id long, tags map<string,string>")
    table = [("r", t, "Q1") for t in ("a_b", "a b", "c", None)] + [("r", f"t_{i % 3000}", "Q2") for i in range(6000)] + [("r", "d", None), ("a", "e", "Q3"), ("r", "f", "Q4")]
    got = ontology.redirect_names(rows, spark.createDataFrame(table, "type string, title string, wikidata_id string"), most=100, many=100)
    found = got.withColumn("task", F.spark_partition_id()).collect()
    want = Counter((i, t) for i in range(3000) for t in ("a b", "c")) + Counter((3000 + i, f"t {j}") for i in range(3) for j in range(3000))
    assert Counter((r["osm_id"], r["title"]) for r in found) == want
    for first, last in ((0, 2999), (3000, 3002)):
        tasks = Counter(r["task"] for r in found if first <= r["osm_id"] <= last)
        assert len(tasks) > 8 and max(tasks.values()) < sum(tasks.values()) / 3


def test_kept_are_the_objects_of_features(spark):
    r = random.Random(8)
    none = [("node/x", "node", 90, {}, 47.0, 9.0, [(9.0, 47.0)]), ("node/y", "node", 91, {"place": "city"}, None, None, []), ("node/z", "node", 92, {"wheelchair": "yes", "wikidata": "Q1"}, 47.0, 9.0, [(9.0, 47.0)])]
    objects = spark.createDataFrame([_object(i, r) for i in range(60)] + none, SCHEMA)
    for conf in (CONF, Config(), Config(nodes_only=True), Config(only_named=True, languages=("de",))):
        ids = lambda df: sorted(x["id"] for x in df.select("id").collect())
        assert ids(features.kept(objects, conf)) == ids(features.build(objects, conf))
