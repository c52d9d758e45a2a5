"""Archives of tiles that the tests write: directories, runs, windows, pushed filters, lookups and shapes of several parts."""

import gzip
import itertools
import random
import struct

import pytest

from placemill.config import Config, Params
from placemill.operators import tiles
from placemill.plans import engine
from placemill.sources import pmtiles
from placemill.sources.pmtiles import tile_id, tile_of


def _varint(n):
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def _f(k, v):
    return _varint(k << 3 | 2) + _varint(len(v)) + v if isinstance(v, bytes) else _varint(k << 3) + _varint(v)


def _packed(ns):
    return b"".join(map(_varint, ns))


def _zig(n):
    return n * 2 if n >= 0 else -n * 2 - 1


def _geometry(kind, parts):
    x = y = 0
    out = []
    for p in parts:
        own = p[:-1] if kind == 3 else p
        for n, (a, b) in enumerate(own):
            if n == 0:
                out.append(9)
            elif n == 1:
                out.append((len(own) - 1) << 3 | 2)
            out += [_zig(a - x), _zig(b - y)]
            x, y = a, b
        if kind == 3:
            out.append(15)
    return out


def _tile(features, layer="poi"):
    """features: (id, kind, parts, name); each is a cafe."""
    names = [f[3] for f in features]
    own = b"".join(_f(2, (_f(1, i) if i is not None else b"") + _f(2, _packed([0, n, 1, len(names)])) + _f(3, kind) + _f(4, _packed(_geometry(kind, parts)))) for n, (i, kind, parts, _) in enumerate(features))
    return gzip.compress(_f(3, _f(1, layer.encode()) + own + _f(3, b"name") + _f(3, b"class") + b"".join(_f(4, _f(1, n.encode())) for n in [*names, "cafe"]) + _f(5, 4096) + _f(15, 2)))


def _directory(entries):
    """entries: (number, run, offset, size)."""
    out, last, behind = _varint(len(entries)), 0, None
    for n, *_ in entries:
        out, last = out + _varint(n - last), n
    out += _packed([e[1] for e in entries]) + _packed([e[3] for e in entries])
    for _, _, offset, size in entries:
        out += _varint(0 if offset == behind else offset + 1)
        behind = offset + size
    return gzip.compress(out)


def _write(path, runs, per_leaf=0, zooms=(0, 14), deeper=False):
    """runs: (number, run, tile), by number. per_leaf: entries of a leaf directory; deeper: a directory between root and leaves."""
    data, entries = b"", []
    for n, run, tile in runs:
        entries.append((n, run, len(data), len(tile)))
        data += tile
    leaves = b""
    if per_leaf:
        root = []
        for i in range(0, len(entries), per_leaf):
            d = _directory(entries[i : i + per_leaf])
            root.append((entries[i][0], 0, len(leaves), len(d)))
            leaves += d
        if deeper:
            d = _directory(root)
            root = [(root[0][0], 0, len(leaves), len(d))]
            leaves += d
        entries = root
    root = _directory(entries)
    head = bytearray(127)
    head[:8] = b"PMTiles\x03"
    struct.pack_into("<11Q", head, 8, 127, len(root), 0, 0, 127 + len(root), len(leaves), 127 + len(root) + len(leaves), len(data), sum(r for _, r, _ in runs), len(runs), len(runs))
    head[100:102] = bytes(zooms)
    path.write_bytes(bytes(head) + root + leaves + data)
    return str(path)


def _point(i, x=2048, y=2048):
    return (i, 1, [[(x, y)]], f"n{i}")


@pytest.fixture
def load(spark):
    pmtiles.register(spark)
    return lambda path, **o: spark.read.format("pmtiles").options(**o).load(path)


def test_numbers_and_windows():
    for z, x, y in [(0, 0, 0), (1, 0, 1), (3, 5, 2), (14, 8623, 5752)]:
        assert tile_of(tile_id(z, x, y)) == (z, x, y)
    r = random.Random(0)
    for z in (0, 1, 4, 5):
        for _ in range(20):
            x1, x2 = sorted(r.randrange(-2, (1 << z) + 2) for _ in range(2))
            y1, y2 = sorted(r.randrange(-2, (1 << z) + 2) for _ in range(2))
            want = {tile_id(z, x, y) for x in range(max(x1, 0), min(x2, (1 << z) - 1) + 1) for y in range(max(y1, 0), min(y2, (1 << z) - 1) + 1)}
            ranges = pmtiles.window_ranges(z, x1, y1, x2, y2)
            assert {n for a, b in ranges for n in range(a, b)} == want and ranges == sorted(ranges)
            rough = pmtiles.window_ranges(z, x1, y1, x2, y2, 5)
            assert want <= {n for a, b in rough for n in range(a, b)} and len(rough) <= 8
    assert len(pmtiles.window_ranges(20, 1000, 2000, 400_000, 700_000)) <= pmtiles.MAX_RANGES + 8


def test_varints_at_once():
    ns = [0, 1, 127, 128, 300, 1 << 40, 5, (1 << 62) + 3]
    assert pmtiles.varints(b"".join(map(_varint, ns))).tolist() == ns and pmtiles.varints(b"").tolist() == []


def test_reader_of_one_tile(load, tmp_path):
    point = _f(1, 42) + _f(2, _packed([0, 0])) + _f(3, 1) + _f(4, _packed([9, _zig(2048), _zig(2048)]))
    ring = _f(2, _packed([1, 1])) + _f(3, 3) + _f(4, _packed([9, _zig(0), _zig(0), 26, _zig(10), 0, 0, _zig(10), _zig(-10), 0, 15, 9, _zig(5), _zig(5)]))
    layer = _f(1, b"poi") + _f(2, point) + _f(2, ring) + _f(3, b"name") + _f(3, b"rank") + _f(4, _f(1, b"Vaduz")) + _f(4, _varint(3 << 3 | 1) + struct.pack("<d", 3.0)) + _f(5, 4096) + _f(15, 2)
    path = _write(tmp_path / "x.pmtiles", [(tile_id(14, 8623, 5752), 1, gzip.compress(_f(3, layer)))])
    rows = sorted(load(path).collect(), key=lambda r: r["at"])
    assert [(r["z"], r["x"], r["y"], r["layer"], r["fid"], r["kind"]) for r in rows] == [(14, 8623, 5752, "poi", 42, "point"), (14, 8623, 5752, "poi", None, "polygon")]
    assert rows[0]["props"] == {"name": "Vaduz"} and rows[1]["props"] == {"rank": "3"} and len(rows[1]["coords"]) == 5 and rows[1]["coords"][0] == rows[1]["coords"][-1]
    assert rows[0]["lon"] == pytest.approx((8623.5 / 16384) * 360 - 180) and load(path, tiles="0,0,10,10").count() == 0 and load(path, zoom="3").count() == 0
    assert load("file:" + path).count() == load("file://" + path).count() == 2


@pytest.mark.parametrize("per_leaf, deeper", [(0, False), (7, False), (7, True)])
def test_directories_are_planned_by_leaves_and_filters(load, spark, tmp_path, per_leaf, deeper):
    r = random.Random(per_leaf)
    places = {(z, r.randrange(1 << z), r.randrange(1 << z)) for z in (3, 6) for _ in range(120)}
    shared = _tile([_point(999)])
    runs = [(tile_id(*t), 1, _tile([_point(tile_id(*t))])) for t in places]
    taken, start = {n for n, *_ in runs}, next(n for n in itertools.count(pmtiles.first_of_zoom(6)) if not {tile_id(*t) for t in places} & set(range(n, n + 5)))
    runs = sorted([*runs, (start, 5, shared)])
    path = _write(tmp_path / "y.pmtiles", runs, per_leaf, (3, 6), deeper)
    every = {tile_of(n + i) for n, run, _ in runs for i in range(run)}
    assert len(taken) == len(places)
    found = lambda df: sorted((x["z"], x["x"], x["y"]) for x in df.collect())
    assert found(load(path)) == sorted(t for t in every if t[0] == 6)
    assert found(load(path, zoom="3")) == sorted(t for t in every if t[0] == 3)
    assert found(load(path, tiles="10,10,40,30")) == sorted(t for t in every if t[0] == 6 and 10 <= t[1] <= 40 and 10 <= t[2] <= 30)
    assert found(load(path).filter("z >= 3")) == sorted(every)
    one = load(path).filter("z = 6 and x > 20 and x <= 33 and y in (4, 5, 9, 50)")
    assert found(one) == sorted(t for t in every if t[0] == 6 and 20 < t[1] <= 33 and t[2] in (4, 5, 9, 50))
    assert found(load(path).filter("z = 2")) == found(load(path, zoom="9")) == []
    asked = [*list(every)[::3], (6, 63, 63), (3, 0, 0), (6, -1, 3), (3, 8, 1), (6, 1, 1)]
    got = pmtiles.lookup(spark.createDataFrame(asked * 2, "z int, x int, y int"), path, 3)
    assert found(got) == sorted(every & set(asked))
    archive = pmtiles.Archive(path)
    assert all((archive.find(n) is not None) == (tile_of(n) in every) for n in range(5000))


def test_a_long_run_is_one_entry(load, tmp_path):
    """A run of a million tiles: planned by its places, and a window of it reads only those."""
    n = 1_000_000
    path = _write(tmp_path / "z.pmtiles", [(pmtiles.first_of_zoom(10), n, _tile([_point(1), _point(2)]))], 1, (10, 10))
    reader = pmtiles.TileReader({"path": path, "tiles": "5,5,9,9"})
    parts = reader.partitions()
    assert len(parts) == 1 and len(parts[0].leaves) == 1 and not parts[0].runs
    assert load(path, tiles="5,5,9,9").count() == 50
    flat = _write(tmp_path / "w.pmtiles", [(pmtiles.first_of_zoom(10), n, _tile([_point(1)]))], 0, (10, 10))
    assert len(pmtiles.TileReader({"path": flat, "tilesPerPartition": 10_000}).partitions()) == 100
    assert load(flat, tilesPerPartition=200_000).filter("x < 8").count() == sum(1 for i in range(n) if tile_of(pmtiles.first_of_zoom(10) + i)[1] < 8)


SQUARE = [(0, 0), (400, 0), (400, 400), (0, 400), (0, 0)]
HOLE = [(100, 100), (100, 300), (300, 300), (300, 100), (100, 100)]


def test_shapes_of_several_parts(load, tmp_path):
    far = [(x + 2000, y + 2000) for x, y in SQUARE]
    own = [(1, 1, [[(5, 5)], [(3000, 3000)]], "points"), (2, 2, [[(0, 0), (10, 0)], [(500, 500), (900, 500)]], "lines"), (3, 3, [SQUARE, HOLE, far], "rings")]
    z, x, y = 14, 8623, 5752
    path = _write(tmp_path / "p.pmtiles", [(tile_id(z, x, y), 1, _tile(own))])
    rows = {r["fid"]: r for r in load(path).collect()}
    assert {i: (r["kind"], len(r["parts"])) for i, r in rows.items()} == {1: ("point", 2), 2: ("line", 2), 3: ("polygon", 3)}
    assert [p["hole"] for p in rows[3]["parts"]] == [False, True, False] and all(p["coords"][0] == p["coords"][-1] for p in rows[3]["parts"])
    assert rows[1]["coords"] == rows[1]["parts"][0]["coords"] and rows[1]["lon"] == rows[1]["coords"][0]["lon"]


def test_coarse_and_precise_filters(load, tmp_path):
    """A point by itself, several points by any, other shapes by their envelope; precisely by distance, if it is asked for."""
    z, x, y = 14, 8623, 5752
    bent = [[(0, 0), (4000, 0)], [(4000, 0), (4000, 4000)]]
    own = [(1, 1, [[(100, 4000)]], "one"), (2, 1, [[(4000, 100)], [(100, 4000)]], "two"), (3, 2, bent, "bent"), (4, 3, [[(a * 10, b * 10) for a, b in SQUARE], [(a * 10, b * 10) for a, b in HOLE]], "ring")]
    path = _write(tmp_path / "q.pmtiles", [(tile_id(z, x, y), 1, _tile(own))])
    objects = tiles.objects(load(path))
    at = lambda px, py, radius: Params(lat=pmtiles._degrees(z, x, y + py / 4096)[1], lon=pmtiles._degrees(z, x + px / 4096, y)[0], radius=radius)
    found = lambda p, conf=Config(): {r["name"] for r in engine.direct_hits(objects, p, conf, repeated=True).collect()}
    precise = Config(pmtiles_post_process=True)
    near = at(100, 4000, "50m")
    assert found(near) == {"one", "two", "bent", "ring"}
    assert found(near, precise) == {"one", "two", "ring"}
    middle = at(2000, 2000, "100m")
    assert found(middle) == {"bent", "ring"} and found(middle, precise) == set()  # within the hole, away from the lines
    assert found(at(500, 500, "10m"), precise) == {"ring"}


def test_inspection(load, spark, tmp_path):
    z, x, y = 14, 8623, 5752
    path = _write(tmp_path / "i.pmtiles", [(tile_id(z, x, y), 1, _tile([(1, 1, [[(5, 5)], [(30, 30)]], "n" * 300), (2, 2, [[(0, 0), (10, 0)]], "short")]))], zooms=(12, 14))
    head = tiles.header(spark, path).first()
    assert (head["least_zoom"], head["most_zoom"], head["n_tiles"]) == (12, 14, 1)
    lon, lat = pmtiles._degrees(z, x + 0.5, y + 0.5)
    rows = sorted(tiles.inspect(spark, path, lat, lon).collect(), key=lambda r: r["fid"])
    assert [(r["z"], r["x"], r["y"], r["layer"], r["shape"]) for r in rows] == [(14, x, y, "poi", "point of 2 parts, 2 positions"), (14, x, y, "poi", "line of 1 parts, 2 positions")]
    assert len(rows[0]["props"]) <= 103 and rows[0]["props"].endswith("...") and rows[1]["props"] == '{"name":"short","class":"cafe"}'
    assert [r["layer"] for r in tiles.list_layers(spark, path, lat, lon).collect()] == ["poi"]
    with pytest.raises(ValueError):
        tiles.inspect(spark, path, lat, lon, zooms=(3, 14))
    assert tiles.inspect(spark, path, lat, lon, layer="other").count() == 0
