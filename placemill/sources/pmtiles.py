"""A Spark data source for PMTiles archives of vector tiles: format "pmtiles".

The driver reads the header and the root directory, nothing else. A partition is some leaf directories, which the task reads and walks, or
some of the root's own entries; a run of equal tiles stays one entry, is decoded once, and its features are given for each of
its places. Wanted are the tiles of the deepest zoom, or those of option "zoom", option "tiles" (x1,y1,x2,y2) and pushed-down filters on z, x and y:
they become ranges of tile numbers along the Hilbert curve, by which directories are skipped before they are read.
`lookup` joins a table of (z, x, y) with an archive, and opens no more than DEPTH directories for a tile.

Rows are the features of the tiles. Points, lines and rings of a feature are its parts, in order; a ring that is cut out of the one
before it is a hole. lon and lat are the first position of all, coords the first part.
"""

from __future__ import annotations

import gzip
import math
import struct
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from placemill.sources.files import open_file
from placemill.sources.osm_pbf import message, packed, signed, varints

POSITIONS = "array<struct<lon: double, lat: double>>"
SCHEMA = f"z int, x int, y int, layer string, fid long, at long, props map<string, string>, lon double, lat double, coords {POSITIONS}, kind string, parts array<struct<hole: boolean, coords: {POSITIONS}>>"
_POSITIONS = pa.list_(pa.struct([("lon", pa.float64()), ("lat", pa.float64())]))
_ARROW = pa.schema([("z", pa.int32()), ("x", pa.int32()), ("y", pa.int32()), ("layer", pa.string()), ("fid", pa.int64()), ("at", pa.int64()), ("props", pa.map_(pa.string(), pa.string())), ("lon", pa.float64()), ("lat", pa.float64()), ("coords", _POSITIONS), ("kind", pa.string()), ("parts", pa.list_(pa.struct([("hole", pa.bool_()), ("coords", _POSITIONS)])))])
KINDS = {1: "point", 2: "line", 3: "polygon"}
#: Directories above a tile, at most; ranges of tile numbers that a window is broken to, at most; rows to an Arrow batch.
DEPTH, MAX_RANGES, BATCH = 4, 4096, 2000


def first_of_zoom(z: int) -> int:
    return ((1 << 2 * z) - 1) // 3


def tile_id(z: int, x: int, y: int) -> int:
    """Number of a tile: those of lower zooms first, then along a Hilbert curve."""
    out, n = ((1 << 2 * z) - 1) // 3, 1 << z
    s = n >> 1
    while s:
        rx, ry = int(x & s > 0), int(y & s > 0)
        out += s * s * ((3 * rx) ^ ry)
        if not ry:
            if rx:
                x, y = n - 1 - x, n - 1 - y
            x, y = y, x
        s >>= 1
    return out


def tile_of(number: int) -> tuple[int, int, int]:
    z = 0
    while number >= ((1 << 2 * (z + 1)) - 1) // 3:
        z += 1
    t, x, y, s = number - ((1 << 2 * z) - 1) // 3, 0, 0, 1
    while s < 1 << z:
        rx = 1 & (t >> 1)
        ry = 1 & (t ^ rx)
        if not ry:
            if rx:
                x, y = s - 1 - x, s - 1 - y
            x, y = y, x
        x, y, t, s = x + s * rx, y + s * ry, t >> 2, s << 1
    return z, x, y


def window_ranges(z: int, x1: int, y1: int, x2: int, y2: int, most: int = MAX_RANGES) -> list[tuple[int, int]]:
    """Ranges [a, b) of numbers of the zoom's tiles that hold the window; they hold others too where it would take more than `most`.

    A square of a lower zoom is one range of the curve: squares inside the window stay whole, those on its edge are split.
    """
    side = (1 << z) - 1
    x1, y1, x2, y2 = max(x1, 0), max(y1, 0), min(x2, side), min(y2, side)
    if x1 > x2 or y1 > y2:
        return []
    whole, edge, level = [], [(0, 0)], 0
    while edge:
        up, nxt = z - level, []
        for x, y in edge:
            a, b, c, d = x << up, y << up, ((x + 1) << up) - 1, ((y + 1) << up) - 1
            if x1 <= a and c <= x2 and y1 <= b and d <= y2:
                whole.append((level, x, y))
            elif a <= x2 and c >= x1 and b <= y2 and d >= y1:
                nxt += [(2 * x, 2 * y), (2 * x + 1, 2 * y), (2 * x, 2 * y + 1), (2 * x + 1, 2 * y + 1)]
        if len(whole) + len(nxt) > most:
            whole += [(level, x >> 1, y >> 1) for x, y in nxt[::4]]
            break
        edge, level = nxt, level + 1
    spans = sorted((first_of_zoom(z) + ((tile_id(n, x, y) - first_of_zoom(n)) << 2 * (z - n)), 1 << 2 * (z - n)) for n, x, y in whole)
    out: list[tuple[int, int]] = []
    for start, n in spans:
        if out and out[-1][1] == start:
            out[-1] = (out[-1][0], start + n)
        else:
            out.append((start, start + n))
    return out


@dataclass
class Entries:
    """A directory: first number, run (0: a further directory), offset and size of each entry, by number."""

    number: np.ndarray
    run: np.ndarray
    offset: np.ndarray
    size: np.ndarray

    @staticmethod
    def of(b: bytes) -> Entries:
        all_ = varints(plain(b))
        n = int(all_[0]) if len(all_) else 0
        step, run, size, offset = all_[1 : 4 * n + 1].reshape(4, n) if n else np.zeros((4, 0), np.int64)
        # an offset of 0: right behind the entry before
        fresh = np.flatnonzero(offset > 0)
        ends = np.cumsum(size)
        from_ = np.zeros(n, np.int64)
        if n:
            own = np.searchsorted(fresh, np.arange(n), "right") - 1
            from_ = offset[fresh][own] - 1 + (ends - size) - (ends - size)[fresh][own]
        return Entries(np.cumsum(step), run, from_, size)

    def wanted(self, ranges: list[tuple[int, int]], end: int) -> np.ndarray:
        """Places of the entries that can hold a wanted number; `end` is beyond the last one's."""
        stop = np.where(self.run > 0, self.number + self.run, np.append(self.number[1:], end)) if len(self.number) else self.number
        lo, hi = (np.array([r[i] for r in ranges], np.int64) for i in (0, 1))
        # the first range that ends behind an entry's start
        at = np.searchsorted(hi, self.number, "right")
        return np.flatnonzero((at < len(lo)) & (np.append(lo, end)[np.minimum(at, len(lo))] < stop))


def plain(b: bytes) -> bytes:
    return gzip.decompress(b) if b[:2] == b"\x1f\x8b" else b


def _value(b: bytes) -> str:
    for k, v in message(b):
        if k == 1:
            return v.decode("utf-8", "replace")
        if k == 2:
            return repr(struct.unpack("<f", v)[0])
        if k == 3:
            d = struct.unpack("<d", v)[0]
            return str(int(d)) if d.is_integer() and abs(d) < 1e21 else repr(d)
        if k == 4:
            return str(v - (1 << 64) if v >> 63 else v)
        if k == 5:
            return str(v)
        if k == 6:
            return str(signed(v))
        if k == 7:
            return "true" if v else "false"
    return ""


def parts_of(kind: int, commands: list[int]) -> list[list[tuple[int, int]]]:
    """Points, lines or closed rings, in order."""
    out: list[list[tuple[int, int]]] = []
    x, y, i = 0, 0, 0
    while i < len(commands):
        what, n = commands[i] & 7, commands[i] >> 3
        i += 1
        if what == 7:
            out[-1].append(out[-1][0])
            continue
        for _ in range(n):
            x, y = x + signed(commands[i]), y + signed(commands[i + 1])
            i += 2
            if what == 1:
                out.append([])
            out[-1].append((x, y))
    return out


def _turns(ring: list[tuple[int, int]]) -> int:
    """Twice the area of a ring, positive for one that isn't a hole."""
    return sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:], strict=False))


def decoded(tile: bytes) -> list[tuple]:
    """layer, fid, number, props, kind, parts of each feature; parts are (hole, positions as shares of the tile)."""
    out = []
    for k, layer in message(plain(tile)):
        if k != 3:
            continue
        name, keys, values, own, extent = "", [], [], [], 4096
        for f, v in message(layer):
            if f == 1:
                name = v.decode()
            elif f == 2:
                own.append(v)
            elif f == 3:
                keys.append(v.decode("utf-8", "replace"))
            elif f == 4:
                values.append(_value(v))
            elif f == 5:
                extent = v
        for number, feature in enumerate(own):
            m = dict(message(feature))
            pairs, kind = packed(m.get(2, b"")), m.get(3, 0)
            parts = parts_of(kind, packed(m.get(4, b"")))
            if parts:
                shares = [(kind == 3 and i > 0 and _turns(p) < 0, [(px / extent, py / extent) for px, py in p]) for i, p in enumerate(parts)]
                out.append((name, m.get(1), number, [(keys[a], values[b]) for a, b in zip(pairs[::2], pairs[1::2], strict=True)], KINDS.get(kind), shares))
    return out


def features(tile: list[tuple], z: int, x: int, y: int) -> Iterator[dict]:
    """Rows of a decoded tile at a place."""
    for layer, fid, number, props, kind, shares in tile:
        parts = [{"hole": hole, "coords": [dict(zip(("lon", "lat"), _degrees(z, x + px, y + py), strict=True)) for px, py in p]} for hole, p in shares]
        yield {"z": z, "x": x, "y": y, "layer": layer, "fid": fid, "at": (tile_id(z, x, y) << 20) + number, "props": props, **parts[0]["coords"][0], "coords": parts[0]["coords"], "kind": kind, "parts": parts}


def _degrees(z: int, x: float, y: float) -> tuple[float, float]:
    n = 1 << z
    return x / n * 360 - 180, math.degrees(math.atan(math.sinh(math.pi * (1 - 2 * y / n))))


@dataclass
class Header:
    root: int
    root_size: int
    leaves: int
    data: int
    least_zoom: int
    most_zoom: int
    n_tiles: int
    n_entries: int
    n_contents: int

    @staticmethod
    def of(head: bytes) -> Header:
        if head[:7] != b"PMTiles" or head[7] != 3:
            raise ValueError("not a PMTiles archive of version 3")
        root, root_size, _, _, leaves, _, data, _, *counts = struct.unpack("<11Q", head[8:96])
        return Header(root, root_size, leaves, data, head[100], head[101], *counts)


class Archive:
    """An open archive. Directories that were read are kept, at most `keep` of them."""

    def __init__(self, path: str, keep: int = 64):
        self.file = open_file(path)
        self.header = Header.of(self.file.read(127))
        self.kept: dict[tuple[int, int], Entries] = {}
        self.keep, self.opened = keep, 0

    def bytes(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        return self.file.read(n)

    def directory(self, at: int, n: int) -> Entries:
        if (at, n) not in self.kept:
            if len(self.kept) >= self.keep:
                self.kept.pop(next(iter(self.kept)))
            self.kept[at, n] = Entries.of(self.bytes(at, n))
            self.opened += 1
        return self.kept[at, n]

    def root(self) -> Entries:
        return self.directory(self.header.root, self.header.root_size)

    def find(self, number: int) -> tuple[int, int] | None:
        """Offset and size of a tile."""
        entries = self.root()
        for _ in range(DEPTH):
            i = int(np.searchsorted(entries.number, number, "right")) - 1
            if i < 0:
                return None
            offset, size, run = int(entries.offset[i]), int(entries.size[i]), int(entries.run[i])
            if run:
                return (self.header.data + offset, size) if number < entries.number[i] + run else None
            entries = self.directory(self.header.leaves + offset, size)
        return None

    def runs(self, leaf: tuple[int, int, int], ranges: list[tuple[int, int]]) -> Iterator[tuple[int, int, int, int]]:
        """first number, run, offset, size of wanted entries below a leaf (offset, size, number beyond its last)."""
        offset, size, end = leaf
        entries = Entries.of(self.bytes(self.header.leaves + offset, size))
        places = entries.wanted(ranges, end)
        for i in places.tolist():
            one = (int(entries.offset[i]), int(entries.size[i]))
            if entries.run[i]:
                yield int(entries.number[i]), int(entries.run[i]), *one
            else:
                yield from self.runs((*one, int(entries.number[i + 1]) if i + 1 < len(entries.number) else end), ranges)


def _batches(rows: Iterable[dict]) -> Iterator[pa.RecordBatch]:
    held: list[dict] = []
    for row in rows:
        held.append(row)
        if len(held) == BATCH:
            yield pa.RecordBatch.from_pylist(held, _ARROW)
            held = []
    if held:
        yield pa.RecordBatch.from_pylist(held, _ARROW)


@dataclass
class Tiles(InputPartition):
    """Leaf directories (offset, size, number beyond the last) and runs of tiles (first number, run, offset, size)."""

    leaves: list[tuple[int, int, int]] = field(default_factory=list)
    runs: list[tuple[int, int, int, int]] = field(default_factory=list)


class TileReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.zoom = int(options["zoom"]) if options.get("zoom") is not None else None
        self.per_task, self.leaves_per_task = int(options.get("tilesPerPartition", 512)), int(options.get("leavesPerPartition", 1))
        #: Inclusive bounds.
        self.window = {"x": [0, 1 << 30], "y": [0, 1 << 30], "z": [0, 30]}
        if options.get("tiles"):
            x1, y1, x2, y2 = (int(n) for n in options["tiles"].split(","))
            self.window |= {"x": [x1, x2], "y": [y1, y2]}

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Bounds on z, x and y narrow the window. Lists are narrowed to their ends, and so are still to be evaluated."""
        for f in filters:
            column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if column not in self.window or not isinstance(f, (EqualTo, In, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)):
                yield f
                continue
            values = f.value if isinstance(f, In) else [f.value]
            if not values or not all(isinstance(v, int) for v in values):
                yield f
                continue
            low, high = self.window[column]
            if isinstance(f, (EqualTo, In, GreaterThan, GreaterThanOrEqual)):
                low = max(low, min(values) + isinstance(f, GreaterThan))
            if isinstance(f, (EqualTo, In, LessThan, LessThanOrEqual)):
                high = min(high, max(values) - isinstance(f, LessThan))
            self.window[column] = [low, high]
            if isinstance(f, In):
                yield f

    def _ranges(self, header: Header) -> list[tuple[int, int]]:
        """Wanted numbers. Zooms are those of the filters; the deepest where neither they nor the option say any."""
        low, high = self.window["z"]
        if self.zoom is not None:
            low, high = max(low, self.zoom), min(high, self.zoom)
        elif (low, high) == (0, 30):
            low = high = header.most_zoom
        (x1, x2), (y1, y2) = self.window["x"], self.window["y"]
        zooms = range(max(low, header.least_zoom), min(high, header.most_zoom) + 1)
        return sorted(r for z in zooms for r in window_ranges(z, x1, y1, x2, y2))

    def partitions(self) -> list[Tiles]:
        archive = Archive(self.path)
        out, leaves, runs, n = [], [], [], 0
        root, end = archive.root(), first_of_zoom(archive.header.most_zoom + 1)
        for i in root.wanted(self._ranges(archive.header), end).tolist():
            number, run, offset, size = (int(a[i]) for a in (root.number, root.run, root.offset, root.size))
            if run == 0:
                leaves.append((offset, size, int(root.number[i + 1]) if i + 1 < len(root.number) else end))
                continue
            # a long run is one entry, dealt to tasks by its places
            for first in range(number, number + run, self.per_task):
                runs.append((first, min(self.per_task, number + run - first), offset, size))
                n += runs[-1][1]
                if n >= self.per_task:
                    out, runs, n = [*out, Tiles(runs=runs)], [], 0
        out += [Tiles(runs=runs)] if runs else []
        out += [Tiles(leaves=leaves[i : i + self.leaves_per_task]) for i in range(0, len(leaves), self.leaves_per_task)]
        return out or [Tiles()]

    def read(self, part: Tiles) -> Iterator[pa.RecordBatch]:
        archive = Archive(self.path)
        ranges = self._ranges(archive.header)
        (x1, x2), (y1, y2) = self.window["x"], self.window["y"]
        low, high = (np.array([r[i] for r in ranges], np.int64) for i in (0, 1))

        def places(first: int, run: int) -> Iterator[tuple[int, int, int]]:
            for a, b in zip(np.maximum(low, first).tolist(), np.minimum(high, first + run).tolist(), strict=True):
                for number in range(a, b):
                    z, x, y = tile_of(number)
                    if x1 <= x <= x2 and y1 <= y <= y2:
                        yield z, x, y

        def rows() -> Iterator[dict]:
            runs = [*part.runs, *(r for leaf in part.leaves for r in archive.runs(leaf, ranges))]
            for first, run, offset, size in runs:
                tile = None
                for at in places(first, run):
                    tile = decoded(archive.bytes(archive.header.data + offset, size)) if tile is None else tile
                    yield from features(tile, *at)

        yield from _batches(rows())


class TileSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "pmtiles"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> TileReader:
        return TileReader(dict(self.options))


def register(spark: SparkSession) -> None:
    """Also lets filters be pushed to sources in Python."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(TileSource)


def lookup(asked: DataFrame, path: str, partitions: int | None = None) -> DataFrame:
    """The features of the tiles that a table of (z, x, y) asks for. Tiles that are near on the curve go to one task, which keeps the directories it read."""

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            z, x, y = (c.to_pylist() for c in batch.columns)
            yield pa.RecordBatch.from_pydict({"number": pa.array([tile_id(*t) for t in zip(z, x, y, strict=True)], pa.int64())})

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        archive = Archive(path)

        def rows() -> Iterator[dict]:
            for batch in batches:
                for number in batch.column(0).to_pylist():
                    if at := archive.find(number):
                        yield from features(decoded(archive.bytes(*at)), *tile_of(number))

        yield from _batches(rows())

    inside = "z between 0 and 30 and x >= 0 and y >= 0 and x < pow(2, z) and y < pow(2, z)"
    numbers = asked.select("z", "x", "y").filter(inside).distinct().mapInArrow(numbered, "number long")
    dealt = numbers.repartitionByRange(partitions, "number") if partitions else numbers.repartitionByRange("number")
    return dealt.sortWithinPartitions("number").mapInArrow(found, SCHEMA)
