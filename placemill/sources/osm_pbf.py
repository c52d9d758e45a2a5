"""A Spark data source for OpenStreetMap PBF files: format "osm_pbf", option "kind" of node, way or relation.

A file is a run of blobs; the plan reads their headers only, and every partition decodes its own run of blobs. Rows are
nodes(id, lon, lat, tags), ways(id, nodes, tags) or relations(id, members, tags); ways and relations carry no positions,
which come by a join. Blocks become Arrow batches, dense nodes column by column. The path is one that executors can open (sources.files).
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from placemill.sources.files import open_file

SCHEMAS = {
    "node": "id long, lon double, lat double, tags map<string, string>",
    "way": "id long, nodes array<struct<ref: long, lon: double, lat: double>>, tags map<string, string>",
    "relation": "id long, members array<struct<type: string, ref: long, role: string>>, tags map<string, string>",
}
_MEMBERS = ("node", "way", "relation")
_TAGS = pa.map_(pa.string(), pa.string())
_STEP = pa.struct([("ref", pa.int64()), ("lon", pa.float64()), ("lat", pa.float64())])
_MEMBER = pa.struct([("type", pa.string()), ("ref", pa.int64()), ("role", pa.string())])
ARROW = {
    "node": pa.schema([("id", pa.int64()), ("lon", pa.float64()), ("lat", pa.float64()), ("tags", _TAGS)]),
    "way": pa.schema([("id", pa.int64()), ("nodes", pa.list_(_STEP)), ("tags", _TAGS)]),
    "relation": pa.schema([("id", pa.int64()), ("members", pa.list_(_MEMBER)), ("tags", _TAGS)]),
}


def varint(b: bytes, i: int) -> tuple[int, int]:
    out = shift = 0
    while True:
        c = b[i]
        out |= (c & 127) << shift
        i += 1
        if c < 128:
            return out, i
        shift += 7


def signed(n: int) -> int:
    return (n >> 1) ^ -(n & 1)


def message(b: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Field number and value (a number or bytes) of a protocol-buffer message."""
    i = 0
    while i < len(b):
        key, i = varint(b, i)
        kind = key & 7
        if kind == 0:
            value, i = varint(b, i)
        elif kind == 2:
            n, i = varint(b, i)
            value, i = b[i : i + n], i + n
        else:
            n = 8 if kind == 1 else 4
            value, i = b[i : i + n], i + n
        yield key >> 3, value


def packed(b: bytes) -> list[int]:
    out, i = [], 0
    while i < len(b):
        n, i = varint(b, i)
        out.append(n)
    return out


def running(b: bytes) -> list[int]:
    """Delta-coded signed numbers as sums."""
    out, at = [], 0
    for n in packed(b):
        at += signed(n)
        out.append(at)
    return out


def varints(b: bytes) -> np.ndarray:
    """All numbers of a run of base-128 numbers, at once."""
    raw = np.frombuffer(b, np.uint8)
    last = raw < 128
    ends = np.flatnonzero(last)
    starts = np.append(0, ends[:-1] + 1)
    place = np.arange(len(raw)) - np.repeat(starts, ends - starts + 1) if len(ends) else np.zeros(0, np.int64)
    bits = (raw[: len(place)].astype(np.uint64) & np.uint64(127)) << (np.uint64(7) * place.astype(np.uint64))
    return np.add.reduceat(bits, starts).view(np.int64) if len(ends) else np.zeros(0, np.int64)


def sums(b: bytes) -> np.ndarray:
    """Delta-coded signed numbers as sums, at once."""
    n = varints(b).view(np.uint64)
    return np.cumsum((n >> np.uint64(1)).view(np.int64) ^ -(n & np.uint64(1)).view(np.int64))


def blobs(f, start: int, stop: int) -> Iterator[tuple[str, int, int]]:
    """Type, place and size of the blobs whose headers start in a range."""
    while start < stop:
        f.seek(start)
        head = f.read(4)
        if len(head) < 4:
            return
        n = int.from_bytes(head, "big")
        fields = dict(message(f.read(n)))
        yield fields[1].decode(), start + 4 + n, fields[3]
        start += 4 + n + fields[3]


def inflate(blob: bytes) -> bytes:
    fields = dict(message(blob))
    if 1 in fields:
        return fields[1]
    if 3 in fields:
        return zlib.decompress(fields[3])
    raise ValueError("a blob is neither plain nor zlib")


def decode(block: bytes, want: str) -> Iterator[pa.RecordBatch]:
    """The objects of a kind in a block: dense nodes by columns, others as rows that are gathered to one batch."""
    strings, groups, grain, lat0, lon0 = [], [], 100, 0, 0
    for k, v in message(block):
        if k == 1:
            strings = [s.decode("utf-8", "replace") for _, s in message(v)]
        elif k == 2:
            groups.append(v)
        elif k == 17:
            grain = v
        elif k == 19:
            lat0 = v - (1 << 64) if v >> 63 else v
        elif k == 20:
            lon0 = v - (1 << 64) if v >> 63 else v
    degrees = lambda n, o: 1e-9 * (o + grain * n)
    rows: list[tuple] = []
    for g in groups:
        for k, v in message(g):
            m = dict(message(v)) if k in (1, 3, 4) else {}
            tags = lambda m=m: list({strings[a]: strings[b] for a, b in zip(packed(m.get(2, b"")), packed(m.get(3, b"")), strict=True)}.items())
            if k == 1 and want == "node":
                rows.append((signed(m[1]), degrees(signed(m[9]), lon0), degrees(signed(m[8]), lat0), tags()))
            elif k == 2 and want == "node":
                m = dict(message(v))
                ids = sums(m[1])
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(degrees(sums(m[9]), lon0)), pa.array(degrees(sums(m[8]), lat0)), _dense_tags(m.get(10, b""), len(ids), strings)], schema=ARROW["node"])
            elif k == 3 and want == "way":
                rows.append((m[1], [(r, 0.0, 0.0) for r in running(m.get(8, b""))], tags()))
            elif k == 4 and want == "relation":
                rows.append((m[1], [(_MEMBERS[t], r, strings[s]) for s, r, t in zip(packed(m.get(8, b"")), running(m.get(9, b"")), packed(m.get(10, b"")), strict=True)], tags()))
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(ARROW[want])], schema=ARROW[want])


def _dense_tags(b: bytes, n: int, strings: list[str]) -> pa.Array:
    """Maps of n nodes from their keys and values, 0 behind each node's last."""
    kv = varints(b)
    if not len(kv):
        return pa.array([[]] * n, _TAGS)
    ends = np.flatnonzero(kv == 0)
    counts = (np.diff(np.append(-1, ends)) - 1) // 2
    pairs = kv[kv > 0]
    node = np.repeat(np.arange(len(ends)), counts)
    whole = len(ends) == n and len(pairs) == 2 * counts.sum() and len(np.unique(node * (len(strings) + 1) + pairs[::2])) == len(node)
    if whole:
        table = pa.array(strings, pa.string())
        return pa.MapArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)).astype(np.int32)), table.take(pa.array(pairs[::2])), table.take(pa.array(pairs[1::2])))
    # an empty value, or a key twice: one node after the other
    out, rest = [], iter(kv.tolist())
    for _ in range(n):
        tags = {}
        while (k := next(rest, 0)) != 0:
            tags[strings[k]] = strings[next(rest)]
        out.append(list(tags.items()))
    return pa.array(out, _TAGS)


@dataclass
class Run(InputPartition):
    start: int
    stop: int


class PbfReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.kind = options["path"], options.get("kind", "node")
        self.size = int(options.get("partitionBytes", 32 << 20))

    def partitions(self) -> list[Run]:
        out, first = [], None
        with open_file(self.path) as f:
            end = f.seek(0, 2)
            for _, at, n in blobs(f, 0, end):
                first = 0 if first is None else first
                if at + n - first >= self.size:
                    out.append(Run(first, at + n))
                    first = at + n
        return [*out, Run(first or 0, end)]

    def read(self, run: Run) -> Iterator[pa.RecordBatch]:
        with open_file(self.path) as f:
            for kind, at, n in blobs(f, run.start, run.stop):
                if kind == "OSMData":
                    f.seek(at)
                    yield from decode(inflate(f.read(n)), self.kind)


class PbfSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "osm_pbf"

    def schema(self) -> str:
        return SCHEMAS[self.options.get("kind", "node")]

    def reader(self, schema) -> PbfReader:
        return PbfReader(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(PbfSource)
