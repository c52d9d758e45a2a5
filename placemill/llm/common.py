"""What the operators share: reading tables, cutting lineage, Arrow text buffers."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a Python task handles at once, if no single text is longer.
SLICE_BYTES = 1 << 18


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; a temporary one only where none is configured and Spark is local."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        where = spark.conf.get("spark.checkpoint.dir", None)
        if where is None:
            if not sc.master.startswith("local[") and sc.master != "local":
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            where = tempfile.mkdtemp(prefix="placemill-")
        sc.setCheckpointDir(where)
    return sc.getCheckpointDir()


class Run:
    """Tables that one query writes to the shared folder, under one folder of its own, which clear() removes."""

    def __init__(self, spark: SparkSession):
        self.spark, self.path = spark, f"{shared_dir(spark)}/{uuid.uuid4().hex}"

    def cut(self, df: DataFrame) -> DataFrame:
        """Write the rows and read them back: later steps don't recompute them, and a lost executor loses nothing."""
        path = f"{self.path}/{uuid.uuid4().hex}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def clear(self) -> None:
        """Remove what was written; nothing that is still to be computed may read it."""
        jvm = self.spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(self.path)
        where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def cut(df: DataFrame) -> DataFrame:
    """Write the rows to the shared folder and read them back, for results that are read after the query has returned."""
    return Run(df.sparkSession).cut(df)


def doc_hash(*cols: str | Column) -> Column:
    """Uniform 64-bit hash that decides samples, buckets and ties."""
    return F.xxhash64(*cols)


def held_out(id_col: Column, modulus: int, remainder: int) -> Column:
    """Whether crc32 of the id as text leaves the remainder; a null id counts as the empty text."""
    return (F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % modulus) == remainder


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of an Arrow text column and the n+1 offsets into them; null counts as empty."""
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    _, offsets, data = texts.buffers()
    wide = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    at = np.frombuffer(offsets, wide)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if offsets else np.zeros(1, np.int64)
    return (np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)), at


def slices(texts: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of whole texts of about `most` bytes: first row, row after the last, their bytes, their lengths."""
    data, at = buffers(texts)
    first, n = 0, len(at) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(at, at[first] + most, "right")) - 1)
        yield first, last, data[at[first] : at[last]], np.diff(at[first : last + 1])
        first = last


def mix64(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit words (xor-shift and multiply rounds)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(31)
    x *= np.uint64(0x9E6C63D0876A9A47)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xC2B2AE3D27D4EB4F)
    x ^= x >> np.uint64(32)
    return x


def uniform(x: np.ndarray) -> np.ndarray:
    """Hashes to floats in the open interval (0, 1)."""
    return ((mix64(x) >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


class HashIndex:
    """Places of 64-bit keys: two open tables, the second with a multiplier under which the leftovers don't meet."""

    def __init__(self, keys: np.ndarray):
        self.n = len(keys)
        self.keys = np.append(keys.astype(np.uint64), np.uint64(0))
        self.bits = max(12, int(self.n + 1).bit_length() + 4)
        places = np.arange(self.n, dtype=np.int32)
        self.first = np.full(1 << self.bits, self.n, np.int32)
        self.first[self._slot(self.keys[:-1], 0x9E3779B97F4A7C15)] = places
        rest = np.flatnonzero(self.first[self._slot(self.keys[:-1], 0x9E3779B97F4A7C15)] != places)
        self.mult, slots = 0xD6E8FEB86659FD93, np.zeros(0, np.uint64)
        while len(np.unique(slots := self._slot(self.keys[rest], self.mult))) < len(rest):
            self.mult = (self.mult + 0x2545F4914F6CDD1E) % (1 << 64)
        self.second = np.full(1 << self.bits, self.n, np.int32)
        self.second[slots] = rest

    def _slot(self, codes: np.ndarray, mult: int) -> np.ndarray:
        return (codes * np.uint64(mult)) >> np.uint64(64 - self.bits)

    def find(self, codes: np.ndarray) -> np.ndarray:
        """The place of each key, n for those that aren't there."""
        at = self.first[self._slot(codes, 0x9E3779B97F4A7C15)]
        lost = np.nonzero(self.keys[at] != codes)
        at[lost] = self.second[self._slot(codes[lost], self.mult)]
        at[self.keys[at] != codes] = self.n
        return at
