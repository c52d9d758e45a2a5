"""Exact top-k search by columnar branch and bound.

Vectors are packed to chunks in vertical layout: one row of numbers per dimension. A block of queries runs over a group of
chunks. Inner products are accumulated a block of dimensions at a time for all vectors of a chunk; after each block, what
is left of a product is bounded by the product of the remaining norms (Cauchy-Schwarz), and vectors that can't reach a
query's k-th best score so far are dropped. While many survive, the next block runs over the chunk's columns that any
query still needs; once few do, over a compact list of (query, vector) pairs.

Components are whole numbers. Where the product of two norms is below 2^53 no partial sum can be larger, so floating-point
sums are exact and the bound is safe with a margin of a half. Pairs beyond that are summed in integers of any size, without
bounds; scores beyond 64 bits count as the largest or least 64-bit number.

Queries and vectors meet in a grid of (block of queries, group of chunks): each cell holds at most about BLOCK queries and
GROUP vectors, and returns k rows per query; a second step takes the best k of each query over its groups. One group is
searched first; a query's k-th best score there is its bar in all other cells. A vector goes to every block of queries, so
what is shuffled is the table times the number of blocks, and the queries times that of the groups.

Defined cases: vectors that are null or hold null or a non-finite number take no part, nor do rows with a null id; a shorter
vector counts as padded with zeros, an empty one as zeros alone; rows with the query's own id are no candidates; of several
query rows with one id that take part, the greatest vector asks; repeated rows are candidates of their own; ties go to the
smaller id; an empty table gives no rows; further columns are not read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from placemill.llm.common import Run, cut, mix64

SCALE = 64
BLOCK, GROUP = 1 << 14, 1 << 16
#: Dimensions to a block; queries that share a pass; share of pairs below which pairs are listed.
DIMS, TOGETHER, FEW = 16, 64, 0.1
_PACKED = "g int, n int, dims int, ids binary, cells binary, bars binary"
_EXACT = 2.0**53


def _quantised(vectors: pa.Array) -> np.ndarray:
    """SCALE * x rounded down, as n x dims. Every such number of float64 is exact."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    sizes = pc.list_value_length(vectors).to_numpy(zero_copy_only=False).astype(np.int64)
    x = vectors.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    out = np.zeros((len(sizes), int(sizes.max(initial=0))))
    with np.errstate(over="ignore"):
        out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(x)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = np.floor(np.clip(SCALE * x, -np.finfo(float).max, np.finfo(float).max))
    return out


def _packer(groups: int, size: int):
    """Chunks of at most `size` vectors, dealt to groups. Columns: id, vector, bar."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 20
        for batch in batches:
            ids, bars = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 2))
            all_ = _quantised(batch.column(1))
            for i in range(0, len(ids), size):
                own = all_[i : i + size]
                kind = np.int16 if not own.size or np.abs(own).max() < 1 << 15 else np.float64
                g = int(mix64(np.array([number], np.uint64))[0] % np.uint64(groups))
                number += 1
                row = {"g": g, "n": len(own), "dims": own.shape[1], "ids": ids[i : i + size].tobytes(), "cells": np.ascontiguousarray(own.T.astype(kind)).tobytes(), "bars": bars[i : i + size].astype(np.float64).tobytes()}
                yield pa.RecordBatch.from_pylist([row], pa.schema([("g", pa.int32()), ("n", pa.int32()), ("dims", pa.int32()), ("ids", pa.binary()), ("cells", pa.binary()), ("bars", pa.binary())]))

    return pack


def _unpack(row: dict, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and the dims x n matrix of a chunk."""
    n, own = row["n"], row["dims"]
    kind = np.int16 if len(row["cells"]) == 2 * n * own else np.float64
    out = np.zeros((dims, n))
    out[:own] = np.frombuffer(row["cells"], kind).reshape(own, n)
    return np.frombuffer(row["ids"], np.int64), out


class _Best:
    """The k best (score, id) of each query so far."""

    def __init__(self, bars: np.ndarray, k: int):
        self.k, self.least = k, bars.copy()
        self.q, self.score, self.id = np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)

    def add(self, q: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        q, score, ids = np.append(self.q, q), np.append(self.score, score), np.append(self.id, ids)
        order = np.lexsort((ids, -score, q))
        q = q[order]
        rank = np.arange(len(q)) - np.searchsorted(q, q)
        keep = rank < self.k
        self.q, self.score, self.id = q[keep], score[order][keep], ids[order][keep]
        last = rank[keep] == self.k - 1
        self.least[self.q[last]] = np.maximum(self.least[self.q[last]], self.score[last])


def _rest(x: np.ndarray, axis: int) -> np.ndarray:
    """Norms of what follows each block of dimensions."""
    squares = np.square(x)
    dims = x.shape[axis]
    return np.sqrt(np.stack([squares.take(range(min(d, dims), dims), axis).sum(axis) for d in range(DIMS, dims + DIMS, DIMS)]))


def _scan(queries: np.ndarray, q_rest: np.ndarray, x: np.ndarray, x_rest: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs (query, column) that can be among the best, and their scores. queries: n x dims, x: dims x columns."""
    columns, dims = np.arange(x.shape[1]), x.shape[0]
    part = np.zeros((len(queries), len(columns)))
    q = c = acc = None
    for b, d in enumerate(range(0, dims, DIMS)):
        own = slice(d, min(d + DIMS, dims))
        if q is None:
            part += queries[:, own] @ x[own, columns]
            alive = part + q_rest[b][:, None] * x_rest[b][columns] >= least[:, None] - 0.5
            if alive.mean() < FEW:
                q, at = np.nonzero(alive)
                c, acc = columns[at], part[q, at]
            else:
                some = alive.any(axis=0)
                if some.mean() < 0.8:
                    columns, part = columns[some], part[:, some]
        else:
            for one in range(own.start, own.stop):
                acc = acc + queries[q, one] * x[one, c]
            ok = acc + q_rest[b][q] * x_rest[b][c] >= least[q] - 0.5
            q, c, acc = q[ok], c[ok], acc[ok]
    if q is None:
        q, at = np.nonzero(part >= least[:, None] - 0.5)
        c, acc = columns[at], part[q, at]
    return q, c, acc


def _whole(x: np.ndarray) -> np.ndarray:
    """The same numbers as Python integers."""
    return np.array([int(v) for v in x.ravel()], object).reshape(x.shape)


def _large(ids: np.ndarray, queries: np.ndarray, own: np.ndarray, x: np.ndarray, k: int) -> tuple[list[int], list[int], list[int]]:
    """query id, vector id, score of each query's k best, in integers of any size. queries: n x dims, x: dims x columns."""
    who, found, scores = [], [], []
    columns = _whole(x).T
    for one, q in zip(ids.tolist(), _whole(queries), strict=True):
        some = heapq.nsmallest(k, ((-max(-(1 << 63), min((1 << 63) - 1, int(v))), i) for v, i in zip(columns @ q if x.shape[0] else [0] * len(own), own.tolist(), strict=True) if i != one))
        who += [one] * len(some)
        found += [i for _, i in some]
        scores += [-v for v, _ in some]
    return who, found, scores


def search_cell(blocks: list[dict], chunks: list[dict], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """query id, vector id and score of each query's k best in the chunks, and some more where numbers are large."""
    dims = max(r["dims"] for r in (*blocks, *chunks))
    asked = [_unpack(r, dims) for r in blocks]
    ids, queries = np.concatenate([i for i, _ in asked]), np.concatenate([x.T for _, x in asked])
    bars = np.concatenate([np.frombuffer(r["bars"], np.float64) for r in blocks])
    with np.errstate(over="ignore"):
        norms = np.sqrt(np.square(queries).sum(axis=1))
    vast = norms >= 2.0**40
    more: tuple[list[int], list[int], list[int]] = ([], [], [])
    plain, plain_ids, plain_bars = queries[~vast], ids[~vast], bars[~vast]
    limit = _EXACT / max(1.0, norms[~vast].max(initial=1.0))
    best = [_Best(plain_bars[i : i + TOGETHER], k) for i in range(0, len(plain), TOGETHER)]
    q_rest = _rest(plain, 1) if dims else np.zeros((0, len(plain)))
    for row in chunks:
        own, x = _unpack(row, dims)
        with np.errstate(over="ignore"):
            large = np.sqrt(np.square(x).sum(axis=0)) >= limit
        for q, some in ((plain, ~vast), (queries[vast], vast)):
            columns = large if q is plain else np.ones(len(own), bool)
            if len(q) and columns.any():
                for all_, part in zip(more, _large(ids[some], q, own[columns], x[:, columns], k), strict=True):
                    all_ += part
        own, x = own[~large], x[:, ~large]
        x_rest = _rest(x, 0) if dims else np.zeros((0, len(own)))
        for n, top in enumerate(best):
            some = slice(n * TOGETHER, n * TOGETHER + len(top.least))
            # a first part of the chunk sets the bar for the rest
            for part in (slice(0, 4 * k), slice(4 * k, 32 * k), slice(32 * k, None)):
                if len(own[part]):
                    q, c, score = _scan(plain[some], q_rest[:, some], x[:, part], x_rest[:, part], top.least)
                    other = plain_ids[some][q] != own[part][c]
                    top.add(q[other], score[other], own[part][c[other]])
    who = [plain_ids[n * TOGETHER + t.q] for n, t in enumerate(best)]
    return tuple(np.concatenate([*a, np.array(b, np.int64)]).astype(np.int64) for a, b in zip((who, [t.id for t in best], [t.score.astype(np.int64) for t in best]), more, strict=True))


def nearest(vectors: DataFrame, asks: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k vectors with the highest inner product for each row that asks."""
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"), asks.alias("asks")).filter(F.col("id").isNotNull() & F.col("v").isNotNull() & fine)
    queries = rows.filter("asks").groupBy("id").agg(F.max("v").alias("v")).withColumn("bar", F.lit(float("-inf")))
    n, n_asks = rows.agg(F.count("*"), F.count_if("asks")).first()
    groups, blocks = max(1, -(-n // GROUP)), max(1, -(-n_asks // BLOCK))
    run = Run(vectors.sparkSession)
    packed = rows.select("id", "v", F.lit(0.0).alias("bar")).mapInArrow(_packer(groups, GROUP // 4), _PACKED)

    def meet(asked: pa.Table, given: pa.Table) -> pa.Table:
        if asked.num_rows and given.num_rows:
            q, i, s = search_cell(asked.to_pylist(), given.to_pylist(), k)
        else:
            q, i, s = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        return pa.table({"query_id": pa.array(q, pa.int64()), "vec_id": pa.array(i, pa.int64()), "score": pa.array(s, pa.int64())})

    def found(asking: DataFrame, given: DataFrame, first: int, stop: int) -> DataFrame:
        """The best of every cell of some groups."""
        left = asking.repartition(blocks).mapInArrow(_packer(1, BLOCK), _PACKED).withColumn("b", F.pmod(F.xxhash64("ids"), F.lit(blocks))).drop("g").withColumn("g", F.explode(F.sequence(F.lit(first), F.lit(stop - 1))))
        right = given.withColumn("b", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
        return left.groupBy("g", "b").cogroup(right.groupBy("g", "b")).applyInArrow(meet, "query_id long, vec_id long, score long")

    best = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    top = lambda hits: hits.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
    if groups == 1:
        return top(found(queries, packed, 0, 1))
    packed = run.cut(packed)
    early = run.cut(top(found(queries, packed.filter("g = 0"), 0, 1)))
    bars = early.groupBy(F.col("query_id").alias("id")).agg(F.when(F.count("*") == k, F.min("score").cast("double")).otherwise(F.lit(float("-inf"))).alias("bar"))
    later = found(queries.drop("bar").join(bars, "id", "left").fillna(float("-inf"), ["bar"]), packed.filter("g > 0"), 1, groups)
    out = cut(top(early.drop("rank").union(later)))
    run.clear()
    return out
