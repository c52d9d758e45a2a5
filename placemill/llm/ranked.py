"""Ranked lexical search over dual-sorted wavelet trees.

Documents are packed to shards where they are read: each holds the whole texts of about SHARD_BYTES. A shard is one sequence of
documents: the postings of its terms one after the other, each in order of falling impact. A wavelet tree holds the
sequence. Going down one level halves the range of documents and keeps the order, so any term's postings within any range
of documents are a stretch of some level, and the first of the stretch has its greatest impact. Documents are numbered in
order of their ids, so a node is a range of ids.

A query starts at the root with one stretch for each of its terms and goes down best node first: a node's bound is the sum
of the first impacts of its stretches, times the terms' weights; at a leaf it is the document's score. A node is
given up once its bound is below the k-th best score so far, or equals it and the node's least id is not below the k-th's. Many nodes of
many queries go down together. A task carries its k best from one of its shards to the next, so they bar
what follows, and returns k rows per query.

Term statistics are counted over all documents: N and L before the shards are built, the documents of a term from the lengths of
its postings. Queries meet the shards in blocks of about BLOCK_BYTES, a pass over the shards each. An item's
terms have to fit into one block.

Defined cases: a null or empty text has no terms and is in no postings; rows are documents each for itself, also where
they or their ids repeat; a null document id is last in ties; items that share an id (null included) are one item with the
terms of all their texts; a term of weight 0 gives nothing; texts of any length are read whole, and a shard may be one text; empty
tables give no rows; further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from placemill.llm.common import Run, buffers, cut, slices

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
SHARD_BYTES, BLOCK_BYTES = 1 << 23, 1 << 22
#: Queries that go down together; nodes of each that are opened at once; terms that are broadcast, at most.
TOGETHER, AT_ONCE, MAX_BROADCAST = 32, 16, 500_000
#: One over the largest impact, and the id that stands for null.
_TOP, _NULL = 1 << 20, (1 << 63) - 1
_SHARD = pa.schema([("n_docs", pa.int32()), ("docs", pa.binary()), ("terms", pa.list_(pa.string())), ("sizes", pa.list_(pa.int32())), ("impacts", pa.binary()), ("bits", pa.binary())])
_SHARD_DDL = "n_docs int, docs binary, terms array<string>, sizes array<int>, impacts binary, bits binary"
_OF_TERM = np.ones(256, bool)
_OF_TERM[:128] = [chr(c).isalnum() for c in range(128)]
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def terms(text: Column) -> Column:
    """The terms of a text in order, A-Z lower-cased; none for null."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), upper, upper.lower()), F.lit(TERM), F.lit(0))


def _tokens(data: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, pa.DictionaryArray]:
    """Row and term of each token of adjacent texts."""
    own = _OF_TERM[data]
    first = own.copy()
    first[1:] &= ~own[:-1]
    at = np.cumsum(lengths) - lengths
    first[at[lengths > 0]] |= own[at[lengths > 0]]
    starts = np.flatnonzero(first)
    row = np.repeat(np.arange(len(lengths)), lengths)[starts]
    ends = np.append(np.cumsum(own)[starts] - 1, own.sum()).astype(np.int64)
    words = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(ends), pa.py_buffer(_LOWER[data[own]]))
    return row, words.dictionary_encode()


def _impacts(tf: np.ndarray, size: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """What a term adds per unit of its weight, in whole numbers."""
    wide = object if 90 * int(size.max(initial=0)) * n_docs >= 1 << 63 else np.int64
    m = 10 + (90 * n_docs * size.astype(wide)) // max(1, n_terms)
    return ((1_000_000_000 * tf.astype(wide)) // (1000 * tf.astype(wide) + 8 * m)).astype(np.int64)


def build_shard(ids: np.ndarray, data: np.ndarray, lengths: np.ndarray, n_docs: int, n_terms: int) -> dict:
    """Postings of adjacent texts by impact, and the bits of their wavelet tree, level by level."""
    order = np.argsort(ids, kind="stable")
    number = np.empty(len(ids), np.int64)
    number[order] = np.arange(len(ids))
    row, words = _tokens(data, lengths)
    code, doc = words.indices.to_numpy().astype(np.int64), number[row]
    posting, tf = np.unique(code * len(ids) + doc, return_counts=True)
    code, doc = np.divmod(posting, max(1, len(ids)))
    impact = _impacts(tf, np.bincount(number[row], minlength=len(ids))[doc], n_docs, n_terms)
    by_impact = np.argsort(code * _TOP + (_TOP - 1 - impact), kind="stable")
    seq, bits = doc[by_impact], []
    for level in reversed(range(max(0, len(ids) - 1).bit_length())):
        bit = (seq >> level & 1).astype(bool)
        bits.append(np.packbits(bit).tobytes())
        seq = np.concatenate([seq[~bit], seq[bit]])
    sizes = np.bincount(code, minlength=len(words.dictionary)).astype(np.int32)
    return {"n_docs": len(ids), "docs": ids[order].tobytes(), "terms": words.dictionary.cast(pa.string()), "sizes": sizes, "impacts": impact[by_impact].astype(np.int32).tobytes(), "bits": b"".join(bits)}


def _indexer(n_docs: int, n_terms: int, size: int):
    """Shards of about `size` bytes of whole texts, from the batches of a partition. Columns: id, text."""

    def shard(ids: pa.Array, texts: pa.Array) -> Iterator[pa.RecordBatch]:
        numbers = pc.fill_null(ids, _NULL).to_numpy()
        for first, last, data, lengths in slices(texts, size):
            row = build_shard(numbers[first:last], data, lengths, n_docs, n_terms)
            yield pa.RecordBatch.from_arrays([pa.array([row["n_docs"]], pa.int32()), pa.array([row["docs"]]), pa.array([row["terms"]], pa.list_(pa.string())), pa.array([row["sizes"]], pa.list_(pa.int32())), pa.array([row["impacts"]]), pa.array([row["bits"]])], schema=_SHARD)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        bytes_ = 0
        for batch in batches:
            held.append(batch)
            bytes_ += int(np.diff(buffers(batch.column(1))[1][[0, -1]])[0])
            if bytes_ >= size:
                yield from shard(*(pa.concat_arrays([b.column(i) for b in held]) for i in (0, 1)))
                held, bytes_ = [], 0
        if held:
            yield from shard(*(pa.concat_arrays([b.column(i) for b in held]) for i in (0, 1)))

    return build


class Shard:
    """A shard ready to be searched: ranks of ones and impacts on every level."""

    def __init__(self, row: dict):
        self.ids = np.frombuffer(row["docs"], np.int64)
        impacts = np.frombuffer(row["impacts"], np.int32)
        self.n, self.depth = len(impacts), max(0, row["n_docs"] - 1).bit_length()
        packed = np.frombuffer(row["bits"], np.uint8).reshape(self.depth, -(-self.n // 8))
        #: Flat, so that one gather serves nodes of many levels.
        self.ones = np.zeros((self.depth, self.n + 1), np.int32)
        self.impacts = np.empty((self.depth + 1, self.n), np.int32)
        self.zeros = np.zeros(self.depth, np.int64)
        for level in range(self.depth):
            bit = np.unpackbits(packed[level], count=self.n).astype(bool)
            np.cumsum(bit, out=self.ones[level, 1:])
            self.zeros[level] = self.n - self.ones[level, -1]
            self.impacts[level] = impacts
            impacts = np.concatenate([impacts[~bit], impacts[bit]])
        self.impacts[self.depth] = impacts
        self.ones, self.impacts = self.ones.ravel(), self.impacts.ravel()

    def down(self, level: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, ...]:
        """The stretches of both halves: lo and hi of the lower, lo and hi of the upper."""
        base = level * (self.n + 1)
        one_lo, one_hi = self.ones[base + lo].astype(np.int64), self.ones[base + hi].astype(np.int64)
        return lo - one_lo, hi - one_hi, self.zeros[level] + one_lo, self.zeros[level] + one_hi


class Best:
    """The k best (score, id) of each query so far, the k-th score and its id."""

    def __init__(self, n: int, k: int):
        self.k, self.bar, self.last = k, np.ones(n, np.int64), np.full(n, _NULL)
        self.q, self.score, self.id = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, q: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        q, score, ids = np.append(self.q, q), np.append(self.score, score), np.append(self.id, ids)
        order = np.lexsort((ids, -score, q))
        q = q[order]
        rank = np.arange(len(q)) - np.searchsorted(q, q)
        keep = rank < self.k
        self.q, self.score, self.id = q[keep], score[order][keep], ids[order][keep]
        last = rank[keep] == self.k - 1
        self.bar[self.q[last]], self.last[self.q[last]] = self.score[last], self.id[last]

    def open(self, q: np.ndarray, bound: np.ndarray, least: np.ndarray) -> np.ndarray:
        """Whether something of that bound and least id can still be among the best."""
        bar = self.bar[q]
        return (bound > bar) | ((bound == bar) & (least < self.last[q]))


def search_shard(shard: Shard, q: np.ndarray, weight: np.ndarray, lo: np.ndarray, hi: np.ndarray, best: Best) -> int:
    """Best nodes first for queries given by stretches of the root, sorted by query. Returns the number of opened nodes."""
    if not len(q):
        return 0

    def bounds(first: np.ndarray, level: np.ndarray, w: np.ndarray, at: np.ndarray) -> np.ndarray:
        return np.add.reduceat(w * shard.impacts[level * shard.n + at], first)

    first = np.flatnonzero(np.append(True, q[1:] != q[:-1]))
    nodes = {"q": q[first], "level": np.zeros(len(first), np.int64), "prefix": np.zeros(len(first), np.int64), "at": first, "n": np.diff(np.append(first, len(q)))}
    nodes["bound"] = bounds(first, np.zeros(len(q), np.int64), weight, lo)
    if not shard.depth:
        best.add(nodes["q"], nodes["bound"], np.repeat(shard.ids[:1], len(first)))
        return 0
    pool, used, opened = [weight.copy(), lo.astype(np.int64), hi.astype(np.int64)], len(q), 0
    while True:
        least = shard.ids[nodes["prefix"] << (shard.depth - nodes["level"])]
        keep = best.open(nodes["q"], nodes["bound"], least)
        order = np.flatnonzero(keep)
        order = order[np.lexsort((-nodes["bound"][order], nodes["q"][order]))]
        if not len(order):
            return opened
        own = nodes["q"][order]
        now = np.arange(len(own)) - np.searchsorted(own, own) < AT_ONCE
        front, nodes = {k: v[order[now]] for k, v in nodes.items()}, {k: v[order[~now]] for k, v in nodes.items()}
        opened += len(front["q"])
        # the stretches of all nodes that are opened
        total = np.cumsum(front["n"])
        item = np.arange(total[-1]) + np.repeat(front["at"] - total + front["n"], front["n"])
        node = np.repeat(np.arange(len(front["n"])), front["n"])
        w, level = pool[0][item], front["level"][node]
        halves = shard.down(level, pool[1][item], pool[2][item])
        children = []
        for upper in (0, 1):
            a, b = halves[2 * upper], halves[2 * upper + 1]
            some = np.flatnonzero(a < b)
            if not len(some):
                continue
            of = node[some]
            start = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
            parent = of[start]
            child = {"q": front["q"][parent], "level": front["level"][parent] + 1, "prefix": 2 * front["prefix"][parent] + upper, "n": np.diff(np.append(start, len(some)))}
            child["bound"] = bounds(start, level[some] + 1, w[some], a[some])
            children.append((child, (w[some], a[some], b[some])))
        for child, _ in children:
            leaf = child["level"] == shard.depth
            if leaf.any():
                best.add(child["q"][leaf], child["bound"][leaf], shard.ids[child["prefix"][leaf]])
        for child, stretches in children:
            ok = (child["level"] < shard.depth) & best.open(child["q"], child["bound"], shard.ids[child["prefix"] << (shard.depth - child["level"])])
            kept = np.repeat(ok, child["n"])
            child = {k: v[ok] for k, v in child.items()}
            more = int(kept.sum())
            if used + more > len(pool[0]):
                pool = [np.concatenate([p[:used], np.empty(used + more, np.int64)]) for p in pool]
            for p, s in zip(pool, stretches, strict=True):
                p[used : used + more] = s[kept]
            child["at"] = used + np.cumsum(child["n"]) - child["n"]
            used += more
            nodes = {k: np.append(v, child[k]) for k, v in nodes.items()}


def _searcher(block, k: int):
    """The k best of each query of a block (sorted q; term; w) over the shards of a task."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked: pa.Table = block.value
        q, weight = asked["q"].to_numpy().astype(np.int64), asked["w"].to_numpy().astype(np.int64)
        wanted = asked["term"].combine_chunks()
        n = int(q.max(initial=-1)) + 1
        best = Best(n, k)
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i].as_py() for c in ("n_docs", "docs", "impacts", "bits")}
                sizes = batch.column("sizes")[i].values.to_numpy().astype(np.int64)
                place = pc.index_in(wanted, value_set=batch.column("terms")[i].values.cast(wanted.type))
                there = np.flatnonzero(place.is_valid().to_numpy(zero_copy_only=False))
                if not len(there):
                    continue
                shard, code = Shard(row), place.take(pa.array(there)).to_numpy().astype(np.int64)
                ends = np.cumsum(sizes)
                own, lo, hi = q[there], (ends - sizes)[code], ends[code]
                for first in range(0, n, TOGETHER):
                    some = slice(*np.searchsorted(own, [first, first + TOGETHER]))
                    search_shard(shard, own[some], weight[there][some], lo[some], hi[some], best)
        yield pa.RecordBatch.from_arrays([pa.array(best.q, pa.int64()), pa.array(best.id, pa.int64()), pa.array(best.score, pa.int64())], ["q", "doc_id", "score"])

    return search


class Index:
    """Shards, with the numbers of documents that have terms and of all their terms."""

    def __init__(self, shards: DataFrame, n_docs: int, n_terms: int):
        self.shards, self.n_docs, self.n_terms = shards, n_docs, n_terms

    @staticmethod
    def of(docs: DataFrame, run: Run, id_col: str = "doc_id", text_col: str = "text", size: int = SHARD_BYTES) -> Index:
        """Index all rows; the shards are written to the folder of the run."""
        n = F.regexp_count(F.coalesce(F.col(text_col), F.lit("")), F.lit(TERM))
        n_docs, n_terms = docs.select(n.alias("n")).agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
        shards = docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(_indexer(n_docs, n_terms, size), _SHARD_DDL)
        return Index(run.cut(shards), n_docs, n_terms)

    def weights(self, wanted: DataFrame) -> DataFrame:
        """term, w of those of the given terms (distinct) that some document holds."""
        small = wanted.limit(MAX_BROADCAST + 1).count() <= MAX_BROADCAST
        held = self.shards.select(F.explode(F.arrays_zip("terms", "sizes")).alias("t")).select("t.terms", "t.sizes").withColumnRenamed("terms", "term")
        df = held.join(F.broadcast(wanted) if small else wanted, "term").groupBy("term").agg(F.sum("sizes").alias("df"))
        return df.select("term", F.floor(1000 * F.log((2 * F.lit(self.n_docs) + 2) / (2 * F.col("df") + 1))).alias("w")).filter("w > 0")


def rank(docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """item_id, rank (from 1), doc_id, score: the k best documents of each item."""
    run = Run(docs.sparkSession)
    index = Index.of(docs, run, id_col, text_col)
    asked = run.cut(items.select(F.col(item_col).alias("item_id"), F.explode(terms(F.col(item_text_col))).alias("term")).distinct())
    weights = run.cut(index.weights(asked.select("term").distinct()))
    asked = asked.join(weights, "term")
    bytes_ = asked.agg(F.coalesce(F.sum(F.octet_length("term") + 24), F.lit(0))).first()[0]
    blocks = max(1, -(-bytes_ // BLOCK_BYTES))
    asked = run.cut(asked.withColumn("block", F.pmod(F.xxhash64("item_id"), F.lit(blocks))))
    found = []
    for b in range(blocks):
        part = asked.filter(F.col("block") == b).toArrow()
        names = part["item_id"].combine_chunks().dictionary_encode(null_encoding="encode")
        part = pa.table({"q": names.indices.cast(pa.int64()), "term": part["term"].combine_chunks(), "w": part["w"]}).sort_by("q")
        named = docs.sparkSession.createDataFrame(pa.table({"q": pa.array(range(len(names.dictionary)), pa.int64()), "item_id": names.dictionary}))
        hits = index.shards.mapInArrow(_searcher(docs.sparkSession.sparkContext.broadcast(part), k), "q long, doc_id long, score long")
        # as many rows as a block has items, which its size bounds
        found.append(hits.join(F.broadcast(named), "q").drop("q"))
    best = W.partitionBy("item_id").orderBy(F.desc("score"), "doc_id")
    top = reduce(DataFrame.union, found).withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    out = cut(top.select("item_id", "rank", F.when(F.col("doc_id") != _NULL, F.col("doc_id")).alias("doc_id"), "score"))
    run.clear()
    return out
