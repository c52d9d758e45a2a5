"""Near-duplicate detection by DartMinHash.

A text is the weighted set of its five-word shingles; a shingle's weight is how often the text says it. The weight axis of
an element is cut into strips of width one, the last one as wide as is left; darts fall on a strip with unit density along
the rank axis, at places that the hash of element and strip decides, the same in all texts, and those beyond the weight are
dropped, so weights may be any positive numbers. Of a text with total weight W the darts with a rank below T / W are thrown,
about T in all; each names a coordinate of the signature, and the earliest dart of a coordinate stays. T grows until no
coordinate is empty. Two signatures agree in a coordinate with the probability of the weighted Jaccard similarity. The cost
is the strips plus about K log K darts, not their product.

A text that repeats shingles has a second signature, of its plain set of shingles, so that texts that differ only in how
often they say something are found too; without repeats both are the same.

Equal texts (by 128-bit digest) are one node from the start; one text of each goes on. Signatures are banded, both alike:
nodes that share a band's bucket are candidates. Within a bucket no pairs are listed at first: every node is compared with a
pivot, a random member of the bucket. Pairs whose signatures (either kind) agree in less than the share AGREE are dropped: of pairs of
similarity 0.8 that is one in 300,000 (binomial, 64 coordinates), beside the 1 in 5,000 that share no band. All others are
verified on the whole sets, and count as linked if their weighted or plain Jaccard similarity is at least 0.8. Classes are
the connected components of all links, found by hooking to the least label and pointer jumping, in tables.

Buckets that still hold several classes after that are finished without loss. In those of at most SMALL members every
pair of different classes is a candidate. The members of larger ones go through an exact prefix-filter join on their
element sets, plain and weighted: elements are ordered from rare to frequent, and of two similar sets the first shared
element stands early in both. Any one order will do, so frequencies are those of hashed slots, a table of fixed size that is
broadcast; elements in a slot of one class alone come first and meet nobody. A text so hands out its prefix only. Sizes are
put into classes of a ratio of SIZE_STEP, so that a prefix is only as long as partners of that size allow, and a text goes
only to size classes that hold its element for another class. Only members of different classes meet, and parity bits of
both sets rule out, without loss, most pairs that differ in too many elements. A pair that shares several prefix elements is
made at the first, as a rule: each element carries the few before it. All others are verified.

A hot bucket costs as many rows as it has members; the joins on buckets and pivots have one row per key on
the other side, and what is grouped by bucket is written first, so Spark can split or pre-aggregate a hot key.

Defined cases: null counts as empty; empty texts are copies of each other; a text of one to four words is one shingle; rows
are told apart by place, so rows that repeat an id are nodes by their own texts; class_id is the least id of the class, null
if it has none; of each class one row is kept, one with the least id; a text of any length is read whole.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from placemill.llm.common import Run, cut, mix64, slices, uniform
from placemill.llm.shingles import copies, shingle_hashes, word_hashes, word_spans

WORDS = 5
SIMILARITY = 0.8
K, ROWS = 64, 4
#: Pairs whose signatures agree in a smaller share are taken for dissimilar: five standard deviations below SIMILARITY.
AGREE = 0.55
MAX_BROADCAST = 2_000_000
#: Members of a bucket up to which all its pairs are listed.
SMALL = 32
SIZE_STEP = 1.03
#: A bucket's pivot is the least member by one of so many orders; buckets of one family that share an order share the
#: pivot, so that a text meets it once, not once in each band.
ORDERS = 8
#: Elements are counted in so many slots (as a power of two) per kind of set, to put rare ones first.
SLOT_BITS = 21
#: Parity bits of a set, in words of 64.
WORDS_OF_BITS = 4
BITS = [f"bits_{i}" for i in range(WORDS_OF_BITS)]
#: A prefix element carries so many elements that stand before it.
BEFORE = 8
COPY = np.uint64(0xA24BAED4963EE407)


def strips(shingles: np.ndarray, own: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weighted elements as strips: the hash of element and strip, its text, and how wide it is (1, but for an element's last)."""
    n = np.ceil(weights).astype(np.int64)
    at = np.repeat(np.arange(len(shingles)), n)
    number = np.arange(len(at)) - (np.cumsum(n) - n)[at]
    hashes = np.where(number > 0, mix64(shingles[at] + number.astype(np.uint64) * COPY), shingles[at])
    return hashes, own[at], np.minimum(weights[at] - number, 1.0)


def dart_signatures(elements: np.ndarray, own: np.ndarray, n_texts: int, k: int = K, width: np.ndarray | None = None) -> np.ndarray:
    """n_texts x k hashes of the earliest darts; a text without elements has zeros. width: of each strip, 1 if not given."""
    out = np.zeros((n_texts, k), np.uint64)
    weight = np.bincount(own, width, minlength=n_texts)
    open_, darts = weight > 0, k * np.log(k) + 2 * k
    while open_.any():
        mine = open_[own]
        e, o = elements[mine], own[mine]
        wide = None if width is None else width[mine]
        limit, rank, number = darts / weight[o], np.zeros(len(e)), 0
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        while len(e):
            dart = mix64(e + np.uint64(number * 0x8CB92BA72F3D8DD7 % (1 << 64)))
            rank = rank - np.log(uniform(dart))
            keep = rank < limit
            e, o, limit, rank, dart, number = e[keep], o[keep], limit[keep], rank[keep], dart[keep], number + 1
            cell = o * k + (dart >> np.uint64(40)).astype(np.int64) % k
            if wide is None:
                found.append((cell, rank, dart))
            else:
                wide = wide[keep]
                hit = uniform(dart ^ COPY) < wide
                found.append((cell[hit], rank[hit], dart[hit]))
        cell, rank, dart = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.lexsort((rank, cell))
        cell, first = np.unique(cell[order], return_index=True)
        out.reshape(-1)[cell] = dart[order][first]
        full = np.bincount(cell // k, minlength=n_texts) == k
        open_ &= ~full
        darts *= 2
    return out


def _bands(full: np.ndarray) -> np.ndarray:
    h = np.zeros((len(full), K // ROWS), np.uint64)
    for r in range(ROWS):
        h = mix64(h * np.uint64(3) + full[:, r::ROWS])
    return mix64(h + np.arange(K // ROWS, dtype=np.uint64)).view(np.int64)


def signatures():
    """An Arrow UDF: for each text its signature (32 bits a coordinate), that of its plain set if that differs, and their bands' hashes."""

    @F.arrow_udf("struct<sig: binary, plain: binary, bands: array<bigint>>")
    def sign(texts: pa.Array) -> pa.Array:
        sigs, plains, bands = [], [], []
        for _, _, data, lengths in slices(texts):
            starts, ends, text = word_spans(data, lengths)
            s, own = shingle_hashes(word_hashes(data, starts, ends), text, len(lengths), WORDS)
            elements = copies(s, own)
            some = np.bincount(own, minlength=len(lengths)) > 0
            first = elements == s
            repeats = np.bincount(own[~first], minlength=len(lengths)) > 0
            full = dart_signatures(elements, own, len(lengths))
            # the plain set of the texts that repeat a shingle, numbered anew
            mine, number = first & repeats[own], np.cumsum(repeats) - 1
            plain = dart_signatures(s[mine], number[own[mine]], int(repeats.sum()))
            h, h_plain = _bands(full), _bands(plain)
            short, short_plain = ((x >> np.uint64(32)).astype(np.uint32) for x in (full, plain))
            sigs += [x.tobytes() if ok else None for x, ok in zip(short, some, strict=True)]
            plains += [short_plain[k].tobytes() if more else None for k, more in zip(number, repeats, strict=True)]
            bands += [(np.union1d(x, h_plain[k]) if more else x) if ok else None for x, k, more, ok in zip(h, number, repeats, some, strict=True)]
        return pa.StructArray.from_arrays([pa.array(sigs, pa.binary()), pa.array(plains, pa.binary()), pa.array(bands, pa.list_(pa.int64()))], names=["sig", "plain", "bands"])

    return sign


@F.arrow_udf(T.DoubleType())
def agreement(a: pa.Array, b: pa.Array, plain_a: pa.Array, plain_b: pa.Array) -> pa.Array:
    """The larger share of equal coordinates, of the signatures and of those of the plain sets."""
    if not len(a):
        return pa.array(np.zeros(0))
    x, y, p, q = (np.frombuffer(b"".join(v.to_pylist()), np.uint32).reshape(len(v), -1) for v in (a, b, plain_a, plain_b))
    return pa.array(np.maximum((x == y).mean(axis=1), (p == q).mean(axis=1)))


@F.arrow_udf(T.BinaryType())
def element_sets(texts: pa.Array) -> pa.Array:
    """Sorted plain shingles and sorted elements of each text, 64 bits each; the number of plain ones comes first."""
    out = []
    for _, _, data, lengths in slices(texts):
        starts, ends, text = word_spans(data, lengths)
        s, own = shingle_hashes(word_hashes(data, starts, ends), text, len(lengths), WORDS)
        e = copies(s, own)
        counts = np.bincount(own, minlength=len(lengths))
        at = np.cumsum(counts) - counts
        for i, n in zip(at, counts, strict=True):
            plain = np.unique(s[i : i + n])
            more = np.setdiff1d(e[i : i + n], plain, assume_unique=True)  # an element that is no plain shingle is a further copy
            out.append(np.concatenate([np.array([len(plain)], np.uint64), plain, more]).tobytes())
    return pa.array(out, pa.binary())


@F.arrow_udf(T.DoubleType())
def similarity(a: pa.Array, b: pa.Array) -> pa.Array:
    """The larger of plain and weighted Jaccard similarity of what element_sets gives."""
    out = []
    for x, y in zip(a.to_pylist(), b.to_pylist(), strict=True):
        p, q = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
        n, m = int(p[0]), int(q[0])
        plain = len(np.intersect1d(p[1 : n + 1], q[1 : m + 1], assume_unique=True))
        more = len(np.intersect1d(p[n + 1 :], q[m + 1 :], assume_unique=True))
        best = plain / max(1, n + m - plain)
        out.append(max(best, (plain + more) / max(1, len(p) + len(q) - 2 - plain - more)))
    return pa.array(out, pa.float64())


def _small(df: DataFrame, most: int) -> DataFrame:
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def components(links: DataFrame, a: str = "a", b: str = "b", cut=cut) -> DataFrame:
    """node, label (the least node of its component) for every node of the links."""
    both = cut(links.select(F.col(a).alias("x"), F.col(b).alias("y")).union(links.select(b, a)))
    labels = cut(both.groupBy(F.col("x").alias("node")).agg(F.least("node", F.min("y")).alias("label")))
    while True:
        near = both.join(labels.withColumnRenamed("node", "y"), "y").groupBy(F.col("x").alias("node")).agg(F.min("label").alias("best"))
        # a node's best neighbour is also offered to the node that its label points at
        offers = labels.join(near, "node").select("node", "label", F.least("label", "best").alias("best"))
        every = offers.select("node", "best", F.col("label").alias("old")).union(offers.select("label", "best", F.lit(None).cast("long")))
        hooked = every.groupBy("node").agg(F.min("best").alias("label"), F.max("old").alias("old"))
        jump = hooked.select(F.col("node").alias("label"), F.col("label").alias("next"))
        new = cut(hooked.join(jump, "label", "left").select("node", F.coalesce("next", "label").alias("label"), "old"))
        labels = new.select("node", "label")
        if not new.filter("label <> old").limit(1).count():
            return labels


def _pairs(members: DataFrame, pivots: DataFrame) -> DataFrame:
    """Members of a bucket with its pivot, if their classes differ, each pair once."""
    both = members.join(pivots, "band").filter((F.col("doc") != F.col("pivot")) & (F.col("label") != F.col("pivot_label")))
    return both.select(F.least("doc", "pivot").alias("a"), F.greatest("doc", "pivot").alias("b")).distinct()


def _kinds(raw: bytes) -> list[np.ndarray]:
    """The plain set of what element_sets gives, and the weighted one if it is another.

    Where one of two texts repeats nothing, their plain similarity is no less than the weighted one, so texts without repeats
    needn't be met by weight.
    """
    x = np.frombuffer(raw, np.uint64)
    n = int(x[0])
    return [x[1 : n + 1], x[1:]] if n + 1 < len(x) else [x[1:]]


def _slots(e: np.ndarray, weighted: int) -> np.ndarray:
    return (e >> np.uint64(64 - SLOT_BITS)).astype(np.int64) + (weighted << SLOT_BITS)


def _count_slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """slot, n, low, high: elements of a slot, and the least and largest label among them. Columns: doc, label, elements."""
    for batch in batches:
        each = [(_slots(e, k), label) for label, raw in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True) for k, e in enumerate(_kinds(raw))]
        slots = np.concatenate([s for s, _ in each])
        labels = np.repeat(np.array([x for _, x in each], np.int64), [len(s) for s, _ in each])
        order = np.lexsort((labels, slots))
        slots, labels = slots[order], labels[order]
        own, first, n = np.unique(slots, return_index=True, return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(v) for v in (own, n.astype(np.int64), labels[first], labels[first + n - 1])], names=["slot", "n", "low", "high"])


def _prefixes(frequencies: Broadcast, least: float):
    """doc, label, weighted, n (size of the set), e, left, before, bits: a row for each prefix element of both sets of a text.

    bits: of each remainder of elements, whether an odd number of them has it. Two sets differ in at least as many elements as
    in bits. before: the last few prefix elements that stand before this one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = frequencies.value
        for batch in batches:
            out = [[np.zeros(0, t)] for t in (np.int64, np.int64, bool, np.int32, np.int64, np.int32, *[np.int64] * WORDS_OF_BITS)]
            for doc, label, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for k, e in enumerate(_kinds(raw)):
                    often = f[_slots(e, k)]
                    order = np.lexsort((e, often))
                    # left: elements from this one on, so the most that can be shared if it is the first shared one
                    left = len(e) - np.arange(len(e))
                    keep = (left >= math.ceil(least * len(e) - 1e-9)) & (often[order] > 0)
                    m, n_bits = int(keep.sum()), 64 * WORDS_OF_BITS
                    bits = np.packbits(np.bincount((e % np.uint64(n_bits)).astype(np.int64), minlength=n_bits) & 1).view(np.int64)
                    for column, v in zip(out, (np.full(m, doc), np.full(m, label), np.full(m, bool(k)), np.full(m, len(e), np.int32), e[order][keep].view(np.int64), left[keep].astype(np.int32), *(np.full(m, x) for x in bits)), strict=True):
                        column.append(v)
            columns = [pa.array(np.concatenate(v)) for v in out]
            stops = np.cumsum([len(v) for v in out[0]])
            e, here = np.concatenate(out[4]), np.arange(stops[-1])
            starts = np.maximum(here - BEFORE, np.repeat(stops - [len(v) for v in out[0]], [len(v) for v in out[0]]))
            ends = np.cumsum(here - starts)
            at = np.repeat(starts - ends + (here - starts), here - starts) + np.arange(ends[-1] if len(ends) else 0)
            before = pa.ListArray.from_arrays(pa.array(np.append(0, ends).astype(np.int32)), pa.array(e[at]))
            yield pa.RecordBatch.from_arrays([*columns, before], names=["doc", "label", "weighted", "n", "e", "left", *BITS, "before"])

    return run


def _prefix_pairs(texts: DataFrame, least: float, cut=cut) -> DataFrame:
    """a, b: pairs of different labels, with all of those that have a similarity of at least `least`. texts: doc, label, elements."""
    share = least / (1 + least)

    def need(n: Column | str, m: Column | str) -> Column:
        """How many elements two sets of these sizes must share."""
        return F.ceil(share * ((F.col(n) if isinstance(n, str) else n) + (F.col(m) if isinstance(m, str) else m)) - 1e-9)

    def size_class(n: Column) -> Column:
        return F.floor(F.log(n) / math.log(SIZE_STEP)).cast("int")

    # written spread evenly, for both readings: the members of a hot family are few rows, but much work each
    texts = cut(texts.select("doc", "label", "elements").repartition("doc"))
    counts = texts.mapInArrow(_count_slots, "slot long, n long, low long, high long").groupBy("slot").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"))
    common = counts.filter("low <> high").select("slot", F.least("n", F.lit((1 << 31) - 1)).cast("int").alias("n")).toArrow()  # at most 2 << SLOT_BITS rows
    table = np.zeros(2 << SLOT_BITS, np.int32)
    table[common.column("slot").to_numpy()] = common.column("n").to_numpy()
    frequencies = texts.sparkSession.sparkContext.broadcast(table)
    posts = cut(texts.mapInArrow(_prefixes(frequencies, least), "doc long, label long, weighted boolean, n int, e long, left int" + "".join(f", {b} long" for b in BITS) + ", before array<long>"))
    # a prefix element that one class alone has in its prefixes meets nobody
    met_by = posts.groupBy("weighted", "e").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low <> high").select("weighted", "e")
    posts = cut(posts.join(met_by, ["weighted", "e"], "left_semi"))
    key = ["weighted", "e", "c"]
    index = posts.filter(F.col("left") >= need("n", "n")).withColumn("c", size_class(F.col("n")))
    index = index.select(*key, F.col("doc").alias("doc2"), F.col("label").alias("label2"), F.col("n").alias("n2"), F.col("left").alias("left2"), F.col("before").alias("before2"), *[F.col(b).alias(f"{b}_2") for b in BITS])
    # a probe goes only to size classes in which another class of texts has the element: one row per element and size class here
    sizes = index.groupBy(*key).agg(F.min("label2").alias("low"), F.max("label2").alias("high"), F.min("n2").alias("n_min"), F.max("left2").alias("left_max"))
    sizes = cut(sizes.groupBy("weighted", "e").agg(F.collect_list(F.struct("c", "low", "high", "n_min", "left_max")).alias("sizes")))

    def reachable(s: Column) -> Column:
        """Whether a size class may hold a partner that is no larger."""
        other = (s["low"] != F.col("label")) | (s["high"] != F.col("label"))
        low = F.greatest(s["n_min"], F.ceil(least * F.col("n") - 1e-9))
        return other & (s["c"] >= size_class(F.ceil(least * F.col("n") - 1e-9))) & (s["n_min"] <= F.col("n")) & (F.least(F.col("left"), s["left_max"]) >= need(low, "n"))

    probe = posts.join(sizes, ["weighted", "e"]).withColumn("c", F.explode(F.transform(F.filter("sizes", reachable), lambda s: s["c"]))).drop("sizes")
    differ = sum((F.bit_count(F.col(b).bitwiseXOR(F.col(f"{b}_2"))) for b in BITS), F.lit(0))
    # a pair that also meets at an earlier element is left to that one; its first shared element has none before it
    again = F.arrays_overlap("before", "before2")
    both = probe.join(index, key).filter((F.col("label") != F.col("label2")) & (F.col("n2") <= F.col("n")) & (F.least("left", "left2") >= need("n", "n2")) & (differ <= F.col("n") + F.col("n2") - 2 * need("n", "n2")) & ~again)
    return both.select(F.least("doc", "doc2").alias("a"), F.greatest("doc", "doc2").alias("b")).distinct()


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = SIMILARITY, most: int = MAX_BROADCAST) -> DataFrame:
    """row (a number of its own), doc (its id), digest (of its text), class_id and kept, for each row of docs. Ids are whole numbers."""
    run = Run(docs.sparkSession)
    cut = run.cut
    texts = docs.select(F.col(id_col).cast("long").alias("doc"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    digest = F.unhex(F.md5("text"))
    signed = cut(texts.select(F.monotonically_increasing_id().alias("row"), "doc", digest.alias("digest"), signatures()("text").alias("s")).select("row", "doc", "digest", "s.sig", "s.plain", "s.bands"))
    # written, so that it is aggregated before its shuffle, and the join with a hot digest can be split
    firsts = cut(signed.groupBy("digest").agg(F.min("row").alias("node"), F.min("doc").alias("low")))
    own = signed.select("row", "sig", "plain", "bands").filter("sig is not null").join(firsts.select(F.col("node").alias("row")), "row", "left_semi").withColumnRenamed("row", "doc")
    banded = own.select("doc", F.explode("bands").alias("band"))
    shared = banded.groupBy("band").agg(F.count("*").alias("n")).filter("n > 1").select("band")
    members = cut(banded.join(shared, "band", "left_semi"))
    suspects = cut(members.select("doc").distinct())
    few = _small(suspects, most)
    sigs = cut(own.join(few, "doc", "left_semi").select("doc", "sig", F.coalesce("plain", "sig").alias("plain")))
    wanted = cut(firsts.join(few, firsts["node"] == few["doc"], "left_semi").select(F.col("digest").alias("d"), "node", "low"))
    # of equal texts the one with the least id; what repeats that id too is dropped
    one = texts.select(F.col("doc").alias("id"), digest.alias("digest"), "text").join(_small(wanted, most), (F.col("digest") == F.col("d")) & F.col("id").eqNullSafe(F.col("low")))
    sets = cut(one.select("node", "text").dropDuplicates(["node"]).select(F.col("node").alias("doc"), element_sets("text").alias("elements")))

    def linked(pairs: DataFrame) -> DataFrame:
        """The pairs that are similar."""
        left, right = (sigs.select(F.col("doc").alias(x), F.col("sig").alias(f"sig_{x}"), F.col("plain").alias(f"plain_{x}")) for x in "ab")
        return similar(cut(pairs.join(left, "a").join(right, "b").filter(agreement("sig_a", "sig_b", "plain_a", "plain_b") >= AGREE).select("a", "b")))

    def similar(near: DataFrame) -> DataFrame:
        left, right = sets.select(F.col("doc").alias("a"), F.col("elements").alias("set_a")), sets.select(F.col("doc").alias("b"), F.col("elements").alias("set_b"))
        return cut(near.join(left, "a").join(right, "b").filter(similarity("set_a", "set_b") >= least).select("a", "b"))

    def joined(fresh: DataFrame, labels: DataFrame) -> DataFrame:
        """The labels after the classes that the links touch are one."""
        if not fresh.limit(1).count():
            return labels
        merged = components(fresh.join(labels.select(F.col("doc").alias("a"), F.col("label").alias("x")), "a").join(labels.select(F.col("doc").alias("b"), F.col("label").alias("y")), "b").select("x", "y").distinct(), "x", "y", cut)
        return cut(labels.join(merged.select(F.col("node").alias("label"), F.col("label").alias("lower")), "label", "left").select("doc", F.coalesce("lower", "label").alias("label")))

    # xor with a hash orders the members of a bucket at random, and can be undone
    order = F.expr(f"doc ^ xxhash64(pmod(band, {ORDERS}))")
    labels = suspects.select("doc", F.col("doc").alias("label"))
    best = members.groupBy("band").agg(F.min(order).alias("o")).select("band", F.expr(f"o ^ xxhash64(pmod(band, {ORDERS}))").alias("pivot"))
    # written first: the pivots are then aggregated before the shuffle, and the join on the bucket stands alone, so that Spark can split a hot one
    links = linked(_pairs(members.withColumn("label", F.col("doc")), cut(best.withColumn("pivot_label", F.col("pivot")))))
    labels = joined(links, labels)

    def mixed(now: DataFrame) -> DataFrame:
        """band, n: buckets of several classes."""
        return cut(now.groupBy("band").agg(F.count("*").alias("n"), F.min("label").alias("low"), F.max("label").alias("high")).filter("n > 2 and low <> high").select("band", "n"))

    now = cut(members.join(labels, "doc"))
    now = cut(now.join(mixed(now), "band"))
    if now.limit(1).count():
        few_each = now.filter(F.col("n") <= SMALL)
        fresh = linked(_pairs(few_each.select("band", "doc", "label"), few_each.select("band", F.col("doc").alias("pivot"), F.col("label").alias("pivot_label"))))
        many = cut(now.filter(F.col("n") > SMALL).select("doc", "label").distinct())
        if many.limit(1).count():
            fresh = fresh.union(similar(cut(_prefix_pairs(many.join(sets, "doc"), least, cut))))
        labels = joined(fresh, labels)
    named = cut(firsts.join(labels.withColumnRenamed("doc", "node"), "node", "left").select("digest", "low", F.coalesce("label", "node").alias("label")))
    ids = cut(named.groupBy("label").agg(F.min("low").alias("class_id")))
    known = cut(signed.select("row", "doc", "digest").join(named.select("digest", "label").join(ids, "label"), "digest"))
    keepers = cut(known.filter(F.col("doc").eqNullSafe(F.col("class_id"))).groupBy("label").agg(F.min("row").alias("row")))
    keepers = keepers.select("row", F.lit(True).alias("kept"))
    last = Run(docs.sparkSession).cut(known.join(keepers, "row", "left").select("row", "doc", "digest", "class_id", F.coalesce("kept", F.lit(False)).alias("kept")))
    run.clear()
    return last


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = SIMILARITY, most: int = MAX_BROADCAST) -> DataFrame:
    """doc_id, class_id (least id of its class), kept (whether it is the one row of its class that stays): one row per row of docs."""
    return classes(docs, id_col, text_col, least, most).select(F.col("doc").alias("doc_id"), "class_id", "kept")


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = SIMILARITY) -> DataFrame:
    """The rows of docs that stay, one of each class, with all of their columns."""
    found = classes(docs, id_col, text_col, least)
    # rows are met again by id and text; only those that occur more than once have to be counted out
    often = found.groupBy(F.col("doc").alias("often_doc"), F.col("digest").alias("often_digest")).agg(F.count("*").alias("n")).filter("n > 1")
    kept = found.filter("kept").join(often, F.col("doc").eqNullSafe(F.col("often_doc")) & (F.col("digest") == F.col("often_digest")), "left")
    kept = cut(kept.select(F.col("doc").alias("kept_doc"), F.col("digest").alias("kept_digest"), F.col("n").isNull().alias("alone")))
    mark = F.unhex(F.md5(F.coalesce(docs[text_col], F.lit(""))))
    pick = lambda few: docs.join(few, docs[id_col].cast("long").eqNullSafe(few["kept_doc"]) & (mark == few["kept_digest"]), "left_semi")
    return pick(kept.filter("alone")).unionByName(pick(kept.filter("not alone")).dropDuplicates([id_col, text_col]))
