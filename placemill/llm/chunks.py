"""Substring deduplication by content-defined chunking with a gear rolling hash.

A gear hash of 32 bits rolls over a text's bytes (A-Z lower-cased, white space as one space): h = (h << 1) + G[byte], so it
depends on the last 32 bytes alone; what stands before the last three words is taken out again, so texts don't depend on
their neighbours. In every WINDOW consecutive word ends the one with the least hash (scrambled; the last of equal ones) is a
boundary, and so are a text's start and end. The boundaries partition the text into variable chunks of at most WINDOW words
(more only at the ends of a text), which follow the content: an insertion moves them along and changes those around it only.
Chunks are compared by a 64-bit digest of their words, pieces (of two chunks and more) by a 128-bit one of their chunks' digests.

A digest that two or more documents hold is repeated. Runs of adjacent repeated chunks are put together to pieces: from each
boundary of a run to the first one at least MIN_SPAN words later. A piece, by the digest of its chunks' digests, that two or
more documents hold is a repeated passage; short chunks that are equal by chance make no piece. Pieces of a text that overlap
or touch merge to spans, those with an earlier place apart from those without one.

Every passage of more than 50 words that occurs twice holds an equal piece in both places: of its 51 words, 49 word ends
depend on it alone; the first WINDOW = 12 of them hold a boundary, and so do the 12 from 25 words later, 2 + 12 + 25 + 12 in
all. A word end outside that window can't displace it, since the window's least one is in its own window too.

A common passage is a hot digest. Counts and least documents are aggregated before the shuffle; the join back to the places
has one row per digest on the other side, so Spark can split a hot digest among tasks. Python reads the texts once.

Defined cases: null or empty texts have no row, and a text of fewer than MIN_SPAN words none either; rows that share an id
are one document, and repeats within one document alone don't count; rows of one id are told apart by text, and equal ones
have equal spans; rows with a null id are a document for each different text, later than all with an id (and among
themselves in the order of their texts' hashes); a text of any length is read whole; an empty table gives no rows; columns
besides id and text are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from placemill.llm.common import Run, mix64, slices
from placemill.llm.shingles import word_hashes, word_spans

MIN_SPAN = 25
#: Words that a boundary depends on; a boundary stands in each WINDOW word ends, so that 51 words always hold a chunk.
CONTEXT = 3
WINDOW = (51 - (CONTEXT - 1) - MIN_SPAN) // 2
_GEAR = (mix64(np.arange(1, 257, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LOWER[9:14] = 32


def gear(x: np.ndarray) -> np.ndarray:
    """The rolling hash at each byte, by doubling: what 1, 2, 4, ... bytes add up to."""
    h, width = _GEAR[x], 1
    while width < 32:
        more = h.copy()
        more[width:] += h[:-width] << np.uint32(width)
        h, width = more, 2 * width
    return h


def _boundaries(h: np.ndarray, first: np.ndarray, last: np.ndarray, text: np.ndarray, window: int) -> np.ndarray:
    """Words behind the word ends that have the least hash of some window within their text."""
    lead = CONTEXT - 1
    n = len(last) - lead - window + 1
    if n < 1:
        return np.zeros(0, np.int64)
    # the hash at the end of each word from the third on, without what stands before its last three words
    begin, end = first[:-lead], last[lead:]
    width = end - begin + 1
    before = np.where(begin > 0, h[begin - 1], np.uint32(0))
    own = h[end] - np.where(width < 32, before << np.minimum(width, 31).astype(np.uint32), np.uint32(0))
    rank = mix64(own.astype(np.uint64))
    whole = np.flatnonzero(text[:n] == text[lead + window - 1 :])
    least, at = rank[:n].copy(), np.arange(n)
    for k in range(1, window):
        lower = rank[k : k + n] <= least
        least[lower] = rank[k : k + n][lower]
        at[lower] = np.flatnonzero(lower) + k
    return np.unique(at[whole]) + lead + 1


def chunk_places(data: np.ndarray, lengths: np.ndarray, window: int = WINDOW) -> dict[str, np.ndarray]:
    """text, first word, words, first byte, bytes (both within the text) and digest (two numbers) of every chunk."""
    starts, ends, text = word_spans(data, lengths)
    if not len(starts):
        return {k: np.zeros(0, np.int64) for k in ("text", "word", "n_words", "byte", "n_bytes", "d1", "d2")}
    # words joined by one space, so that the kind and amount of white space doesn't matter
    sizes = ends - starts + 1
    at = np.cumsum(sizes) - sizes
    joined = np.full(int(sizes.sum()), 32, np.uint8)
    within = np.arange(len(joined)) - np.repeat(at, sizes)
    inner = within < np.repeat(sizes - 1, sizes)
    joined[inner] = _LOWER[data[(np.repeat(starts, sizes) + within)[inner]]]
    fresh = np.flatnonzero(np.append(True, text[1:] != text[:-1]))
    first = np.union1d(fresh, _boundaries(gear(joined), at, at + sizes - 2, text, window))
    first = first[first < len(starts)]
    last = np.append(first[1:], len(starts))
    w = word_hashes(data, starts, ends)
    before = np.zeros(len(lengths), np.int64)
    before[text[fresh]] = fresh
    out = {"text": text[first], "word": first - before[text[first]], "n_words": last - first}
    begin = (np.cumsum(lengths) - lengths)[text[first]]
    out |= {"byte": starts[first] - begin, "n_bytes": ends[last - 1] - starts[first]}
    for name, base in (("d1", 0x9FB21C651E98DF25), ("d2", 0xA0761D6478BD642F)):
        power = _powers(base, len(w))
        sums = np.zeros(len(w) + 1, np.uint64)
        np.cumsum(mix64(w ^ np.uint64(base)) * power, out=sums[1:])
        back = _powers(pow(base, -1, 1 << 64), len(w))
        out[name] = mix64((sums[last] - sums[first]) * back[first] + (last - first).astype(np.uint64)).view(np.int64)
    return out


def _powers(base: int, n: int) -> np.ndarray:
    p = np.full(n, base, np.uint64)
    p[0] = 1
    return np.cumprod(p, dtype=np.uint64)


def chunks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """doc_id, key (hash of the text), word, n_words, byte, n_bytes, d1, d2: a row for each chunk."""
    kinds = {"word": np.int32, "n_words": np.int32, "byte": np.int32, "n_bytes": np.int32, "d1": np.int64, "d2": np.int64}

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, data, lengths in slices(batch.column(2)):
                c = chunk_places(data, lengths, window)
                rows = batch.slice(first, last - first).select([0, 1]).take(pa.array(c["text"]))
                yield pa.RecordBatch.from_arrays([*rows.columns, *(pa.array(c[k].astype(t)) for k, t in kinds.items())], names=["doc_id", "key", *kinds])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("key"), F.col(text_col).alias("text"))
    return rows.mapInArrow(cut_up, "doc_id long, key long, word int, n_words int, byte int, n_bytes int, d1 long, d2 long")


def _several(rows: DataFrame, *digest: str) -> DataFrame:
    """The digests that two or more documents hold: their places, the least document with an id, and the least text without one."""
    who = F.coalesce("doc_id", "key")  # a text without an id stands for itself
    other = F.when(F.col("doc_id").isNull(), F.col("key"))
    held = rows.groupBy(*digest).agg(F.count("*").alias("n_places"), F.min("doc_id").alias("first_doc"), F.min(other).alias("first_key"), F.min(who).alias("least"), F.max(who).alias("most"))
    return held.filter("least < most").drop("least", "most")


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, min_span: int = MIN_SPAN) -> DataFrame:
    """doc_id, word, n_words, byte, n_bytes, first_doc, n_places, is_first: a row for each span of at least min_span words that repeats.

    word and byte are where it starts in the text (UTF-8 bytes); first_doc is the document of the first place of the span's
    most repeated piece (null if only rows without ids hold it), n_places the number of places of that piece; is_first says that no earlier document holds its
    pieces. Dropping the spans where it is false keeps the first copy of each passage.
    """
    return _spans(docs, id_col, text_col, window, min_span).drop("key")


def _spans(docs: DataFrame, id_col: str, text_col: str, window: int, min_span: int) -> DataFrame:
    spark = docs.sparkSession
    run, last = Run(spark), Run(spark)
    found = run.cut(chunks(docs, id_col, text_col, window).drop("d2"))
    repeated = run.cut(_several(found, "d1").select("d1"))
    hits = found.join(repeated, "d1")
    # adjacent repeated chunks of a text; repeated rows of a document are one
    own = ("doc_id", "key")
    in_text = W.partitionBy(*own).orderBy("word")
    hits = hits.select(*own, "word", "n_words", "byte", "n_bytes", "d1").dropDuplicates([*own, "word"])
    hits = hits.withColumn("end", F.col("word") + F.col("n_words"))
    hits = hits.withColumn("new", (F.col("word") != F.coalesce(F.lag("end").over(in_text), F.lit(-1))).cast("int")).withColumn("run", F.sum("new").over(in_text))
    # a piece ends with the first chunk that reaches min_span words from where it starts: at most that many chunks on
    ahead = W.partitionBy(*own, "run").orderBy("word").rowsBetween(0, min_span - 1)
    next_ = F.collect_list(F.struct("end", (F.col("byte") + F.col("n_bytes")).alias("end_byte"), "d1")).over(ahead)
    steps = hits.select(*own, "word", "byte", next_.alias("steps"))
    upto = F.size(F.filter("steps", lambda x: x["end"] < F.col("word") + min_span)) + 1
    steps = steps.withColumn("n", upto).filter(F.col("n") <= F.size("steps"))
    part = F.slice("steps", F.lit(1), F.col("n"))
    digests = [F.xxhash64(F.lit(seed), F.transform(part, lambda x: x["d1"])) for seed in (1, 2)]
    stop = F.element_at("steps", F.col("n"))
    pieces = run.cut(steps.select(*own, "word", "byte", stop["end"].alias("end"), stop["end_byte"].alias("end_byte"), digests[0].alias("p1"), digests[1].alias("p2")))
    hits = pieces.join(run.cut(_several(pieces, "p1", "p2")), ["p1", "p2"]).withColumn("is_first", F.coalesce(F.col("first_doc") == F.col("doc_id"), F.col("first_doc").isNull() & (F.col("first_key") == F.col("key"))))
    by_doc = W.partitionBy(*own, "is_first").orderBy("word")
    ends = F.max("end").over(by_doc.rowsBetween(W.unboundedPreceding, -1))
    spans = hits.withColumn("new", F.when(F.col("word") <= ends, 0).otherwise(1)).withColumn("span", F.sum("new").over(by_doc.rowsBetween(W.unboundedPreceding, 0)))
    out = spans.groupBy(*own, "is_first", "span").agg(F.min("word").alias("word"), F.max("end").alias("end"), F.min("byte").alias("byte"), F.max("end_byte").alias("end_byte"), F.max(F.struct("n_places", -F.col("first_doc"))).alias("most"))
    out = last.cut(out.select("doc_id", "key", "word", (F.col("end") - F.col("word")).alias("n_words"), "byte", (F.col("end_byte") - F.col("byte")).alias("n_bytes"), (-F.col("most.col2")).alias("first_doc"), F.col("most.n_places").alias("n_places"), "is_first"))
    run.clear()
    return out


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, min_span: int = MIN_SPAN) -> DataFrame:
    """docs without the repeated spans that have an earlier document; the text around them is kept as it is."""
    spans = _spans(docs, id_col, text_col, window, min_span).filter(~F.col("is_first"))
    cuts = spans.groupBy(F.col("doc_id").alias("cut_doc"), F.col("key").alias("cut_key")).agg(F.array_sort(F.collect_list(F.struct("byte", "n_bytes"))).alias("cuts"))

    @F.arrow_udf(T.StringType())
    def drop(texts: pa.Array, places: pa.Array) -> pa.Array:
        out = []
        for text, some in zip(texts.to_pylist(), places.to_pylist(), strict=True):
            if text is not None and some:
                raw, kept, at = text.encode(), [], 0
                for c in some:
                    kept.append(raw[at : c["byte"]])
                    at = max(at, c["byte"] + c["n_bytes"])
                text = b"".join([*kept, raw[at:]]).decode()
            out.append(text)
        return pa.array(out, pa.string())

    both = docs.join(cuts, docs[id_col].cast("long").eqNullSafe(cuts["cut_doc"]) & (F.xxhash64(docs[text_col]) == cuts["cut_key"]), "left")
    return both.select(*[drop(docs[text_col], cuts["cuts"]).alias(text_col) if c == text_col else docs[c] for c in docs.columns])
