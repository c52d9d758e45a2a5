"""Benchmark decontamination: which documents hold a benchmark item.

Size-partitioned MinHash containment search. A text's domain is its set of five-word shingles, each hashed to 64 bits;
one random order of hashes serves all sets. Items are partitioned by size (powers of two), and each partition has its own
sketch length: with at most u shingles in its items and l = floor((1 - t) u), an item's MinHash sketch is its 2 l + 1
smallest hashes (all, if it has fewer). The partition's largest sketch hash is its threshold. A document's sketch for a
partition is all of its hashes up to that threshold, so that it holds whatever of a sketch the document holds: with a fixed
number of smallest hashes a long document would nearly never agree with a short item. A hash of a document is probed once in each
partition whose threshold it does not pass.

A document that holds the share t of an item with n shingles lacks at most floor((1 - t) n) of them, so of the k hashes of
the item's sketch it holds at least k - floor((1 - t) n): the containment threshold of each size. Pairs below it are
dropped; the search loses nothing. What is left is verified exactly, on the words of the shingles, over the candidate
documents only.

An item of fewer than five words is one shingle of its own length, which documents are also cut into where such items
exist. The items' tables are broadcast while they have at most MAX_BROADCAST rows, and are joined by shuffle beyond that.

Within, documents and items go by a digest of their texts, so rows that share an id, or have none, are judged each for itself.

Words are runs of letters and digits, lower-cased. Defined cases: an item without words matches nothing, and a text without
words holds nothing; null counts as empty; rows with a null id are left out of the pairs, but judged (documents and items)
by drop_contaminated; of rows that share an id each text is a document (or item) of its own, and equal rows of the result are
given once; texts of any length are cut whole; an empty table gives no pairs; further columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placemill.llm.common import Run

WORDS = 5
SHARE = 0.8
#: Rows of two numbers or of one shingle; at most about 100 MB.
MAX_BROADCAST = 1_000_000


def words(text: Column) -> Column:
    spaced = F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))
    return F.split(spaced, " ")  # of a text without words: one empty word


def _joined(*words_: Column) -> Column:
    return F.concat_ws(" ", *words_)


def _places(make, n: int) -> Column:
    """The shingles of n words of the column w, one for each place."""
    starts = F.sequence(F.lit(0), F.size("w") - n)
    return F.when(F.size("w") >= n, F.transform(starts, lambda i: make(*[F.get(F.col("w"), i + k) for k in range(n)])))


def _item_shingles(items: DataFrame, make, n: int) -> DataFrame:
    """item_id, s: an item's distinct shingles; a short item is one."""
    df = items.select("item_id", words(F.col("text")).alias("w")).filter(F.get("w", 0) != "")
    own = F.when(F.size("w") >= n, _places(make, n)).otherwise(F.coalesce(*[F.when(F.size("w") == k, _places(make, k)) for k in range(1, n)]) if n > 1 else F.array())
    return df.select("item_id", F.explode(own).alias("s")).distinct()


def _text_shingles(docs: DataFrame, make, n: int, short: list[int]) -> DataFrame:
    """doc_id, s: a row for each place of a shingle, and of n or of a short item's number of words."""
    df = docs.select("doc_id", words(F.col("text")).alias("w"))
    own = [_places(make, k) for k in (n, *short)]
    if short:
        own = [F.coalesce(x, F.array().cast("array<bigint>" if make is F.xxhash64 else "array<string>")) for x in own]
    return df.select("doc_id", F.explode(F.concat(*own) if short else own[0]).alias("s"))


def sketches(items: DataFrame, share: float) -> DataFrame:
    """item_id, s, part, need: each item's smallest hashes, as many as its size partition asks for, and how many a document must hold."""
    own = items.groupBy("item_id").agg(F.array_sort(F.collect_set("s")).alias("all"))
    own = own.withColumn("part", F.floor(F.log2(F.size("all"))).cast("int"))
    # the small term keeps a product that is a whole number from falling below it
    lacks = lambda n: F.floor(F.lit(1.0 - share) * n + 1e-9)
    own = own.withColumn("k", F.least(2 * lacks(F.pow(F.lit(2.0), F.col("part") + 1) - 1) + 1, F.size("all")).cast("int"))
    need = F.greatest(F.col("k") - lacks(F.size("all")), F.lit(1)).cast("int")
    return own.select("item_id", "part", need.alias("need"), F.explode(F.slice("all", F.lit(1), F.col("k"))).alias("s"))


def _small(df: DataFrame, most: int) -> DataFrame:
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def _digest(text: Column) -> Column:
    whole = F.coalesce(text, F.lit(""))
    return F.struct(F.xxhash64(whole, F.lit(1)).alias("a"), F.xxhash64(whole, F.lit(2)).alias("b"))


def _found(docs: DataFrame, items: DataFrame, run: Run, n: int, share: float, most: int) -> DataFrame:
    """doc_id, item_id, n_shared, n_item, containment; both ids are digests of texts."""
    own = items.select(words(F.col("text")).alias("w")).filter(F.get("w", 0) != "")
    short = sorted(r["k"] for r in own.select(F.size("w").alias("k")).filter(F.col("k") < n).distinct().collect())  # at most n - 1
    sketch = run.cut(sketches(_item_shingles(items, F.xxhash64, n), share))
    tops = sketch.groupBy("part").agg(F.max("s").alias("top")).collect()  # one row for each power of two
    open_ = [F.when(F.col("s") <= F.lit(r["top"]), F.lit(r["part"])) for r in sorted(tops)]
    parts = F.array_compact(F.array(*open_)) if open_ else F.array().cast("array<int>")
    top = max((r["top"] for r in tops), default=-(1 << 63))
    probes = _text_shingles(docs, F.xxhash64, n, short).filter(F.col("s") <= F.lit(top)).select("doc_id", "s", F.explode(parts).alias("part"))
    hits = probes.join(_small(sketch, most), ["part", "s"]).groupBy("doc_id", "item_id", "need").agg(F.count_distinct("s").alias("n"))
    found = run.cut(hits.filter("n >= need").select("doc_id", "item_id"))
    exact = run.cut(_item_shingles(items, _joined, n))
    sizes = run.cut(exact.groupBy("item_id").agg(F.count("*").alias("n_item")))
    suspects = docs.join(_small(run.cut(found.select("doc_id").distinct()), most), "doc_id", "left_semi")
    shared = _text_shingles(suspects, _joined, n, short).join(_small(exact, most), "s")
    shared = shared.groupBy("doc_id", "item_id").agg(F.count_distinct("s").alias("n_shared"))
    out = shared.join(found, ["doc_id", "item_id"], "left_semi").join(_small(sizes, most), "item_id")
    return run.cut(out.withColumn("containment", F.col("n_shared") / F.col("n_item")).filter(F.col("containment") >= share))


def contained_items(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", n: int = WORDS, share: float = SHARE, most: int = MAX_BROADCAST) -> DataFrame:
    """doc_id, item_id, n_shared, n_item, containment: a row for each document that holds at least the share of an item's shingles."""
    run, last = Run(docs.sparkSession), Run(docs.sparkSession)
    docs = docs.select(F.col(id_col).alias("own"), F.col(text_col).alias("text")).filter("own is not null").withColumn("doc_id", _digest(F.col("text")))
    items = items.select(F.col(item_col).alias("named"), F.col(item_text_col).alias("text")).filter("named is not null").withColumn("item_id", _digest(F.col("text")))
    found = _found(docs.drop("own"), items.drop("named"), run, n, share, most)
    named = run.cut(found.join(items.select("item_id", "named").distinct(), "item_id"))
    out = docs.select("doc_id", "own").join(_small(named, most), "doc_id")
    out = last.cut(out.select(F.col("own").alias("doc_id"), F.col("named").alias("item_id"), "n_shared", "n_item", "containment").distinct())
    run.clear()
    return out


def drop_contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_text_col: str = "text", n: int = WORDS, share: float = SHARE, most: int = MAX_BROADCAST) -> DataFrame:
    """The rows of docs whose own text holds no item. Rows of both tables are judged by text, so ids may be null or repeat."""
    run, last = Run(docs.sparkSession), Run(docs.sparkSession)
    texts = docs.select(_digest(docs[text_col]).alias("doc_id"), docs[text_col].alias("text"))
    asked = items.select(_digest(items[item_text_col]).alias("item_id"), items[item_text_col].alias("text"))
    found = last.cut(_found(texts, asked, run, n, share, most).select("doc_id").distinct())
    run.clear()
    return docs.join(_small(found, most), _digest(docs[text_col]) == found["doc_id"], "left_anti")
