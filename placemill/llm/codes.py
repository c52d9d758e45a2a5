"""Vector code compression: product codes, assigned by partial-distance search.

Vectors of whole numbers are cut into equal consecutive parts; each part is coded by the nearest entry of its position's
codebook. The codebooks start from the parts of the vectors of the smallest ids and are moved to the means of their parts in a
fixed number of rounds. Everything is integer arithmetic, so results don't depend on how rows are spread.

A part is assigned by partial-distance search. The dimensions are taken in descending order of the codebook's variance.
An entry near by in the first of them gives a first complete distance; the other entries are added up dimension by dimension,
a mask over all (vector, entry) pairs that are left dropping those whose sum already exceeds the vector's best complete
distance strictly. They run in waves, so that later ones meet a better best. What is left at the end is complete; ties go to the lower entry.

A round is one pass over the vectors, which were written once as whole numbers: each task returns counts and sums by
(part, entry, position), which are added in a shuffle of that many keys. The driver holds the codebooks, whose size is that of `entries` vectors.

Defined cases: vectors that are null or hold null or a non-finite number are dropped; shorter vectors are padded with zeros to
the longest, and all to a multiple of the number of parts; components beyond 2^62 are held at it, and errors beyond 64 bits count as
the largest 64-bit number; fewer vectors than entries give as many entries; rows of a null id are coded, but come last for
the start, ties by the vector; repeated rows are coded and count each for itself; null labels are one label; an empty table
gives no rows; further columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placemill.llm.common import Run, cut

SCALE, PARTS, ENTRIES, ROUNDS = 4096, 8, 16, 6
#: Entries that are tried before the best distances are looked at again; labels that are broadcast, at most.
WAVE, MAX_BROADCAST = 5, 500_000
_MOST, _LONG = 1 << 62, (1 << 63) - 1


def quantised(vector: Column, scale: int = SCALE) -> Column:
    """scale * x rounded down, as whole numbers."""
    return F.transform(vector, lambda x: F.greatest(F.lit(-_MOST), F.least(F.lit(_MOST), F.floor(F.lit(float(scale)) * F.greatest(F.lit(-1e300), F.least(F.lit(1e300), x))))).cast("long"))


def _matrix(vectors: pa.Array, dims: int) -> np.ndarray:
    """n x dims, padded with zeros; Python integers where squares may pass 64 bits."""
    sizes = pc.list_value_length(vectors).to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(sizes), dims), np.int64)
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = vectors.flatten().to_numpy()
    return out


def _safe(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both in 64 bits if no squared distance passes them, else as Python integers."""
    top = max(int(np.abs(a).max(initial=0)) for a in (x, book))
    return (x, book) if 4 * top * top * max(1, x.shape[1]) < 1 << 63 else (x.astype(object), book.astype(object))


def nearest_entries(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest entry of each row and its squared distance. x: n x dims, book: entries x dims."""
    x, book = _safe(x, book)
    n, dims = x.shape
    if not dims:
        return np.zeros(n, np.int64), np.zeros(n, np.int64)
    order = np.argsort(-book.astype(float).var(axis=0), kind="stable")
    partial = np.square(x[:, order[:1]] - book[:, order[0]])
    code = partial.argmin(axis=1)
    best = np.square(x - book[code]).sum(axis=1)
    ranks = partial.argsort(axis=1, kind="stable")
    for start in range(1, len(book), WAVE):
        entry = ranks[:, start : start + WAVE]
        row = np.repeat(np.arange(n), entry.shape[1])
        entry = entry.ravel()
        total = partial[row, entry]
        for d in order[1:]:
            left = total <= best[row]
            row, entry, total = row[left], entry[left], total[left]
            total = total + np.square(x[row, d] - book[entry, d])
        left = (total < best[row]) | ((total == best[row]) & (entry < code[row]))
        row, entry, total = row[left], entry[left], total[left]
        by = np.lexsort((entry, total, row))
        first = by[np.append(True, row[by][1:] != row[by][:-1])[: len(by)]]
        code[row[first]], best[row[first]] = entry[first], total[first]
    return code, best


def _assigned(batch: pa.RecordBatch, books: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Part, entries and distances for each position. books: parts x entries x width."""
    parts, _, width = books.shape
    x = _matrix(batch.column(0), parts * width)
    for p in range(parts):
        own = x[:, p * width : (p + 1) * width]
        yield own, *nearest_entries(own, books[p])


_SUMS = "part int, entry int, position int, n long, high long, low long"


def _summer(books):
    """Counts and sums of the parts of a task by (part, entry, position); a sum is high * 2^32 + low."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, entries, width = books.value.shape
        counts, sums = np.zeros((parts, entries), np.int64), np.zeros((parts, entries, 2, width), np.int64)
        for batch in batches:
            for p, (own, code, _) in enumerate(_assigned(batch, books.value)):
                counts[p] += np.bincount(code, minlength=entries)
                np.add.at(sums[p, :, 0], code, own >> 32)
                np.add.at(sums[p, :, 1], code, own & 0xFFFFFFFF)
        part, entry, position = (a.ravel() for a in np.indices((parts, entries, width), np.int32))
        high, low = (sums[:, :, i].ravel() for i in (0, 1))
        yield pa.RecordBatch.from_arrays([pa.array(a) for a in (part, entry, position, np.repeat(counts.ravel(), width), high + (low >> 32), low & 0xFFFFFFFF)], ["part", "entry", "position", "n", "high", "low"])

    return run


def _coder(books):
    """Codes in hexadecimal and errors, beside the columns behind the vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, error = [], np.zeros(batch.num_rows, object)
            for _, code, distance in _assigned(batch, books.value):
                codes.append(code)
                error = error + distance
            text = [bytes(r).hex() for r in np.stack(codes, axis=1).astype(np.uint8)]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(text, pa.string()), pa.array(np.minimum(error, _LONG).astype(np.int64))], [*batch.schema.names[1:], "code", "error"])

    return run


class Codebooks:
    """parts x entries x width whole numbers."""

    def __init__(self, books: np.ndarray):
        self.books = books

    @staticmethod
    def learn(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> Codebooks:
        """From rows of (q, id), q being vectors of whole numbers."""
        if not 1 <= entries <= 256:
            raise ValueError("an entry is two hexadecimal digits")
        dims = vectors.agg(F.coalesce(F.max(F.size("q")), F.lit(0))).first()[0]
        first = [r["q"] for r in vectors.orderBy(F.col("id").asc_nulls_last(), "q").limit(entries).collect()]
        width = -(-dims // parts)
        start = np.zeros((len(first), parts * width), np.int64)
        for row, q in zip(start, first, strict=True):
            row[: len(q)] = q
        books = np.ascontiguousarray(start.reshape(len(first), parts, width).transpose(1, 0, 2))
        sc = vectors.sparkSession.sparkContext
        for _ in range(rounds if books.size else 0):
            shared = sc.broadcast(books)
            sums = vectors.select("q").mapInArrow(_summer(shared), _SUMS).groupBy("part", "entry", "position").agg(F.sum("n").alias("n"), F.sum("high").alias("high"), F.sum("low").alias("low")).filter("n > 0")
            books = books.copy()
            for r in sums.collect():  # as many rows as the codebooks have numbers
                books[r["part"], r["entry"], r["position"]] = ((r["high"] << 32) + r["low"]) // r["n"]
            shared.unpersist()
        return Codebooks(books)

    def digest(self) -> str:
        return hashlib.sha256(",".join(map(str, self.books.ravel().tolist())).encode()).hexdigest()

    def encode(self, vectors: DataFrame) -> DataFrame:
        """code and error beside the other columns. vectors: q and any others."""
        others = [f for f in vectors.schema.fields if f.name != "q"]
        ddl = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in others), "code string", "error long"])
        return vectors.select("q", *(f.name for f in others)).mapInArrow(_coder(vectors.sparkSession.sparkContext.broadcast(self.books)), ddl)

    def decode(self, code: str) -> list[int]:
        """The vector that a code stands for."""
        return [int(x) for book, entry in zip(self.books, bytes.fromhex(code), strict=True) for x in book[entry]]


def compress(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", scale: int = SCALE, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 of every vector that is kept."""
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = vectors.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vector_col).cast("array<double>").alias("v")).filter(F.col("v").isNotNull() & fine)
    run = Run(vectors.sparkSession)
    kept = run.cut(rows.select("id", "label", quantised(F.col("v"), scale).alias("q")))
    books = Codebooks.learn(kept.select("id", "q"), parts, entries, rounds)
    if not books.books.shape[1]:
        coded = kept.select("id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"))
    else:
        coded = run.cut(books.encode(kept.select("q", "id", "label")))
    by_label = run.cut(coded.groupBy(F.col("label").alias("l")).agg(F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(_LONG)).cast("long").alias("label_error")))
    # a label may have most rows: its sum goes to the rows, or else a join that AQE splits
    small = by_label.limit(MAX_BROADCAST + 1).count() <= MAX_BROADCAST
    out = coded.join(F.broadcast(by_label) if small else by_label, F.col("label").eqNullSafe(F.col("l")))
    out = cut(out.select(F.col("id").alias(id_col), "code", "error", "label_error", F.lit(books.digest()).alias("codebooks_sha256")))
    run.clear()
    return out
