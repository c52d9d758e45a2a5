"""LM scoring by subword lattice likelihood.

The vocabulary is that of a public tokenizer (its pieces; the tokenizer isn't trained). A text is its words, each with a
leading space, and one end; pieces have no space but at their start. The model draws pieces one by one from a unigram
distribution until it draws the end, so a text's probability is the sum over all segmentations of the product of the pieces'
probabilities, times that of the end. A piece never spans two words, so the sum factors into one forward recursion in log
space per word. The bytes are pieces too, so every word has a probability.

The pieces' scores start from their rank in the vocabulary and are re-estimated from the training texts by expected counts
over all segmentations (forward-backward), every word counting as often as these texts say it. In the last pass each
piece's count loses the discount D, and what is lost goes to all pieces by their rank: pieces that the training texts hardly use
keep some mass for words that were never seen.

The work is done per distinct word: word counts over the whole corpus are one shuffle, and each distinct word's lattice
is evaluated once per pass. Short words of one length go side by side; a word beyond LONG bytes goes alone, segment by segment,
with the last positions' values carried over, so that memory stays that of a segment, and a few numbers for each border.
To score, the commonest words (at most HOT_WORDS, and HOT_BYTES) are broadcast with their values; a text's
other words are joined by shuffle. Commoner words are taken first, so a hot key is among those that are broadcast.

Beside it stand a base, the same words and end under add-one unigram counts of whole words, and word_score, the score of a
model that gives a word seen in training an arc of its own, with its discounted relative frequency, beside its spellings.

Defined cases: a null text counts as empty and has the end alone; with no training text the scores are those of the
ranks; rows are scored each for itself, also where they or their ids repeat or ids are null; a word of any length is
evaluated whole; an empty table gives no rows; further columns are not read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placemill.llm.common import HashIndex, cut

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
PASSES = 3
HOT_WORDS, HOT_BYTES = 200_000, 32 << 20
#: Words of more bytes are evaluated in segments.
LONG, SEGMENT = 1024, 1 << 16
FLUSH = 300_000
DISCOUNT = 0.75
_SMOOTH = 0.01
_CELLS = 2_000_000
_END = b""


def load_pieces(path: str = VOCABULARY) -> list[bytes]:
    """The vocabulary in order of rank, a leading mark as a space; the 256 bytes come after it where it lacks them."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    seen: dict[bytes, None] = {}
    for i in range(sp.get_piece_size()):
        if sp.is_control(i) or sp.is_unknown(i):
            continue
        p = sp.id_to_piece(i)
        raw = bytes([int(m[1], 16)]) if (m := re.fullmatch(r"<0x([0-9A-F]{2})>", p)) else p.replace("▁", " ").encode()
        if b" " not in raw[1:]:
            seen.setdefault(raw)
    for b in range(256):
        seen.setdefault(bytes([b]))
    return list(seen)


def rank_scores(n: int) -> np.ndarray:
    """Natural logarithms of probabilities that fall with the rank; the last is the end's."""
    p = 1.0 / (np.arange(n + 1) + 10.0)
    return np.log(p / p.sum())


_STEP = np.uint64(0x100000001B3)
_POWERS = np.cumprod(np.full(4096, _STEP, np.uint64))


def _hash(piece: bytes) -> int:
    x = np.frombuffer(piece, np.uint8).astype(np.uint64) + np.uint64(1)
    return int((x * _POWERS[: len(x)]).sum(dtype=np.uint64))


class Lattice:
    """Places of the pieces in words, and recursions over them."""

    def __init__(self, pieces: list[bytes]):
        self.k = len(pieces)
        keys = np.array([_hash(p) for p in pieces], np.uint64)
        if len(np.unique(keys)) < self.k:
            raise ValueError("two pieces share a hash")
        self.index = HashIndex(keys)
        self.lengths = sorted({len(p) for p in pieces})

    def edges(self, x: np.ndarray) -> dict[int, np.ndarray]:
        """x: words of one length as rows of bytes. For each piece length, the piece that starts at each place (k: none)."""
        y, n = x.astype(np.uint64) + np.uint64(1), x.shape[1]
        out, h = {}, np.zeros(x.shape, np.uint64)
        for size in range(1, min(n, self.lengths[-1]) + 1):
            h = h[:, : n - size + 1] + y[:, size - 1 :] * _POWERS[size - 1]
            if size in self.lengths:
                found = self.index.find(h)
                if (found < self.k).any():
                    out[size] = found
        return out

    @staticmethod
    def _sum(terms: list[np.ndarray]) -> np.ndarray:
        a = np.stack(terms)
        top = a.max(axis=0)
        return top + np.log(np.exp(a - top).sum(axis=0))

    def forward(self, scores: dict[int, np.ndarray], n: int) -> list[np.ndarray]:
        a = [np.zeros(len(next(iter(scores.values()))))]
        for t in range(1, n + 1):
            a.append(self._sum([a[t - size] + s[:, t - size] for size, s in scores.items() if size <= t]))
        return a

    def backward(self, scores: dict[int, np.ndarray], n: int) -> list[np.ndarray]:
        b = [np.zeros(len(next(iter(scores.values()))))] * (n + 1)
        for t in range(n - 1, -1, -1):
            b[t] = self._sum([b[t + size] + s[:, t] for size, s in scores.items() if t + size <= n])
        return b

    def arcs(self, x: np.ndarray, padded: np.ndarray, at: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Start, end, piece and score of each piece in a stretch of a word that begins at that place of it."""
        start, end, piece = [], [], []
        for size, e in self.edges(x[None]).items():
            i = np.flatnonzero(e[0] < self.k)
            start.append(i + at)
            end.append(i + at + size)
            piece.append(e[0, i])
        own = np.concatenate(piece)
        return np.concatenate(start), np.concatenate(end), own, padded[own]


def _chain(known: list[float], first: int, new: np.ndarray, old: np.ndarray, w: np.ndarray, places: range) -> list[float]:
    """Values of the places, one after the other: the log-sum of the arcs from places whose values are there already.

    known: values from the place `first` on, in the direction of the places; the new ones are appended.
    """
    order = np.argsort(new if places.step > 0 else -new, kind="stable")
    new, w = new[order], w[order].tolist()
    at = ((old[order] - first) * places.step).tolist()
    ends = np.searchsorted(new * places.step, np.arange(places.start, places.stop, places.step) * places.step, "right").tolist()
    i, log, exp = 0, math.log, math.exp
    for j in ends:
        if j - i == 1:
            known.append(known[at[i]] + w[i])
        else:
            terms = [known[at[n]] + w[n] for n in range(i, j)]
            top = max(terms, default=-math.inf)
            known.append(top + log(sum([exp(t - top) for t in terms])) if top > -math.inf else top)
        i = j
    return known


class Long:
    """The lattice of one long word, in segments."""

    def __init__(self, word: bytes, lattice: Lattice, padded: np.ndarray):
        self.x, self.lattice, self.padded = np.frombuffer(b" " + word, np.uint8), lattice, padded
        self.n, self.reach = len(self.x), lattice.lengths[-1]
        self.borders = list(range(0, self.n, SEGMENT))
        # forward values of the places up to each border that a piece can start at
        self.carried: list[list[float]] = []

    def _forward(self, lo: int, before: list[float]) -> tuple[int, list[float]]:
        """The first place, and the values from it to the end of the segment."""
        first, hi = lo + 1 - len(before), min(self.n, lo + SEGMENT)
        start, end, _, w = self.lattice.arcs(self.x[first:hi], self.padded, first)
        new = end > lo
        return first, _chain(list(before), first, end[new], start[new], w[new], range(lo + 1, hi + 1))

    def whole(self) -> float:
        """Log-probability of the word over all segmentations."""
        now = [0.0]
        self.carried.clear()
        for lo in self.borders:
            self.carried.append(now)
            now = self._forward(lo, now)[1][-self.reach :]
        return now[-1]

    def counts(self, out: np.ndarray, times: float) -> None:
        """Adds how often each piece occurs on average, so many times. Forward values are made anew segment by segment, from the last."""
        whole, after = self.whole(), [0.0]
        for lo, before in zip(reversed(self.borders), reversed(self.carried), strict=True):
            hi = min(self.n, lo + SEGMENT)
            first, forth = self._forward(lo, before)
            last = hi + len(after) - 1
            start, end, piece, w = self.lattice.arcs(self.x[lo:last], self.padded, lo)
            own = start < hi
            start, end, piece, w = start[own], end[own], piece[own], w[own]
            back = _chain(list(after), last, start, end, w, range(hi - 1, lo - 1, -1))
            p = np.exp(np.array(forth)[start - first] + w + np.array(back)[last - end] - whole) * times
            out += np.bincount(piece, p, len(out))
            after = back[-self.reach :]


_BUILT: dict[int, Lattice] = {}


def _lattice(pieces: list[bytes]) -> Lattice:
    key = hash(tuple(pieces))
    if key not in _BUILT:
        _BUILT.clear()
        _BUILT[key] = Lattice(pieces)
    return _BUILT[key]


def _by_length(words: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of words of one length, and these words, with a leading space, as a matrix of bytes. Long ones are left out."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    for n in np.unique(sizes[sizes <= LONG]):
        rows, most = np.flatnonzero(sizes == n), max(1, _CELLS // (16 * (int(n) + 1)))
        for i in range(0, len(rows), most):
            own = rows[i : i + most]
            flat = b"".join(b" " + words[j] for j in own)
            yield own, np.frombuffer(flat, np.uint8).reshape(len(own), int(n) + 1)


def word_scores(words: list[bytes], pieces: list[bytes], scores: np.ndarray) -> np.ndarray:
    """log10 of each word's probability over all segmentations; the end, as the empty word, has its own."""
    lattice, padded, out = _lattice(pieces), np.append(scores[:-1], -np.inf), np.zeros(len(words))
    for rows, x in _by_length(words):
        found = {size: padded[e] for size, e in lattice.edges(x).items()}
        out[rows] = lattice.forward(found, x.shape[1])[-1] / np.log(10)
    for i, w in enumerate(words):
        if len(w) > LONG:
            out[i] = Long(w, lattice, padded).whole() / np.log(10)
    out[[i for i, w in enumerate(words) if w == _END]] = scores[-1] / np.log(10)
    return out


def with_counts(spelled: np.ndarray, n: np.ndarray, n_all: int, n_kinds: int) -> np.ndarray:
    """log10 of the words' probabilities with an arc of their own beside their spellings, which share the discounted mass."""
    if not n_all:
        return spelled
    with np.errstate(divide="ignore"):
        own = np.log10(np.maximum(n - DISCOUNT, 0) / n_all)
    rest = spelled + np.log10(DISCOUNT * n_kinds / n_all)
    top = np.maximum(own, rest)
    return top + np.log10(10.0 ** (own - top) + 10.0 ** (rest - top))


def expected_counts(words: list[bytes], pieces: list[bytes], scores: np.ndarray, times: np.ndarray | None = None) -> np.ndarray:
    """How often each piece occurs in the words, each of them so many times, on average over their segmentations."""
    lattice, padded, out = _lattice(pieces), np.append(scores[:-1], -np.inf), np.zeros(len(pieces) + 1)
    for rows, x in _by_length(words):
        edges, n = lattice.edges(x), x.shape[1]
        found = {size: padded[e] for size, e in edges.items()}
        a, b = lattice.forward(found, n), lattice.backward(found, n)
        forth, back = np.stack(a, axis=1), np.stack(b, axis=1)
        whole = forth[:, -1:]
        weight = 1.0 if times is None else times[rows][:, None]
        for size, e in edges.items():
            p = np.exp(forth[:, : n - size + 1] + found[size] + back[:, size:] - whole) * weight
            out += np.bincount(e.ravel(), p.ravel(), len(out))
    for i, w in enumerate(words):
        if len(w) > LONG:
            Long(w, lattice, padded).counts(out, 1.0 if times is None else float(times[i]))
    return out[:-1]


def _words(text: bytes | None) -> list[bytes]:
    return (text or b"").lower().split()


def _counter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    train, other = Counter(), Counter()

    def flush() -> pa.RecordBatch:
        words = [*train, *other]
        own, rest = [*train.values(), *[0] * len(other)], [*[0] * len(train), *other.values()]
        train.clear()
        other.clear()
        return pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array(own, pa.int64()), pa.array(rest, pa.int64())], names=["word", "n", "rest"])

    for batch in batches:
        for held, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
            words = _words(text)
            words.append(_END)
            (other if held else train).update(words)
            if len(train) + len(other) > FLUSH:
                yield flush()
    yield flush()


def count_words(docs: DataFrame, held: Column, text_col: str = "text") -> DataFrame:
    """word (binary), n in texts to learn from, rest in the others; the end is the empty word."""
    rows = docs.select(held.alias("held"), F.col(text_col))
    return rows.mapInArrow(_counter, "word binary, n long, rest long").groupBy("word").agg(F.sum("n").alias("n"), F.sum("rest").alias("rest"))


def learn_scores(words: DataFrame, pieces: list[bytes], passes: int = PASSES) -> np.ndarray:
    """Natural logarithms of the pieces' and the end's probabilities. What reaches the driver is a number per piece."""
    sc, scores = words.sparkSession.sparkContext, rank_scores(len(pieces))
    ends = words.filter(F.col("word") == F.lit(_END)).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    if not ends:
        return scores
    known = words.filter((F.col("n") > 0) & (F.col("word") != F.lit(_END))).select("word", "n")
    for step in range(passes):
        shared = sc.broadcast((pieces, scores))

        def expect(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            own, now = shared.value
            total = np.zeros(len(own))
            for batch in batches:
                total += expected_counts(batch.column(0).to_pylist(), own, now, batch.column(1).to_numpy().astype(float))
            some = np.flatnonzero(total > 0)
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(total[some])], names=["piece", "n"])

        got = known.mapInArrow(expect, "piece int, n double").groupBy("piece").agg(F.sum("n").alias("n")).toArrow()
        n = np.zeros(len(pieces) + 1)
        n[got.column("piece").to_numpy()] = got.column("n").to_numpy()
        n[-1] = ends
        if step < passes - 1:
            n += _SMOOTH
        else:
            kept = np.maximum(n - DISCOUNT, 0)
            before = np.exp(rank_scores(len(pieces)))
            n = kept + (n.sum() - kept.sum() + _SMOOTH) * before
        scores = np.log(n / n.sum())
    return scores


def score_texts(docs: DataFrame, held: Column, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY, passes: int = PASSES, hot: int = HOT_WORDS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, word_score: a row for each row of docs."""
    spark = docs.sparkSession
    pieces = load_pieces(vocabulary)
    words = cut(count_words(docs, held, text_col))
    n_all, n_kinds = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.when(F.col("n") > 0, 1))).first()
    model = spark.sparkContext.broadcast((pieces, learn_scores(words, pieces, passes)))
    below = float(np.log10(n_all + n_kinds + 1))

    def value(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, scores = model.value
        for batch in batches:
            kinds, n = batch.column(0).to_pylist(), batch.column(1).to_numpy()
            spelled = word_scores(kinds, own, scores)
            whole = with_counts(spelled, n.astype(float), n_all, n_kinds)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(np.log10(n + 1.0) - below), pa.array(spelled), pa.array(whole)], names=["word", "n", "rest", "base", "lm", "whole"])

    valued = cut(words.mapInArrow(value, "word binary, n long, rest long, base double, lm double, whole double"))
    step = F.floor(F.log2(F.col("n") + F.col("rest")) * 16).cast("int")
    room, space, least = hot, HOT_BYTES, 1 << 30
    by_step = valued.groupBy(step.alias("step")).agg(F.count("*").alias("kinds"), F.sum(F.octet_length("word")).alias("size"))
    for r in sorted(by_step.collect(), reverse=True):  # at most 16 steps a doubling
        if r["kinds"] > room or r["size"] > space:
            break
        room, space, least = room - r["kinds"], space - r["size"], r["step"]
    common = valued.filter((step >= least) | (F.col("word") == F.lit(_END))).select("word", "n", "base", "lm", "whole").toArrow()
    values = zip(common.column("base").to_pylist(), common.column("lm").to_pylist(), common.column("whole").to_pylist(), pc.greater(common.column("n"), 0).to_pylist(), strict=True)
    at_once = spark.sparkContext.broadcast(dict(zip(common.column("word").to_pylist(), values, strict=True)))
    id_type = docs.schema[id_col].dataType.simpleString()

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each text with the sums over its common words, and a row for each of its other words."""
        hot_words, task, row = at_once.value, TaskContext.get().partitionId() << 40, 0
        for batch in batches:
            uid, doc, word, n, base, lm, whole, known = [], [], [], [], [], [], [], []
            for i, text in enumerate(batch.column(2).cast(pa.binary()).to_pylist()):
                key, own, b, s, u, k = task + row, 0, 0.0, 0.0, 0.0, 0
                tokens = Counter(_words(text))
                tokens[_END] = 1
                for w, c in tokens.items():
                    if (v := hot_words.get(w)) is None:
                        uid.append(key)
                        doc.append(None)
                        word.append(w)
                        n.append(c)
                        base.append(None)
                        lm.append(None)
                        whole.append(None)
                        known.append(None)
                    else:
                        own, b, s, u, k = own + c, b + c * v[0], s + c * v[1], u + c * v[2], k + c * v[3]
                uid.append(key)
                doc.append(i)
                word.append(b" %d" % key)  # no word has a space
                n.append(own)
                base.append(b)
                lm.append(s)
                whole.append(u)
                known.append(k)
                row += 1
            at = pa.array(doc, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(uid, pa.int64()), batch.column(0).take(at), batch.column(1).take(at), pa.array(word, pa.binary()), pa.array(n, pa.int64()), pa.array(base, pa.float64()), pa.array(lm, pa.float64()), pa.array(whole, pa.float64()), pa.array(known, pa.int64())], names=["uid", "doc_id", "held_out", "word", "n", "base", "lm", "whole", "known"])

    rows = docs.select(F.col(id_col), held.alias("held_out"), F.col(text_col)).mapInArrow(split, f"uid long, doc_id {id_type}, held_out boolean, word binary, n long, base double, lm double, whole double, known long")
    rest = valued.filter((step < least) & (F.col("word") != F.lit(_END))).select(F.col("word").alias("w"), F.col("n").alias("c"), F.col("base").alias("b"), F.col("lm").alias("s"), F.col("whole").alias("u"))
    both = rows.join(rest, rows["word"] == rest["w"], "left")
    sums = both.groupBy("uid").agg(
        F.max("doc_id").alias("doc_id"),
        F.max("held_out").alias("held_out"),
        F.sum("n").alias("n_tokens"),
        F.sum(F.coalesce("known", F.when(F.col("c") > 0, F.col("n")), F.lit(0))).alias("n_known"),
        F.sum(F.coalesce("base", F.col("n") * F.col("b"))).alias("base_score"),
        F.sum(F.coalesce("lm", F.col("n") * F.col("s"))).alias("score"),
        F.sum(F.coalesce("whole", F.col("n") * F.col("u"))).alias("word_score"),
    )
    return sums.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(n_all).cast("long").alias("train_tokens"), "base_score", "score", "word_score")
