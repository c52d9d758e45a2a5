"""Language identification by prediction with partial matching (PPM).

A language's statistics are the counts of every byte after each context of up to three bytes (the context tree down to
order 3), taken from a bounded sample of its labelled training texts. A byte seen after its longest context costs
-log2(c / (n + q)) bits, n and q being the context's count and number of different successors; otherwise an escape of
-log2(q / (n + q)) bits is paid and the context is shortened (method C), down to 8 bits for a byte never seen. The
statistics are frozen, so a text's code length is a sum of table entries, and the language with the shortest code wins.
The score is that language's posterior probability when all languages are equally likely beforehand.

The sample is drawn by a hash of id and text: about `sample_docs` texts and `sample_bytes` bytes of each language at most,
and at least one text, so every label that occurs is learned. The costs are looked up by the strings of four and three
bytes that the sample holds, and in tables of pairs. They are built once per Python worker from the broadcast counts, for
TOGETHER languages at a time: the model grows with the number of languages and the sample, not with the corpus.

Defined cases: null, empty and letterless texts are `und` with score 0; with no training text every text is `und`; ties
go to the language that sorts first; ids may be null or repeat, and repeated rows count each; a text of any length is
scored whole; columns beside id, text and language are not read.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placemill.llm.common import HashIndex, Run, doc_hash, slices

UNKNOWN = "und"
#: Labelled training texts, and their bytes, per language; the bound of the fitted sample.
SAMPLE_DOCS, SAMPLE_BYTES = 1500, 8 << 20
#: Languages that share a table.
TOGETHER = 32
RESULT = "struct<lang_pred: string, score: double, bits: double>"
_PAD = np.frombuffer(b"\n\n\n", np.uint8)


def _padded(data: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts with three newlines before each, and where their own bytes are."""
    rows = np.repeat(np.arange(1, len(lengths) + 1), lengths)
    where = np.arange(len(data)) + 3 * rows
    out = np.full(len(data) + 3 * len(lengths), _PAD[0], np.uint8)
    out[where] = data
    return out, where


def _grams(x: np.ndarray) -> np.ndarray:
    """Four-byte strings that end at each position from 3 on."""
    y = x.astype(np.uint32)
    return (y[:-3] << 24) | (y[1:-2] << 16) | (y[2:-1] << 8) | y[3:]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        langs = np.array(batch.column(0).to_pylist(), object)
        for lang in sorted(set(langs)):
            texts = batch.column(1).filter(pa.array(langs == lang))
            for _, _, data, lengths in slices(texts):
                x, where = _padded(data, lengths)
                code, n = np.unique(_grams(x)[where - 3], return_counts=True)
                yield pa.RecordBatch.from_pydict({"lang": [lang] * len(code), "code": code.astype(np.int64), "n": n.astype(np.int64)})


@dataclass
class Counts:
    """Frozen statistics: language number, four-byte string and count."""

    langs: list[str]
    lang: np.ndarray
    code: np.ndarray
    n: np.ndarray
    uid: str = field(default_factory=lambda: uuid.uuid4().hex)


def _bits(c: np.ndarray, n: np.ndarray, q: np.ndarray, otherwise: np.ndarray) -> np.ndarray:
    """Cost of what was seen c times in a context seen n times with q different successors; else the other cost."""
    return np.where(c > 0, np.log2(np.maximum(n + q, 1)) - np.log2(np.maximum(c, 1)), otherwise).astype(np.float32)


def _escape(n: np.ndarray, q: np.ndarray) -> np.ndarray:
    return np.where(n > 0, np.log2(np.maximum(n + q, 1)) - np.log2(np.maximum(q, 1)), 0).astype(np.float32)


class Tables:
    """Costs of the strings of four and of three bytes that were seen, and dense ones of pairs; a row has a number per language."""

    def __init__(self, m: Counts):
        self.langs, k = m.langs, len(m.langs)
        codes, at = np.unique(m.code, return_inverse=True)
        four = np.zeros((len(codes), k))
        np.add.at(four, (at, m.lang), m.n)
        triples, tail = np.unique(codes & 0xFFFFFF, return_inverse=True)
        three = np.zeros((len(triples), k))
        np.add.at(three, tail, four)
        two = np.zeros((1 << 16, k))
        np.add.at(two, triples & 0xFFFF, three)
        two = two.reshape(256, 256, k)
        one = two.sum(axis=0)
        zero = _bits(one, one.sum(axis=0), (one > 0).sum(axis=0), _escape(one.sum(axis=0), (one > 0).sum(axis=0)) + np.float32(8))
        n, q = two.sum(axis=1), (two > 0).sum(axis=1)
        self.pair = _bits(two, n[:, None], q[:, None], _escape(n, q)[:, None] + zero).reshape(-1, k)
        # contexts of two bytes, then of three; a context may be one that was never the end of a string
        n, q = self._context(triples >> 8, three, 1 << 16)
        self.escape_two = _escape(n, q)
        low = self.escape_two[triples >> 8] + self.pair[triples & 0xFFFF]
        self.triple = _bits(three, n[triples >> 8], q[triples >> 8], low)
        heads, head = np.unique(codes >> 8, return_inverse=True)
        n, q = self._context(head, four, len(heads))
        self.escape_three = np.append(_escape(n, q), np.zeros((1, k), np.float32), axis=0)
        self.quad = _bits(four, n[head], q[head], self.escape_three[head] + self.triple[tail])
        self.quads, self.triples, self.heads = HashIndex(codes), HashIndex(triples), HashIndex(heads)

    @staticmethod
    def _context(of: np.ndarray, counts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        n, q = np.zeros((size, counts.shape[1])), np.zeros((size, counts.shape[1]))
        np.add.at(n, of, counts)
        np.add.at(q, of, counts > 0)
        return n, q

    def bits_of(self, data: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Code length of each text under each language."""
        k = len(self.langs)
        x, where = _padded(data, lengths)
        code = _grams(x)[where - 3].astype(np.uint64)
        found = self.quads.find(code)
        cost = np.empty((len(code), k), np.float32)
        here = found < self.quads.n
        cost[here] = self.quad[found[here]]
        gone = np.flatnonzero(~here)
        code = code[gone]
        triple = self.triples.find(code & np.uint64(0xFFFFFF))
        rest = np.empty((len(gone), k), np.float32)
        here = triple < self.triples.n
        rest[here] = self.triple[triple[here]]
        pair = code[~here].astype(np.int64)
        rest[~here] = self.escape_two[(pair >> 8) & 0xFFFF] + self.pair[pair & 0xFFFF]
        cost[gone] = self.escape_three[self.heads.find(code >> np.uint64(8))] + rest
        out, full = np.zeros((len(lengths), k)), np.flatnonzero(lengths)
        if len(full):
            starts = np.cumsum(lengths) - lengths
            out[full] = np.add.reduceat(cost, starts[full], axis=0, dtype=np.float64)
        return out


_BUILT: dict[str, Tables] = {}


def _tables(model: list[Counts]) -> list[Tables]:
    if any(c.uid not in _BUILT for c in model):
        _BUILT.clear()
        _BUILT.update({c.uid: Tables(c) for c in model})
    return [_BUILT[c.uid] for c in model]


def _has_letter(data: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    out, full = np.zeros(len(lengths), bool), np.flatnonzero(lengths)
    if not len(full):
        return out
    starts, low = np.cumsum(lengths) - lengths, data | 32
    out[full] = np.logical_or.reduceat((low >= 97) & (low <= 122), starts[full])
    for i in np.flatnonzero(~out & (lengths > 0)):  # letters beyond ASCII
        out[i] = any(c.isalpha() for c in bytes(data[starts[i] : starts[i] + lengths[i]]).decode("utf-8", "replace"))
    return out


def learn(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_docs: int = SAMPLE_DOCS, sample_bytes: int = SAMPLE_BYTES) -> list[Counts]:
    """Counts over a hash-chosen sample of each language, for TOGETHER languages each. What reaches the driver is the model."""
    run = Run(labelled.sparkSession)
    chance = F.shiftrightunsigned(doc_hash(F.col(id_col), F.col(text_col)), 11) * F.lit(2.0**-53)
    known = labelled.filter(F.col(lang_col).isNotNull()).select(F.col(lang_col).cast("string").alias("lang"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), chance.alias("chance"))
    sizes = known.groupBy("lang").agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes"), F.min("chance").alias("first"))
    share = F.greatest("first", F.least(F.lit(sample_docs) / F.col("n"), F.lit(sample_bytes) / F.greatest("bytes", F.lit(1))))
    shares = run.cut(sizes.select(F.col("lang").alias("of"), share.alias("share")))
    sample = known.join(shares, F.col("lang") == F.col("of")).filter(F.col("chance") <= F.col("share")).select("lang", "text")
    grams = run.cut(sample.mapInArrow(_count, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n")))
    langs, out = sorted(r["of"] for r in shares.collect()), []
    for i in range(0, len(langs), TOGETHER):
        own = langs[i : i + TOGETHER]
        got, number = grams.filter(F.col("lang").isin(*own)).toArrow(), {x: k for k, x in enumerate(own)}
        out.append(Counts(own, np.array([number[x] for x in got.column("lang").to_pylist()], np.int64), got.column("code").to_numpy(), got.column("n").to_numpy()))
    run.clear()
    return out


def predictor(model: Broadcast):
    """An Arrow UDF over a text column; see RESULT. bits is the winner's code length."""

    @F.arrow_udf(RESULT)
    def predict(texts: pa.Array) -> pa.Array:
        lang, score, bits = [], [], []
        tables = _tables(model.value)
        langs = [x for t in tables for x in t.langs]
        for _, _, data, lengths in slices(texts):
            if not langs:
                lang += [UNKNOWN] * len(lengths)
                score += [0.0] * len(lengths)
                bits += [0.0] * len(lengths)
                continue
            each = np.concatenate([t.bits_of(data, lengths) for t in tables], axis=1)
            best = each.argmin(axis=1)
            least = each[np.arange(len(best)), best]
            ok = _has_letter(data, lengths)
            sure = 1.0 / np.exp2(np.maximum(least[:, None] - each, -1000.0)).sum(axis=1)
            lang += [langs[b] if o else UNKNOWN for b, o in zip(best, ok, strict=True)]
            score += np.where(ok, sure, 0.0).tolist()
            bits += np.where(ok, least, 0.0).tolist()
        return pa.StructArray.from_arrays([pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(bits, pa.float64())], names=["lang_pred", "score", "bits"])

    return predict


def identify(docs: DataFrame, model: list[Counts], text_col: str = "text") -> Column:
    """The struct RESULT for each row's text."""
    return predictor(docs.sparkSession.sparkContext.broadcast(model))(F.col(text_col))
