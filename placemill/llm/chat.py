"""Chat formatting by token-level assembly.

A turn is START, its role, a line break, its text, END and a line break. START and END are reserved ids behind the vocabulary of a public
tokenizer; roles and texts are encoded segment by segment as ordinary text, so no text can make a reserved id, whatever it says. The
segments of all turns of a batch are laid out by the prefix sums of their lengths, the reserved ids are spliced in between,
and the loss mask is the prefix sum of +1 at the start and -1 at the end of each segment that is to be learnt.

Where the ids are written as a text, START and END have names, so those names inside roles and texts are escaped: `<|name|>` gets a
backslash behind its first bar, and one that has backslashes there gets one more. Taking one away reverses it. In a role, a
backslash and a line break are written as two characters first, so a role ends at the first line break.

Everything up to here is done per turn where the turn is read. `placed` numbers a conversation's turns and their first tokens by a
window of running sums, for `unrolled`, which cuts conversations to training blocks. `read_back` parses turns out of ids; `digests`
sums conversations up, turn by turn in order, so a conversation of any length is a stream with a hash as its state. (A hash of
a whole conversation is sequential, so one that holds much of the table is one task's stream; encoding and parsing are not.)

Defined cases: null roles and texts count as empty; turns go by number, nulls first, ties by a hash of their ids; repeated rows are turns each
for itself; a null conversation id is one conversation; texts of any length are encoded whole; an empty table gives no rows; further
columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import importlib.util
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The pattern that splits texts before merges, published with the vocabulary (fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Names of the reserved ids. The vocabulary's own last id stays free.
START, END = "<|im_start|>", "<|im_end|>"
LEARNT = ("assistant",)
_CONTROL = re.compile(r"<\|(\\*)(im_start|im_end|endoftext)\|>")
_TURN = "conv_id long, turn long, ids array<int>, loss array<tinyint>"


def escape(text: str) -> str:
    return _CONTROL.sub(r"<|\\\1\2|>", text)


def unescape(text: str) -> str:
    return _CONTROL.sub(lambda m: f"<|{m[1][1:]}{m[2]}|>", text)


def escape_role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


class Tokenizer:
    """Ordinary text to ids and back; START and END behind them."""

    def __init__(self, path: str):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("placemill", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.start, self.end = max(ranks.values()) + 2, max(ranks.values()) + 3
        self.line = self.encoding.encode_ordinary("\n")

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [self.encoding.encode_ordinary(t) for t in texts]

    def decode(self, ids: np.ndarray) -> str:
        return self.encoding.decode(ids.tolist())


@lru_cache(maxsize=2)
def tokenizer(path: str) -> Tokenizer:
    """One to a Python worker."""
    if importlib.util.find_spec("tiktoken") is None:
        raise ImportError("tiktoken is needed to format conversations")
    return Tokenizer(path)


def assemble(t: Tokenizer, roles: list[str], texts: list[str], learnt: tuple[str, ...] = LEARNT) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids of all turns, the mask beside them, and the n+1 places where turns begin."""
    names = {r: t.encode([escape_role(r)])[0] for r in set(roles)}
    content = t.encode([escape(x) for x in texts])
    # six segments to a turn, in the order of the template
    head, line, tail = [t.start], t.line, [t.end]
    parts = [s for r, c in zip(roles, content, strict=True) for s in (head, names[r], line, c, tail, line)]
    lengths = np.fromiter(map(len, parts), np.int64, len(parts))
    ends = np.cumsum(lengths)
    ids = np.fromiter((i for p in parts for i in p), np.int32, int(lengths.sum()))
    step = np.zeros(len(ids) + 1, np.int8)
    learn = np.array([r in learnt for r in roles]) & (lengths[3::6] > 0)
    step[(ends - lengths)[3::6][learn]] += 1
    step[ends[3::6][learn]] -= 1
    return ids, np.cumsum(step[:-1], dtype=np.int8), np.append(0, ends[5::6])


def _formatter(path: str, learnt: tuple[str, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizer(path)
        for batch in batches:
            if batch.num_rows:
                ids, loss, at = assemble(t, batch.column(2).to_pylist(), batch.column(3).to_pylist(), learnt)
                at = pa.array(at.astype(np.int32))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.ListArray.from_arrays(at, pa.array(ids)), pa.ListArray.from_arrays(at, pa.array(loss))], ["conv_id", "turn", "ids", "loss"])

    return run


def format_turns(conversations: DataFrame, path: str = VOCABULARY, learnt: tuple[str, ...] = LEARNT) -> DataFrame:
    """conv_id, turn, ids, loss: each turn's tokens, with 1 where they are to be learnt. Nothing is shuffled."""
    rows = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(_formatter(path, learnt), _TURN)


def placed(turns: DataFrame) -> DataFrame:
    """number (from 0) and first (place of the first token) of each turn in its conversation."""
    order = W.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), F.xxhash64("ids"))
    before = F.coalesce(F.sum(F.size("ids").cast("long")).over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0).cast("long"))
    return turns.select("conv_id", (F.row_number().over(order) - 1).cast("long").alias("number"), before.alias("first"), "ids", "loss")


def parse(t: Tokenizer, ids: np.ndarray, loss: np.ndarray) -> list[tuple[str, str, str, int]]:
    """role, text, text under the mask, characters when written out, of each turn in a run of ids."""
    out = []
    starts, ends = np.flatnonzero(ids == t.start), np.flatnonzero(ids == t.end)
    for n, (a, b) in enumerate(zip(starts, ends, strict=True)):
        body = t.decode(ids[a + 1 : b])
        after = t.decode(ids[b + 1 : starts[n + 1] if n + 1 < len(starts) else len(ids)])
        role, text = body.split("\n", 1)
        learnt = t.decode(ids[a + 1 : b][loss[a + 1 : b] > 0])
        out.append((unescape_role(role), unescape(text), unescape(learnt), len(START) + len(body) + len(END) + len(after)))
    return out


def _reader(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizer(path)
        for batch in batches:
            conv, turn, tie = (batch.column(i).to_pylist() for i in range(3))
            ids, loss = batch.column(3), batch.column(4)
            rows: list[tuple] = []
            for i in range(batch.num_rows):
                rows += [(conv[i], turn[i], tie[i], n, *p) for n, p in enumerate(parse(t, ids[i].values.to_numpy(), loss[i].values.to_numpy()))]
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], ["conv_id", "turn", "tie", "part", "role", "text", "learnt", "n_chars"])

    return run


def read_back(turns: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """conv_id, turn, tie, part, role, text, learnt, n_chars of every turn found in the ids. Nothing is shuffled."""
    return turns.select("conv_id", "turn", F.xxhash64("ids").alias("tie"), "ids", "loss").mapInArrow(_reader(path), "conv_id long, turn long, tie long, part int, role string, text string, learnt string, n_chars long")


def _digester(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by conversation and turn: hashes go on from batch to batch."""
    now: tuple | None = None  # id, turns, hash of turns, learnt characters, hash of them, characters
    done: list[tuple] = []

    def close() -> None:
        if now is not None:
            done.append((now[0], now[1], now[2].hexdigest(), now[3], now[4].hexdigest(), now[5]))

    def flush() -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
        out = pa.RecordBatch.from_arrays([pa.array([r[i] for r in done], k) for i, k in enumerate(kinds)], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])
        done.clear()
        return out

    for batch in batches:
        for conv, role, text, learnt, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if now is None or now[0] != conv:
                close()
                now = (conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0)
            now[2].update(f"{role}\n{text}\n".encode())
            now[4].update(learnt.encode())
            now = (conv, now[1] + 1, now[2], now[3] + len(learnt), now[4], now[5] + n)
        yield flush()
    close()
    yield flush()


def digests(turns: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars of each conversation, read back from its turns' ids."""
    sorted_ = read_back(turns, path).repartition("conv_id").sortWithinPartitions("conv_id", "turn", "tie", "part")
    return sorted_.select("conv_id", "role", "text", "learnt", "n_chars").mapInArrow(_digester, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def unrolled(turns: DataFrame, length: int) -> DataFrame:
    """Blocks of at most `length` tokens of placed turns for training: conv_id, block, ids, loss. A turn is cut where a block ends."""
    row = turns.select("conv_id", "first", "ids", "loss", F.size("ids").alias("n"))
    block = F.explode(F.sequence(F.expr(f"first div {length}"), F.expr(f"(first + n - 1) div {length}"))).alias("block")
    cuts = row.select("*", block).select("*", F.greatest(F.lit(0), F.col("block") * length - F.col("first")).cast("int").alias("a"), F.least(F.col("n"), (F.col("block") + 1) * length - F.col("first")).cast("int").alias("b"))
    piece = cuts.select("conv_id", "block", F.struct("first", F.slice("ids", F.col("a") + 1, F.col("b") - F.col("a")).alias("ids"), F.slice("loss", F.col("a") + 1, F.col("b") - F.col("a")).alias("loss")).alias("s"))
    parts = piece.groupBy("conv_id", "block").agg(F.sort_array(F.collect_list("s")).alias("s"))  # a block bounds what is collected
    return parts.select("conv_id", "block", F.flatten("s.ids").alias("ids"), F.flatten("s.loss").alias("loss"))
