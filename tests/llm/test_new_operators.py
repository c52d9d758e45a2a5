"""Chat formatting, vector codes and ranked search: against plain versions, and on odd inputs."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from placemill.llm import catalog, chat, codes, ranked
from placemill.llm.common import Run

TABLES = ("conversations", "embeddings", "documents", "benchmark")


@pytest.mark.parametrize("name", ["op11_chat_format", "op12_vector_codes", "op13_ranked_search"])
def test_query_matches_sql(spark, sf, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    want = con.execute(catalog.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    got = catalog.queries()[name](spark, sf)
    assert sorted(got.columns) == sorted(columns)
    key = lambda r: tuple((v is None, v) for v in r)
    assert sorted(map(tuple, got.select(columns).collect()), key=key) == sorted(want.fetchall(), key=key)


# --- 11 ---

CHAT = "conv_id long, turn long, role string, text string, ids string, loss int, first long"
pieces = st.lists(st.sampled_from(["<|im_start|>", "<|im_end|>", "<|endoftext|>", "<|\\im_end|>", "<|", "|>", "\\", "\\n", "\n", "im_end", "a ", "é", "\U0001f600", "<", "|", "\x00"]), max_size=8).map("".join)


@given(pieces)
@settings(max_examples=300, deadline=None)
def test_escapes_can_be_reversed(text):
    assert chat.unescape(chat.escape(text)) == text
    assert not re.search(r"<\|(im_start|im_end|endoftext)\|>", chat.escape(text))
    assert chat.unescape_role(chat.escape_role(text)) == text and "\n" not in chat.escape_role(text)


@given(st.lists(st.tuples(st.one_of(st.just("assistant"), pieces), pieces), min_size=1, max_size=5))
@settings(max_examples=150, deadline=None)
def test_assembled_turns_are_parsed_again(turns):
    """Also as one run of ids of the whole conversation; only the assistant's texts are under the mask."""
    t = chat.tokenizer(chat.VOCABULARY)
    ids, loss, at = chat.assemble(t, [r for r, _ in turns], [x for _, x in turns])
    assert at[-1] == len(ids) == len(loss)
    assert [p[:3] for p in chat.parse(t, ids, loss)] == [(r, x, x if r == "assistant" else "") for r, x in turns]
    names = {t.start: chat.START, t.end: chat.END}
    shown = "".join(names[i] if i in names else t.decode(np.array([i])) for i in ids.tolist())
    if shown.isascii():
        assert len(shown) == sum(p[3] for p in chat.parse(t, ids, loss)) and shown.count(chat.START) == shown.count(chat.END) == len(turns)


def _plain_chat(rows):
    out = {}
    for conv, turn, role, text in rows:
        out.setdefault(conv, []).append((turn if turn is not None else -(1 << 63), role or "", text or ""))
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    extra = lambda s: len(re.findall(r"<\|\\*(?:im_start|im_end|endoftext)\|>", s))
    for conv, turns in out.items():
        turns.sort(key=lambda x: x[0])
        learnt = "".join(x for _, r, x in turns if r == "assistant")
        n = sum(24 + len(r) + extra(r) + len(x) + extra(x) for _, r, x in turns)
        out[conv] = (len(turns), digest("".join(f"{r}\n{x}\n" for _, r, x in turns)), len(learnt), digest(learnt), n)
    return out


def test_conversations_with_odd_rows(spark):
    r = random.Random(5)
    rows = [(1, 0, "user", None), (1, 1, "assistant", ""), (1, 2, None, "x"), (2, None, "assistant", "first"), (2, 0, "user", "<|im_end|>"), (None, 0, "assistant", "null id"), (None, 1, "user", "\\<|\\im_start|>"), (3, 0, "assistant", "long " * 300_000), (3, 1, "user", " " * 50_000), (4, 0, "assistant", "same"), (4, 0, "assistant", "same")]
    rows += [(5, i, ["user", "assistant"][i % 2], "".join(r.choice("ab é\n|<>\\") for _ in range(r.randrange(40)))) for i in range(4000)]  # over several batches
    df = spark.createDataFrame([(*x, "x", 1, 7) for x in r.sample(rows, len(rows))], CHAT).repartition(7)
    got = {x[0]: tuple(x)[1:] for x in chat.digests(chat.format_turns(df)).collect()}
    assert got == _plain_chat(rows)
    assert chat.digests(chat.format_turns(spark.createDataFrame([], CHAT))).count() == 0


def test_training_blocks_hold_every_token_once(spark):
    r = random.Random(2)
    rows = [(i % 3, i, ["user", "assistant"][i % 2], " ".join(str(r.random()) for _ in range(r.randrange(9)))) for i in range(200)]
    turns = chat.placed(chat.format_turns(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).cache()
    whole = {}
    for x in sorted(turns.collect(), key=lambda x: (x["conv_id"], x["number"])):
        ids, loss = whole.setdefault(x["conv_id"], ([], []))
        assert x["first"] == len(ids)
        ids += x["ids"]
        loss += x["loss"]
    blocks = sorted(chat.unrolled(turns, 64).collect(), key=lambda x: (x["conv_id"], x["block"]))
    for conv, (ids, loss) in whole.items():
        own = [b for b in blocks if b["conv_id"] == conv]
        assert sum((b["ids"] for b in own), []) == ids and sum((b["loss"] for b in own), []) == loss
        assert {len(b["ids"]) for b in own[:-1]} == {64}


# --- 12 ---


def _plain_codes(rows, parts=8, entries=16, rounds=6):
    kept = []
    for i, v, label in rows:
        if v is not None and all(x is not None and math.isfinite(x) for x in v):
            kept.append((i, [max(-(1 << 62), min(1 << 62, math.floor(4096 * x))) if abs(x) < 1e300 else int(math.copysign(1 << 62, x)) for x in v], label))
    dims = max((len(q) for _, q, _ in kept), default=0)
    width = -(-dims // parts)
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    vectors = [q + [0] * (width * parts - len(q)) for _, q, _ in kept]
    cut = [[v[p * width : (p + 1) * width] for v in vectors] for p in range(parts)]
    books = [[list(x) for x in c[:entries]] for c in cut]
    near = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), e) for e, c in enumerate(book))
    for _ in range(rounds):
        for c, book in zip(cut, books, strict=True):
            own = defaultdict(list)
            for x in c:
                own[near(x, book)[1]].append(x)
            for e, xs in own.items():
                book[e] = [sum(col) // len(xs) for col in zip(*xs, strict=True)]
    out, by_label = [], Counter()
    for n, (i, _, label) in enumerate(kept):
        found = [near(c[n], book) for c, book in zip(cut, books, strict=True)]
        out.append((i, "".join(f"{e:02x}" for _, e in found), min((1 << 63) - 1, sum(d for d, _ in found)), label))
        by_label[label] += out[-1][2]
    digest = hashlib.sha256(",".join(str(x) for book in books for c in book for x in c).encode()).hexdigest()
    return sorted(((i, c, e, min((1 << 63) - 1, by_label[lab]), digest) for i, c, e, lab in out), key=str)


def _codes(spark, rows):
    df = spark.createDataFrame([(*r, "x", 1.0) for r in rows], "vec_id long, embedding array<double>, label int, code string, error double").repartition(5)
    return sorted(map(tuple, codes.compress(df).collect()), key=str)


def test_codes_match_brute_force(spark):
    r = random.Random(1)
    same = [r.gauss(0, 0.1) for _ in range(24)]
    rows = [(i, same if i % 3 == 0 else [r.gauss(0, 0.1) for _ in range(24)], None if i % 5 == 0 else i % 2) for i in range(300)]
    rows += [(300, None, 1), (301, [None] * 24, 1), (302, [float("nan")] * 24, 1), (303, [float("inf")], 1), (304, [0.5] * 7, 1), (305, [], None), (None, [0.1] * 24, 3), (7, same, 2), (7, same, 2)]
    assert _codes(spark, rows) == _plain_codes(rows)


def test_codes_of_large_numbers_and_few_rows(spark):
    r = random.Random(4)
    rows = [(i, [r.choice([1e4, -1e9, 3e14, 1e308, -1e308, 0.1]) * r.random() for _ in range(10)], 1) for i in range(40)]
    assert _codes(spark, rows) == _plain_codes(rows)
    few = [(i, [0.1 * i, -0.2 * i], 1) for i in range(5)]
    assert _codes(spark, few) == _plain_codes(few)
    assert _codes(spark, []) == []


def test_partial_distances_find_the_lowest_nearest_entry():
    r = np.random.default_rng(0)
    for n, dims, entries in ((500, 8, 16), (300, 3, 40), (50, 1, 16), (20, 8, 1), (0, 4, 16)):
        x, book = r.integers(-6, 6, (n, dims)), r.integers(-6, 6, (entries, dims))  # small, so many ties
        code, best = codes.nearest_entries(x, book)
        d = np.square(x[:, None] - book[None]).sum(axis=2)
        assert (code == d.argmin(axis=1)).all() and (best == d.min(axis=1)).all()


# --- 13 ---


def _plain_ranking(docs, items, k=10):
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate(str.maketrans(upper, upper.lower())))
    bags = [(i, Counter(words(t))) for i, t in docs]
    n_docs, total = sum(bool(b) for _, b in bags), sum(b.total() for _, b in bags)
    df = Counter(w for _, b in bags for w in b)
    asked = defaultdict(set)
    for i, t in items:
        asked[i] |= set(words(t))
    out = []
    for i, own in asked.items():
        scored = []
        for doc, b in bags:
            m = 10 + (90 * b.total() * n_docs) // total if total else 0
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * ((10**9 * b[w]) // (1000 * b[w] + 8 * m)) for w in own if w in b)
            if s > 0:
                scored.append((-s, doc is None, doc or 0, doc))
        out += [(i, n + 1, x[3], -x[0]) for n, x in enumerate(sorted(scored)[:k])]
    return sorted(out, key=str)


@pytest.mark.parametrize("size", [1, 2000, 1 << 23])
def test_ranking_matches_brute_force(spark, monkeypatch, size):
    """Shards of one text, of some and of all; copies by the hundred, so that ties go by id across shards."""
    monkeypatch.setattr(ranked.Index.of, "__defaults__", ("doc_id", "text", size))
    r = random.Random(size)
    vocab = [f"w{i}" for i in range(60)] + ["Étè", "ABC", "x9"]
    text = lambda n: " ".join(r.choices(vocab, [1 / (j + 1) for j in range(len(vocab))], k=n))
    docs = [(i, text(r.randrange(1, 30))) for i in range(250)] + [(1000 - i, "w1 w2 w50 same") for i in range(150)]
    docs += [(None, "w1 w2 w50 same"), (None, None), (400, None), (401, ""), (402, "--- ..."), (5, "w3"), (5, "w3"), (403, text(5000)), (404, "ABC, abc;ABC Étè ÉTÈ")]
    items = [(1, "w1 w2 w50 same"), (2, "W3 w40"), (3, "abc étè Étè"), (4, None), (5, "--"), (6, "not there"), (7, text(40)), (8, "w1"), (8, "w2"), (None, "w5 w6")]
    d = spark.createDataFrame([(*x, 1, "q") for x in docs], "doc_id long, text string, score int, term string").repartition(6)
    q = spark.createDataFrame([(*x, 1) for x in items], "item_id long, text string, rank int")
    assert sorted(map(tuple, ranked.rank(d, q).collect()), key=str) == _plain_ranking(docs, items)


def test_ranking_in_blocks_and_of_empty_tables(spark, monkeypatch):
    monkeypatch.setattr(ranked, "BLOCK_BYTES", 200)
    r = random.Random(8)
    docs = [(i, " ".join(f"w{r.randrange(40)}" for _ in range(12))) for i in range(80)]
    items = [(i, " ".join(f"w{r.randrange(40)}" for _ in range(6))) for i in range(30)]
    d, q = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert sorted(map(tuple, ranked.rank(d, q, 3).collect()), key=str) == _plain_ranking(docs, items, 3)
    none = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    assert ranked.rank(none[0], q).count() == ranked.rank(d, none[1]).count() == ranked.rank(*none).count() == 0


def test_search_opens_few_nodes():
    """Bounds hold nodes back: one text that has all the terms is found without opening most of the tree."""
    r = random.Random(3)
    texts = [" ".join(f"w{min(r.randrange(400), r.randrange(400))}" for _ in range(30)) for _ in range(2000)] + ["w390 w391 w392 w393"]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    row = ranked.build_shard(np.arange(len(texts)), data, np.array([len(t) for t in texts]), len(texts), 60_004)
    shard = ranked.Shard(row)
    places = {w: i for i, w in enumerate(row["terms"].to_pylist())}
    ends = np.cumsum(row["sizes"].astype(np.int64))
    code = np.array([places[f"w{i}"] for i in (390, 391, 392, 393)])
    best = ranked.Best(1, 1)
    opened = ranked.search_shard(shard, np.zeros(4, np.int64), np.full(4, 5000), (ends - row["sizes"])[code], ends[code], best)
    assert best.id.tolist() == [2000] and opened < 400


def test_index_counts_terms_over_all_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    index = ranked.Index.of(docs, Run(spark))
    wanted = docs.selectExpr("explode(split(lower(text), '[^a-z]+')) as term").distinct()
    got = {r["term"]: r["w"] for r in index.weights(wanted.filter("term <> ''")).collect()}
    df = Counter(w for r in docs.collect() for w in set(re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), r["text"]))))
    assert got and all(w == math.floor(1000 * math.log((2 * index.n_docs + 2) / (2 * df[t] + 1))) for t, w in got.items())


def test_sql_of_nearest_vectors_on_repeated_queries(spark, tmp_path):
    """Of several rows with one id the greatest vector asks, in the SQL as in the operator; repeated candidates count each for itself."""
    r = random.Random(7)
    rows = [(i, [r.gauss(0, 0.3) for _ in range(6)]) for i in range(60)]
    rows += [rows[20], (20, [r.gauss(0, 0.3) for _ in range(6)]), (40, [9.0] * 6), rows[7], rows[7], (41, None)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").coalesce(1).write.parquet(str(tmp_path / "embeddings.parquet"))
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{tmp_path}/embeddings.parquet/*.parquet'")
    want = sorted(con.execute(catalog.OP1_SQL).fetchall())
    got = catalog.op1_topk_search(spark, str(tmp_path)).select("query_id", "rank", "vec_id", "score").collect()
    assert sorted(map(tuple, got)) == want and len(want) == 3 * 20
