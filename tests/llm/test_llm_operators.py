"""Each operator against a plain version, and on nulls, empty and long texts, ties, repeated rows, empty tables and extra columns."""

import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from placemill.llm import catalog, chunks, decontaminate, language, licenses, lm, mixing, neardup, pii, topk, urls

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, s string, w array<string>, label int, score double, h long, key long"
PROSE = "of the land and sea they spoke in turns while rain fell on old roofs and bells rang far away over fields"


def _docs(spark, rows):
    return spark.createDataFrame([(i, t, lang, src, len(t or ""), "x", ["y"], 1, 0.5, 7, 9) for i, t, lang, src in rows], SCHEMA)


@pytest.fixture(scope="module")
def odd(spark):
    """Null and empty texts, sources, languages and ids; repeats; ties; one very long text."""
    long_text = " ".join(f"word{i % 5000} item{i}" for i in range(40_000))
    rows = [(1, None, "en", "a"), (2, "", "en", "a"), (3, "   \n\t ", None, "b"), (4, "one two", "en", None), (5, PROSE, "en", "a"), (5, PROSE, "en", "a"), (6, PROSE, "de", "b"), (None, PROSE, None, None), (7, long_text, "en", "a"), (8, "12 34 -- !!", "de", "a"), (9, "x" * 3000, "de", "b"), (10, PROSE + " MIT License", "de", "c")]
    return _docs(spark, rows)


@pytest.fixture(scope="module")
def none(spark):
    return _docs(spark, [])


@pytest.fixture(scope="module")
def texts(sf):
    t = pq.read_table(f"{sf}/documents.parquet").to_pydict()
    return dict(zip(t["doc_id"], t["text"], strict=True)), dict(zip(t["doc_id"], t["lang"], strict=True))


# --- 1 ---


def _plain_topk(rows, k):
    ok = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    asks = {}
    for i, v in rows:
        if i is not None and i % 20 == 0 and (i, v) and any(j == i for j, _ in ok):
            asks[i] = max(w for j, w in ok if j == i)
    for i, q in asks.items():
        scored = sorted(((-max(-(1 << 63), min((1 << 63) - 1, sum(a * b for a, b in zip(q, x, strict=False)))), j) for j, x in ok if j != i))[:k]
        out += [(i, n + 1, j, -s) for n, (s, j) in enumerate(scored)]
    return sorted(out)


def test_topk_matches_brute_force(spark):
    r = random.Random(3)
    same = [r.gauss(0, 0.2) for _ in range(40)]
    rows = [(i, same if i % 3 == 0 else [r.gauss(0, 0.2) for _ in range(40)]) for i in range(400)]
    rows += [(400, None), (401, [None] * 40), (402, [float("nan")] * 40), (403, [float("inf")] * 40), (None, same), (404, [0.5] * 7), (405, []), (41, same), (41, same), (440, [1e5] * 40)]
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<double>, rank int, score string").repartition(5)
    got = sorted(tuple(x) for x in topk.nearest(df, F.col("vec_id") % 20 == 0).collect())
    assert got == _plain_topk(rows, 20)


def test_topk_of_few_and_no_rows(spark):
    schema = "vec_id long, embedding array<float>"
    assert topk.nearest(spark.createDataFrame([], schema), F.col("vec_id") % 20 == 0).count() == 0
    got = topk.nearest(spark.createDataFrame([(0, [1.0]), (1, [2.0])], schema), F.col("vec_id") % 20 == 0).collect()
    assert [tuple(x) for x in got] == [(0, 1, 1, 64 * 128)]


def test_topk_of_large_numbers_and_half_valid_ids(spark):
    """Sums beyond 2^53, components beyond 2^46, and an id of a valid and an invalid row."""
    rows = [(20, [1.0, 2.0]), (20, [float("nan"), 9.0]), (1, [3e5 + 1 / 64, 1.0]), (2, [2.0**46, -(2.0**20)]), (3, [-(2.0**46), 1.0]), (40, [3e5, 3e5 + 3 / 64]), (4, [3e5 + 5 / 64, 3e5 + 7 / 64]), (60, [2.0**46, 1 / 64])]
    rows += [(100 + i, [float(i % 7), float(i % 11)]) for i in range(60)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = sorted(tuple(x) for x in topk.nearest(df, F.col("vec_id") % 20 == 0, k=5).collect())
    assert got == _plain_topk(rows, 5) and any(s > 2**53 for *_, s in got) and {q for q, *_ in got} >= {20, 40, 60}


def test_topk_over_many_groups(spark, monkeypatch):
    """A grid of several cells, with bars from the first group."""
    monkeypatch.setattr(topk, "GROUP", 64)
    monkeypatch.setattr(topk, "BLOCK", 8)
    r = random.Random(9)
    rows = [(i, [r.gauss(0, 0.2) for _ in range(20)]) for i in range(500)]
    got = sorted(tuple(x) for x in topk.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(6), F.col("vec_id") % 20 == 0, k=7).collect())
    assert got == _plain_topk([(i, np.array(v, np.float32).astype(float).tolist()) for i, v in rows], 7)


# --- 2 ---


def test_lattice_sums_over_all_segmentations():
    pieces = [b" ", b"a", b"b", b"ab", b" a", b"aba", b"ba"]
    scores = np.log(np.array([0.1, 0.2, 0.1, 0.2, 0.1, 0.1, 0.1, 0.1]))
    p = dict(zip(pieces, np.exp(scores), strict=False))
    for word in (b"a", b"ab", b"abab", b"bbaba"):
        text, total = b" " + word, 0.0
        for cuts in itertools.product([0, 1], repeat=len(text) - 1):
            parts, at = [], 0
            for i, c in enumerate([*cuts, 1], 1):
                if c:
                    parts.append(text[at:i])
                    at = i
            total += math.prod(p.get(x, 0.0) for x in parts)
        assert lm.word_scores([word], pieces, scores)[0] == pytest.approx(math.log10(total))
    assert lm.word_scores([b""], pieces, scores)[0] == pytest.approx(math.log10(0.1))
    counts = lm.expected_counts([b"abab"], pieces, scores)
    assert sum(c * len(x) for c, x in zip(counts, pieces, strict=True)) == pytest.approx(5)


@pytest.mark.parametrize("segment", [1, 2, 7, 64, 1000])
def test_long_words_in_segments_equal_the_plain_lattice(monkeypatch, segment):
    pieces = [*[bytes([b]) for b in range(32, 128)], b" a", b"ab", b"abc", b"bca", b"abcabc", b" abca", b"cab"]
    rng = np.random.default_rng(3)
    scores = np.log(rng.dirichlet(np.ones(len(pieces) + 1)))
    words = [bytes(rng.choice(list(b"abcx"), n).astype(np.uint8)) for n in (1, 2, 3, 5, 63, 64, 65, 300)] + [b"abc" * 40, b""]
    times = rng.integers(1, 9, len(words)).astype(float)
    plain = lm.word_scores(words, pieces, scores), lm.expected_counts(words, pieces, scores, times)
    monkeypatch.setattr(lm, "LONG", 0)
    monkeypatch.setattr(lm, "SEGMENT", segment)
    assert lm.word_scores(words, pieces, scores) == pytest.approx(plain[0], rel=1e-12)
    assert lm.expected_counts(words, pieces, scores, times) == pytest.approx(plain[1], rel=1e-9, abs=1e-12)


def test_a_word_of_a_megabyte_is_scored_whole(spark):
    """The bound of the broadcast is one of bytes, so the long word is joined; its copies are one word."""
    blob = "".join(map(chr, np.random.default_rng(5).integers(97, 123, 1 << 20)))
    docs = _docs(spark, [(1, f"{PROSE} {blob}", "en", "a"), (2, blob, "en", "a"), (3, PROSE, "en", "a")])
    got = {r["doc_id"]: r for r in lm.score_texts(docs, F.col("doc_id") == 3).collect()}
    pieces = lm.load_pieces()
    scores = lm.learn_scores(lm.count_words(docs, F.col("doc_id") == 3), pieces)
    assert got[2]["score"] == pytest.approx(lm.word_scores([blob.encode()], pieces, scores)[0] + scores[-1] / math.log(10))
    assert got[1]["score"] - got[3]["score"] == pytest.approx(got[2]["score"] - scores[-1] / math.log(10))
    assert got[2]["n_tokens"] == 2 and got[2]["n_known"] == 2


def test_lm_base_and_edges(spark, odd, none):
    held = F.col("doc_id").eqNullSafe(6)
    got = lm.score_texts(odd, held, hot=3).collect()
    assert len(got) == odd.count()
    train = Counter()
    for r in odd.collect():
        if r["doc_id"] != 6:
            train.update((r["text"] or "").encode().lower().split() + [b""])
    n, v = sum(train.values()), len(train)
    for r in got:
        assert r["train_tokens"] == n and r["score"] <= 0 and math.isfinite(r["score"])
    one = next(r for r in got if r["doc_id"] == 6)
    words = PROSE.encode().split() + [b""]
    assert one["held_out"] and one["n_tokens"] == len(words) == one["n_known"]
    assert one["base_score"] == pytest.approx(sum(math.log10((train[w] + 1) / (n + v + 1)) for w in words))
    assert lm.score_texts(none, held).count() == 0


def _plain_lattice(text, p):
    """log10 of a text's probability: every segmentation of each word, and the end."""
    out = math.log10(p[b""])
    for word in text.encode().lower().split():
        x = b" " + word
        at = [1.0] + [0.0] * len(x)
        for j in range(1, len(x) + 1):
            at[j] = sum(at[i] * p.get(x[i:j], 0.0) for i in range(j))
        out += math.log10(at[-1])
    return out


def test_lm_scores_of_whole_texts(spark, sf, texts):
    """Scores by plain recursion over the learned pieces; base columns by SQL."""
    held = catalog.held_out(F.col("doc_id"), 7, 2)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = {r["doc_id"]: r for r in lm.score_texts(docs, held).collect()}
    pieces = lm.load_pieces()
    scores = lm.learn_scores(lm.count_words(docs, held), pieces)
    assert np.exp(scores).sum() == pytest.approx(1)
    p = {x: math.exp(v) for x, v in zip(pieces, scores, strict=False)} | {b"": math.exp(scores[-1])}
    for i in sorted(texts[0])[:40]:
        assert got[i]["score"] == pytest.approx(_plain_lattice(texts[0][i] or "", p), rel=1e-6)
    held_ids = [i for i in texts[0] if zlib.crc32(str(i).encode()) % 7 == 2]
    train = Counter(w for i, t in texts[0].items() if i not in set(held_ids) for w in [*(t or "").encode().lower().split(), b""])
    n, v = sum(train.values()), len(train)
    for i, r in got.items():
        own = [*(texts[0][i] or "").encode().lower().split(), b""]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (i in held_ids, len(own), sum(w in train for w in own), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((train[w] + 1) / (n + v + 1)) for w in own))


def test_lm_prefers_prose_to_noise(spark):
    docs = _docs(spark, [(i, PROSE, "en", "a") for i in range(5)] + [(6, "the rain and the sea", "en", "a"), (7, "zqx jjv qqq wzx vvk", "en", "a")])
    got = {r["doc_id"]: r["score"] for r in lm.score_texts(docs, F.col("doc_id") > 5).collect()}
    assert got[6] > got[7]


# --- 3 ---


def test_pseudonyms_keep_format_and_link():
    p, back = pii.Pseudonyms(b"k"), pii.Pseudonyms(b"k", back=True)
    text = "card 4111 1111 1111 1111 or 4111-1111-1111-1111, +1 (017) 555-7713, 10.0.0.1, a.b7@mail.example.com, 1980-02-29, GB82 WEST 1234 5698 7654 32, 123-45-6789"
    new, kinds = p.text(text)
    assert Counter(kinds) == Counter({"card": 2, "phone": 1, "ip": 1, "email": 1, "date": 1, "iban": 1, "ssn": 1})
    assert back.text(new)[0] == text and re.sub(r"\d+", "9", new)[:9] == re.sub(r"\d+", "9", text)[:9]
    cards = re.findall(r"4\d{3}(?:[ -]\d{4}){3}", new)
    assert len(cards) == 2 and len({re.sub(r"\D", "", c) for c in cards}) == 1 and pii.luhn(re.sub(r"\D", "", cards[0])) % 10 == 0
    for clean in ("9807915762804490", "256.1.1.1", "2023-13-45", "000-12-3456", "Version 2.0. 3.14", 'token = "04dbebab91ab85687d33"'):
        assert p.text(clean) == (clean, [])


def test_cards_before_other_digits_and_timestamps():
    p, back = pii.Pseudonyms(b"k"), pii.Pseudonyms(b"k", back=True)
    one = p.text("4111 1111 1111 1111")[0]
    for tail in (" 12/26", " 123", " 1", "-12", " 12 or more"):
        new, kinds = p.text("4111 1111 1111 1111" + tail)
        assert (new, kinds) == (one + tail, ["card"]) and back.text(new)[0] == "4111 1111 1111 1111" + tail
    new, kinds = p.text("4111111111111111 123 and 4111111111111111 4111111111111111")
    assert kinds == ["card"] * 3 and "4111111111111111" not in new and new[16:25] == " 123 and "
    assert p.text("12 4111 1111 1111 1111") == ("12 " + one, ["card"])
    for stamp, rest in (("2024-05-06T10:00", "T10:00"), ("2024-05-06T10:00:00Z", "T10:00:00Z"), ("2024-05-06t1000", "t1000")):
        new, kinds = p.text(f"at {stamp}, then")
        assert kinds == ["date"] and new == f"at {p.text('2024-05-06')[0]}{rest}, then" and back.text(new)[0] == f"at {stamp}, then"
    assert p.text("2024-05-06Test") == ("2024-05-06Test", [])


def test_dates_in_words_and_long_addresses():
    p, back = pii.Pseudonyms(b"k"), pii.Pseudonyms(b"k", back=True)
    day = re.sub(r"\D", "", p.text("1980-05-12")[0])
    for text in ("born 12 May 1980.", "May 12, 1980", "am 12. Mai 1980", "le 12 mai 1980", "el 12 de mayo de 1980"):
        new, kinds = p.text(text)
        again = back.text(new)[0]
        assert kinds == ["date"] and new != text and day[:4] in new and re.findall(r"\d+", again) == re.findall(r"\d+", text)
        assert again == text or "mai" in text.lower()  # months that two languages share don't say which of them it was
    full = "2001:0db8:0000:0000:0000:0000:0000:0001"
    new, kinds = p.text(f"from {full} on")
    assert kinds == ["ip"] and full not in new and back.text(new)[0] == f"from {full} on" and p.text("2001:db8::1")[0] == new[5:-3]
    for clean in ("31 February 2001", "in May 2001", "a::b", "std::vector", "ratio 3::4", "at 10:20:30"):
        assert p.text(clean) == (clean, [])


def test_key_of_the_session(spark, odd):
    old = spark.conf.get(pii.KEY_SETTING, None)
    try:
        spark.conf.unset(pii.KEY_SETTING)
        made = pii.session_key(spark)
        assert made == pii.session_key(spark) and len(made) == 64
        spark.conf.set(pii.KEY_SETTING, "one")
        assert pii.session_key(spark) != made
    finally:
        spark.conf.unset(pii.KEY_SETTING) if old is None else spark.conf.set(pii.KEY_SETTING, old)


def test_permutation_is_a_derangement():
    for n in (2, 3, 10, 97):
        p = pii.Permutation(b"k", "t", n)
        image = [p(x) for x in range(n)]
        assert sorted(image) == list(range(n)) and all(x != y for x, y in enumerate(image)) and [p.invert(y) for y in image] == list(range(n))


def test_pii_edges(odd, none):
    got = pii.replace(odd, key=b"k")
    assert got.columns == odd.columns and got.exceptAll(odd).count() == 0 and pii.replace(none, key=b"k").count() == 0


# --- 4 ---


def _words(t):
    return re.sub(r"[\W_]+", " ", (t or "").lower()).split()


def _shingles(t, n=5):
    w = _words(t)
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}


def test_decontamination_matches_brute_force(spark, sf, texts):
    items = {r["item_id"]: _shingles(r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()}
    want = {(d, i) for d, t in texts[0].items() for i, s in items.items() if s and len(s & _shingles(t)) / len(s) >= 0.8}
    got = {(r["doc_id"], r["item_id"]) for r in catalog.op4_decontamination(spark, sf).collect()}
    assert got == want


def test_decontamination_edges(spark, odd, none):
    items = spark.createDataFrame([(1, PROSE[:60]), (2, None), (3, ""), (4, "one two"), (None, PROSE)], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.contained_items(odd, items).collect()}
    assert got == {(5, 1), (6, 1), (10, 1), (4, 4)}
    assert got == {(r["doc_id"], r["item_id"]) for r in decontaminate.contained_items(odd, items, most=0).collect()}
    assert decontaminate.contained_items(none, items).count() == 0 and decontaminate.contained_items(odd, items.limit(0)).count() == 0


def test_short_items_and_rows_without_id(spark, odd):
    """Items of fewer than five words are one shingle; what is dropped goes by text."""
    docs = _docs(spark, [(1, "so the Answer, is yes!", "en", "a"), (2, "the answer was yes", "en", "a"), (3, "answer", "en", "a"), (4, None, "en", "a"), (None, "the answer is yes", "en", "a")])
    items = spark.createDataFrame([(1, "The answer is yes"), (2, "!!"), (3, "was yes")], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"], r["n_item"]) for r in decontaminate.contained_items(docs, items).collect()}
    assert got == {(1, 1, 1), (2, 3, 1)}
    assert sorted(r["doc_id"] for r in decontaminate.drop_contaminated(docs, items).collect()) == [3, 4]
    left = decontaminate.drop_contaminated(odd, spark.createDataFrame([(1, PROSE)], "item_id long, text string"))
    assert left.columns == odd.columns and sorted((r["doc_id"] for r in left.collect()), key=str) == [1, 2, 3, 4, 7, 8, 9]


def test_items_without_id_or_with_one_id_are_held_each_for_itself(spark):
    """Ids of items and documents may be missing or shared; dropping equals brute force over the texts."""
    r = random.Random(6)
    item = lambda n: " ".join(f"v{r.randrange(5000)}" for _ in range(n))
    items = [(None, item(30)), (None, item(12)), (7, item(40)), (7, item(9)), (7, item(6)), (8, item(25)), (9, "tiny item"), (9, item(200)), (10, item(80))]
    held = [f"{item(50)} {t} {item(20)}" for _, t in items]
    partly = [" ".join(t.split()[: len(t.split()) // 2]) + " " + item(30) for _, t in items if len(t.split()) > 8]
    docs = [(i if i % 3 else None, t, "en", "a") for i, t in enumerate(held + partly + [item(60) for _ in range(20)])] + [(4, held[0], "en", "a"), (4, held[2], "en", "b"), (1, None, "en", "a")]
    grams = lambda t, n: {tuple(_words(t)[i : i + n]) for i in range(len(_words(t)) - n + 1)}
    holds = lambda t, x: len(grams(x, n := min(5, len(_words(x)))) & grams(t, n)) >= 0.8 * len(grams(x, n))
    d, q = _docs(spark, docs), spark.createDataFrame(items, "item_id long, text string")
    left = decontaminate.drop_contaminated(d, q)
    key = lambda x: (str(x[0]), str(x[1]))
    assert sorted(((x["doc_id"], x["text"]) for x in left.collect()), key=key) == sorted(((x[0], x[1]) for x in docs if not any(holds(x[1], t) for _, t in items)), key=key)
    want = {(x[0], i) for x in docs for i, t in items if x[0] is not None and i is not None and holds(x[1], t)}
    assert {(x["doc_id"], x["item_id"]) for x in decontaminate.contained_items(d, q).collect()} == want and len(want) >= 5


def test_partial_item_is_found_anywhere(spark):
    w = [f"w{i}" for i in range(60)]
    halves = " ".join(w[:28]) + " filler " * 30 + " ".join(w[28:])
    docs = _docs(spark, [(1, halves, "en", "a"), (2, " ".join(w[:40]), "en", "a")])
    items = spark.createDataFrame([(1, " ".join(w))], "item_id long, text string")
    assert [r["doc_id"] for r in decontaminate.contained_items(docs, items).collect()] == [1]


# --- 5 ---


def test_licenses(spark, odd, none):
    rows = [(1, "Intro.\nReleased under the MIT License.\nmit LICENSE again", "en", "a"), (2, "Licensed under CC BY-NC 4.0. Text", "en", "a"), (3, "This work is licensed under the GNU General Public License, version 3.", "en", "a"), (4, "apache helicopter license plate", "en", "a"), (5, "apache license and mit license", "en", "a")]
    got = {r["doc_id"]: r for r in licenses.scan(_docs(spark, rows)).collect()}
    assert (got[1]["n_base"], got[1]["first_word"], got[1]["last_word"], got[1]["labels"]) == (2, 4, 6, "mit")
    assert (got[2]["base_labels"], got[2]["labels"], got[2]["score"]) == ("", "cc-by-nc", 1.0)
    assert got[3]["labels"] == "gpl" and (got[4]["n_base"], got[4]["labels"], got[4]["score"], got[4]["first_word"]) == (0, "", 0.0, None)
    assert got[5]["base_labels"] == "apache,mit"
    edge = licenses.scan(odd).collect()
    assert len(edge) == odd.count() and all(r["n_words"] == 0 for r in edge if r["doc_id"] in (1, 2, 3))
    assert [r["labels"] for r in edge if r["doc_id"] == 10] == ["mit"]
    assert licenses.scan(none).count() == 0


def test_wrapped_and_scattered_notices(spark):
    """Notices over lines with comment marks are met; their words strewn over a long line aren't."""
    mit = "Permission is hereby granted, free of charge, to any person\n# obtaining a copy of this software and associated\n# documentation files"
    bsd = " * Redistribution and use in source and binary forms, with or without\n * modification, are permitted provided that the following conditions\n * are met:"
    words = dict.fromkeys(w for _, n in licenses.TEMPLATES if n.startswith(("This is free", "Permission is")) for w in n.split())
    strewn = " ".join(" ".join([w, *(f"x{i}y{j}" for j in range(90))]) for i, w in enumerate(words))
    rows = [(1, mit, "en", "a"), (2, f"#!/bin/sh\n{'z ' * 700}\n{bsd}", "en", "a"), (3, strewn, "en", "a"), (4, "q " * 5000 + "Licensed under CC\nBY-SA 4.0 " + "q " * 50, "en", "a"), (5, "licensed under the lesser evil general", "en", "a")]
    got = {r["doc_id"]: (r["labels"], r["n_base"]) for r in licenses.scan(_docs(spark, rows)).collect()}
    assert got == {1: ("mit", 0), 2: ("bsd", 0), 3: ("", 0), 4: ("cc-by-sa", 0), 5: ("", 0)}
    own = licenses.scan(_docs(spark, rows), templates=[("house", "obtaining a copy of this software")]).collect()
    assert {r["doc_id"]: r["labels"] for r in own} == {1: "house", 2: "", 3: "", 4: "", 5: ""}


# --- 6 ---


def _plain_ppm(train, text, k=3):
    """Code length by walking contexts from long to short."""
    seen = defaultdict(Counter)
    for t in train:
        x = b"\n\n\n" + t
        for i in range(3, len(x)):
            for order in range(k + 1):
                seen[x[i - order : i]][x[i]] += 1
    x, bits = b"\n\n\n" + text, 0.0
    for i in range(3, len(x)):
        for order in range(k, -2, -1):
            if order < 0:
                bits += 8
                break
            c = seen[x[i - order : i]] if x[i - order : i] in seen else None
            if not c:
                continue
            n, q = sum(c.values()), len(c)
            if c[x[i]]:
                bits -= math.log2(c[x[i]] / (n + q))
                break
            bits -= math.log2(q / (n + q))
    return bits


def test_ppm_code_lengths():
    train = {"en": [b"the rain in spain", b"then and there"], "fr": ["la pluie à paris".encode(), b"et puis la mer"]}
    rows = [(lang, *x) for lang, ts in train.items() for t in ts for x in Counter(int.from_bytes(p[i - 3 : i + 1], "big") for p in [b"\n\n\n" + t] for i in range(3, len(p))).items()]
    counts = language.Counts(["en", "fr"], np.array([["en", "fr"].index(a) for a, _, _ in rows]), np.array([c for _, c, _ in rows]), np.array([n for _, _, n in rows]))
    tables = language.Tables(counts)
    for text in (b"the", b"la pluie", "zürich à".encode(), b"q"):
        got = tables.bits_of(np.frombuffer(text, np.uint8), np.array([len(text)]))[0]
        assert got == pytest.approx([_plain_ppm(train["en"], text), _plain_ppm(train["fr"], text)], rel=1e-4)


def test_language_on_held_out(spark, sf, texts):
    got = catalog.op6_language_id(spark, sf).collect()
    assert len(got) == len(texts[0])
    held = [r for r in got if r["held_out"]]
    assert {r["doc_id"] for r in held} == {i for i in texts[0] if zlib.crc32(str(i).encode()) % 4 == 2}
    assert sum(r["lang_pred"] == texts[1][r["doc_id"]] for r in held) / len(held) > 0.98


def test_many_languages_and_a_shared_id(spark):
    """Every label is learned, however many there are and whatever ids their rows have."""
    rows = [(None, f"word{i}x letter{i}y sound{i}z", f"l{i:03d}", "a") for i in range(250)] + [(8, f"{PROSE} {i}", "en", "a") for i in range(3000)] + [(8, f"la mer et la pluie {i}", "fr", "a") for i in range(5)]
    docs = _docs(spark, rows)
    model = language.learn(docs)
    assert sorted(x for c in model for x in c.langs) == sorted({lang for _, _, lang, _ in rows}) and len(model) == 8
    some = docs.filter("lang in ('en', 'fr', 'l007', 'l249')").select("lang", language.identify(docs, model).alias("p"))
    assert some.filter("lang <> p.lang_pred").count() == 0
    few = language.learn(docs, sample_docs=2, sample_bytes=100)
    assert sum(len(c.langs) for c in few) == 252


def test_language_edges(odd, none):
    counts = language.learn(odd)
    got = [(r["doc_id"], r["p"]["lang_pred"], r["p"]["score"]) for r in odd.select("doc_id", language.identify(odd, counts).alias("p")).collect()]
    assert {i for i, lang, _ in got if lang == "und"} == {1, 2, 3, 8} and all(0 <= s <= 1 for _, _, s in got)
    empty = language.learn(none)
    assert {r["p"]["lang_pred"] for r in odd.select(language.identify(odd, empty).alias("p")).collect()} == {"und"}
    assert none.select(language.identify(none, empty)).count() == 0


# --- 7 ---


def _plain_chunks(text, window=chunks.WINDOW):
    """Words of a text, and where its chunks start, by the rule as the module states it."""
    words = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    if not words:
        return words, []
    table = (chunks.mix64(np.arange(1, 257, dtype=np.uint64)) >> np.uint64(32)).tolist()
    ranks = []
    for i in range(2, len(words)):
        h = 0
        for b in b" ".join(words[i - 2 : i + 1])[-32:]:
            h = ((h << 1) + table[b]) % (1 << 32)
        ranks.append(h)
    ranks = chunks.mix64(np.array(ranks, np.uint64)).tolist()
    starts = {0}
    for i in range(len(ranks) - window + 1):
        starts.add(max(range(i, i + window), key=lambda k: (-ranks[k], k)) + 3)
    return words, sorted(s for s in starts if s < len(words))


def _plain_spans(texts, least=chunks.MIN_SPAN):
    """(doc, first word, words, least doc, is_first) of every span."""
    places, pieces = defaultdict(list), {}
    for i, t in texts.items():
        words, starts = _plain_chunks(t)
        ends = [*starts[1:], len(words)] if starts else []
        for s in starts:
            if e := next((e for e in ends if e >= s + least), None):
                pieces[i, s] = (e, tuple(words[s:e]), tuple(x - s for x in starts if s <= x < e))
                places[pieces[i, s][1:]].append(i)
    out, open_ = [], {}
    for (i, s), (e, *piece) in sorted(pieces.items()):
        docs = places[tuple(piece)]
        if len(set(docs)) > 1:
            first = min(docs) == i
            span = open_.get((i, first))
            best = (len(docs), -min(docs))
            if span and s <= span[2]:
                span[2], span[3] = max(span[2], e), max(span[3], best)
            else:
                open_[i, first] = span = [i, s, e, best, first]
                out.append(span)
    return sorted((i, s, e - s, -best[1], best[0], first) for i, s, e, best, first in out)


def test_substring_spans_match_a_plain_chunker(spark, sf, texts):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = ("doc_id", "word", "n_words", "first_doc", "n_places", "is_first")
    rows = lambda df: sorted(tuple(r[c] for c in columns) for r in chunks.repeated_spans(df).collect())
    got = rows(docs)
    assert got == _plain_spans(texts[0])
    assert got == rows(docs.orderBy(F.desc("doc_id"))) == rows(docs.repartition(7))


def test_chunks_partition_the_texts(spark, texts):
    some = [t or "" for t in list(texts[0].values())[:60]]
    c = chunks.chunk_places(np.frombuffer("".join(some).encode(), np.uint8), np.array([len(t.encode()) for t in some]))
    for i, t in enumerate(some):
        words, starts = _plain_chunks(t)
        mine = c["text"] == i
        assert c["word"][mine].tolist() == starts and (not words or c["n_words"][mine].sum() == len(words))
        raw = t.encode()
        assert b" ".join(b" ".join(raw[b : b + n].split()) for b, n in zip(c["byte"][mine], c["n_bytes"][mine], strict=True)) == b" ".join(raw.split())


def test_substring_repeats(spark, sf, texts):
    found = {r["doc_id"] for r in catalog.op7_substring_dedup(spark, sf).collect()}
    places = defaultdict(lambda: defaultdict(set))
    for n in (51, 25):
        for i, t in texts[0].items():
            w = (t or "").lower().split()
            for j in range(len(w) - n + 1):
                places[n][tuple(w[j : j + n])].add(i)
    shared = {n: set().union(*[s for s in p.values() if len(s) > 1]) for n, p in places.items()}
    assert shared[51] <= found <= shared[25]


@pytest.mark.parametrize("size", [1, 6, 12])
def test_every_passage_of_51_words_holds_a_common_piece(size):
    r = random.Random(size)
    words = lambda n: ["".join(r.choices("abcdefghijklmnop", k=r.randint(1, size))) for _ in range(n)]
    passages = [words(51) for _ in range(1000)]
    texts = [" ".join(words(n) + p + words(m)).encode() for p in passages for n, m in ((30, 40), (45, 0))]
    c = chunks.chunk_places(np.frombuffer(b"".join(texts), np.uint8), np.array([len(t) for t in texts]))
    inner = defaultdict(list)
    for text, word, n, *digest in zip(*(c[k].tolist() for k in ("text", "word", "n_words", "d1", "d2")), strict=True):
        start = 45 if text % 2 else 30
        if start <= word and word + n <= start + 51:
            inner[text].append((word - start, n, *digest))
    for i in range(len(passages)):
        both = sorted(set(inner[2 * i]) & set(inner[2 * i + 1]))
        assert both[-1][0] + both[-1][1] - both[0][0] >= chunks.MIN_SPAN and all(a[0] + a[1] == b[0] for a, b in zip(both, both[1:], strict=False))


def test_rows_that_share_an_id(spark):
    """Each row is cut by its own text."""
    r = random.Random(4)
    w = lambda n: " ".join("".join(r.choices("abcdefghé", k=5)) for _ in range(n))
    passage = w(80)
    docs = _docs(spark, [(1, passage, "en", "x"), (2, w(40) + " " + passage, "en", "x"), (2, passage + " " + w(300), "en", "x"), (2, w(10), "en", "x"), (2, w(40) + passage, "en", "x")])
    before, after = ({t: Counter((r["text"] or "").split()) for t, r in enumerate(sorted(x.collect(), key=lambda r: -len(r["text"])))} for x in (docs, chunks.deduplicate(docs)))
    assert sum(map(len, after.values())) < sum(map(len, before.values())) and chunks.deduplicate(docs).filter(F.col("text") == passage).count() == 1


def test_passages_of_rows_without_ids(spark):
    """Each text without an id is a document, behind those with one; rows of one text without an id are one document."""
    r = random.Random(7)
    w = lambda n: " ".join("".join(r.choices("abcdefghé", k=5)) for _ in range(n))
    one, two, three = w(80), w(80), w(80)
    texts = [(9, f"{w(40)} {one}"), (None, f"{w(30)} {one} {w(5)}"), (None, f"{w(20)} {two}"), (None, f"{w(60)} {two} {w(9)}"), (None, three), (None, three), (None, None)]
    docs = _docs(spark, [(i, t, "en", "x") for i, t in texts]).withColumn("key", F.lit(1)).withColumn("word", F.lit("x"))
    spans = sorted((x["first_doc"] or 0, x["is_first"], x["doc_id"] or 0) for x in chunks.repeated_spans(docs).collect())
    assert spans == [(0, False, 0), (0, True, 0), (9, False, 0), (9, True, 9)]
    kept = [x["text"] for x in chunks.deduplicate(docs).collect()]
    count = lambda p: sum(" ".join(p.split()[12:-12]) in (t or "") for t in kept)
    assert (count(one), count(two), count(three), len(kept)) == (1, 1, 2, 7)


def test_substring_shift_and_drop(spark, odd, none):
    r = random.Random(1)
    w = lambda n: " ".join("".join(r.choices("abcdefgh", k=6)) for _ in range(n))
    passage, a, b = w(120), w(60), w(60)
    docs = _docs(spark, [(1, f"{a} {passage}", "en", "x"), (2, f"{b} inserted {passage} end", "en", "x"), (3, w(200), "en", "x")])
    spans = {r["doc_id"]: r for r in chunks.repeated_spans(docs).collect()}
    assert set(spans) == {1, 2} and spans[1]["is_first"] and not spans[2]["is_first"] and spans[2]["first_doc"] == 1 and spans[2]["n_words"] > 80
    kept = {r["doc_id"]: r["text"] for r in chunks.deduplicate(docs).collect()}
    assert passage in kept[1] and len(kept[2]) < len(b) + 400 and kept[2].endswith("end")
    assert {r["doc_id"] for r in chunks.repeated_spans(odd).collect()} <= {5, 6, 10} and chunks.repeated_spans(none).count() == 0
    assert chunks.deduplicate(odd).count() == odd.count()


# --- 8 ---


def _plain_classes(texts):
    """Classes by all pairs that share a shingle."""
    sets, first, up = {}, {}, {}

    def top(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for i, t in sorted(texts.items()):
        top(i)
        if (t or "") in first:
            up[i] = first[t or ""]
            continue
        first[t or ""] = i
        w = (t or "").lower().split()
        sets[i] = {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if w else set()
    where = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            where[x].append(i)
    for i, s in sets.items():
        for j in {j for x in s for j in where[x] if j < i}:
            both = len(s & sets[j])
            if both / (len(s) + len(sets[j]) - both) >= 0.8:
                a, b = top(i), top(j)
                up[max(a, b)] = min(a, b)
    return {i: top(i) for i in texts}


def test_near_duplicates_match_brute_force(spark, sf, texts):
    got = {r["doc_id"]: r["class_id"] for r in catalog.op8_near_duplicates(spark, sf).collect()}
    assert got == _plain_classes(texts[0])


def test_near_duplicates_in_planted_families(spark):
    """Copies that are alike only by way of their original; pairs within families of a common body; texts that differ in repetition."""
    r = random.Random(5)
    words = lambda n, letters="abcdefghij": ["".join(r.choices(letters, k=6)) for _ in range(n)]
    texts, base = {}, words(150)
    texts[0] = " ".join(base)
    for i in range(1, 120):
        w = list(base)
        for j in r.sample(range(150), 3):
            w[j] = f"new{i}x{j}"
        texts[i] = " ".join(w)
    texts |= {i: " ".join(words(80, "klmnop")) for i in range(120, 160)}
    for start, n, common, own, shared in ((1000, 600, 240, 36, 30), (2000, 1000, 150, 30, 26)):
        body = words(common)
        for i in range(start, start + n, 2):
            mine = words(own)
            texts[i], texts[i + 1] = " ".join(body + mine), " ".join(body + mine[:shared] + words(own - shared))
    for i in range(4000, 4100, 5):
        body = words(100)
        texts |= {i + k: " ".join(body * n) for k, n in enumerate((1, 2, 3, 8))}
        texts[i + 4] = " ".join(body + body[40:60] * 20)
    want = _plain_classes(texts)
    assert all(want[i] == i - i % 5 for i in texts if i >= 4000) and len({want[i] for i in texts if 1000 <= i < 3000}) == 800 and {want[i] for i in range(120)} == {0}
    got = {x["doc_id"]: x["class_id"] for x in neardup.near_duplicates(_docs(spark, [(i, t, "en", "a") for i, t in texts.items()])).collect()}
    assert got == want


def test_near_duplicate_edges(odd, none):
    got = [(r["doc_id"], r["class_id"], r["kept"]) for r in neardup.near_duplicates(odd).collect()]
    assert len(got) == odd.count()
    by_id = {i: (c, k) for i, c, k in got}
    assert by_id[2] == (1, False) and by_id[1] == (1, True) and by_id[6] == (5, False) and by_id[None] == (5, False) and by_id[4] == (4, True) and sorted(k for i, _, k in got if i == 5) == [False, True]
    assert neardup.near_duplicates(none).count() == 0
    kept = neardup.deduplicate(odd)
    assert kept.columns == odd.columns and sorted(r["doc_id"] for r in kept.collect()) == [1, 3, 4, 5, 7, 8, 9] and neardup.deduplicate(none).count() == 0


def test_near_duplicates_of_rows_that_share_an_id(spark):
    r = random.Random(6)
    w = lambda: " ".join("".join(r.choices("abcdefgh", k=6)) for _ in range(60))
    a, b, c = w(), w(), w()
    rows = [(1, a, "en", "s"), (1, b, "en", "s"), (2, b + " end", "en", "s"), (None, c, "en", "s"), (None, c, "de", "t"), (3, a, "en", "s"), (None, w(), "en", "s")]
    got = sorted(((r["doc_id"], r["class_id"], r["kept"]) for r in neardup.near_duplicates(_docs(spark, rows)).collect()), key=str)
    assert [x[1] for x in got if x[0] in (1, 2, 3)] == [1, 1, 1, 1] and [x[1:] for x in got if x[0] is None].count((None, True)) == 2
    assert Counter(r["text"] for r in neardup.deduplicate(_docs(spark, rows)).collect()).values().__len__() == 4 and neardup.deduplicate(_docs(spark, rows)).count() == 4


def test_dart_signatures_estimate_weighted_jaccard():
    r = np.random.default_rng(2)
    a, extra = r.integers(0, 2**63, 400).astype(np.uint64), r.integers(0, 2**63, 100).astype(np.uint64)
    b = np.concatenate([a[:350], extra])
    sig = neardup.dart_signatures(np.concatenate([a, b]), np.repeat([0, 1], [len(a), len(b)]), 2, k=512)
    assert (sig[0] == sig[1]).mean() == pytest.approx(350 / 500, abs=0.07) and (sig != 0).all()


def test_dart_signatures_of_real_weights():
    r = np.random.default_rng(3)
    e = r.integers(0, 2**63, 300).astype(np.uint64)
    x, y = r.uniform(0.1, 4, 300), r.uniform(0.1, 4, 300)
    h, own, width = neardup.strips(np.concatenate([e, e]), np.repeat([0, 1], 300), np.concatenate([x, y]))
    assert width.sum() == pytest.approx(x.sum() + y.sum()) and (width > 0).all()
    sig = neardup.dart_signatures(h, own, 2, k=1024, width=width)
    assert (sig[0] == sig[1]).mean() == pytest.approx(np.minimum(x, y).sum() / np.maximum(x, y).sum(), abs=0.05)


# --- 9 ---


def test_url_rules_and_parts(spark):
    rows = [(1, "HTTP://A.Example.COM/en/7x?q#f", None), (2, "https://x.net", None), (3, "no scheme", None), (4, None, None), (5, "ftp://b.example.net/de/8/", None), (6, "http://x.net/de/1", None), (7, "http://q.org?x=/es/", None), (8, "http://com/en/", None), (9, "http://xcom/en/", None), (10, "a://b#c", None)]
    got = {r["page_id"]: r for r in urls.judge(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert (got[1]["host"], got[1]["path"], got[1]["rule"], got[1]["verdict"]) == ("a.example.com", "/en/7x", "example.com/en/7", "allow")
    assert (got[5]["rule"], got[5]["verdict"]) == ("example.net/de/8", "block") and got[6]["rule"] == "net/de/"
    assert [(got[i]["host"], got[i]["path"]) for i in (2, 3, 4, 7, 10)] == [("x.net", ""), ("", ""), ("", ""), ("q.org", ""), ("b", "")]
    assert got[7]["rule"] is None and got[8]["verdict"] == "block" and got[9]["rule"] is None and got[3]["verdict"] == "allow"
    assert urls.judge(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_propagation_matches_plain_iteration(spark):
    edges = {("a", "b"): 2, ("b", "c"): 1, ("c", "a"): 1, ("d", "c"): 3, ("b", "d"): 1}
    seeds = {("a", "trust"): 1.0, ("c", "distrust"): 1.0}
    score = dict(seeds)
    for _ in range(7):
        new = defaultdict(float)
        for (h, k), s in seeds.items():
            new[h, k] += 0.15 * s
        for (a, b), n in edges.items():
            out = sum(m for (x, _), m in edges.items() if x == a)
            into = sum(m for (_, y), m in edges.items() if y == b)
            new[b, "trust"] += 0.85 * score.get((a, "trust"), 0) * n / out
            new[a, "distrust"] += 0.85 * score.get((b, "distrust"), 0) * n / into
        score = {k: v for k, v in new.items() if v}
    got = urls.propagate(spark.createDataFrame([(*k, n) for k, n in edges.items()], "src string, dst string, n long"), spark.createDataFrame([(*k, v) for k, v in seeds.items()], "host string, kind string, seed double"), iterations=7)
    assert {(r["host"], r["kind"]): pytest.approx(r["score"]) for r in got.collect()} == score


@pytest.mark.parametrize("far", [False, True])
def test_rounds_end_when_traces_of_one_kind_are_all_that_is_open(spark, far):
    """10^4 hosts, most of them reached by a trace of trust; a host that both kinds reach equally keeps the rounds going to the last."""
    r = random.Random(6)
    edges = {(f"t{r.randrange(10_000)}", f"t{r.randrange(10_000)}"): 1 for _ in range(30_000)} | {("b1", "b2"): 1}
    seeds = [("t1", "trust", 1.0), ("b2", "distrust", 1.0), *((f"t{i}", "trust", 1.0) for i in range(50, 60))]
    if far:
        edges |= {("a", "m"): 1, ("m", "z"): 1}
        seeds += [("a", "trust", 1.0), ("z", "distrust", 1.0)]
    calls = []

    def counted(df):
        calls.append(1)
        return urls.cut(df)

    got = urls.propagate(spark.createDataFrame([(*k, n) for k, n in edges.items()], "src string, dst string, n long"), spark.createDataFrame(seeds, "host string, kind string, seed double"), cut=counted)
    rounds = 5 * (len(calls) - 1)
    assert rounds >= 150 if far else rounds <= 65
    assert {x["host"] for x in got.filter("kind = 'distrust' and host not in ('z', 'm', 'a')").collect()} == {"b1", "b2"} and got.filter("kind = 'trust'").count() > 8000


def test_links_spread_distrust(spark):
    html = '<a href="http://bad.example.com/x">x</a> <a HREF=//bad.example.com/y>y</a> <a href="/local">z</a>'
    rows = [(1, "http://bad.example.com/en/1", None), (2, "http://friend.test/a", html), (3, "http://other.test/a", "<p>")]
    got = {r["page_id"]: r["verdict"] for r in urls.judge(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {1: "block", 2: "block", 3: "allow"}


def test_ancestors_without_pages_carry_scores(spark):
    """A blocked host, and one that no rule decides, meet in a domain that has no pages; a chain of hosts is longer than ten links."""
    link = lambda i: f'<a href="http://n{i + 1}.test/">x</a>'
    rows = [(1, "http://a.y.example.com/en/1", None), (2, "http://b.y.example.com/x", None), (3, "http://10.0.0.1/x", None), (4, "http://n14.test/", '<a href="http://bad.com/en/">x</a>'), (5, "http://bad.com/en/", None)]
    rows += [(100 + i, f"http://n{i}.test/", link(i)) for i in range(14)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r["verdict"] for r in urls.judge(pages, domain_ties=True).collect()}
    assert {r["page_id"]: r["verdict"] for r in urls.judge(pages).collect()}[2] == "allow"
    assert got[2] == "block" and got[3] == "allow" and all(got[100 + i] == "block" for i in range(14))
    hosts = spark.createDataFrame([("a.y.test",), ("b.y.test",), ("10.0.0.1",)], "host string")
    edges = {(r["src"], r["dst"]) for r in urls.host_edges(hosts.selectExpr("host", "'' as html"), hosts, True).collect()}
    assert edges == {("a.y.test", "y.test"), ("y.test", "a.y.test"), ("b.y.test", "y.test"), ("y.test", "b.y.test")}


def _plain_verdicts(pages, rounds=400):
    """Verdicts by dense iteration over host links."""
    parts = {}
    for i, url, _ in pages:
        _, sep, rest = (url or "").partition("://")
        host, path = re.match(r"([^/?#]*)([^?#]*)", rest if sep else "").groups()
        parts[i] = re.sub("[A-Z]", lambda m: m[0].lower(), host), path
    rule = {}
    for i, (h, p) in parts.items():
        fit = [(len(a + b), v) for a, b, v in urls.RULES if (h == a or h.endswith("." + a)) and p.startswith(b)]
        rule[i] = max(fit)[1] if fit else None
    hosts = sorted({h for h, _ in parts.values() if h})
    at, n = {h: k for k, h in enumerate(hosts)}, Counter(h for h, _ in parts.values())
    seeds = {v: np.array([sum(parts[i][0] == h and rule[i] == v for i in parts) / n[h] for h in hosts]) for v in ("allow", "block")}
    links = Counter()
    for i, _, html in pages:
        for x in re.findall(r"""(?i)href\s*=\s*["']?(?:https?:)?//([^"'\s>/?#]+)""", html or ""):
            a, b = parts[i][0], x.lower()
            if a and a != b:
                links[a, b] += 1
                at.setdefault(b, len(at))
    m = np.zeros((len(at), len(at)))
    for (a, b), k in links.items():
        m[at[a], at[b]] = k
    score = {}
    for v, steps in (("allow", m), ("block", m.T)):
        seed = np.append(seeds[v], np.zeros(len(at) - len(hosts)))
        share = np.divide(steps, steps.sum(axis=1, keepdims=True), out=np.zeros_like(steps), where=steps.sum(axis=1, keepdims=True) > 0)
        x = seed
        for _ in range(rounds):
            x = 0.15 * seed + 0.85 * x @ share
        score[v] = x
    return {i: rule[i] or ("block" if parts[i][0] and score["block"][at[parts[i][0]]] > (1 + 1e-9) * score["allow"][at[parts[i][0]]] else "allow") for i in parts}


def test_verdicts_match_dense_iteration(spark, sf):
    r = random.Random(8)
    rows = [(x["page_id"], x["url"], x["html"]) for x in spark.read.parquet(f"{sf}/pages.parquet").collect()]
    assert {x["page_id"]: x["verdict"] for x in catalog.op9_url_filter(spark, sf).collect()} == _plain_verdicts(rows)
    hosts = [f"h{i}.{r.choice(['example.com', 'example.net', 'test'])}" for i in range(40)]
    url = lambda: f"http://{r.choice(hosts)}/{r.choice(['en', 'de', 'x'])}/{r.randint(1, 9)}"
    rows = [(i, url(), "".join(f'<a href="{url()}">' for _ in range(r.randint(0, 3)))) for i in range(150)] + [(900, None, None), (901, "http://h1.test/x", "y" * 200_000)]
    pages = spark.createDataFrame([(*x, "z") for x in rows + rows[-2:-1] * 3], "page_id long, url string, html string, host string")
    got = [(x["page_id"], x["verdict"]) for x in urls.judge(pages).collect()]
    assert len(got) == len(rows) + 3 and set(got) == set(_plain_verdicts(rows).items())


# --- 10 ---


def test_targets():
    assert [float(x) for x in mixing.fill_targets([100, 10, 10], [5, 2, 1], 3)] == [75.0, 30.0, 15.0]
    assert [float(x) for x in mixing.fill_targets([100, 5, 10], [5, 2, 1], 3)] == [pytest.approx(100 * 5 / 6), 15.0, pytest.approx(100 / 6)]
    assert [float(x) for x in mixing.fill_targets([80, 80], [5, 2], 3)] == [pytest.approx(160 * 5 / 7), pytest.approx(160 * 2 / 7)]
    assert mixing.fill_targets([], [], 3) == [] and mixing.fill_targets([0, 5], [5, 2], 3) == [0, 5]


def test_mix_meets_targets(spark):
    r = random.Random(2)
    rows = [(i, " ".join(["w"] * r.randint(1, 60)), "en", "hot" if i % 3 else f"s{i % 4}") for i in range(3000)]
    docs = _docs(spark, rows)
    got = mixing.mix_sources(docs, fan=64).collect()
    assert len(got) == 3000
    for s in {x["source"] for x in got}:
        own = [x for x in got if x["source"] == s]
        assert sum(x["size"] for x in own) == own[0]["source_size"] and abs(sum(x["taken"] for x in own) - own[0]["target"]) <= 60
    assert all(x["taken"] == x["copies"] * x["size"] <= 3 * x["size"] for x in got)
    assert sorted(map(tuple, got)) == sorted(map(tuple, mixing.mix_sources(docs.repartition(7), fan=64).collect()))


def test_mix_columns_match_sql(spark, sf):
    con = duckdb.connect()
    want = con.execute(rf"""SELECT doc_id, size, sum(size) OVER (PARTITION BY source) AS source_size, source FROM (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size FROM '{sf}/documents.parquet')""").fetchall()
    total, sources = {s: n for _, _, n, s in want}, sorted({s for *_, s in want}, key=lambda s: (s is None, s or ""))
    each = mixing.fill_targets([total[s] for s in sources], [(5, 2, 1)[i % 3] for i in range(len(sources))], 3)
    target = {s: float(t) for s, t in zip(sources, each, strict=True)}
    got = sorted((r["doc_id"], r["size"], r["source_size"], r["target"]) for r in catalog.op10_mix_sources(spark, sf).collect())
    assert got == sorted((i, n, int(m), pytest.approx(target[s])) for i, n, m, s in want)


def test_mix_of_many_sources_in_tables(spark):
    """The same targets whether they are made on the driver or in tables."""
    r = random.Random(3)
    rows = [(i, " ".join(["w"] * r.randint(0, 40)), "en", None if i % 50 == 0 else f"s{r.randint(0, 60)}") for i in range(900)]
    docs = _docs(spark, rows).repartition(5)
    a, b = ({x["doc_id"]: (x["source_size"], pytest.approx(x["target"])) for x in mixing.mix_sources(docs, most=most).collect()} for most in (1000, 0))
    assert a == b and len(a) == 900
    got = mixing.mix_sources(docs, most=0).collect()
    for s in {x["source"] for x in got}:
        own = [x for x in got if x["source"] == s]
        assert abs(sum(x["taken"] for x in own) - own[0]["target"]) <= 40 and all(x["taken"] <= 3 * x["size"] for x in own)


def test_mix_of_repeated_rows(spark, monkeypatch):
    monkeypatch.setattr(mixing, "_PART", 50)
    rows = [(None, "a b c", "en", "x")] * 400 + [(i, "d e", "en", "x") for i in range(100)] + [(1000 + i, "f " * 30, "en", "y") for i in range(200)]
    got = mixing.mix_sources(_docs(spark, rows), fan=64).collect()
    hot = [x["copies"] for x in got if x["doc_id"] is None]
    assert len(got) == 700 and len(hot) == 400 and max(hot) - min(hot) <= 1
    for s in "xy":
        own = [x for x in got if x["source"] == s]
        assert abs(sum(x["taken"] for x in own) - own[0]["target"]) <= 30


def test_mix_edges(odd, none):
    got = mixing.mix_sources(odd).collect()
    assert len(got) == odd.count() and {r["taken"] for r in got if r["doc_id"] in (1, 2, 3)} == {0}
    assert mixing.mix_sources(none).count() == 0


# --- pipeline ---


def test_pipeline_stages(spark, sf, texts):
    import corpus_pipeline as c

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    one = docs
    expected = {i for i, t in texts[0].items() if any(x.isalpha() for x in t or "")}
    items = [_shingles(r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    for (name, stage), step in zip(c.STAGES[:-1], range(4), strict=True):
        one = stage(spark, one, sf)
        assert one.columns == docs.columns, name
        if step == 1:
            classes = _plain_classes({i: texts[0][i] for i in expected})
            expected = {i for i in expected if classes[i] == i}
        if step == 2:
            expected = {i for i in expected if not any(s and len(s & _shingles(texts[0][i])) / len(s) >= 0.8 for s in items)}
    p = pii.Pseudonyms(pii.session_key(spark))
    assert {r["doc_id"]: r["text"] for r in one.collect()} == {i: p.text(texts[0][i])[0] for i in expected}
    got = c.run(spark, sf).collect()
    assert {r["doc_id"] for r in got} == expected
    for s in {r["source"] for r in got}:
        own = [r for r in got if r["source"] == s]
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= max(r["size"] for r in own)


def test_pipeline_edges(spark, sf, odd, none):
    import corpus_pipeline as c

    for start in (odd, none):
        docs = start
        for _, stage in c.STAGES:
            docs = stage(spark, docs, sf)
        docs.collect()
