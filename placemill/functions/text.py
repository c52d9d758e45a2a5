"""Text as columns: folding, tokens, analyzers, edit distance."""

from __future__ import annotations

import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

# What accented and joined letters fold to, after lower-casing.
FOLD_ONE = {"à": "a", "á": "a", "â": "a", "ã": "a", "å": "a", "è": "e", "é": "e", "ê": "e", "ë": "e", "ì": "i", "í": "i", "î": "i", "ï": "i", "ò": "o", "ó": "o", "ô": "o", "õ": "o", "ù": "u", "ú": "u", "û": "u", "ý": "y", "ÿ": "y", "ñ": "n", "ç": "c", "ø": "o", "ð": "d"}
FOLD_TWO = {"ä": "ae", "ö": "oe", "ü": "ue", "ß": "ss", "æ": "ae", "þ": "th"}
# English stop words of the standard analyzer.
STOP_WORDS = tuple("a an and are as at be but by for if in into is it no not of on or such that the their then there these they this to was will with".split())

_TOKEN = r"[\p{L}\p{Nd}]+"
_FOLD_NOW = str.maketrans(FOLD_ONE | FOLD_TWO)


#: White space of any kind: ASCII, next line, and the separators of Unicode.
_SPACES = "\t\n\x0b\f\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def trim(c: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.btrim(c, F.lit(_SPACES))


def trim_now(s: str) -> str:
    """trim() of a text that the driver holds."""
    return s.strip(_SPACES)


def fold(c: Column) -> Column:
    """Lower-cased, accents and joined letters as ASCII."""
    out = F.translate(F.lower(c), "".join(FOLD_ONE), "".join(FOLD_ONE.values()))
    for a, b in FOLD_TWO.items():
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def compact(c: Column) -> Column:
    return F.regexp_replace(c, r"[^\p{L}\p{Nd}]", "")


def tokens(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(f"({_TOKEN})"), F.lit(1))


def as_bytes(c: Column) -> Column:
    """One character per UTF-8 byte, so that string functions count bytes."""
    return F.decode(F.encode(c, "UTF-8"), "ISO-8859-1")


def within_one_edit(a: Column, b: Column) -> Column:
    """Whether the byte edit distance is at most one."""
    return F.levenshtein(as_bytes(a), as_bytes(b), 1) >= 0


def edit_distance(a: Column, b: Column) -> Column:
    return F.levenshtein(as_bytes(a), as_bytes(b))


# --- analyzers ---------------------------------------------------------------------------------------------------


def standard(c: Column) -> Column:
    stop = F.array(*[F.lit(w) for w in STOP_WORDS])
    return F.filter(tokens(F.lower(c)), lambda t: ~F.array_contains(stop, t))


_WORD_NOW = regex.compile(_TOKEN)


def words_now(s: str) -> list[str]:
    """tokens() of a text that the driver holds."""
    return _WORD_NOW.findall(s)


def fold_now(s: str) -> str:
    """fold() of a text that the driver holds."""
    return s.lower().translate(_FOLD_NOW)


def standard_words(s: str) -> tuple[str, ...]:
    """Distinct terms of standard() of a text that the driver holds."""
    return tuple(sorted(set(words_now(s.lower())) - set(STOP_WORDS)))


def edge_ngrams(c: Column, most: int = 12) -> Column:
    return F.flatten(F.transform(tokens(F.lower(c)), lambda t: F.transform(F.sequence(F.lit(1), F.least(F.lit(most), F.length(t))), lambda n: F.substring(t, F.lit(1), n))))


def ngrams(c: Column, least: int = 2, most: int = 15) -> Column:
    def of(t: Column) -> Column:
        sizes = F.when(F.length(t) >= least, F.sequence(F.lit(least), F.least(F.lit(most), F.length(t)))).otherwise(F.array().cast("array<int>"))
        return F.flatten(F.transform(sizes, lambda n: F.transform(F.sequence(F.lit(1), F.length(t) - n + 1), lambda i: F.substring(t, i, n))))

    return F.flatten(F.transform(tokens(F.lower(c)), of))


def keyword(c: Column) -> Column:
    return F.array(F.lower(c))


ANALYZERS = {"standard": standard, "edge_ngram": edge_ngrams, "ngram": ngrams, "keyword": keyword}

# --- matches of a value with a query -----------------------------------------------------------------------------


def folded(values: Column) -> Column:
    """Values as matches look at them; empty ones are left out."""
    return F.transform(F.filter(values, lambda v: F.coalesce(v, F.lit("")) != ""), lambda v: fold(trim(v)))


_W, _N = r"[\p{L}\p{Nd}]", r"[^\p{L}\p{Nd}]"


def has_prefix(v: Column, c: str) -> Column:
    """Whether the value without its other characters, or one of its words, starts with c, which is letters and digits: one search of the value."""
    return F.rlike(v, F.lit(f"(?:(?<!{_W}){c}|^{_N}*+{f'{_N}*+'.join(c)})"))


def has_near_word(v: Column, c: str) -> Column:
    """Whether the value without its other characters, or one of its words, is within one byte edit of c (lower-case letters and digits).

    Words one edit from ASCII letters are ASCII, so a search for all of them finds such a word; for others each word of a fitting length is compared.
    A value of more than one letter beyond c's bytes is too long as a whole, which shows after so many of its letters.
    """
    n = len(c.encode())
    if c.isascii():
        any_ = "[a-z0-9]"
        less = "?" if len(c) > 1 else ""  # no word is empty
        ways = [f"{c[:i]}{any_}{less}{c[i + 1 :]}" for i in range(len(c))] + [f"{c[:i]}{any_}{c[i:]}" for i in range(len(c) + 1)]
        word = F.rlike(v, F.lit(f"(?<!{_W})(?:{'|'.join(dict.fromkeys(ways))})(?!{_W})"))
    else:
        word = F.exists(tokens(v), lambda t: (F.abs(F.octet_length(t) - n) <= 1) & within_one_edit(t, F.lit(c)))
    short = F.rlike(v, F.lit(f"^{_N}*+(?:{_W}{_N}*+){{0,{n + 1}}}+\\z"))
    return word | (short & within_one_edit(compact(v), F.lit(c)))


def _has_word(v: Column, test) -> Column:
    """Whether the value without its other characters, or one of its words, passes."""
    return test(compact(v)) | F.exists(tokens(v), test)


def best_match(values: Column, query: Column | str, held: bool = False) -> Column:
    """The best of the values: 400 equal, 300 contained, 220 prefix, 160 within one edit, else 0. values: folded.

    A worse kind of match is looked for only where no value has a better one. A query that the driver holds is searched for by patterns.
    held: some value is known to contain the query, so that all that matters is whether a value equals it.
    """
    any_ = lambda test: F.exists(values, test)
    if isinstance(query, str):
        said = fold_now(trim_now(query))
        letters = "".join(words_now(said))
        if said == "":
            return F.lit(0.0)
        if held:
            return F.when(any_(lambda v: trim(v) == trim_now(said)), 400.0).otherwise(300.0)
        out = F.when(F.size(values) == 0, 0.0).when(any_(lambda v: trim(v) == trim_now(said)), 400.0).when(any_(lambda v: F.contains(v, F.lit(said))), 300.0)
        if not letters:
            return out.otherwise(0.0)
        return out.when(any_(lambda v: has_prefix(v, letters)), 220.0).when(any_(lambda v: has_near_word(v, letters)), 160.0).otherwise(0.0)
    q = fold(trim(query))
    c = compact(q)
    out = F.when((q == "") | (F.size(values) == 0), 0.0).when(any_(lambda v: trim(v) == trim(q)), 400.0).when(any_(lambda v: F.contains(v, q)), 300.0)
    out = out.when((c != "") & any_(lambda v: _has_word(v, lambda t: F.startswith(t, c))), 220.0)
    return out.when((c != "") & any_(lambda v: _has_word(v, lambda t: within_one_edit(t, c))), 160.0).otherwise(0.0)


def text_match(value: Column, query: Column) -> Column:
    """best_match of one value, folded on both sides."""
    return best_match(folded(F.array(value)), query)


def exact_match(values: Column, query: Column) -> Column:
    """Whether one of the values is the query. values: folded."""
    q = fold(trim(query))
    return (q != "") & F.array_contains(values, q)


def direct_match(value: Column, query: str, prefix: bool = False, fuzzy: bool = False) -> Column:
    """Lower-cased containment; with the flags also prefix of the compact value or a token, or one edit. No accent folding."""
    v, q = F.lower(value), query.lower()
    c = "".join(words_now(q))
    out = F.contains(v, F.lit(q))
    if prefix and c:
        out = out | has_prefix(v, c)
    if fuzzy and c:
        out = out | has_near_word(v, c)
    return (F.coalesce(value, F.lit("")) != "") & F.lit(q != "") & out


def short_enough(values: Column, query: str) -> Column:
    """The values that folding can make equal to the query: it takes no letter away, so those of no more letters than it has."""
    n = len(fold_now(trim_now(query)))
    return F.filter(F.transform(F.filter(values, lambda v: F.coalesce(v, F.lit("")) != ""), trim), lambda v: F.length(v) <= n)


# --- query texts -------------------------------------------------------------------------------------------------

_NEAR = r"(?di)^(.+?)\s+(near|in|around|close\s+to)\s+(.+)\z"


def near_parts(query: Column) -> tuple[Column, Column]:
    """What and where of "X near Y"; both null if the text isn't of that form or X has more than five words."""
    what, where = trim(F.regexp_extract(query, _NEAR, 1)), trim(F.regexp_extract(query, _NEAR, 3))
    ok = (what != "") & (where != "") & (F.size(F.regexp_extract_all(what, F.lit(r"(\S+)"), F.lit(1))) <= 5)
    return F.when(ok, what), F.when(ok, where)


def query_fields(query: Column) -> Column:
    """One more than the number of spaces; 0 for the empty text."""
    return F.when(query == "", 0).otherwise(F.length(query) - F.length(F.replace(query, F.lit(" "), F.lit(""))) + 1)


_LEADING = r"(?d)^(\d[\p{L}\p{N}/-]*)[,\s]+(.+)\z"
_TRAILING = r"(?d)^(.+?)[,\s]+(\d[\p{L}\p{N}/-]*)\z"


def split_address(street: Column, number: Column) -> tuple[Column, Column]:
    """Street and house number, the latter taken from the front or end of the street where it is missing or the same."""
    s = trim(street)
    lead = F.regexp_extract(s, _LEADING, 1)
    found = F.when(lead != "", lead).otherwise(F.regexp_extract(s, _TRAILING, 2))
    rest = F.when(lead != "", F.regexp_extract(s, _LEADING, 2)).otherwise(F.regexp_extract(s, _TRAILING, 1))
    given = trim(number)
    split = (found != "") & ((given == "") | (F.lower(found) == F.lower(given)))
    return F.when(split, trim(rest)).otherwise(s), F.when(split & (given == ""), found).otherwise(given)


def radius_metres(text: Column) -> Column:
    """Whole metres of "2km", "500m" or "500"; what can't be read is 0."""
    t = F.lower(text)
    n = F.coalesce(F.regexp_extract(t, r"^\s*([+-]?\d+(?:\.\d*)?|\.\d+)", 1).try_cast("double"), F.lit(0.0))
    return F.when(F.endswith(t, F.lit("km")), n * 1000).otherwise(n).cast("int")
