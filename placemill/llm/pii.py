"""Personal data: format-preserving pseudonyms by a keyed Feistel permutation.

Found and validated: card numbers (13 to 19 digits, Luhn), IBANs (mod 97), US social security numbers, IPv4 and IPv6
addresses, phone numbers, e-mail addresses (the part before the @; domains stay) and calendar dates (1900 to 2099), as
numbers or with an English, German, French or Spanish month name. A value is read as a number within its format (digits
by place, letters by alphabet, days since 1900), mapped to another number of the same format, and written back with the
punctuation it had; check digits are computed anew, so the result is valid again. Numbers that fail validation stay. Of a
run of digit groups that is no card number as a whole, the first and longest run of groups within it that is one counts. A date may be
followed by T and a time, which stays.

The key comes from the session (KEY_SETTING); there is none in the source, so the source alone inverts nothing.

The map is E = P^-1 (P(x) + c), P a ten-round Feistel network over a x b >= n with cycle walking, c from 1 to n - 1, both
keyed: a permutation of the format without fixed points. Equal values get equal pseudonyms in every document, and
different values get different ones. Whoever has the key can invert it.

Defined cases: null stays null; an empty text and an empty table stay; texts of any length are read whole; repeated rows
get equal texts; a value of which nothing can be permuted stays; columns beside the text and its count are handed on as they
are, whatever their names.
"""

from __future__ import annotations

import datetime
import hashlib
import ipaddress
import re
import secrets
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The session setting that holds the key, any text; jobs whose pseudonyms must agree set the same one.
KEY_SETTING = "spark.placemill.pii.key"
RESULT = "struct<text: string, n_found: int, kinds: array<string>>"
_ALPHABETS = ("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "ßàáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿ", "ÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÐÑÒÓÔÕÖØÙÚÛÜÝÞ")
_PLACE = {c: (a, i) for a in _ALPHABETS for i, c in enumerate(a)}
_FIRST_DAY, _DAYS = datetime.date(1900, 1, 1).toordinal(), datetime.date(2100, 1, 1).toordinal() - datetime.date(1900, 1, 1).toordinal()
_ROUNDS = 10
# Month names, by language.
_MONTHS = {
    "en": "January February March April May June July August September October November December".split(),
    "de": "Januar Februar März April Mai Juni Juli August September Oktober November Dezember".split(),
    "fr": "janvier février mars avril mai juin juillet août septembre octobre novembre décembre".split(),
    "es": "enero febrero marzo abril mayo junio julio agosto septiembre octubre noviembre diciembre".split(),
}
_MONTH_OF = {name.lower(): (lang, i) for lang, names in reversed(_MONTHS.items()) for i, name in enumerate(names)}
_MONTH_OF |= {name[:3].lower(): ("en", i) for i, name in enumerate(_MONTHS["en"])}


class Permutation:
    """A keyed permutation of 0 .. n - 1 that moves every number (n > 1)."""

    def __init__(self, key: bytes, name: str, n: int):
        self.n = n
        self.key = hashlib.blake2b(f"{name}/{n}".encode(), key=key[:64], digest_size=32).digest()
        root = max(1, int(n**0.5))
        while root * root < n:
            root += 1
        self.a, self.b = root, -(-n // root)
        self.step = 1 + self._f(99, 0) % (n - 1) if n > 1 else 0

    def _f(self, i: int, x: int) -> int:
        return int.from_bytes(hashlib.blake2b(i.to_bytes(1, "big") + x.to_bytes((x.bit_length() + 8) // 8, "big"), key=self.key, digest_size=24).digest(), "big")

    def _feistel(self, x: int, forth: bool) -> int:
        left, right = divmod(x, self.b)
        for i in range(_ROUNDS) if forth else reversed(range(_ROUNDS)):
            if i % 2:
                right = (right + (self._f(i, left) if forth else -self._f(i, left))) % self.b
            else:
                left = (left + (self._f(i, right) if forth else -self._f(i, right))) % self.a
        return left * self.b + right

    def _walk(self, x: int, forth: bool) -> int:
        x = self._feistel(x, forth)
        while x >= self.n:
            x = self._feistel(x, forth)
        return x

    def __call__(self, x: int) -> int:
        return self._walk((self._walk(x, True) + self.step) % self.n, False) if self.n > 1 else x

    def invert(self, x: int) -> int:
        return self._walk((self._walk(x, True) - self.step) % self.n, False) if self.n > 1 else x


def luhn(digits: str) -> int:
    """The sum that a valid number has divisible by ten."""
    twice = [0, 2, 4, 6, 8, 1, 3, 5, 7, 9]
    return sum(twice[int(c)] if i % 2 else int(c) for i, c in enumerate(reversed(digits)))


def iban_rest(iban: str) -> int:
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97


class Pseudonyms:
    def __init__(self, key: bytes, back: bool = False):
        self.key, self.back = key, back
        self.made: dict[tuple[str, int], Permutation] = {}

    def move(self, kind: str, x: int, n: int) -> int:
        p = self.made.get((kind, n))
        if p is None:
            p = self.made[kind, n] = Permutation(self.key, kind, n)
        return p.invert(x) if self.back else p(x)

    def letters(self, kind: str, text: str) -> str:
        """Letters and digits permuted together, each within its alphabet; other characters stay."""
        x, n = 0, 1
        for c in text:
            if c in _PLACE:
                a, i = _PLACE[c]
                x, n = x * len(a) + i, n * len(a)
        x, out = self.move(kind, x, n), []
        for c in reversed(text):
            if c in _PLACE:
                x, i = divmod(x, len(_PLACE[c][0]))
                c = _PLACE[c][0][i]
            out.append(c)
        return "".join(reversed(out))

    def card(self, m: re.Match) -> str | None:
        digits = re.sub(r"\D", "", m[0])
        if luhn(digits) % 10 or not int(digits):
            return None
        body = digits[0] + self.letters("card", digits[1:-1])
        return _refill(m[0], body + str(-luhn(body + "0") % 10))

    def card_within(self, text: str) -> tuple[str, int] | None:
        """The text up to the end of the first and longest run of whole digit groups that is a card number, and that end."""
        borders = [i for i, c in enumerate(text) if c in " -"]
        for start in (0, *(i + 1 for i in borders)):
            for end in (len(text), *reversed(borders)):
                if (fit := _ANCHORED["card"].fullmatch(text, start, end)) and (new := self.card(fit)) is not None:
                    return text[:start] + new, end
        return None

    def iban(self, m: re.Match) -> str | None:
        code = m[0].replace(" ", "")
        if not 15 <= len(code) <= 34 or iban_rest(code) != 1:
            return None
        body = self.letters("iban", code[4:])
        code = f"{code[:2]}{98 - iban_rest(code[:2] + '00' + body):02d}{body}"
        out = iter(code)
        return "".join(c if c == " " else next(out) for c in m[0])

    def ssn(self, m: re.Match) -> str | None:
        a, b, c = map(int, m[0].split("-"))
        if not (0 < a < 900 and a != 666 and b and c):
            return None
        a -= 1 + (a > 666)
        x = self.move("ssn", (a * 99 + b - 1) * 9999 + c - 1, 898 * 99 * 9999)
        a, b, c = x // (99 * 9999) + 1, x // 9999 % 99 + 1, x % 9999 + 1
        return f"{a + (a >= 666):03d}-{b:02d}-{c:04d}"

    def ip(self, m: re.Match) -> str | None:
        parts = [int(p) for p in m[0].split(".")]
        if max(parts) > 255:
            return None
        x = self.move("ip", int.from_bytes(bytes(parts), "big"), 1 << 32)
        return ".".join(map(str, x.to_bytes(4, "big")))

    def phone(self, m: re.Match) -> str | None:
        digits = re.sub(r"\D", "", m[0])
        code = ""
        if m[0].startswith("+"):
            head = re.match(r"\+(\d{1,3})(?!\d)", m[0])
            code = head[1] if head else digits[: 1 if digits[0] in "17" else 2]
        rest = digits[len(code) :]
        if not (len(rest) == 10 if code in ("", "1") else 7 <= len(rest) <= 15 - len(code)):
            return None
        return _refill(m[0], code + self.letters("phone" + (code or "1"), rest))

    def date(self, m: re.Match) -> str | None:
        a, sep, b, c = re.match(r"(\d+)(\D)(\d+)\D(\d+)", m[0]).groups()
        if len(a) == 4:
            order = "ymd"
        else:
            order = "mdy" if sep == "/" and int(a) <= 12 and int(b) <= 31 else "dmy"
        own = dict(zip(order, (a, b, c), strict=True))
        try:
            day = datetime.date(int(own["y"]), int(own["m"]), int(own["d"])).toordinal() - _FIRST_DAY
        except ValueError:
            return None
        if not 0 <= day < _DAYS:
            return None
        new = datetime.date.fromordinal(self.move("date", day, _DAYS) + _FIRST_DAY)
        short = len(a) == 1 or len(b) == 1
        part = {"y": f"{new.year:04d}", "m": str(new.month) if short else f"{new.month:02d}", "d": str(new.day) if short else f"{new.day:02d}"}
        return sep.join(part[k] for k in order)

    def words(self, m: re.Match) -> str | None:
        """A date with a month's name: "12 May 1980", "May 12, 1980"; the name stays in its language and length."""
        one, gap, two, mark, year = re.fullmatch(r"(\d+|[^\W\d]+)((?:\.|er|th|st|nd|rd)?(?: de)? )(\d+|[^\W\d]+)(,? (?:de )?)(\d{4})", m[0]).groups()
        name, day = (two, one) if one.isdigit() else (one, two)
        if name.lower() not in _MONTH_OF:
            return None
        lang, month = _MONTH_OF[name.lower()]
        try:
            at = datetime.date(int(year), month + 1, int(day)).toordinal() - _FIRST_DAY
        except ValueError:
            return None
        if not 0 <= at < _DAYS:
            return None
        new = datetime.date.fromordinal(self.move("date", at, _DAYS) + _FIRST_DAY)
        called = _MONTHS[lang][new.month - 1]
        called = called[:3] if len(name) == 3 and name.lower() != _MONTHS[lang][month].lower() else called
        called = called.upper() if name.isupper() else called.capitalize() if name[0].isupper() else called.lower()
        number = f"{new.day:02d}" if len(day) == 2 and day[0] == "0" else str(new.day)
        return f"{number if one.isdigit() else called}{gap}{called if one.isdigit() else number}{mark}{new.year:04d}"

    def ip6(self, m: re.Match) -> str | None:
        """Written out in full, so that it has no shortest form to keep. Fewer than three groups ("a::b") are no address here."""
        if len(re.findall(r"[0-9A-Fa-f]+", m[0])) < 3:
            return None
        try:
            x = int(ipaddress.IPv6Address(m[0]))
        except ValueError:
            return None
        return ipaddress.IPv6Address(self.move("ip6", x, 1 << 128)).exploded

    def email(self, m: re.Match) -> str | None:
        local, _, domain = m[0].partition("@")
        new = self.letters("email", local)
        return None if new == local else f"{new}@{domain}"

    def text(self, text: str) -> tuple[str, list[str]]:
        """The text with pseudonyms, and the kind of each value found."""
        found: list[str] = []

        def swap(m: re.Match) -> str:
            kinds = (m.lastgroup,) if m.lastgroup != "number" else ("card", "phone")
            for kind in kinds:
                make: Callable = getattr(self, kind)
                fit = m if m.lastgroup != "number" else _ANCHORED[kind].fullmatch(m[0])
                if fit and (new := make(fit)) is not None:
                    found.append(_CALLED.get(kind, kind))
                    return new
            return m[0]

        if "@" in text:
            text = _EMAIL.sub(swap, text)
        if _YEAR.search(text):
            text = _WORDS.sub(swap, text)
        if "::" in text or text.count(":") >= 7:
            text = _IP6.sub(swap, text)
        if _DIGIT.search(text):
            out, at = [], 0
            while m := _NUMBER.search(text, at):
                new, end = swap(m), m.end()
                # digits around a card number may have been read as part of it
                if new == m[0] and m.lastgroup == "number" and (card := self.card_within(m[0])):
                    found.append("card")
                    new, end = card[0], m.start() + card[1]
                out += [text[at : m.start()], new]
                at = end
            text = "".join([*out, text[at:]])
        return text, found


def _refill(old: str, digits: str) -> str:
    new = iter(digits)
    return "".join(next(new) if c.isdigit() else c for c in old)


_DIGIT = re.compile(r"[0-9]{2}|[0-9][/.)]")
_EMAIL = re.compile(r"(?<![\w%+.-])(?P<email>[\w%+-]+(?:\.[\w%+-]+)*@(?:[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?\.)+[A-Za-z]{2,})")
_CALLED = {"words": "date", "ip6": "ip"}
_YEAR = re.compile(r" (?:19|20)[0-9]{2}")
_NAMES = "|".join(sorted(_MONTH_OF, key=len, reverse=True))
_WORDS = re.compile(rf"(?<!\w)(?P<words>[0-9]{{1,2}}(?:\.|er|th|st|nd|rd)?(?: de)? (?i:{_NAMES})(?: de)? (?:19|20)[0-9]{{2}}|(?i:{_NAMES}) [0-9]{{1,2}},? (?:19|20)[0-9]{{2}})(?!\w)")
_IP6 = re.compile(r"(?<![0-9A-Za-z:.])(?P<ip6>(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,6})?::(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,6})?)(?![0-9A-Za-z:]|\.[0-9])")
_CARD = r"[0-9](?:[ -]?[0-9]){12,18}"
_PHONE = r"(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{2,4}\)|[0-9]{2,4})(?:[ .-]?[0-9]{2,4}){2,4}"
_ANCHORED = {"card": re.compile(_CARD), "phone": re.compile(r"\+[0-9]{8,15}|\+[0-9]{1,3}[ .-]?(?:\([0-9]{2,4}\)|[0-9]{2,4})(?:[ .-]?[0-9]{2,4}){2,4}|\([0-9]{3}\)[ .-]?[0-9]{3}[ .-][0-9]{4}|[0-9]{3}[ .-][0-9]{3}[ .-][0-9]{4}")}
_NUMBER = re.compile(
    r"(?P<iban>(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9]))"
    r"|(?<![0-9A-Za-z.+-])(?:"
    r"(?P<date>[0-9]{4}(?:-[0-9]{2}-|/[0-9]{2}/)[0-9]{2}(?:(?=[Tt][0-9]{2}:?[0-9]{2})|(?![0-9A-Za-z/-]))|[0-9]{1,2}(?:/[0-9]{1,2}/|\.[0-9]{1,2}\.)[0-9]{4}(?![0-9A-Za-z/]|\.[0-9]))"
    r"|(?P<ip>[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9A-Za-z]|\.[0-9]))"
    r"|(?P<ssn>[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])))"
    r"|(?<![0-9A-Za-z.-])(?P<number>\+[0-9]{8,15}(?![0-9A-Za-z])|" + _CARD + r"(?![0-9A-Za-z])|" + _PHONE + r"(?![0-9A-Za-z]|[.-][0-9]))",
)


def session_key(spark: SparkSession) -> bytes:
    """The key of KEY_SETTING; where it is unset, a new secret one, which the session then keeps and no other session has."""
    if not (key := spark.conf.get(KEY_SETTING, None)):
        key = secrets.token_hex(32)
        spark.conf.set(KEY_SETTING, key)
    return hashlib.blake2b(key.encode(), digest_size=64).digest()


def pseudonymiser(key: bytes):
    """An Arrow UDF over a text column; see RESULT."""

    @F.arrow_udf(RESULT)
    def swap(texts: pa.Array) -> pa.Array:
        p = Pseudonyms(key)
        done = [(None, []) if t is None else p.text(t) for t in texts.to_pylist()]
        return pa.StructArray.from_arrays([pa.array([t for t, _ in done], pa.string()), pa.array([len(k) for _, k in done], pa.int32()), pa.array([sorted(set(k)) for _, k in done], pa.list_(pa.string()))], names=["text", "n_found", "kinds"])

    return swap


def pseudonyms(text: str | Column = "text", *, key: bytes) -> Column:
    return pseudonymiser(key)(text)


def replace(docs: DataFrame, text_col: str = "text", count_col: str | None = "n_chars", *, key: bytes) -> DataFrame:
    """docs with pseudonyms in the text; count_col, where docs has it, then counts the new text's characters."""
    out = docs.withColumn(text_col, pseudonyms(text_col, key=key)["text"])
    return out.withColumn(count_col, F.coalesce(F.length(text_col), count_col).cast(dict(docs.dtypes)[count_col])) if count_col in docs.columns else out
