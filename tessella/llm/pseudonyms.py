"""Format-preserving Feistel pseudonyms for validated numbers, dates and other personal values.

Each kind of value is a bijection between its valid forms and the numbers below some n: cards without their
check digit, phone numbers by their allowed leading digits, dates by their day, and so on. A keyed Feistel
network over these numbers (walking cycles until the result is below n) permutes them, and the result
is written in the form of the original: separators stay, check digits are made anew. So a pseudonym is valid in its
format, equal values get equal pseudonyms in every document and spelling, different values never
meet, and the holder of the key can undo it. Values that don't validate are left alone. What tells a value's form stays in
clear: an e-mail address's domain, an IBAN's country, a key's prefix, and whether a date's day is above 12 (by which
a date written month first is told from one written day first).

A card or IBAN may run into what follows it (an expiry date, a security code, an amount, a currency). If the longest
match isn't valid, its shorter ends before a blank or hyphen are tried, for an IBAN its country's length first, else
the longest first; if none is valid either, the later kinds are tried from the same start.

Texts are rewritten in place, each by itself, without a shuffle, in time proportional to their length.

Defined results. Null text: null. Empty text or none found: unchanged. Repeated rows and null ids: each by its
text. Empty table: no rows. Very long texts: whole. Extra columns pass through `pseudonymised`.
"""

from __future__ import annotations

import datetime
import functools
import hashlib
import re
from bisect import bisect_right
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import fresh, text_slices

FEISTEL_ROUNDS = 8
FIRST_YEAR, LAST_YEAR = 1900, 2099
#: Symbols of a secret or a mail name that are moved at a time.
BLOCK = 48

DIGITS, LOWER, UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

#: Symbols of an IBAN by country.
IBAN_LENGTHS = {
    k: n
    for n, countries in {
        15: "NO",
        16: "BE",
        18: "DK FI FK FO GL NL SD",
        19: "MK SI",
        20: "AT BA EE KZ LT LU MN XK",
        21: "CH HR LI LV",
        22: "BG BH CR DE GB GE IE ME RS VA",
        23: "AE GI IL IQ OM SO TL",
        24: "AD CZ ES MD PK RO SA SE SK TN VG",
        25: "LY PT ST",
        26: "IS TR",
        27: "BI DJ FR GR IT MC MR SM",
        28: "AL AZ BY CY DO GT HU LB NI PL SV",
        29: "BR EG PS QA UA",
        30: "JO KW MU YE",
        31: "MT SC",
        33: "LC RU",
    }.items()
    for k in countries.split()
}


class Permutation:
    """A keyed permutation of the numbers below any n."""

    def __init__(self, key: bytes) -> None:
        self.key = hashlib.blake2b(key, digest_size=32).digest()

    def _round(self, tweak: bytes, i: int, half: int, bits: int) -> int:
        size = (bits + 7) // 8
        data = bytes([i]) + half.to_bytes(size + 1, "big")
        person = tweak if len(tweak) <= 16 else hashlib.blake2b(tweak, digest_size=16).digest()
        out = b"".join(hashlib.blake2b(data + bytes([block]), key=self.key, person=person, digest_size=64).digest() for block in range((size + 63) // 64))
        return int.from_bytes(out[:size], "big") & ((1 << bits) - 1)

    def _walk(self, x: int, n: int, tweak: bytes, rounds: list[int], forward: bool) -> int:
        bits = max(1, ((n - 1).bit_length() + 1) // 2)
        mask = (1 << bits) - 1
        while True:
            left, right = x >> bits, x & mask
            for i in rounds:
                if forward:
                    left, right = right, left ^ self._round(tweak, i, right, bits)
                else:
                    left, right = right ^ self._round(tweak, i, left, bits), left
            x = left << bits | right
            if x < n:
                return x

    def apply(self, x: int, n: int, tweak: str) -> int:
        return self._walk(x, n, tweak.encode(), list(range(FEISTEL_ROUNDS)), True)

    def invert(self, x: int, n: int, tweak: str) -> int:
        return self._walk(x, n, tweak.encode(), list(reversed(range(FEISTEL_ROUNDS))), False)


@dataclass(frozen=True)
class Move:
    """Moves a number below n by a permutation, or back."""

    permutation: Permutation
    forward: bool

    def __call__(self, x: int, n: int, tweak: str) -> int:
        return (self.permutation.apply if self.forward else self.permutation.invert)(x, n, tweak)


def _mixed(symbols: str, alphabets: list[str], tweak: str, move: Move) -> str:
    """Move a string whose i-th symbol is from the i-th alphabet."""
    n, x = 1, 0
    for s, a in zip(symbols, alphabets, strict=True):
        x, n = x * len(a) + a.index(s), n * len(a)
    x = move(x, n, tweak)
    out = []
    for a in reversed(alphabets):
        x, i = divmod(x, len(a))
        out.append(a[i])
    return "".join(reversed(out))


def _refill(form: str, symbols: str, of: str = DIGITS) -> str:
    """form with its symbols of an alphabet replaced in order."""
    fresh = iter(symbols)
    return "".join(next(fresh) if c in of else c for c in form)


_DOUBLED = dict(zip(DIGITS, (0, 2, 4, 6, 8, 1, 3, 5, 7, 9), strict=True))


def luhn_digit(digits: str) -> str:
    """The check digit that makes digits valid."""
    return str(-(sum(map(_DOUBLED.__getitem__, digits[::-2])) + sum(map(int, digits[-2::-2]))) % 10)


def _is_card(digits: str) -> bool:
    return 13 <= len(digits) <= 19 and luhn_digit(digits[:-1]) == digits[-1] and digits[0] != "0"


def _card(value: str, move: Move) -> str | None:
    digits = "".join(c for c in value if c in DIGITS)
    if not _is_card(digits):
        return None
    body = _mixed(digits[:-1], [DIGITS[1:], *[DIGITS] * (len(digits) - 2)], f"card{len(digits)}", move)
    return _refill(value, body + luhn_digit(body))


def _phone(value: str, move: Move) -> str | None:
    digits = "".join(c for c in value if c in DIGITS)
    own = digits[-10:]
    if own[0] in "01" or own[3] in "01" or digits[:-10] not in ("", "1"):
        return None
    lead = DIGITS[2:]
    return _refill(value, digits[:-10] + _mixed(own, [lead, DIGITS, DIGITS, lead, *[DIGITS] * 6], "phone", move))


def _address(value: str, move: Move) -> str | None:
    parts = value.split(".")
    if any(int(p) > 255 or (len(p) > 1 and p[0] == "0") for p in parts):
        return None
    x = move(int.from_bytes(bytes(map(int, parts)), "big"), 1 << 32, "ipv4")
    return ".".join(map(str, x.to_bytes(4, "big")))


@functools.cache
def _late_days() -> list[int]:
    """For each month from the first year on, and the end: days above 12 in the months before it."""
    months = [datetime.date(FIRST_YEAR + m // 12, m % 12 + 1, 1).toordinal() for m in range(12 * (LAST_YEAR + 1 - FIRST_YEAR) + 1)]
    return [day - months[0] - 12 * m for m, day in enumerate(months)]


def _date(value: str, move: Move) -> str | None:
    """Days up to 12 and days above 12 are permuted each among themselves, so that every spelling can be read again."""
    a, mark, b, _, c = re.match(r"(\d+)(\D)(\d+)(\D)(\d+)", value).groups()
    year_first = len(a) == 4
    year, day = (int(a), int(c)) if year_first else (int(c), int(a))
    month = int(b)
    swapped = not year_first and month > 12  # written month first
    if swapped:
        month, day = day, month
    try:
        datetime.date(year, month, day)
    except ValueError:
        return None
    if not FIRST_YEAR <= year <= LAST_YEAR:
        return None
    months, late = 12 * (year - FIRST_YEAR) + month - 1, _late_days()
    if day <= 12:
        months, day = divmod(move(12 * months + day - 1, 12 * (len(late) - 1), "early day"), 12)
        day += 1
    else:
        x = move(late[months] + day - 13, late[-1], "late day")
        months = bisect_right(late, x) - 1
        day = x - late[months] + 13
    year, month = FIRST_YEAR + months // 12, months % 12 + 1
    if year_first:
        return f"{year:04}{mark}{month:02}{mark}{day:02}"
    first, second = (month, day) if swapped else (day, month)
    return f"{first:02}{mark}{second:02}{mark}{year:04}"


def _social(value: str, move: Move) -> str | None:
    area, group, serial = (int(x) for x in value.split("-"))
    if not 1 <= area <= 899 or area == 666 or not group or not serial:
        return None
    areas = [a for a in range(1, 900) if a != 666]
    x = move((areas.index(area) * 99 + group - 1) * 9999 + serial - 1, len(areas) * 99 * 9999, "ssn")
    x, serial = divmod(x, 9999)
    area, group = divmod(x, 99)
    return f"{areas[area]:03}-{group + 1:02}-{serial + 1:04}"


def _iban(value: str, move: Move) -> str | None:
    text = value.replace(" ", "")
    number = lambda s: int("".join(str(int(c, 36)) for c in s))
    if number(text[4:] + text[:4]) % 97 != 1:
        return None
    body = _mixed(text[4:], [DIGITS if c in DIGITS else UPPER for c in text[4:]], f"iban{text[:2]}", move)
    check = f"{98 - number(body + text[:2] + '00') % 97:02}"
    return _refill(value, text[:2] + check + body, DIGITS + UPPER)


def _card_ends(value: str) -> Iterator[int]:
    """Shorter ends of a card, longest first, but none if a longer valid card starts further on."""
    places = [i for i, c in enumerate(value) if c in DIGITS]
    digits = "".join(value[i] for i in places)
    cuts = [k for k in range(1, len(digits)) if places[k] > places[k - 1] + 1]  # digits behind a blank or hyphen
    inner = max((b - a for a in cuts for b in [*cuts, len(digits)] if b - a >= 13 and _is_card(digits[a:b])), default=0)
    yield from (places[k - 1] + 1 for k in reversed(cuts) if k >= max(13, inner))


def _iban_ends(value: str) -> Iterator[int]:
    """Shorter ends of an IBAN: its country's length, then the others, longest first."""
    borders = [i for i, c in enumerate(value) if c == " " and len(value[:i].replace(" ", "")) >= 12]
    usual = IBAN_LENGTHS.get(value[:2])
    yield from sorted(reversed(borders), key=lambda b: len(value[:b].replace(" ", "")) != usual)


def _letters(value: str, move: Move, tweak: str) -> str:
    """Letters and digits move within their own class, other characters stay. Each block depends on the blocks before it."""
    out, before = [], b""
    for at in range(0, len(value), BLOCK):
        block = value[at : at + BLOCK]
        kinds = [next((a for a in (DIGITS, LOWER, UPPER) if c in a), c) for c in block]
        moved = _mixed(block, kinds, f"{tweak}{before.hex()}", move)
        before = hashlib.blake2b(before + (block if move.forward else moved).encode(), digest_size=16).digest()
        out.append(moved)
    return "".join(out)


def _email(value: str, move: Move) -> str | None:
    local, _, domain = value.partition("@")
    return f"{_letters(local, move, 'email')}@{domain}"


def _key(value: str, move: Move) -> str | None:
    return value[:4] + _mixed(value[4:], [UPPER + DIGITS] * (len(value) - 4), "key", move)


def _secret(value: str, move: Move) -> str | None:
    head, secret = re.match(r"(.*?[=:]\s*)(\S+)$", value, re.DOTALL).groups()
    return head + _letters(secret, move, "secret")


#: Each kind: its pattern and what moves a value, or gives None if it isn't valid. Earlier kinds go first.
KINDS: dict[str, tuple[str, Callable[[str, Move], str | None]]] = {
    "email": (r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", _email),
    "secret": (r"(?i:password|passwd|secret|api_key|token)\s*[=:]\s*[A-Za-z0-9]{6,}", _secret),
    "key": (r"\bAKIA[A-Z0-9]{16}\b", _key),
    "iban": (r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b", _iban),
    "date": (r"(?<![\d.])(?:\d{4}([-/.])\d{2}\1\d{2}|\d{2}([-/.])\d{2}\2\d{4})(?![\d]|\.\d)", _date),
    "ipv4": (r"(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?![\d]|\.\d)", _address),
    "ssn": (r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])", _social),
    "card": (r"(?<![\d-])\d(?:[ -]?\d){12,18}(?![\d-])", _card),
    "phone": (r"(?<![\d-])(?:\+?1[ .-]?)?(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}(?!\d)", _phone),
}
#: Kinds whose pattern can take in what follows a value, and the shorter ends to try.
ENDS: dict[str, Callable[[str], Iterator[int]]] = {"iban": _iban_ends, "card": _card_ends}
_MAYBE = re.compile(r"[0-9@=:]")


def _pattern() -> re.Pattern[str]:
    parts, groups = [], 0
    for name, (pattern, _) in KINDS.items():
        own = re.compile(pattern).groups
        shifted = re.sub(r"\\(\d)(?!\d)", lambda m, g=groups: f"\\{int(m[1]) + g + 1}", pattern) if own else pattern
        parts.append(f"(?P<{name}>{shifted})")
        groups += own + 1
    return re.compile("|".join(parts))


class Pseudonymiser:
    """Rewrites texts; keeps the values it has met up to a number."""

    def __init__(self, key: bytes, remembered: int = 100_000) -> None:
        self.permutation, self.pattern = Permutation(key), _pattern()
        self.patterns = {kind: re.compile(pattern) for kind, (pattern, _) in KINDS.items()}
        self.known: dict[tuple[str, str], str | None] = {}
        self.remembered = remembered

    def moved(self, kind: str, value: str) -> str | None:
        if (kind, value) not in self.known:
            if len(self.known) >= self.remembered:
                self.known.clear()
            self.known[kind, value] = KINDS[kind][1](value, Move(self.permutation, True))
        return self.known[kind, value]

    def original(self, kind: str, pseudonym: str) -> str | None:
        return KINDS[kind][1](pseudonym, Move(self.permutation, False))

    def _found(self, text: str, first: re.Match[str]) -> tuple[str, int, str] | None:
        """Kind, end and pseudonym of the valid value that starts where first does."""
        start, kinds = first.start(), list(KINDS)
        for kind in kinds[kinds.index(first.lastgroup) :]:
            if not (m := self.patterns[kind].match(text, start)):
                continue
            if (fresh := self.moved(kind, m[0])) is not None:
                return kind, m.end(), fresh
            for end in ENDS[kind](m[0]) if kind in ENDS else ():
                value = m[0][:end]
                if self.patterns[kind].fullmatch(value) and (fresh := self.moved(kind, value)) is not None:
                    return kind, start + end, fresh
        return None

    def rewrite(self, text: str | None) -> tuple[str | None, list[str]]:
        """The text with pseudonyms, and the kinds found in order."""
        if not text or not _MAYBE.search(text):
            return text, []
        out, kinds, at, search = [], [], 0, 0
        while m := self.pattern.search(text, search):
            found = self._found(text, m)
            if found is None:  # not valid: look again behind its first character
                search = m.start() + 1
                continue
            kind, end, fresh = found
            out += [text[at : m.start()], fresh]
            kinds.append(kind)
            at = search = end
        return "".join([*out, text[at:]]), kinds


def _rewriter(key: bytes, kinds: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = Pseudonymiser(key)
        for batch in batches:
            for part in text_slices(batch):
                done = [tool.rewrite(t) for t in part.column("text").to_pylist()]
                found = [pa.array([t for t, _ in done], pa.string()), pa.array([k for _, k in done], pa.list_(pa.string()))]
                rest = [(c, part.column(c)) for c in part.schema.names if c != "text"]
                yield pa.RecordBatch.from_arrays([*(v for _, v in rest), *found], names=[*(c for c, _ in rest), "text", kinds])

    return run


def _rewritten(docs: DataFrame, key: bytes, kinds: str) -> DataFrame:
    docs = docs.withColumn("text", F.col("text").cast("string"))
    schema = docs.drop("text").withColumn("text", F.lit("").cast("string")).withColumn(kinds, F.array(F.lit(""))).schema
    for field in schema:
        field.nullable = True
    return docs.mapInArrow(_rewriter(key, kinds), schema)


def pseudonymised(docs: DataFrame, key: bytes) -> DataFrame:
    """docs with the values in text replaced."""
    (kinds,) = fresh(docs, "kinds")
    return _rewritten(docs, key, kinds).select(*(F.col(f"`{c}`") for c in docs.columns))


def pseudonym_report(docs: DataFrame, key: bytes) -> DataFrame:
    """doc_id, n_found, kinds (distinct, sorted, comma-joined) and the rewritten text for each row."""
    out = _rewritten(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), key, "kinds")
    return out.select("doc_id", F.coalesce(F.size("kinds"), F.lit(0)).cast("long").alias("n_found"), F.array_join(F.array_sort(F.array_distinct("kinds")), ",").alias("kinds"), "text")
