"""Identities: canonical JSON of flat records, and hashes of texts and numbers, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Start and factor of the two lanes.
FIRST, SECOND = (0x811C9DC5, 0x01000193), (0x9E3779B9, 0x85EBCA6B)
_LOW = (1 << 32) - 1


def bound(value: Column, then) -> Column:
    """then(value), where the value is made once, however often it is used (inner functions make theirs anew for every element)."""
    return F.element_at(F.transform(F.array(value), then), 1)


def code_units(text: Column) -> Column:
    """The UTF-16 code units of a text, as longs."""
    unit = lambda raw: lambda i: F.conv(F.substring(raw, 4 * i + 1, F.lit(4)), 16, 10).cast("long")
    places = lambda raw: F.sequence(F.lit(0), F.greatest(F.lit(0), (F.length(raw) / 4).cast("int") - 1))
    return bound(F.hex(F.encode(text, "UTF-16BE")), lambda raw: F.when(raw == "", F.array().cast("array<bigint>")).otherwise(F.transform(places(raw), unit(raw))))


def _times(h: Column, factor: int) -> Column:
    """h * factor modulo 2**32 without leaving a long."""
    high, low = F.shiftright(h, 16), h.bitwiseAND(F.lit(0xFFFF))
    return ((high * factor).bitwiseAND(F.lit(0xFFFF)) * 65536 + low * factor).bitwiseAND(F.lit(_LOW))


def _lane(values: Column, lane: tuple[int, int], plus=lambda c, i: c) -> Column:
    numbered = F.transform(values, lambda c, i: plus(c, i))
    return F.aggregate(numbered, F.lit(lane[0]).cast("long"), lambda h, c: _times(h.bitwiseXOR(c), lane[1]))


def _hex8(h: Column) -> Column:
    return F.lpad(F.lower(F.hex(h)), 8, "0")


def paired_hash(text: Column) -> Column:
    """16 hex digits: two lanes over the code units, the second mixed with their places."""
    return bound(code_units(text), lambda units: F.concat(_hex8(_lane(units, FIRST)), _hex8(_lane(units, SECOND, lambda c, i: c + i))))


def text_fingerprint(text: Column) -> Column:
    """16 hex digits: two lanes over the low and high bytes of the code units."""
    halves = F.flatten(F.transform(code_units(text), lambda c: F.array(c.bitwiseAND(F.lit(255)), F.shiftright(c, 8))))
    return bound(halves, lambda h: F.concat(_hex8(_lane(h, FIRST)), _hex8(_lane(h, SECOND))))


def short_hash(text: Column) -> Column:
    """Seven digits of base 36: one lane over the code units."""
    return F.lpad(F.lower(F.conv(_lane(code_units(text), FIRST).cast("string"), 10, 36)), 7, "0")


def canonical(entries: dict[str, Column]) -> Column:
    """JSON of a record with its keys in order; null entries are left out."""
    parts = [F.when(v.isNotNull(), F.concat(F.lit(f'"{k}":'), v)) for k, v in sorted(entries.items())]
    return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))


def quoted(text: Column) -> Column:
    """A text as a JSON string."""
    return F.concat(F.lit('"'), F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))


def listed(values: Column) -> Column:
    """Texts that are JSON already, as a JSON array."""
    return F.concat(F.lit("["), F.array_join(values, ","), F.lit("]"))


def record_hash(entries: dict[str, Column], digits: int = 64) -> Column:
    """SHA-256 of the canonical JSON."""
    return F.substring(F.sha2(canonical(entries), 256), 1, digits)
