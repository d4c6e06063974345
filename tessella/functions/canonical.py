"""Canonical JSON of nested values, as Column expressions made from their schema: keys in order, no blanks, numbers as scripts write them.

Structs and maps become records with sorted keys, arrays keep their order, and a null becomes `null`, or is left out of records if asked for.
Numbers are the shortest digits that `cast` to text gives, without a trailing `.0`, with exponents from 1e21 on and below 1e-6.
"""

from __future__ import annotations

from collections.abc import Callable
from json import dumps

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.functions import identities

#: Control characters that JSON writes with a letter.
LETTERS = {"\b": "\\b", "\t": "\\t", "\n": "\\n", "\f": "\\f", "\r": "\\r"}
CONTROLS = {chr(c): LETTERS.get(chr(c), f"\\u{c:04x}") for c in range(32)}


def text(value: Column) -> Column:
    """A text as JSON."""
    plain = F.replace(F.replace(value, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    pairs = F.array(*(F.struct(F.lit(raw).alias("raw"), F.lit(written).alias("written")) for raw, written in CONTROLS.items()))
    escaped = F.aggregate(pairs, plain, lambda s, c: F.replace(s, c.raw, c.written))
    return F.concat(F.lit('"'), F.when(value.rlike("[\\x00-\\x1F]"), escaped).otherwise(plain), F.lit('"'))


def _exponential(written: Column) -> Column:
    """A positive number that `cast` writes with an exponent (from 1e7 on, below 1e-3)."""
    zeros = lambda count: F.repeat(F.lit("0"), count)

    def one(p: Column) -> Column:
        digits, n = p.digits, p.power + 1  # the value is 0.digits times 10 to the n
        k = F.length(digits)
        fraction = F.when(k > 1, F.concat(F.lit("."), F.substring(digits, F.lit(2), k))).otherwise("")
        scientific = F.concat(F.substring(digits, 1, 1), fraction, F.when(n > 0, "e+").otherwise("e-"), F.abs(n - 1).cast("string"))
        return (
            F.when((k <= n) & (n <= 21), F.concat(digits, zeros(n - k)))
            .when((n > 0) & (n <= 21), F.concat(F.substring(digits, F.lit(1), n), F.lit("."), F.substring(digits, n + 1, k)))
            .when((n > -6) & (n <= 0), F.concat(F.lit("0."), zeros(-n), digits))
            .otherwise(scientific)
        )

    digits = F.rtrim(F.replace(F.substring_index(written, "E", 1), F.lit("."), F.lit("")), F.lit("0"))
    return identities.bound(F.struct(digits.alias("digits"), F.substring_index(written, "E", -1).try_cast("int").alias("power")), one)


def number(value: Column) -> Column:
    """A double as JSON; `null` if it isn't finite. The value and its text are made once each: most numbers need no more than their last zeros cut."""
    positive = lambda written: F.when(F.contains(written, F.lit("E")), _exponential(written)).otherwise(F.rtrim(F.rtrim(written, F.lit("0")), F.lit(".")))
    finite = lambda v: ~F.isnan(v) & (F.abs(v) < float("inf"))
    return identities.bound(value, lambda v: F.when(finite(v), F.concat(F.when(v < 0, "-").otherwise(""), identities.bound(F.abs(v).cast("string"), positive))).otherwise("null"))


def _joined(parts: Column, opening: str, closing: str) -> Column:
    return F.concat(F.lit(opening), F.array_join(parts, ","), F.lit(closing))


def json(value: Column, kind: T.DataType, omit: bool = False) -> Column:
    """Canonical JSON of a column of that type. With `omit`, records leave out entries that are null."""
    inner: Callable[[Column, T.DataType], Column] = lambda v, k: json(v, k, omit)
    if isinstance(kind, T.StructType):
        fields = sorted(kind.fields, key=lambda f: f.name.encode("utf-16-be"))
        parts = [F.concat(F.lit(dumps(f.name, ensure_ascii=False) + ":"), inner(value.getField(f.name), f.dataType)) for f in fields]
        kept = F.array_compact(F.array(*(F.when(value.getField(f.name).isNotNull(), p) if omit else p for f, p in zip(fields, parts, strict=True)))) if fields else F.array().cast("array<string>")
        out = F.when(value.isNotNull(), _joined(kept, "{", "}"))
    elif isinstance(kind, T.MapType):
        if not isinstance(kind.keyType, T.StringType):
            raise TypeError("a record's keys are texts")
        entries = F.array_sort(F.transform(F.map_entries(value), lambda e: F.struct(e.key.alias("key"), inner(e.value, kind.valueType).alias("json"), e.value.isNull().alias("none"))))
        entries = F.filter(entries, lambda e: ~e.none) if omit else entries
        out = _joined(F.transform(entries, lambda e: F.concat(text(e.key), F.lit(":"), e.json)), "{", "}")
    elif isinstance(kind, T.ArrayType):
        out = _joined(F.transform(value, lambda v: inner(v, kind.elementType)), "[", "]")
    elif isinstance(kind, T.StringType):
        out = text(value)
    elif isinstance(kind, (T.DoubleType, T.FloatType)):
        out = number(value.cast("double"))
    elif isinstance(kind, T.BooleanType) or isinstance(kind, T.IntegralType):
        out = value.cast("string")
    elif isinstance(kind, T.DateType):
        out = text(value.cast("string"))
    else:
        raise TypeError(f"{kind.simpleString()} has no JSON of its own")
    return F.coalesce(out, F.lit("null"))


def identified(rows: DataFrame, column: str, name: str = "identity", digits: int = 64, omit: bool = False) -> DataFrame:
    """rows with the SHA-256 (so many digits of it) of a column's canonical JSON."""
    return rows.withColumn(name, F.substring(F.sha2(json(F.col(column), rows.schema[column].dataType, omit), 256), 1, digits))
