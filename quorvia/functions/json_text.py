"""JSON texts as Column expressions, byte for byte as Python's ``json.dumps`` writes them.

Numbers are the shortest decimals that read back as the same double, in Python's layout;
texts are escaped as Python escapes them; keys are sorted by code point. So a value can be
signed, and a signature checked, row by row in the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DataType, DecimalType, FractionalType, IntegralType, MapType, StringType, StructType

from quorvia.functions.distributions import col, let

#: A double has at most so many significant digits.
DIGITS = 17
SHORT_ESCAPES = {"\b": "\\b", "\f": "\\f", "\n": "\\n", "\r": "\\r", "\t": "\\t"}


def shortest_digits(x: Column) -> Column:
    """digits (no zeros at either end) and point, so that a positive x is 0.digits times ten to the point.

    The JVM's own text may have more digits than needed, and be off in the last; it is rounded
    to each number of digits, and the first, or a neighbour, that reads back as x is taken.
    """
    text = x.cast("string")
    mantissa = F.split_part(text, F.lit("E"), F.lit(1))
    whole, fraction = (F.split_part(mantissa, F.lit("."), F.lit(i)) for i in (1, 2))
    power = F.coalesce(F.split_part(text, F.lit("E"), F.lit(2)).try_cast("int"), F.lit(0))
    every = F.regexp_replace(F.concat(whole, fraction), "^0+", "")
    lead = F.length(whole) + F.length(fraction) - F.length(every)
    parts = F.struct(F.concat(F.lit("0."), every).cast(f"decimal({DIGITS + 3},{DIGITS + 1})").alias("m"), (F.length(whole) - lead + power).alias("point"))

    def chosen(p: Column) -> Column:
        wide = f"decimal({DIGITS + 3},{DIGITS + 1})"
        near = lambda k: (0, 1, -1) if k >= DIGITS - 2 else (0,)
        rounded = [(F.round(p["m"], k) + F.lit(f"{step}e-{k}").cast(wide)).cast(wide) for k in range(1, DIGITS + 1) for step in near(k)]
        back = F.filter(F.array(*rounded), lambda m: F.concat(m.cast("string"), F.lit("E"), p["point"].cast("string")).cast("double") == x)
        return let(
            F.coalesce(F.get(back, F.lit(0)), p["m"]),
            lambda m: F.struct(
                F.regexp_replace(F.regexp_replace(m.cast("string"), "^0?[.]|[.]", ""), "0+$", "").alias("digits"),
                (p["point"] + F.when(m >= 1, 1).otherwise(0)).alias("point"),
            ),
        )

    return let(parts, chosen)


def python_number(x: Column | str) -> Column:
    """A double as ``repr`` writes it; null stays, and what JSON has no number for is an error."""
    value = col(x).cast("double")

    def text(found: Column) -> Column:
        digits, point = found["digits"], found["point"]
        n = F.length(digits)
        fixed = (
            F.when(point <= 0, F.concat(F.lit("0."), F.repeat(F.lit("0"), -point), digits))
            .when(point >= n, F.concat(digits, F.repeat(F.lit("0"), point - n), F.lit(".0")))
            .otherwise(F.concat(F.substring(digits, F.lit(1), point), F.lit("."), F.substring(digits, point + 1, n)))
        )
        rest = F.when(n > 1, F.concat(F.lit("."), F.substring(digits, F.lit(2), n))).otherwise("")
        power = F.concat(F.when(point > 0, "e+").otherwise("e-"), F.lpad(F.abs(point - 1).cast("string"), F.greatest(F.length(F.abs(point - 1).cast("string")), F.lit(2)), "0"))
        return F.when((point > -4) & (point <= 16), fixed).otherwise(F.concat(F.substring(digits, F.lit(1), F.lit(1)), rest, power))

    # a negative zero keeps its sign, which only its text shows
    sign = F.when(value.cast("string").startswith("-"), "-").otherwise("")
    wrong = F.isnan(value) | (F.abs(value) == float("inf"))
    body = F.when(value == 0, "0.0").otherwise(let(shortest_digits(F.abs(value)), text))
    return F.when(wrong, F.raise_error(F.lit("no number of JSON"))).otherwise(F.concat(sign, body))


def json_string(x: Column | str, ascii_only: bool = False) -> Column:
    """A text in quotes, escaped. ascii_only: every other character as ``\\uXXXX``."""
    value = col(x)
    out = F.replace(F.replace(value, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    controls = out
    for i in range(32):
        controls = F.replace(controls, F.lit(chr(i)), F.lit(SHORT_ESCAPES.get(chr(i), f"\\u{i:04x}")))
    out = F.when(value.rlike("[\\x00-\\x1f]"), controls).otherwise(out)
    if ascii_only:
        units = lambda c: F.regexp_replace(F.lower(F.hex(F.encode(c, "UTF-16BE"))), "(.{4})", "\\\\u$1")
        escaped = lambda c: F.when((F.octet_length(c) > 1) | (c == "\x7f"), units(c)).otherwise(c)
        out = F.when(value.rlike("[^\\x00-\\x7e]"), F.array_join(F.transform(F.split(out, ""), escaped), "")).otherwise(out)
    return F.concat(F.lit('"'), out, F.lit('"'))


def canonical_json(x: Column | str, kind: DataType, *, compact: bool = True, ascii_only: bool = False) -> Column:
    """A value of a known type as JSON with sorted keys. compact: no spaces after commas and colons."""
    comma, colon = (",", ":") if compact else (", ", ": ")
    sub = lambda c, k: canonical_json(c, k, compact=compact, ascii_only=ascii_only)
    entry = lambda key, text: F.concat(json_string(key, ascii_only), F.lit(colon), text)
    value = col(x)
    if isinstance(kind, StringType):
        out = json_string(value, ascii_only)
    elif isinstance(kind, (BooleanType, IntegralType)):
        out = value.cast("string")
    elif isinstance(kind, DecimalType) and kind.scale == 0:
        out = value.cast("string")
    elif isinstance(kind, FractionalType) and not isinstance(kind, DecimalType):
        out = python_number(value)
    elif isinstance(kind, ArrayType):
        out = F.concat(F.lit("["), F.array_join(F.transform(value, lambda e: sub(e, kind.elementType)), comma), F.lit("]"))
    elif isinstance(kind, MapType) and isinstance(kind.keyType, StringType):
        rows = F.transform(F.array_sort(F.map_keys(value)), lambda k: entry(k, sub(F.try_element_at(value, k), kind.valueType)))
        out = F.concat(F.lit("{"), F.array_join(rows, comma), F.lit("}"))
    elif isinstance(kind, StructType):
        rows = [entry(F.lit(f.name), sub(value[f.name], f.dataType)) for f in sorted(kind.fields, key=lambda f: f.name)]
        out = F.when(value.isNotNull(), F.concat(F.lit("{"), F.concat_ws(comma, *rows), F.lit("}")))
    else:
        raise TypeError(f"{kind.simpleString()} has no JSON here")
    return F.coalesce(out, F.lit("null"))


def canonical_hash(x: Column | str, kind: DataType) -> Column:
    """SHA-256 of the compact JSON with sorted keys: the signature of a value."""
    return F.sha2(F.encode(canonical_json(x, kind), "UTF-8"), 256)
