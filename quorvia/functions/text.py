"""Scalar text expressions: ids, display names, options, formats, hashes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructType

from quorvia.functions.distributions import col

#: The suffix and the patterns of sample names in survey exports.
CURRENT_SAMPLE_SUFFIX = " (Current national sample)"
INELIGIBLE_SAMPLE = r"(?i)\((?:Non-national|Old national) sample\)"
#: Fixed value: a parser artefact among options.
TABLE_TOTAL = r"(?i)^total\s+n\s*=\s*$"
#: Fixed value: answers that are no answer.
NONRESPONSE = r"(?U)^(?:dk(?:\s*/\s*refused)?\b|don['’]?t know\b|refus(?:e|ed|al)\b|no answer\b|not answered?\b|missing\b|can['’]?t choose\b|not sure\b|no opinion\b)"


def strip(text: Column | str) -> Column:
    """Without white space at either end, Unicode's included."""
    return F.regexp_replace(col(text), r"(?U)^\s+|\s+$", "")


def is_blank(text: Column | str) -> Column:
    """Null, or nothing but white space."""
    return F.coalesce(strip(text) == "", F.lit(True))


def canonical_option(option: Column | str) -> Column:
    """Stripped; null where nothing is left."""
    found = strip(option)
    return F.when(found != "", found)


def display_country(country: Column | str) -> Column:
    c = col(country)
    return F.when(c.endswith(CURRENT_SAMPLE_SUFFIX), F.substring(c, F.lit(1), F.length(c) - len(CURRENT_SAMPLE_SUFFIX))).otherwise(c)


def sample_status(country: Column | str) -> Column:
    return F.when(col(country).endswith(CURRENT_SAMPLE_SUFFIX), "current_national").otherwise("national")


def is_ineligible_sample(country: Column | str) -> Column:
    return col(country).rlike(INELIGIBLE_SAMPLE)


def is_table_total(option: Column | str) -> Column:
    return col(option).rlike(TABLE_TOTAL)


def is_nonresponse(option: Column | str) -> Column:
    """Only plain missing or refused answers; Both, Neither, None or Depends stay."""
    return F.lower(strip(option)).rlike(NONRESPONSE)


def directed_unit_id(question: Column | str, label: Column | str, evidence: Column | str) -> Column:
    return F.concat(col(question), F.lit("::"), col(label), F.lit("=>"), col(evidence))


def target_unit_id(question: Column | str, label: Column | str) -> Column:
    return F.concat(col(question), F.lit("::"), col(label))


def stable_seed(seed: int, unit_id: Column | str) -> Column:
    """Unsigned 64-bit seed of a unit: the first eight bytes of SHA-256 over both, as DECIMAL(20, 0)."""
    text = F.concat(F.lit(f"{seed}\0"), col(unit_id))
    return F.conv(F.substring(F.sha2(F.encode(text, "UTF-8"), 256), 1, 16), 16, 10).cast("decimal(20,0)")


def text_hash(text: Column | str) -> Column:
    return F.sha2(F.encode(col(text), "UTF-8"), 256)


def source_name(domain: Column | str) -> Column:
    return F.when(col(domain) == "GAS", "Global Attitudes").otherwise(col(domain))


def canonical_condition(condition: Column | str) -> Column:
    """Raw files say evidence where everything else says population_evidence."""
    return F.when(col(condition) == "evidence", "population_evidence").otherwise(col(condition))


def fixed(x: Column | str, decimals: int = 4) -> Column:
    return F.format_string(f"%.{decimals}f", col(x))


def interval(low: Column | str, high: Column | str, decimals: int = 4) -> Column:
    return F.format_string(f"[%.{decimals}f, %.{decimals}f]", col(low), col(high))


def estimate_with_interval(x: Column | str, low: Column | str, high: Column | str, decimals: int = 4) -> Column:
    return F.concat(fixed(x, decimals), F.lit(" "), interval(low, high, decimals))


def clean_question(text: Column | str) -> Column:
    return strip(F.replace(col(text), F.lit("\n"), F.lit(" ")))


def latex_escape(text: Column | str) -> Column:
    """The characters that TeX would read as commands."""
    out = F.replace(col(text), F.lit("\\"), F.lit("\x00"))
    for c in "{}&%$#_":
        out = F.replace(out, F.lit(c), F.lit("\\" + c))
    for c, name in (("~", "asciitilde"), ("^", "asciicircum"), ("\x00", "backslash")):
        out = F.replace(out, F.lit(c), F.lit(f"\\text{name}{{}}"))
    return out


def sorted_keys(c: Column, kind: DataType) -> Column:
    """A nested value with the keys of its maps and the fields of its structs in order, at every depth."""
    if isinstance(kind, ArrayType):
        return F.transform(c, lambda x: sorted_keys(x, kind.elementType))
    if isinstance(kind, MapType):
        entry = lambda k: F.struct(k.alias("key"), sorted_keys(F.try_element_at(c, k), kind.valueType).alias("value"))
        return F.map_from_entries(F.transform(F.array_sort(F.map_keys(c)), entry))
    if isinstance(kind, StructType):
        return F.when(c.isNotNull(), F.struct(*[sorted_keys(c[f.name], f.dataType).alias(f.name) for f in sorted(kind.fields, key=lambda f: f.name)]))
    return c


def csv_cell(x: Column | str, kind: str) -> Column:
    """Null as nothing, booleans in lower case, nested values as compact JSON with sorted keys. kind: a type's simple string."""
    from pyspark.sql.types import _parse_datatype_string

    c = col(x)
    if kind.startswith(("array", "map", "struct")):
        c = F.to_json(sorted_keys(c, _parse_datatype_string(kind)), {"ignoreNullFields": "false"})
    return F.coalesce(c.cast("string"), F.lit(""))
