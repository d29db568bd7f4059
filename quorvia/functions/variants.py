"""VARIANT columns: JSON values that keep the type they were written with."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quorvia.functions.distributions import col
from quorvia.functions.json_text import python_number


def kind(v: Column | str) -> Column:
    """The type of a value: STRING, BIGINT, DECIMAL(p,s), DOUBLE, BOOLEAN, VOID, ARRAY<...> or OBJECT<...>."""
    return F.schema_of_variant(col(v))


def is_text(v: Column | str) -> Column:
    return F.coalesce(kind(v) == "STRING", F.lit(False))


def is_number(v: Column | str) -> Column:
    """Whole or not; a boolean is none."""
    return F.coalesce(kind(v).rlike(r"^(BIGINT|DOUBLE|DECIMAL)"), F.lit(False))


def value_text(v: Column | str) -> Column:
    """A scalar as Python's ``str`` writes the parsed value: 1 and 1.0 stay apart, as do True and "true".

    A number of 19 digits or more without a fraction is taken as a whole one. Arrays and
    objects are given as compact JSON.
    """
    value, found = col(v), kind(v)
    number = F.try_variant_get(value, "$", "double")
    text = F.try_variant_get(value, "$", "string")
    whole = found.rlike(r"^DECIMAL\((19|[23]\d),0\)$") | (found == "BIGINT")
    return (
        F.when((found == "STRING") | whole, text)
        .when(found == "BOOLEAN", F.initcap(text))
        .when(found == "VOID", "None")
        .when(is_number(value), python_number(number))
        .when(value.isNotNull(), F.to_json(value))
    )
