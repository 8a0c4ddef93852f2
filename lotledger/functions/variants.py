"""Reading loosely typed JSON fields from VARIANT columns.

A field of a scraped item may be a number in one record and a text, list or object in
the next one, so every reader looks at the kind of the value before it converts it.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def blank_to_null(text: Column) -> Column:
    """The text, or NULL for the empty one; the expression behind it is evaluated once."""
    return F.get(F.array_remove(F.array(text), ""), 0)


def member(value: Column, name: str) -> Column:
    """The named field as VARIANT, NULL when it is absent."""
    return F.try_variant_get(value, f"$['{name}']", "variant")


def kind(value: Column) -> Column:
    return F.schema_of_variant(value)


def is_text(value: Column) -> Column:
    return value.isNotNull() & (kind(value) == "STRING")


def is_object(value: Column) -> Column:
    # Nothing but an object can be read as a struct; its members are not looked at.
    return F.try_variant_get(value, "$", "struct<>").isNotNull()


def is_null(value: Column) -> Column:
    """Absent or JSON null."""
    return value.isNull() | (kind(value) == "VOID")


def as_text(value: Column) -> Column:
    """The text itself; NULL for any other kind."""
    return F.when(kind(value) == "STRING", F.try_variant_get(value, "$", "string"))


def filled_text(value: Column) -> Column:
    """Like `as_text`, with the empty text as NULL."""
    return blank_to_null(as_text(value))


def is_truthy(value: Column) -> Column:
    """Neither null, false, zero, empty text, empty list nor empty object."""
    empty = ["null", "false", "0", "0.0", "-0.0", "[]", "{}"]
    filled = F.when(kind(value) == "STRING", F.try_variant_get(value, "$", "string") != "").otherwise(
        ~F.to_json(value).isin(empty)
    )
    return value.isNotNull() & filled


def elements(value: Column) -> Column:
    """The list members as array<variant>; an empty array for any other kind."""
    return F.coalesce(F.try_variant_get(value, "$", "array<variant>"), F.array().cast("array<variant>"))


def first_digits(text: Column) -> Column:
    """First run of digits with thousands commas, as a number; NULL without one."""
    digits = blank_to_null(F.regexp_extract(text, r"\d[\d,]*", 0))
    return F.replace(digits, F.lit(","), F.lit("")).try_cast("bigint")


def _number(value: Column, of_text: Column) -> Column:
    """`of_text` for a text; numbers and booleans converted; NULL for lists and objects, which make no number."""
    return F.when(kind(value) == "STRING", of_text).otherwise(F.try_variant_get(value, "$", "bigint"))


def loose_number(value: Column) -> Column:
    """Whole number from a number or from the first digits of a text."""
    return _number(value, first_digits(F.try_variant_get(value, "$", "string")))


def strict_number(value: Column) -> Column:
    """Whole number from a number or from a text that is nothing but a number."""
    text = F.try_variant_get(value, "$", "string")
    return _number(value, F.trim(text).try_cast("bigint"))


def plain_text(value: Column) -> Column:
    """Text of a scalar: the text, `true`/`false`, or the digits; NULL otherwise."""
    text = F.try_variant_get(value, "$", "string")
    listed = F.startswith(kind(value), F.lit("ARRAY")) | is_object(value)
    return blank_to_null(F.when(~listed, text))


def json_or_null(value: Column) -> Column:
    """The value as JSON text, `null` when it is absent."""
    return F.coalesce(F.to_json(value), F.lit("null"))
