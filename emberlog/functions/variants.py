"""Type tests and text forms of JSON values held as VARIANT."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from emberlog.functions.text import MAX_SAFE_INTEGER, number_text


def get(value: Column, target: str) -> Column:
    return F.try_variant_get(value, "$", target)


def kind(value: Column) -> Column:
    """``STRING``, ``BIGINT``, ``DECIMAL(p,s)``, ``DOUBLE``, ``BOOLEAN``, ``VOID``,
    ``OBJECT<…>`` or ``ARRAY<…>``; NULL when the field is missing."""
    return F.schema_of_variant(value)


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value worked out once, however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def needs_number_rule(name: Column, value: Column) -> Column:
    """Whether the plain cast to text may differ from JavaScript's number text; ``name`` is
    the value's kind."""
    return (
        (name == "DOUBLE")
        | name.startswith("DECIMAL")
        | ((name == "BIGINT") & (F.abs(get(value, "double")) >= MAX_SAFE_INTEGER))
    )


def text_of(name: Column, value: Column) -> Column:
    """Text of a scalar of a known kind."""
    number = let(get(value, "double"), number_text)
    return F.when(needs_number_rule(name, value), number).otherwise(get(value, "string"))


def only_text(value: Column) -> Column:
    """The value if it is a string, else NULL."""
    return F.when(kind(value) == "STRING", get(value, "string"))


def scalar_text(value: Column) -> Column:
    return let(kind(value), lambda name: text_of(name, value))


def any_text(value: Column) -> Column:
    """What interpolating the value into a message prints."""
    items = F.transform(
        get(value, "array<variant>"),
        lambda item: let(
            kind(item),
            lambda name: F.when(name == "VOID", F.lit("")).otherwise(text_of(name, item)),
        ),
    )
    return let(
        kind(value),
        lambda name: (
            F.when(name.isNull(), F.lit("undefined"))
            .when(name == "VOID", F.lit("null"))
            .when(name.startswith("OBJECT"), F.lit("[object Object]"))
            .when(name.startswith("ARRAY"), F.array_join(items, ","))
            .otherwise(text_of(name, value))
        ),
    )
