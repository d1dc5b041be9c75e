"""Text rules that have to agree with JavaScript string handling and SQL LIKE."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed pattern: a character that JavaScript's trim() would leave in place.
NOT_BLANK = (
    r"[^\t\n\x0B\f\r \u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF]"
)

# Fixed value: the largest whole number a double holds without gaps.
MAX_SAFE_INTEGER = 9007199254740992


def has_text(text: Column) -> Column:
    return text.rlike(NOT_BLANK)


def entry_id(*names: Column) -> Column:
    """A name-based UUID of an entry: the same names give the same id, in any attempt."""
    return F.regexp_replace(
        F.md5(F.concat_ws("/", *names)), r"^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"
    )


def contains_pattern(q: str) -> str:
    """The LIKE pattern of a message search.

    ``%`` and ``_`` in ``q`` are wildcards; an escaped one is literal.  Spark
    raises on a backslash before any other character, where the search treats
    the pair as that character, so such a backslash is dropped.  One at the very end
    makes the last wildcard of the pattern a literal percent sign.
    """
    text, out, i = q.lower() + "%", [], 0
    while i < len(text):
        char = text[i]
        if char == "\\":
            i += 1
            char = text[i]
            if char in "%_\\":
                char = "\\" + char
        out.append(char)
        i += 1
    return "%" + "".join(out)


def shortest_text(value: Column) -> Column:
    """The fewest digits that read back as the same DOUBLE.

    The cast to text may give 17 digits where 15 or 16 do; such long texts are
    tried again with fewer.
    """
    text = value.cast("string")
    fewer = F.lit(None).cast("string")
    for digits in (16, 15):
        tried = F.format_string(f"%.{digits - 1}E", value)
        fewer = F.when(tried.try_cast("double") == value, tried).otherwise(fewer)
    tidy = F.regexp_replace(F.regexp_replace(fewer, r"\.?0*E\+?", "E"), r"E(-?)0+(\d)", "E$1$2")
    return F.when(F.length(text) > 17, F.coalesce(tidy, text)).otherwise(text)


def number_text(value: Column) -> Column:
    """A DOUBLE as JavaScript prints it: 3, 100, 0.00001, 1e+21, 1.5e-7."""
    size = F.abs(value)
    shortest = shortest_text(value)

    def plain(scale: int) -> Column:
        digits = shortest.try_cast(f"decimal(38,{scale})").cast("string")
        return F.regexp_replace(F.regexp_replace(digits, r"0+$", ""), r"\.$", "")

    scientific = F.regexp_replace(
        F.regexp_replace(F.regexp_replace(shortest, r"\.0E", "E"), r"E-", "e-"), r"E", "e+"
    )
    return (
        F.when(value == 0, F.lit("0"))
        .when((size >= 1e21) | (size < 1e-6), scientific)
        .when(size >= 1, plain(16))
        .otherwise(plain(24))
    )
