"""Text, identifier, array and document column functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.dates import to_col


def joined_text(*parts: str | Column, sep: str = "") -> Column:
    """Concatenation that treats a missing part as empty text."""
    texts = [F.coalesce(to_col(p).cast("string"), F.lit("")) for p in parts]
    return F.concat_ws(sep, *texts)


def mentions_any(c: str | Column, words: list[str]) -> Column:
    """True where the text holds one of the literal words."""
    found = F.lit(False)
    for word in words:
        found = found | to_col(c).contains(word)
    return found


def normalize_sql(c: str | Column) -> Column:
    """Upper case, single blanks, no trailing semicolons, trimmed - in that order.

    Semicolons go before the final trim, so text that ends in a semicolon and a
    blank keeps its semicolon.
    """
    blanks = F.regexp_replace(F.upper(to_col(c)), r"\s+", " ")
    return F.trim(F.regexp_replace(blanks, ";+$", ""))


def preview(c: str | Column, length: int = 80) -> Column:
    return F.substring(to_col(c), 1, length)


def stable_id(*parts: str | Column) -> Column:
    """32 lower-case hex digits that depend on the parts only."""
    return F.md5(F.concat_ws("\x1f", *[F.coalesce(to_col(p).cast("string"), F.lit("\x00")) for p in parts]))


def is_hex_id(c: str | Column) -> Column:
    return F.coalesce(to_col(c).rlike("^[0-9a-f]{32}$"), F.lit(False))


def is_three_part_name(c: str | Column) -> Column:
    parts = F.split(to_col(c), r"\.")
    return F.coalesce((F.size(parts) == 3) & F.forall(parts, lambda p: F.trim(p) != ""), F.lit(False))


def last_name_part(c: str | Column) -> Column:
    return F.element_at(F.split(to_col(c), r"\."), -1)


def with_value(array: str | Column, value: str | Column) -> Column:
    """Append a value unless the array already holds it; order is kept."""
    array, value = F.coalesce(to_col(array), F.array().cast("array<string>")), to_col(value)
    return F.when(F.array_contains(array, value), array).otherwise(F.array_append(array, value))


def without_value(array: str | Column, value: str | Column) -> Column:
    return F.array_remove(to_col(array), to_col(value))


def details_map(fields: Column, captured: list[str]) -> Column:
    """The entries of a string map that have no column of their own."""
    return F.map_filter(fields, lambda k, v: ~k.isin(captured) & v.isNotNull())


def first_json(c: str | Column, *paths: str) -> Column:
    """First non-empty value among several JSON paths."""
    c = to_col(c)
    found = [F.get_json_object(c, p) for p in paths]
    return F.coalesce(*[F.when(v != "", v) for v in found])


def joined_lines(array: str | Column) -> Column:
    return F.array_join(to_col(array), "")


def text_list_distinct(c: str | Column, sep: str = ", ") -> Column:
    """Sorted distinct values as one text.

    Use it on rows already reduced to one per (group, value): the state then
    grows with the vocabulary, not with the rows of a hot group.
    """
    return F.array_join(F.array_sort(F.collect_set(to_col(c))), sep)


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once per row.

    What a lambda reads from outside itself is computed anew for every element,
    and a value named twice may be computed twice; a lambda's own variable is not.
    """
    return F.get(F.transform(F.array(value), use), F.lit(0))
