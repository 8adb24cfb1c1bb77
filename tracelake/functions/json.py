"""Defensive readers of dynamic JSON: a text is a non-empty JSON string, a number a JSON number.

Objects are read as ``map<string, variant>``, which keeps the order of the keys and the type of the values.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from tracelake.functions.text import col, nz


def is_object_text(c: Column | str) -> Column:
    """Text that is exactly one JSON object."""
    t = F.trim(F.regexp_replace(col(c), "[\\r\\n]+$", ""))
    return F.startswith(t, F.lit("{")) & F.try_parse_json(t).isNotNull()


def obj(c: Column | str) -> Column:
    """A JSON object as a map; anything else is null."""
    return F.from_json(col(c), "map<string,variant>")


def _as_text(v: Column) -> Column:
    return F.when(F.schema_of_variant(v) == "STRING", nz(F.try_variant_get(v, "$", "string")))


def text(m: Column, *keys: str) -> Column:
    """The first of the keys that holds a non-empty text."""
    return F.coalesce(*[_as_text(F.try_element_at(m, F.lit(k))) for k in keys])


def any_text(m: Column, key: Column | str) -> Column:
    """A text, number or boolean as text."""
    v = F.try_element_at(m, F.lit(key) if isinstance(key, str) else key)
    kind = F.schema_of_variant(v)
    scalar = (kind == "STRING") | (kind == "BIGINT") | (kind == "DOUBLE") | (kind == "BOOLEAN") | F.startswith(kind, F.lit("DECIMAL"))
    return F.when(scalar, nz(F.try_variant_get(v, "$", "string")))


def number(m: Column, key: str) -> Column:
    v = F.try_element_at(m, F.lit(key))
    kind = F.schema_of_variant(v)
    numeric = (kind == "BIGINT") | (kind == "DOUBLE") | F.startswith(kind, F.lit("DECIMAL"))
    return F.when(numeric, F.try_variant_get(v, "$", "double"))


def json_text(m: Column, key: str) -> Column:
    """The value as JSON text (for nested objects and lists)."""
    return F.to_json(F.try_element_at(m, F.lit(key)))


def texts(m: Column, key: str) -> Column:
    """The text items of a list value."""
    items = F.try_variant_get(F.try_element_at(m, F.lit(key)), "$", "array<variant>")
    return F.filter(F.transform(items, _as_text), lambda x: x.isNotNull())


def first_text(m: Column, skip: tuple[str, ...] = ()) -> Column:
    """The first non-empty text value in key order, leaving out some keys and opaque encrypted payloads."""
    entries = F.map_entries(m)
    values = F.transform(
        entries,
        lambda e: F.when(~e["key"].isin(list(skip)) if skip else F.lit(True), _as_text(e["value"])),
    )
    return F.try_element_at(F.filter(values, lambda x: x.isNotNull()), F.lit(1))


def blocks(content: Column | str, is_list: Column, schema: str) -> Column:
    """Content as an array of structs: a text is one text block, a list keeps its objects only."""
    content = col(content)
    raw = F.filter(F.from_json(content, "array<string>"), lambda b: F.startswith(b, F.lit("{")))
    single = F.to_json(F.struct(F.lit("text").alias("type"), content.alias("text")))
    items = F.when(is_list, raw).when(content.isNotNull(), F.array(single))
    return F.transform(items, lambda b: F.from_json(b, schema))
