"""JSON expressions over text columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def decoded(payload: Column) -> Column:
    """VARIANT; null where the text is no JSON."""
    return F.try_parse_json(payload)


def corrupt(payload: Column) -> Column:
    """There is a payload, and it is no JSON."""
    return payload.isNotNull() & F.try_parse_json(payload).isNull()


def encoded(row: Column) -> Column:
    """Null fields stay in the text."""
    return F.to_json(row, {"ignoreNullFields": "false"})


def field(payload: Column, path: str, kind: str = "string") -> Column:
    """A nested field, null where any part of the way is absent or the text is no object."""
    return F.try_variant_get(F.try_parse_json(payload), path, kind)


def has_key(payload: Column, key: str) -> Column:
    """The key is there, be its value null; false for anything but an object."""
    return F.coalesce(F.array_contains(F.json_object_keys(payload), key), F.lit(False))


def truthy(payload: Column) -> Column:
    """False for no text, ``null``, ``false``, zero, and empty texts, lists and objects. Text that is no JSON counts as itself."""
    plain = F.regexp_replace(F.trim(payload), r"\s+", "")
    return payload.isNotNull() & ~plain.isin("", "null", "false", "{}", "[]", '""') & ~plain.rlike(r"^-?0+(\.0*)?([eE][+-]?[0-9]+)?$")
