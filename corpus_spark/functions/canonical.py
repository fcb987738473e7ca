"""Canonical JSON text and the hashes taken over it."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

_KEEP_NULLS = {"ignoreNullFields": "false"}
_ASCII = {"ignoreNullFields": "false", "writeNonAsciiCharacterAsCodePoint": "true"}


def sorted_struct(fields: Mapping[str, Column | Mapping]) -> Column:
    """A struct whose fields are declared in key order, nested mappings included."""
    columns = []
    for name in sorted(fields):
        value = fields[name]
        column = sorted_struct(value) if isinstance(value, Mapping) else value
        columns.append(column.alias(name))
    return F.struct(*columns)


def canonical_json(value: Column) -> Column:
    """Tightest separators, raw UTF-8, nulls kept. Key order is the struct's own."""
    return F.to_json(value, _KEEP_NULLS)


def sha256_hex(text: Column) -> Column:
    return F.sha2(text, 256)


def json_string(text: Column) -> Column:
    """One JSON string literal, quotes included."""
    wrapped = F.to_json(F.array(text))
    return F.substring(wrapped, F.lit(2), F.length(wrapped) - 2)


def ascii_json_string(text: Column) -> Column:
    wrapped = F.to_json(F.array(text), _ASCII)
    return F.substring(wrapped, F.lit(2), F.length(wrapped) - 2)


def struct_text(value: Column, fields: tuple[str, ...]) -> Column:
    """Canonical text of a struct element, keys in sorted order."""
    return F.to_json(F.struct(*[value[n].alias(n) for n in sorted(fields)]), _ASCII)


def description_digest(package: Column, description: Column) -> Column:
    """sha256 over `{"description": ..., "package": ...}` with spaced separators."""
    return sha256_hex(
        F.concat(
            F.lit('{"description": '),
            json_string(description),
            F.lit(', "package": '),
            json_string(package),
            F.lit("}"),
        )
    )
