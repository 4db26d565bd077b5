"""Small text expressions shared by operators."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def slug(value: Column) -> Column:
    """Lower case, ASCII letters and digits only; null stays null."""
    return F.regexp_replace(F.lower(value), "[^a-z0-9]", "")


def column_slug(name: str) -> str:
    """A column name in lower case, letters and digits only, for matching names across spellings."""
    return "".join(c for c in name.lower() if c.isascii() and c.isalnum())


def resolve_columns(wanted: list[str], columns: list[str]) -> list[str] | None:
    """The table's spelling of each wanted column, or None if one is missing."""
    known = {column_slug(c): c for c in columns}
    found = [known.get(column_slug(w)) for w in wanted]
    return None if None in found else found
