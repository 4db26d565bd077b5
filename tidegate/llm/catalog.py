"""All training-data queries by name, with their SQL where SQL can state the result."""

from __future__ import annotations

from tidegate.llm import queries
from tidegate.llm.sql import SQL  # noqa: F401

QUERIES = {name: getattr(queries, name) for name in dir(queries) if name[0] == "p" and name[1].isdigit()}
