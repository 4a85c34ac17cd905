"""All queries of the engine, by name, with DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from .queries import _register, models, more, survey, text, topics, vectors, views  # noqa: F401

QUERIES = _register.QUERIES
ORACLE_SQL = _register.ORACLE_SQL
