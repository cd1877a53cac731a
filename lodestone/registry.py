"""All queries of the engine and the SQL that each must agree with."""

from __future__ import annotations

from lodestone.queries import notes, texts, vectors

_ALL = vectors.QUERIES | texts.QUERIES | notes.QUERIES
QUERIES = {name: query for name, (query, _) in _ALL.items()}
ORACLE_SQL = {name: sql for name, (_, sql) in _ALL.items() if sql}
