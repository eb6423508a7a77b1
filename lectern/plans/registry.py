"""All queries over the driver's tables, and the SQL that says the same where SQL can."""

from __future__ import annotations

from . import figures, pages, papers, review

_PARTS = (pages, papers, review, figures)
QUERIES = {name: query for part in _PARTS for name, query in part.QUERIES.items()}
ORACLES = {name: sql for part in _PARTS for name, sql in part.ORACLES.items()}
