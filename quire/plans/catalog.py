"""All queries of the library by name, and their SQL."""

from __future__ import annotations

from quire.plans import layouts, operators, pages, records, rules

QUERIES = operators.QUERIES | pages.QUERIES | records.QUERIES | layouts.QUERIES | rules.QUERIES
ORACLE_SQL: dict[str, str] = operators.ORACLE_SQL | pages.ORACLE_SQL | records.ORACLE_SQL | layouts.ORACLE_SQL | rules.ORACLE_SQL
FLAGSHIP = "repeated_lines"
