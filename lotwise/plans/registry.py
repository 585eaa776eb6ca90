"""All queries of the ledger engine by name, with their SQL."""

from __future__ import annotations

from lotwise.plans import identity_queries, layout_queries, ledger_queries, merge_queries, note_queries, predicate_queries, price_queries, report_queries, schedule_queries, sheet_queries, statement_queries, upsert_queries

_MODULES = (ledger_queries, price_queries, note_queries, layout_queries, merge_queries, identity_queries, schedule_queries, predicate_queries, upsert_queries, report_queries, statement_queries, sheet_queries)
QUERIES = {k: f for m in _MODULES for k, f in m.REGISTER.queries.items()}
ORACLE_SQL: dict[str, str] = {k: s for m in _MODULES for k, s in m.REGISTER.sql.items()}
