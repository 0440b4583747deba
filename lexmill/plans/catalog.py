"""All queries of the plans with their DuckDB SQL."""

from __future__ import annotations

from lexmill.plans import answers, atlas, corpus, documents, evaluation, governance, matching, people, ranking, records, relational, similarity, tiers, usage, vectors

_PLANS = (documents, relational, governance, people, vectors, evaluation, usage, records, tiers, ranking, matching, corpus, atlas, answers, similarity)
QUERIES = {name: fn for plan in _PLANS for name, fn in plan.QUERIES.items()}
ORACLE_SQL = {name: sql.strip() for plan in _PLANS for name, sql in plan.ORACLE.items()}
