"""All queries over the reference's own operators, and their SQL."""

from __future__ import annotations

from leadmill.jobs import document_queries, finding_queries, gate_queries, lead_queries, scoring_queries, surface_queries, verdict_queries

AREAS = (finding_queries, verdict_queries, scoring_queries, surface_queries, lead_queries, gate_queries, document_queries)
QUERIES = {k: v for a in AREAS for k, v in a.QUERIES.items()}
ORACLE_SQL = {k: v for a in AREAS for k, v in a.ORACLE_SQL.items()}
