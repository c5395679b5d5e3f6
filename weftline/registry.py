"""All registered queries of the lineage engine, and their SQL."""

from __future__ import annotations

from weftline import proof_queries, queries

QUERIES = {**queries.QUERIES, **proof_queries.QUERIES}
ORACLE_SQL = {**queries.ORACLE_SQL, **proof_queries.ORACLE_SQL}
flagship = proof_queries.reduced_outcomes
