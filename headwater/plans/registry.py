"""All queries by name, and their SQL."""

from headwater.plans import corpus_golden, corpus_queries, corpus_sql, lineage_queries, lineage_sql, operator_queries

QUERIES = {**corpus_queries.QUERIES, **lineage_queries.QUERIES, **operator_queries.QUERIES}
ORACLE_SQL = {**corpus_sql.ORACLE_SQL, **lineage_sql.ORACLE_SQL, **corpus_golden.GOLDEN}
