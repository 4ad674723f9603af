"""All queries of the feeds, with their SQL."""

from . import boards, chain, cycles, merge, queries, singles, streams, views

QUERIES = queries.QUERIES | merge.QUERIES | boards.QUERIES | cycles.QUERIES | streams.QUERIES | views.QUERIES | singles.QUERIES | chain.QUERIES
ORACLE_SQL = queries.ORACLE_SQL | merge.ORACLE_SQL | boards.ORACLE_SQL | cycles.ORACLE_SQL | streams.ORACLE_SQL | views.ORACLE_SQL | singles.ORACLE_SQL | chain.ORACLE_SQL
