"""Every operator as a query over the given tables, with the SQL it must agree with."""

from lakeload.queries import check_queries, lake_queries, source_queries

QUERIES = source_queries.QUERIES | lake_queries.QUERIES | check_queries.QUERIES
ORACLE = source_queries.ORACLE | lake_queries.ORACLE | check_queries.ORACLE
