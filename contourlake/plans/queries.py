"""All queries of the core library and the SQL that must give the same rows."""

from . import metric_queries, signal_queries, study_queries

QUERIES = {**metric_queries.QUERIES, **signal_queries.QUERIES, **study_queries.QUERIES}
ORACLE_SQL = {**metric_queries.SQL, **signal_queries.SQL, **study_queries.SQL}
