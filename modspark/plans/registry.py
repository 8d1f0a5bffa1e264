"""All registered queries and their SQL."""

from __future__ import annotations

from modspark.plans import account_queries, admission_queries, file_queries, text_queries, text_sql

QUERIES = {**text_queries.QUERIES, **account_queries.QUERIES, **admission_queries.QUERIES, **file_queries.QUERIES}
SQL = {**text_sql.SQL, **account_queries.SQL, **admission_queries.SQL, **file_queries.SQL}
