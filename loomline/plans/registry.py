"""Registration: a query and, where SQL can express it, the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..operators.views import ORDER_LINES_SQL

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name. SQL that starts with a comma continues a WITH
    clause that defines order_lines."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            text = sql.strip()
            if text.startswith(","):
                text = f"WITH {ORDER_LINES_SQL.strip()}{text}"
            elif "order_lines" in text:
                text = f"WITH {ORDER_LINES_SQL.strip()} {text}"
            ORACLE_SQL[f.__name__] = text
        return f

    return add
