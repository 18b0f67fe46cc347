"""Table functions for SQL: SELECT * FROM split_statements('...', 'tsql'), SELECT * FROM parse_statement('...')."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from headwater.operators import lexer
from headwater.operators.parser import parse_statement


class SplitStatements:
    """Statements of a text in a dialect: ord, statement."""

    def eval(self, sql: str, dialect: str) -> Iterator[tuple[int, str]]:
        yield from enumerate(lexer.statements(sql or "", dialect or "tsql"))


class ParseStatement:
    """One row per source of each column of a statement, or a row without column where it has none."""

    def eval(self, sql: str) -> Iterator[tuple]:
        st = parse_statement(sql or "")
        head = (st.kind, st.subtype, st.target, ",".join(st.sources))
        rows = [(*head, c.name, c.transform, t, x) for c in st.columns for t, x in c.resolved or [(None, None)]]
        yield from rows or [(*head, None, None, None, None)]


def register(spark: SparkSession) -> None:
    """Makes both functions known to SQL in a session."""
    spark.udtf.register("split_statements", udtf(SplitStatements, returnType="ord: int, statement: string"))
    spark.udtf.register("parse_statement", udtf(ParseStatement, returnType="statement_type: string, statement_subtype: string, target_table: string, source_tables: string, column_name: string, transform: string, src_table: string, src_column: string"))
