"""Lineage of statements as tables: one parse per statement, facts by exploding, reports by grouping."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from headwater.functions import rules
from headwater.operators import cleaning
from headwater.operators.parser import Statement, parse_statement

_SOURCE = "struct<src_table: string, src_column: string, cte_reference: string>"
#: Types of the lists of columns and CTEs of a statement, and of the statements of a routine.
COLUMNS = f"array<struct<name: string, ordinal: int, transform: string, expression: string, is_aggregate: boolean, is_calculated: boolean, is_placeholder: boolean, sources: array<{_SOURCE}>, resolved: array<{_SOURCE}>>>"
CTES = "array<struct<name: string, columns: array<string>, source_tables: array<string>, snippet: string>>"
_FACTS = f"statement_type: string, statement_subtype: string, target_table: string, source_tables: array<string>, columns: {COLUMNS}, ctes: {CTES}, returning: array<string>"
BODY = f"array<struct<{_FACTS}>>"
PARSED = f"struct<{_FACTS}, body: {BODY}, parse_error: string>"


def _as_dict(sql: str | None) -> dict | None:
    if sql is None:
        return None
    try:
        st = parse_statement(sql)
    except Exception as e:  # one bad statement must not fail a job; it becomes a row of kind ERROR
        return {"statement_type": "ERROR", "statement_subtype": None, "target_table": None, "source_tables": [], "columns": [], "ctes": [], "returning": [], "body": [], "parse_error": f"{type(e).__name__}: {e}"[:200]}
    return _facts(st) | {"body": [_facts(x) for x in st.body], "parse_error": "; ".join(st.errors)[:200] or None}


def _facts(st: Statement) -> dict:
    src = lambda t, c, cte=None: {"src_table": t, "src_column": c, "cte_reference": cte}
    return {
        "statement_type": st.kind,
        "statement_subtype": st.subtype,
        "target_table": st.target,
        "source_tables": st.sources,
        "columns": [
            {"name": c.name, "ordinal": c.ordinal, "transform": c.transform, "expression": c.expression, "is_aggregate": c.is_aggregate, "is_calculated": c.is_calculated, "is_placeholder": c.is_placeholder, "sources": [src(*x) for x in c.sources], "resolved": [src(*x) for x in c.resolved]}
            for c in st.columns
        ],
        "ctes": [{"name": n, "columns": cols, "source_tables": t, "snippet": s} for n, cols, t, s in st.ctes],
        "returning": st.returning,
    }


def parsed(sql: Column) -> Column:
    """The lineage of a statement as a struct; null for null, statement_type ERROR with parse_error if it can't be read."""

    @F.pandas_udf(PARSED)
    def parse(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        empty = {"statement_type": None, "statement_subtype": None, "target_table": None, "source_tables": None, "columns": None, "ctes": None, "returning": None, "body": None, "parse_error": None}
        for batch in texts:
            yield pd.DataFrame([_as_dict(t) or empty for t in batch], columns=list(empty))

    return parse(sql)


def source_tables(sql: Column) -> Column:
    """The stored tables that a statement reads, as an array; null for null, empty for what can't be read."""

    @F.pandas_udf("array<string>")
    def tables(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield batch.map(lambda t: None if t is None else _tables_of(t))

    return tables(sql)


def _tables_of(sql: str) -> list[str]:
    try:
        return parse_statement(sql, columns=False).sources
    except Exception:  # parsed has the error
        return []


def statement_kind(sql: Column) -> Column:
    """Type and error of a statement as a struct of statement_type and parse_error; nulls for null."""

    @F.pandas_udf("struct<statement_type: string, parse_error: string>")
    def kinds(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in texts:
            yield pd.DataFrame([(None, None) if t is None else _kind_of(t) for t in batch], columns=["statement_type", "parse_error"])

    return kinds(sql)


def _kind_of(sql: str) -> tuple[str, str | None]:
    try:
        return parse_statement(sql, columns=False).kind, None
    except Exception as e:
        return "ERROR", f"{type(e).__name__}: {e}"[:200]


def analyze(corpus: DataFrame, dialect: str = "tsql", source_kind: str = "SCRIPT") -> DataFrame:
    """Statements of a corpus (file_path, sql_text): the table all facts are taken from. Persist or write it before using several.

    Result: file_path, ord, stmt_ord, dialect, source_kind, object_kind, object_name, statement, features, is_dynamic and the
    fields of ``parsed``. Null texts have no statements.
    """
    d = rules.dialect_of(dialect)
    text = cleaning.strip_noise(cleaning.strip_comments_exactly(F.col("sql_text")), d)
    scripts = corpus.select("file_path", text.alias("sql_text"))
    # Only T-SQL has lines that end a batch.
    batches = cleaning.split_batches(scripts) if d == "tsql" else scripts.filter("sql_text is not null").select("file_path", F.lit(0).alias("ord"), F.col("sql_text").alias("content"))
    rows = cleaning.split_statements(batches, "content", d)
    body = F.col("statement")
    rows = rows.select("file_path", "ord", "stmt_ord", F.lit(d).alias("dialect"), F.lit(source_kind).alias("source_kind"), cleaning.object_kind(body, d).alias("object_kind"), cleaning.object_name(body, d).alias("object_name"), "statement", cleaning.feature_tags(body, d).alias("features"), cleaning.is_dynamic(body, d).alias("is_dynamic"), parsed(body).alias("p"))
    rows = rows.select("*", "p.*").drop("p").withColumn("stmt_id", F.xxhash64("file_path", "ord", "stmt_ord"))
    return rows.withColumn("statement_subtype", cleaning.subtype(F.col("statement"), F.col("statement_subtype"), d))


def _with_bodies(statements: DataFrame) -> DataFrame:
    """The statements and those in the bodies of routines: stmt_id, file_path, statement_type, target_table, source_tables, columns, ctes.

    What a routine's queries return, without a table of their own, stands under the routine's name.
    """
    facts = ["statement_type", "source_tables", "columns", "ctes"]
    own = statements.select("stmt_id", "file_path", "target_table", *facts)
    inner = statements.select("stmt_id", "file_path", F.col("target_table").alias("routine"), F.explode("body").alias("b"))
    return own.unionByName(inner.select("stmt_id", "file_path", F.coalesce("b.target_table", "routine").alias("target_table"), *[F.col(f"b.{c}") for c in facts]))


def column_defs(statements: DataFrame) -> DataFrame:
    """One row per target column of a statement."""
    c = _with_bodies(statements).select("stmt_id", "file_path", F.col("target_table").alias("dst_table"), F.explode("columns").alias("c"))
    return c.select("stmt_id", "file_path", "dst_table", F.col("c.name").alias("dst_column"), "c.ordinal", F.col("c.transform").alias("transform_type"), "c.expression", "c.is_aggregate", "c.is_calculated", "c.is_placeholder")


def column_edges(statements: DataFrame, resolved: bool = False) -> DataFrame:
    """One row per source of a target column; resolved goes through CTEs down to stored tables."""
    c = _with_bodies(statements).select("stmt_id", "file_path", F.col("target_table").alias("dst_table"), F.explode("columns").alias("c"))
    s = c.select("stmt_id", "file_path", "dst_table", F.col("c.name").alias("dst_column"), F.explode("c.resolved" if resolved else "c.sources").alias("s"))
    return s.select("stmt_id", "file_path", "dst_table", "dst_column", "s.*").distinct()


def table_edges(statements: DataFrame) -> DataFrame:
    """One row per table that a statement reads for its target. An edge of a table to itself is kept and flagged."""
    e = _with_bodies(statements).filter("target_table is not null").select("stmt_id", "file_path", F.explode("source_tables").alias("src_table"), F.col("target_table").alias("dst_table")).distinct()
    return e.withColumn("is_self_edge", F.lower("src_table") == F.lower("dst_table"))


def cte_table(statements: DataFrame) -> DataFrame:
    return _with_bodies(statements).select("stmt_id", "file_path", F.explode("ctes").alias("c")).select("stmt_id", "file_path", "c.*")


def temp_registry(statements: DataFrame) -> DataFrame:
    """Temporary tables of each script: where each is first made, and the number of later statements of the script that read it.

    Result: file_path, table_name, defined_by (stmt_id), n_uses.
    """
    at = F.struct("ord", "stmt_ord")
    rows = statements.select("stmt_id", "file_path", at.alias("at"), F.explode(F.concat(F.array(F.struct("target_table", "source_tables")), F.transform("body", lambda b: F.struct(b["target_table"].alias("target_table"), b["source_tables"].alias("source_tables"))))).alias("s"))
    declared = statements.select("stmt_id", "file_path", at.alias("at"), F.explode(F.flatten(F.array(*[cleaning.temp_names(F.col("statement"), d) for d in rules.DIALECTS]))).alias("table_name"))
    named = rows.select("stmt_id", "file_path", "at", F.lower("s.target_table").alias("table_name")).filter(F.col("table_name").rlike(r"^#"))
    made = declared.join(rows.select("file_path", F.lower("s.target_table").alias("table_name")).distinct(), ["file_path", "table_name"], "left_semi").unionByName(named)
    first = made.groupBy("file_path", "table_name").agg(F.min(F.struct("at", "stmt_id")).alias("m")).select("file_path", "table_name", "m.at", F.col("m.stmt_id").alias("defined_by"))
    uses = rows.select("stmt_id", "file_path", F.col("at").alias("used_at"), F.explode("s.source_tables").alias("t")).select("stmt_id", "file_path", "used_at", F.lower("t").alias("table_name")).distinct()
    n = first.join(uses, ["file_path", "table_name"], "left").groupBy("file_path", "table_name", "defined_by").agg(F.count(F.when(F.col("used_at") >= F.col("at"), 1)).alias("n_uses"))
    return n.select("file_path", "table_name", "defined_by", "n_uses")


def errors(statements: DataFrame) -> DataFrame:
    return statements.filter("parse_error is not null").select("stmt_id", "file_path", "statement", "parse_error")


def confidence(n_transforms: Column, is_direct: Column, is_aggregate: Column, n_sources: Column, via_cte: Column, n_scripts: Column, extra: Column | None = None) -> Column:
    """How sure a merged column's lineage is, from 0 to 1."""
    score = F.when(is_direct, 1.0).when(n_transforms > 2, 0.7).when(is_aggregate, 0.85).otherwise(1.0)
    score = score * F.when(n_sources > 5, 0.8).otherwise(1.0) * F.when(via_cte, 0.95).otherwise(1.0) * F.when(n_scripts > 1, 0.9).otherwise(1.0)
    return F.round(score if extra is None else score * extra, 2)


def merged_columns(defs: DataFrame, edges: DataFrame) -> DataFrame:
    """Columns merged over all statements, without regard to case: sources, kinds, scripts, up to ten expressions, confidence.

    Placeholder names go if the table has a column with a name of its own.
    """
    key = [F.lower("dst_table").alias("table_key"), F.lower("dst_column").alias("column_key")]
    d = defs.filter("dst_table is not null").groupBy(*key).agg(
        F.min("dst_table").alias("table_name"), F.min("dst_column").alias("column_name"),
        F.array_sort(F.collect_set("transform_type")).alias("transforms"), F.bool_or("is_aggregate").alias("is_aggregate"), F.bool_or("is_calculated").alias("is_calculated"), F.bool_and("is_placeholder").alias("is_placeholder"),
        F.slice(F.array_sort(F.collect_set("expression")), 1, 10).alias("expressions"), F.countDistinct("file_path").alias("n_scripts"), F.count(F.lit(1)).alias("n_definitions"),
    )
    s = edges.filter("dst_table is not null").groupBy(*key).agg(F.array_sort(F.collect_set(F.concat_ws(".", "src_table", "src_column"))).alias("sources"), F.bool_or(F.col("cte_reference").isNotNull()).alias("via_cte"))
    out = d.join(s, ["table_key", "column_key"], "left").withColumn("sources", F.coalesce("sources", F.array().cast("array<string>")))
    real = F.max((~F.col("is_placeholder")).cast("int")).over(Window.partitionBy("table_key"))
    out = out.withColumn("_real", real).filter(~F.col("is_placeholder") | (F.col("_real") == 0)).drop("_real")
    score = confidence(F.size("transforms"), F.array_contains("transforms", "direct"), F.col("is_aggregate"), F.size("sources"), F.coalesce("via_cte", F.lit(False)), F.col("n_scripts"))
    return out.withColumn("confidence", score)


def table_registry(statements: DataFrame) -> DataFrame:
    """Tables over all statements: scripts, kinds of definition, number of dependencies and of dependents, temporary by name."""
    edges = table_edges(statements).filter("not is_self_edge")
    temp = F.lit(False)
    for d in rules.DIALECTS:
        temp = temp | (F.array_contains("_dialects", d) & cleaning.is_temp_name(F.element_at(F.split("table_name", r"\."), -1), d))
    dialects = statements.select("file_path", "dialect").distinct()
    target = _with_bodies(statements).filter("target_table is not null").select(F.lower("target_table").alias("table_name"), "file_path", "statement_type", F.lit(1).alias("is_target"))
    source = edges.select(F.lower("src_table").alias("table_name"), "file_path", F.lit("REFERENCE").alias("statement_type"), F.lit(0).alias("is_target"))
    t = target.unionByName(source).join(dialects, "file_path").groupBy("table_name").agg(F.array_sort(F.collect_set("file_path")).alias("scripts"), F.array_sort(F.collect_set("statement_type")).alias("definition_types"), F.collect_set("dialect").alias("_dialects"))
    out = edges.groupBy(F.lower("dst_table").alias("table_name")).agg(F.countDistinct(F.lower("src_table")).alias("depends_on_count"))
    into = edges.groupBy(F.lower("src_table").alias("table_name")).agg(F.countDistinct(F.lower("dst_table")).alias("referenced_by_count"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return t.join(out, "table_name", "left").join(into, "table_name", "left").select("table_name", "scripts", "definition_types", zero("depends_on_count"), zero("referenced_by_count"), temp.alias("is_temp"))


def _total(facts: str) -> Column:
    return F.size(facts) + F.aggregate("body", F.lit(0), lambda n, b: n + F.size(b[facts]))


def summary(statements: DataFrame) -> DataFrame:
    """One row of totals."""
    one = lambda c: F.coalesce(F.sum(c.cast("bigint")), F.lit(0))
    return statements.agg(
        F.count(F.lit(1)).alias("total_statements"), F.countDistinct("file_path").alias("total_files"), F.countDistinct(F.lower("target_table")).alias("total_targets"),
        one(_total("columns")).alias("total_columns"), one(F.col("parse_error").isNotNull()).alias("parse_errors"), one(F.col("is_dynamic")).alias("dynamic_statements"), one(_total("ctes")).alias("total_ctes"),
        F.format_string("%.1f%%", 100.0 * F.avg(F.col("parse_error").isNull().cast("int"))).alias("parse_success_rate"),
    )
