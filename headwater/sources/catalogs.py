"""Catalogs of databases: queries on their public catalog views, descriptions written as JSON, and the parts of a description.

A description is a set of DataFrames: tables, columns, views, procedures, functions, triggers, foreign_keys, query_history,
dependencies and others by the name of their class. They come over JDBC, from JSON, or are handed in.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from headwater.functions import rules
from headwater.sources.corpus import read_jdbc, read_metadata

_INFO = "information_schema"
#: Queries per dialect and class of objects, on the catalog views that each system documents.
QUERIES: dict[str, dict[str, str]] = {
    "tsql": {
        "tables": "SELECT s.name AS schema_name, t.name AS table_name, SUM(p.rows) AS row_count FROM sys.tables t JOIN sys.schemas s ON s.schema_id = t.schema_id LEFT JOIN sys.partitions p ON p.object_id = t.object_id AND p.index_id IN (0, 1) GROUP BY s.name, t.name",
        "columns": f"SELECT table_schema AS schema_name, table_name, column_name, data_type, is_nullable, ordinal_position, column_default FROM {_INFO}.columns",
        "views": "SELECT s.name AS schema_name, v.name AS view_name, m.definition, v.create_date, v.modify_date FROM sys.views v JOIN sys.schemas s ON s.schema_id = v.schema_id JOIN sys.sql_modules m ON m.object_id = v.object_id",
        "procedures": "SELECT s.name AS schema_name, o.name AS procedure_name, m.definition, o.create_date, o.modify_date FROM sys.procedures o JOIN sys.schemas s ON s.schema_id = o.schema_id JOIN sys.sql_modules m ON m.object_id = o.object_id",
        "functions": "SELECT s.name AS schema_name, o.name AS function_name, o.type AS function_type, m.definition FROM sys.objects o JOIN sys.schemas s ON s.schema_id = o.schema_id JOIN sys.sql_modules m ON m.object_id = o.object_id WHERE o.type IN ('FN', 'IF', 'TF')",
        "triggers": "SELECT OBJECT_SCHEMA_NAME(t.parent_id) AS schema_name, OBJECT_NAME(t.parent_id) AS table_name, t.name AS trigger_name, m.definition, t.is_disabled FROM sys.triggers t JOIN sys.sql_modules m ON m.object_id = t.object_id WHERE t.parent_class = 1",
        "primary_keys": f"SELECT k.table_schema AS schema_name, k.table_name, k.column_name, k.ordinal_position AS position FROM {_INFO}.key_column_usage k JOIN {_INFO}.table_constraints c ON c.constraint_name = k.constraint_name AND c.table_schema = k.table_schema WHERE c.constraint_type = 'PRIMARY KEY'",
        "foreign_keys": "SELECT OBJECT_NAME(c.constraint_object_id) AS constraint_name, OBJECT_SCHEMA_NAME(c.parent_object_id) AS schema_name, OBJECT_NAME(c.parent_object_id) AS table_name, COL_NAME(c.parent_object_id, c.parent_column_id) AS column_name, OBJECT_SCHEMA_NAME(c.referenced_object_id) AS referenced_schema, OBJECT_NAME(c.referenced_object_id) AS referenced_table, COL_NAME(c.referenced_object_id, c.referenced_column_id) AS referenced_column FROM sys.foreign_key_columns c",
        "indexes": "SELECT OBJECT_SCHEMA_NAME(i.object_id) AS schema_name, OBJECT_NAME(i.object_id) AS table_name, i.name AS index_name, i.type_desc AS index_type, u.user_seeks, u.user_scans, u.user_updates FROM sys.indexes i LEFT JOIN sys.dm_db_index_usage_stats u ON u.object_id = i.object_id AND u.index_id = i.index_id AND u.database_id = DB_ID() WHERE i.name IS NOT NULL",
        "check_constraints": "SELECT OBJECT_SCHEMA_NAME(parent_object_id) AS schema_name, OBJECT_NAME(parent_object_id) AS table_name, name AS constraint_name, definition FROM sys.check_constraints",
        "unique_constraints": f"SELECT table_schema AS schema_name, table_name, constraint_name FROM {_INFO}.table_constraints WHERE constraint_type = 'UNIQUE'",
        "sequences": "SELECT SCHEMA_NAME(schema_id) AS schema_name, name AS sequence_name FROM sys.sequences",
        "synonyms": "SELECT SCHEMA_NAME(schema_id) AS schema_name, name AS synonym_name, base_object_name FROM sys.synonyms",
        "dependencies": "SELECT DISTINCT OBJECT_SCHEMA_NAME(referencing_id) AS referencing_schema, OBJECT_NAME(referencing_id) AS referencing_name, referenced_schema_name AS referenced_schema, referenced_entity_name AS referenced_name FROM sys.sql_expression_dependencies",
        "query_history": "SELECT q.query_text_id, q.query_sql_text, SUM(r.count_executions) AS count_executions, AVG(r.avg_duration) / 1000.0 AS avg_duration_ms, MAX(r.last_execution_time) AS last_execution_time FROM sys.query_store_query_text q JOIN sys.query_store_query y ON y.query_text_id = q.query_text_id JOIN sys.query_store_plan p ON p.query_id = y.query_id JOIN sys.query_store_runtime_stats r ON r.plan_id = p.plan_id GROUP BY q.query_text_id, q.query_sql_text",
    },
    "postgres": {
        "tables": "SELECT n.nspname AS schema_name, c.relname AS table_name, CAST(c.reltuples AS bigint) AS row_count FROM pg_catalog.pg_class c JOIN pg_catalog.pg_namespace n ON n.oid = c.relnamespace WHERE c.relkind IN ('r', 'p', 'f')",
        "columns": f"SELECT table_schema AS schema_name, table_name, column_name, data_type, is_nullable, ordinal_position, column_default FROM {_INFO}.columns",
        "views": "SELECT schemaname AS schema_name, viewname AS view_name, definition FROM pg_catalog.pg_views",
        "materialized_views": "SELECT schemaname AS schema_name, matviewname AS view_name, definition FROM pg_catalog.pg_matviews",
        "procedures": "SELECT n.nspname AS schema_name, p.proname AS procedure_name, pg_get_functiondef(p.oid) AS definition FROM pg_catalog.pg_proc p JOIN pg_catalog.pg_namespace n ON n.oid = p.pronamespace WHERE p.prokind = 'p'",
        "functions": "SELECT n.nspname AS schema_name, p.proname AS function_name, CASE WHEN p.proretset THEN 'TF' ELSE 'FN' END AS function_type, pg_get_functiondef(p.oid) AS definition FROM pg_catalog.pg_proc p JOIN pg_catalog.pg_namespace n ON n.oid = p.pronamespace WHERE p.prokind = 'f'",
        "triggers": "SELECT n.nspname AS schema_name, c.relname AS table_name, t.tgname AS trigger_name, pg_get_triggerdef(t.oid) AS definition FROM pg_catalog.pg_trigger t JOIN pg_catalog.pg_class c ON c.oid = t.tgrelid JOIN pg_catalog.pg_namespace n ON n.oid = c.relnamespace WHERE NOT t.tgisinternal",
        "primary_keys": f"SELECT k.table_schema AS schema_name, k.table_name, k.column_name, k.ordinal_position AS position FROM {_INFO}.key_column_usage k JOIN {_INFO}.table_constraints c USING (constraint_schema, constraint_name) WHERE c.constraint_type = 'PRIMARY KEY'",
        "foreign_keys": f"SELECT k.constraint_name, k.table_schema AS schema_name, k.table_name, k.column_name, u.table_schema AS referenced_schema, u.table_name AS referenced_table, u.column_name AS referenced_column FROM {_INFO}.referential_constraints r JOIN {_INFO}.key_column_usage k USING (constraint_schema, constraint_name) JOIN {_INFO}.key_column_usage u ON u.constraint_name = r.unique_constraint_name AND u.ordinal_position = k.position_in_unique_constraint",
        "indexes": "SELECT schemaname AS schema_name, tablename AS table_name, indexname AS index_name, indexdef AS definition FROM pg_catalog.pg_indexes",
        "sequences": f"SELECT sequence_schema AS schema_name, sequence_name FROM {_INFO}.sequences",
        "dependencies": f"SELECT DISTINCT view_schema AS referencing_schema, view_name AS referencing_name, table_schema AS referenced_schema, table_name AS referenced_name FROM {_INFO}.view_table_usage",
        "query_history": "SELECT queryid AS query_text_id, query AS query_sql_text, calls AS count_executions, mean_exec_time AS avg_duration_ms FROM pg_stat_statements",
    },
    "oracle": {
        "tables": "SELECT owner AS schema_name, table_name, num_rows AS row_count FROM all_tables",
        "columns": "SELECT owner AS schema_name, table_name, column_name, data_type, nullable AS is_nullable, column_id AS ordinal_position FROM all_tab_columns",
        "views": "SELECT owner AS schema_name, view_name, text AS definition FROM all_views",
        "materialized_views": "SELECT owner AS schema_name, mview_name AS view_name, query AS definition FROM all_mviews",
        "sources": "SELECT owner AS schema_name, name AS routine_name, type AS routine_type, line, text FROM all_source",
        "triggers": "SELECT table_owner AS schema_name, table_name, trigger_name, triggering_event AS trigger_event, trigger_body AS definition FROM all_triggers",
        "primary_keys": "SELECT c.owner AS schema_name, c.table_name, c.column_name, c.position FROM all_cons_columns c JOIN all_constraints k ON k.owner = c.owner AND k.constraint_name = c.constraint_name WHERE k.constraint_type = 'P'",
        "foreign_keys": "SELECT k.constraint_name, c.owner AS schema_name, c.table_name, c.column_name, r.owner AS referenced_schema, r.table_name AS referenced_table, r.column_name AS referenced_column FROM all_constraints k JOIN all_cons_columns c ON c.owner = k.owner AND c.constraint_name = k.constraint_name JOIN all_cons_columns r ON r.owner = k.r_owner AND r.constraint_name = k.r_constraint_name AND r.position = c.position WHERE k.constraint_type = 'R'",
        "indexes": "SELECT table_owner AS schema_name, table_name, index_name, index_type FROM all_indexes",
        "db_links": "SELECT owner AS schema_name, db_link, host FROM all_db_links",
        "synonyms": "SELECT owner AS schema_name, synonym_name, table_owner || '.' || table_name AS base_object_name FROM all_synonyms",
        "sequences": "SELECT sequence_owner AS schema_name, sequence_name FROM all_sequences",
        "dependencies": "SELECT DISTINCT owner AS referencing_schema, name AS referencing_name, referenced_owner AS referenced_schema, referenced_name FROM all_dependencies",
    },
    "teradata": {
        "tables": "SELECT DatabaseName AS schema_name, TableName AS table_name FROM DBC.TablesV WHERE TableKind IN ('T', 'O')",
        "columns": "SELECT DatabaseName AS schema_name, TableName AS table_name, ColumnName AS column_name, ColumnType AS data_type, Nullable AS is_nullable, ColumnId AS ordinal_position FROM DBC.ColumnsV",
        "views": "SELECT DatabaseName AS schema_name, TableName AS view_name, RequestText AS definition FROM DBC.TablesV WHERE TableKind = 'V'",
        "procedures": "SELECT DatabaseName AS schema_name, TableName AS procedure_name, RequestText AS definition FROM DBC.TablesV WHERE TableKind IN ('P', 'E')",
        "macros": "SELECT DatabaseName AS schema_name, TableName AS procedure_name, RequestText AS definition FROM DBC.TablesV WHERE TableKind = 'M'",
        "indexes": "SELECT DatabaseName AS schema_name, TableName AS table_name, IndexNumber AS index_number, IndexType AS index_type, ColumnName AS column_name, ColumnPosition AS position FROM DBC.IndicesV",
        "foreign_keys": "SELECT IndexName AS constraint_name, ChildDB AS schema_name, ChildTable AS table_name, ChildKeyColumn AS column_name, ParentDB AS referenced_schema, ParentTable AS referenced_table, ParentKeyColumn AS referenced_column FROM DBC.All_RI_ChildrenV",
        "sizes": "SELECT DatabaseName || '.' || TableName AS table_name, CurrentPerm AS current_bytes, PeakPerm AS peak_bytes FROM DBC.TableSizeV",
        "query_history": "SELECT l.QueryID AS query_text_id, s.SqlTextInfo AS query_sql_text, 1 AS count_executions, l.StartTime AS last_execution_time FROM DBC.QryLogV l JOIN DBC.QryLogSqlV s ON s.QueryID = l.QueryID",
    },
    "snowflake": {
        "tables": f"SELECT table_catalog AS database_name, table_schema AS schema_name, table_name, row_count, bytes AS current_bytes FROM {_INFO}.tables WHERE table_type LIKE '%TABLE'",
        "columns": f"SELECT table_schema AS schema_name, table_name, column_name, data_type, is_nullable, ordinal_position FROM {_INFO}.columns",
        "views": f"SELECT table_schema AS schema_name, table_name AS view_name, view_definition AS definition FROM {_INFO}.views",
        "procedures": f"SELECT procedure_schema AS schema_name, procedure_name, argument_signature, procedure_definition AS definition FROM {_INFO}.procedures",
        "functions": f"SELECT function_schema AS schema_name, function_name, argument_signature, function_definition AS definition FROM {_INFO}.functions",
        "stages": f"SELECT stage_schema AS schema_name, stage_name, stage_url FROM {_INFO}.stages",
        "pipes": f"SELECT pipe_schema AS schema_name, pipe_name, definition FROM {_INFO}.pipes",
        "sequences": f"SELECT sequence_schema AS schema_name, sequence_name FROM {_INFO}.sequences",
        "file_formats": f"SELECT file_format_schema AS schema_name, file_format_name FROM {_INFO}.file_formats",
        "external_tables": f"SELECT table_schema AS schema_name, table_name, location FROM {_INFO}.external_tables",
        "constraints": f"SELECT table_schema AS schema_name, table_name, constraint_name, constraint_type FROM {_INFO}.table_constraints",
        "tasks": "SHOW TASKS",
        "streams": "SHOW STREAMS",
        "masking_policies": "SHOW MASKING POLICIES",
        "row_access_policies": "SHOW ROW ACCESS POLICIES",
        "tags": "SHOW TAGS",
        "dynamic_tables": "SHOW DYNAMIC TABLES",
        "primary_keys": "SHOW PRIMARY KEYS",
        "foreign_keys": "SHOW IMPORTED KEYS",
        "dependencies": "SELECT DISTINCT referencing_schema, referencing_object_name AS referencing_name, referenced_schema, referenced_object_name AS referenced_name FROM snowflake.account_usage.object_dependencies",
        "query_history": "SELECT query_id AS query_text_id, query_text AS query_sql_text, 1 AS count_executions, total_elapsed_time AS avg_duration_ms, start_time AS last_execution_time FROM snowflake.account_usage.query_history WHERE execution_status = 'SUCCESS'",
    },
}
#: Parts of errors that pass when one tries again.
TRANSIENT = ("timeout", "timed out", "connection reset", "connection refused", "deadlock", "temporarily", "broken pipe", "communication link", "too many connections", "session closed")
#: Classes with text that is analysed as views (tabular) and as routines (executable).
TABULAR, EXECUTABLE = ("views", "materialized_views", "query_history"), ("procedures", "functions", "triggers", "macros", "packages")


def is_transient(error: BaseException) -> bool:
    """Whether an error may pass by itself."""
    return any(x in str(error).lower() for x in TRANSIENT)


def with_retries(read: Callable[[], DataFrame], tries: int = 5, wait: float = 1.0, sleep: Callable[[float], None] = time.sleep) -> DataFrame:
    """What ``read`` gives; after an error that may pass it is tried again, each time after twice as long."""
    for k in range(tries):
        try:
            return read()
        except Exception as e:
            if k == tries - 1 or not is_transient(e):
                raise
            sleep(wait * 2**k)
    raise ValueError("tries must be positive")


def extract(spark: SparkSession, dialect: str, host: str, port: int, database: str, classes: list[str] | None = None, read: Callable[..., DataFrame] = read_jdbc, **options: str) -> dict[str, DataFrame]:
    """The description of a database over JDBC, one DataFrame per class of objects, all of them or those asked for."""
    d = rules.dialect_of(dialect)
    wanted = {k: q for k, q in QUERIES[d].items() if classes is None or k in classes}
    return {k: with_retries(lambda q=q: read(spark, d, host, port, database, q, **options)).withColumn("database_name", F.lit(database)) for k, q in wanted.items()}


def frames_of(metadata: DataFrame) -> dict[str, DataFrame]:
    """The parts of a description that was read from JSON: one DataFrame per array of structs in it, columns also from within tables."""
    out = {}
    for f in metadata.schema.fields:
        if f.dataType.typeName() == "array" and f.dataType.elementType.typeName() == "struct":
            out[f.name] = metadata.select("database" if "database" in metadata.columns else F.lit(None).cast("string").alias("database"), F.explode(f.name).alias("x")).select(F.col("database").alias("database_name"), "x.*")
    tables = out.get("tables")
    if tables is not None:
        names = {"schema": "schema_name", "name": "table_name"}
        for old, new in names.items():
            if old in tables.columns and new not in tables.columns:
                tables = tables.withColumnRenamed(old, new)
        out["tables"] = tables
        if "columns" in tables.columns and "columns" not in out:
            c = tables.select("database_name", "schema_name", "table_name", F.posexplode("columns").alias("i", "c"))
            have = c.schema["c"].dataType.fieldNames()
            out["columns"] = c.select("database_name", "schema_name", "table_name", F.col("c.name").alias("column_name"), *[F.col(f"c.{x}") for x in ("data_type", "is_nullable") if x in have], (F.col("i") + 1).alias("ordinal_position"))
    return out


def description(spark: SparkSession, path: str | None = None, preloaded: dict[str, DataFrame] | None = None, fresh: Callable[[], dict[str, DataFrame]] | None = None, force_refresh: bool = False) -> dict[str, DataFrame]:
    """A description by the first way there is: handed in, read from JSON (of several files that fit a pattern, the last), or extracted.
    With force_refresh it is extracted in any case."""
    if force_refresh and fresh is not None:
        return fresh()
    if preloaded is not None:
        return preloaded
    if path is not None:
        files = spark.read.format("binaryFile").load(path).select("path")
        return frames_of(read_metadata(spark, files.agg(F.max("path")).first()[0]))
    if fresh is not None:
        return fresh()
    raise ValueError("no description: give frames, a path or a way to extract one")


def components(frames: dict[str, DataFrame], tabular: bool) -> DataFrame | None:
    """Texts of a description for analysis: file_path, sql_text, source_kind; views and history if tabular, else routines."""
    out = None
    for kind in TABULAR if tabular else EXECUTABLE:
        df = frames.get(kind)
        if df is None:
            continue
        text = "query_sql_text" if kind == "query_history" else "definition"
        name = next((c for c in df.columns if c.endswith("_name") and c not in ("schema_name", "database_name", "table_name")), None)
        label = F.concat_ws(".", "schema_name", name) if name and "schema_name" in df.columns else F.col("query_text_id").cast("string") if "query_text_id" in df.columns else F.lit(kind)
        part = df.filter(F.col(text).isNotNull()).select(F.concat(F.lit(kind + ":"), label).alias("file_path"), F.col(text).alias("sql_text"), F.lit(kind.rstrip("s").upper()).alias("source_kind"))
        out = part if out is None else out.unionByName(part)
    return out


def sources_as_definitions(sources: DataFrame) -> DataFrame:
    """Routines from lines of source: schema_name, procedure_name, routine_type, definition. sources: line by line, as Oracle keeps
    them; a routine's lines are put together in their order."""
    by = sources.groupBy("schema_name", "routine_name", "routine_type").agg(F.array_sort(F.collect_list(F.struct("line", "text"))).alias("l"))
    return by.select("schema_name", F.col("routine_name").alias("procedure_name"), "routine_type", F.concat(F.lit("CREATE "), F.array_join(F.transform("l", lambda x: x["text"]), "")).alias("definition"))


def write_description(frames: dict[str, DataFrame], path: str) -> list[str]:
    """Writes each part as JSON, by database; returns the folders."""
    out = []
    for name, df in frames.items():
        out.append(f"{path.rstrip('/')}/enhanced_metadata/{name}")
        w = df.write.mode("overwrite")
        (w.partitionBy("database_name") if "database_name" in df.columns and len(df.columns) > 1 else w).json(out[-1])
    return out
