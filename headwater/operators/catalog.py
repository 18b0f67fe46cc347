"""Catalogs: names in all their forms, assembly of tables with their columns and keys, and what a catalog adds to lineage.

Tables are DataFrames with database_name, schema_name, table_name (and what else they hold); names compare in lower case, without
quotes and blanks. A name is looked up by equality of its forms, never by comparing all names with each other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from headwater.functions import rules
from headwater.functions.names import clean_name
from headwater.operators.parser import UNKNOWN

#: Tables for which statements are made where a catalog holds none; the limit is the feature.
SYNTHETIC = 250


def _join(*parts: Column) -> Column:
    return F.concat_ws(".", *parts)


def name_forms(tables: DataFrame) -> DataFrame:
    """The forms a table may be named in: form, qualified_name (schema.table), full_name, n_tables (that have the form), rank.

    Forms are database.schema.table (rank 1), schema.table (2), database..table (3) and table (4); quotes and brackets are gone once a
    name is clean.
    """
    t = tables.select(clean_name(F.col("database_name")).alias("d"), clean_name(F.col("schema_name")).alias("s"), clean_name(F.col("table_name")).alias("t")).filter("t is not null").distinct()
    forms = F.array(*[F.struct(F.lit(r).alias("rank"), f.alias("form")) for r, f in enumerate((_join("d", "s", "t"), _join("s", "t"), F.concat("d", F.lit(".."), "t"), F.col("t")), 1)])
    rows = t.select(_join("s", "t").alias("qualified_name"), _join("d", "s", "t").alias("full_name"), F.explode(forms).alias("f")).select("f.form", "qualified_name", "full_name", "f.rank").filter("form is not null")
    return rows.groupBy("form").agg(F.min("qualified_name").alias("qualified_name"), F.min("full_name").alias("full_name"), F.countDistinct("full_name").alias("n_tables"), F.min("rank").alias("rank"))


def resolve_names(refs: DataFrame, name: str, tables: DataFrame, dialect: str = "tsql") -> DataFrame:
    """References with the table they mean: adds qualified_name and resolved_by (full, schema, database, default, name), null if none.

    A name is looked up as it stands, with the dialect's default schema, and by itself if only one table has it.
    """
    forms = name_forms(tables)
    default = rules.DEFAULT_SCHEMA[rules.dialect_of(dialect)]
    by = F.when(F.col("rank") == 1, "full").when(F.col("rank") == 2, "schema").when(F.col("rank") == 3, "database").otherwise("name")
    # A table in no schema has its name as schema.table form too; what counts is that one table alone has the form.
    only = forms.filter("n_tables = 1").select("form", F.col("qualified_name").alias("_q"), by.alias("_by"))
    ref = refs.withColumn("_ref", clean_name(F.col(name)))
    out = ref.join(only, F.col("_ref") == F.col("form"), "left").drop("form")
    inside = forms.filter("n_tables = 1 and rank = 2").select("form", F.col("qualified_name").alias("_dq"))
    plain = F.when(~F.col("_ref").contains("."), F.concat(F.lit(default + "."), "_ref")) if default else F.lit(None).cast("string")
    out = out.join(inside, plain == F.col("form"), "left").drop("form")
    use_default = F.col("_dq").isNotNull() & ~F.coalesce(F.col("_by").isin("full", "schema"), F.lit(False))
    return out.withColumn("qualified_name", F.when(use_default, F.col("_dq")).otherwise(F.col("_q"))).withColumn("resolved_by", F.when(use_default, "default").otherwise(F.col("_by"))).drop("_ref", "_q", "_by", "_dq")


def disambiguation(tables: DataFrame) -> DataFrame:
    """Each table name with the number of schemas that have it: table_name, n_schemas, is_unique, qualified_names."""
    t = tables.select(clean_name(F.col("schema_name")).alias("s"), clean_name(F.col("table_name")).alias("table_name")).filter("table_name is not null").distinct()
    out = t.groupBy("table_name").agg(F.count(F.lit(1)).alias("n_schemas"), F.array_sort(F.collect_list(_join("s", "table_name"))).alias("qualified_names"))
    return out.withColumn("is_unique", F.col("n_schemas") == 1)


def column_map(columns: DataFrame) -> DataFrame:
    """Each column name with its tables and types: column_name, n_tables, n_types, is_unique, first_table."""
    c = columns.select(clean_name(F.col("column_name")).alias("column_name"), _join(clean_name(F.col("schema_name")), clean_name(F.col("table_name"))).alias("t"), F.lower("data_type").alias("ty")).filter("column_name is not null")
    out = c.groupBy("column_name").agg(F.countDistinct("t").alias("n_tables"), F.countDistinct("ty").alias("n_types"), F.min("t").alias("first_table"))
    return out.withColumn("is_unique", F.col("n_tables") == 1)


def primary_keys(indexes: DataFrame) -> DataFrame:
    """Primary keys from indexes: table_name, columns in their order. indexes: table_name, index_number, index_type, column_name,
    position. The key is index 1 or of type P; if both are there, that of type P."""
    keys = indexes.filter("index_number = 1 or index_type = 'P'").withColumn("_p", (F.col("index_type") == "P").cast("int"))
    best = keys.groupBy("table_name").agg(F.max(F.struct(F.coalesce("_p", F.lit(0)).alias("p"), -F.col("index_number"))).alias("b")).select("table_name", (-F.col("b.col2")).alias("index_number"))
    cols = keys.join(best, ["table_name", "index_number"]).groupBy("table_name").agg(F.array_sort(F.collect_set(F.struct("position", "column_name"))).alias("c"))
    return cols.select("table_name", F.transform("c", lambda x: x["column_name"]).alias("columns"))


def assemble(tables: DataFrame, columns: DataFrame, keys: DataFrame | None = None, foreign_keys: DataFrame | None = None) -> DataFrame:
    """One row per table with its columns, primary key and foreign keys, as arrays in a defined order.

    columns: schema_name, table_name, column_name, data_type, is_nullable, ordinal_position; keys: table_name (schema.table),
    columns; foreign_keys: schema_name, table_name, constraint_name, column_name, referenced (schema.table), referenced_column.
    A table without any has empty arrays.
    """
    q = lambda: _join(clean_name(F.col("schema_name")), clean_name(F.col("table_name"))).alias("qualified_name")
    t = tables.withColumn("qualified_name", q()).dropDuplicates(["qualified_name"])
    c = columns.select(q(), F.struct("ordinal_position", clean_name(F.col("column_name")).alias("column_name"), "data_type", "is_nullable").alias("c")).groupBy("qualified_name").agg(F.array_sort(F.collect_set("c")).alias("columns"))
    out = t.join(c, "qualified_name", "left").withColumn("columns", F.coalesce("columns", F.array().cast(c.schema["columns"].dataType)))
    none = F.array().cast("array<string>")
    if keys is not None:
        out = out.join(keys.select(F.col("table_name").alias("qualified_name"), F.col("columns").alias("primary_key")), "qualified_name", "left").withColumn("primary_key", F.coalesce("primary_key", none))
    if foreign_keys is not None:
        f = foreign_keys.select(q(), F.struct("constraint_name", clean_name(F.col("column_name")).alias("column_name"), clean_name(F.col("referenced")).alias("referenced"), clean_name(F.col("referenced_column")).alias("referenced_column")).alias("f"))
        f = f.groupBy("qualified_name").agg(F.array_sort(F.collect_set("f")).alias("foreign_keys"))
        out = out.join(f, "qualified_name", "left").withColumn("foreign_keys", F.coalesce("foreign_keys", F.array().cast(f.schema["foreign_keys"].dataType)))
    return out


def statistics(sizes: DataFrame, counts: DataFrame | None = None) -> DataFrame:
    """Bytes and rows per table: sizes: table_name, current_bytes, peak_bytes, approximate_rows (one row per part of a table); counts:
    table_name, row_count. Where a table isn't counted its approximate number stands, is_exact tells which."""
    s = sizes.groupBy("table_name").agg(F.sum("current_bytes").alias("current_bytes"), F.sum("peak_bytes").alias("peak_bytes"), F.max("approximate_rows").alias("_approx"))
    out = s.join(counts.select("table_name", "row_count"), "table_name", "left") if counts is not None else s.withColumn("row_count", F.lit(None).cast("bigint"))
    return out.select("table_name", "current_bytes", "peak_bytes", F.coalesce("row_count", "_approx").alias("row_count"), F.col("row_count").isNotNull().alias("is_exact"))


def synthetic_statements(tables: DataFrame, n: int = SYNTHETIC) -> DataFrame:
    """Statements that read whole tables, for a catalog without views, history and routines: file_path, sql_text, source_kind."""
    name = _join("database_name", "table_name")
    return tables.select(name.alias("t")).distinct().orderBy("t").limit(n).select(F.concat(F.lit("table:"), "t").alias("file_path"), F.format_string("SELECT * FROM %s", "t").alias("sql_text"), F.lit("TABLE_METADATA").alias("source_kind"))


def backfill_header(kind: Column, schema: Column, name: Column, arguments: Column, body: Column) -> Column:
    """A routine's definition with a header where the catalog holds the body alone. Types only are left of arguments such as
    "F(VARCHAR, NUMBER) RETURN VARCHAR"."""
    inside = F.coalesce(F.regexp_extract(arguments, r"\(([^)]*)\)", 1), F.lit(""))
    returns = F.regexp_extract(arguments, r"(?i)\)\s*RETURNS?\s+(.+)$", 1)
    head = F.concat(F.lit("CREATE "), F.upper(kind), F.lit(" "), F.concat_ws(".", schema, F.regexp_replace(name, r"\(.*$", "")), F.lit("("), inside, F.lit(")"), F.when(returns != "", F.concat(F.lit(" RETURNS "), returns)).otherwise(""), F.lit(" AS "))
    return F.when(body.isNull() | (F.trim(body) == ""), F.lit(None).cast("string")).when(body.rlike(r"(?is)^\s*(?:CREATE|REPLACE|ALTER)\b"), body).otherwise(F.concat(head, body))


# ---- lineage and catalog
def enrich_edges(edges: DataFrame, columns: DataFrame, keys: DataFrame | None = None) -> DataFrame:
    """Column edges with what the catalog says of both ends: exists, type, nullability and whether it is in the primary key.

    edges: src_table, src_column, dst_table, dst_column as schema.table; columns as in ``assemble``; keys: table_name, columns.
    """
    c = columns.select(_join(clean_name(F.col("schema_name")), clean_name(F.col("table_name"))).alias("t"), clean_name(F.col("column_name")).alias("c"), F.col("data_type").alias("ty"), F.col("is_nullable").alias("nn")).groupBy("t", "c").agg(F.min("ty").alias("ty"), F.bool_or("nn").alias("nn"))
    if keys is not None:
        c = c.join(keys.select(F.col("table_name").alias("t"), F.explode("columns").alias("c"), F.lit(True).alias("pk")).distinct(), ["t", "c"], "left")
    else:
        c = c.withColumn("pk", F.lit(None).cast("boolean"))
    known = c.select("t").distinct()
    out = edges
    for end in ("src", "dst"):
        table = clean_name(F.col(f"{end}_table"))
        out = out.join(known.select(F.col("t").alias("_k")), table == F.col("_k"), "left").withColumn(f"{end}_table_exists", F.col("_k").isNotNull()).drop("_k")
        out = out.join(c, (table == F.col("t")) & (clean_name(F.col(f"{end}_column")) == F.col("c")), "left")
        out = out.withColumn(f"{end}_exists", F.col("t").isNotNull()).withColumnRenamed("ty", f"{end}_type").withColumnRenamed("nn", f"{end}_nullable").withColumn(f"{end}_in_key", F.coalesce("pk", F.lit(False))).drop("t", "c", "pk")
    return out


def resolve_unknown(edges: DataFrame, sources: DataFrame, columns: DataFrame) -> DataFrame:
    """Column edges with unqualified columns resolved: where exactly one of a statement's tables has the column in the catalog.

    edges: stmt_id, src_table, src_column and others; sources: stmt_id, src_table of the statements; columns: table_name
    (schema.table), column_name. Others stay unknown.
    """
    have = columns.select(clean_name(F.col("table_name")).alias("_t"), clean_name(F.col("column_name")).alias("_c")).distinct()
    open_ = edges.filter(F.col("src_table") == UNKNOWN).select("stmt_id", F.col("src_column").alias("_col")).distinct()
    may = open_.join(sources.select("stmt_id", F.col("src_table").alias("_table")).distinct(), "stmt_id").join(have, (clean_name(F.col("_table")) == F.col("_t")) & (clean_name(F.col("_col")) == F.col("_c")))
    one = may.groupBy("stmt_id", "_col").agg(F.min("_table").alias("_table"), F.countDistinct("_t").alias("_n")).filter("_n = 1")
    out = edges.join(one, (edges["stmt_id"] == one["stmt_id"]) & (edges["src_column"] == one["_col"]) & (edges["src_table"] == UNKNOWN), "left").drop(one["stmt_id"])
    return out.withColumn("src_table", F.coalesce("_table", "src_table")).drop("_table", "_col", "_n")


def references_in_text(texts: DataFrame, text: str, tables: DataFrame) -> DataFrame:
    """Tables of the catalog that a text names in any form: the columns of texts but the text itself, and qualified_name.

    Names are taken from the text and looked up, in brackets or quotes, dotted or bare; a bare name counts if one table alone has it.
    """
    part = r"(?:\[[^\]\n]+\]|\"[^\"\n]+\"|`[^`\n]+`|[A-Za-z_#@][\w$#@]*)"
    keep = [c for c in texts.columns if c != text]
    named = texts.select(*keep, F.explode(F.array_distinct(F.regexp_extract_all(text, F.lit(rf"({part}(?:\.{part})*)"), F.lit(1)))).alias("_n")).select(*keep, clean_name(F.col("_n")).alias("_n")).distinct()
    forms = name_forms(tables).filter("n_tables = 1").select("form", "qualified_name")
    return named.join(forms, F.col("_n") == F.col("form")).select(*keep, "qualified_name").distinct()


def context(refs: DataFrame, catalog: DataFrame) -> DataFrame:
    """For each reference to a table (its columns and qualified_name), the table's columns and keys from ``assemble``."""
    return refs.join(catalog.drop("schema_name", "table_name", "database_name"), "qualified_name")


def view_graph(views: DataFrame, edges: DataFrame) -> DataFrame:
    """Views with the numbers of views they depend on and that depend on them, and their level; null on circles and behind them.

    views: view_name; edges: src_table, dst_table (dst reads src).
    """
    from headwater.operators import graphs

    v = views.select(F.lower("view_name").alias("node")).distinct()
    e = edges.select(F.lower("src_table").alias("src"), F.lower("dst_table").alias("dst")).distinct()
    e = e.join(v.select(F.col("node").alias("src")), "src", "left_semi").join(v.select(F.col("node").alias("dst")), "dst", "left_semi").select("src", "dst")
    out = v.join(graphs.adjacency(e), "node", "left").join(graphs.execution_levels(e), "node", "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    return out.select(F.col("node").alias("view_name"), zero("n_in").alias("n_dependencies"), zero("n_out").alias("n_dependents"), F.when(F.coalesce("is_circular", F.lit(False)), F.lit(None)).otherwise(zero("level")).cast("int").alias("level"), F.coalesce("is_circular", F.lit(False)).alias("is_circular"))


def virtual_sources(catalog: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes for a viewer: tables of the catalog and those only named in edges, each once, preferring the catalog's and of those the
    one with most columns. catalog: table_name, n_columns; edges: src_table, dst_table."""
    named = edges.select(F.explode(F.array("src_table", "dst_table")).alias("table_name")).filter("table_name is not null")
    rows = catalog.select(F.lower("table_name").alias("node"), F.lit(1).alias("in_catalog"), "n_columns").unionByName(named.select(F.lower("table_name").alias("node"), F.lit(0).alias("in_catalog"), F.lit(0).cast("bigint").alias("n_columns")).distinct())
    best = Window.partitionBy("node").orderBy(F.desc("in_catalog"), F.desc("n_columns"))
    return rows.withColumn("_r", F.row_number().over(best)).filter("_r = 1").drop("_r")
