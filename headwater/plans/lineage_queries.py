"""Queries on the operators for lineage, run over the test tables: text rules on documents and query history, registries and
scores on lineage tables, graphs on keys, and medallion views on the sales tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from headwater.functions import rules
from headwater.functions.names import clean_name, object_of, schema_of
from headwater.operators import cleaning, graphs, lineage, reports, routines
from headwater.scratch import Scratch
from headwater.sources import corpus
from headwater.sources.tables import table

T = table


def strip_comments(spark: SparkSession, d: str) -> DataFrame:
    """B1: block and line comments."""
    return T(spark, d, "documents").select("doc_id", F.length(cleaning.strip_comments(F.col("text"))).cast("bigint").alias("n_left"))


def strip_noise(spark: SparkSession, d: str) -> DataFrame:
    """Statements without lineage, by dialect."""
    docs = T(spark, d, "catalog_procedures").select("procedure_id", "definition").filter("definition is not null").distinct()
    return docs.select("procedure_id", *[F.length(cleaning.strip_noise(F.col("definition"), x)).cast("bigint").alias(f"n_{x}") for x in rules.DIALECTS])


def split_batches(spark: SparkSession, d: str) -> DataFrame:
    """Batches between separator lines; here empty lines of documents."""
    parts = cleaning.split_batches(T(spark, d, "documents").select("doc_id", "text"), "text", r"\n\n")
    return parts.select("doc_id", F.col("ord").cast("int").alias("ord"), F.length("content").cast("bigint").alias("n_chars"))


def normalize_whitespace(spark: SparkSession, d: str) -> DataFrame:
    """B27."""
    return T(spark, d, "query_history").select("query_text_id", cleaning.normalize(F.col("query_sql_text")).alias("sql_text")).distinct()


def classify_documents(spark: SparkSession, d: str) -> DataFrame:
    """Kinds of objects, by dialect, over all definitions."""
    p = T(spark, d, "catalog_procedures").select("procedure_id", "definition").filter("definition is not null").distinct()
    return p.select("procedure_id", *[cleaning.object_kind(F.col("definition"), x).alias(f"kind_{x}") for x in rules.DIALECTS])


def valid_statements(spark: SparkSession, d: str) -> DataFrame:
    """Documents that may be statements, by first word."""
    docs = T(spark, d, "documents").select("text").filter(cleaning.is_valid_statement(F.col("text"), "tsql"))
    return docs.groupBy(F.upper(F.regexp_extract(F.trim("text"), r"^(\w+)", 1)).alias("first_word")).agg(F.count(F.lit(1)).alias("n_documents"))


def function_kinds(spark: SparkSession, d: str) -> DataFrame:
    """B21."""
    p = T(spark, d, "catalog_procedures").select("procedure_id", "definition").filter("definition is not null").distinct()
    return p.groupBy(cleaning.function_kind(F.col("definition")).alias("function_kind")).agg(F.count(F.lit(1)).alias("n_routines"))


def clean_stats(spark: SparkSession, d: str) -> DataFrame:
    """Counters."""
    return T(spark, d, "documents").groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n_documents"), F.coalesce(F.sum("n_chars"), F.lit(0)).cast("bigint").alias("n_chars"))


def temp_names(spark: SparkSession, d: str) -> DataFrame:
    """Temporary names among the sources of statements."""
    s = T(spark, d, "statement_lineage").select("statement_id", F.explode("source_tables").alias("t")).select("statement_id", clean_name(F.col("t")).alias("table_name")).dropna().distinct()
    return s.filter(cleaning.is_temp_name(object_of(F.col("table_name")), "tsql"))


def feature_counts(spark: SparkSession, d: str) -> DataFrame:
    """Documents per feature tag of two dialects."""
    docs = T(spark, d, "documents").select("text")
    tags = [docs.select(F.lit(x).alias("dialect"), F.explode(cleaning.feature_tags(F.col("text"), x)).alias("tag")) for x in ("postgres", "teradata")]
    return tags[0].unionByName(tags[1]).groupBy("dialect", "tag").agg(F.count(F.lit(1)).alias("n_documents"))


def regex_sources(spark: SparkSession, d: str) -> DataFrame:
    """Tables behind FROM and JOIN."""
    q = T(spark, d, "query_history").select("query_text_id", F.explode(F.array_distinct(F.regexp_extract_all("query_sql_text", F.lit(r"(?i)\b(?:from|join)[\s\xA0]+([^\s\xA0,;()]+)"), F.lit(1)))).alias("t"))
    return q.select("query_text_id", clean_name(F.col("t")).alias("table_name")).distinct()


def _history(spark: SparkSession, d: str) -> DataFrame:
    return T(spark, d, "query_history").select("query_text_id", "query_sql_text").distinct()


def parsed_sources(spark: SparkSession, d: str) -> DataFrame:
    """Source tables by the parser, over the whole query history."""
    q = _history(spark, d).select("query_text_id", F.explode(lineage.source_tables(F.col("query_sql_text"))).alias("t"))
    return q.select("query_text_id", clean_name(F.col("t")).alias("table_name")).distinct()


def statement_types(spark: SparkSession, d: str) -> DataFrame:
    """C1 to C3."""
    p = _history(spark, d).select(lineage.statement_kind(F.col("query_sql_text")).alias("p"))
    return p.groupBy("p.statement_type").agg(F.count(F.lit(1)).alias("n_statements"), F.sum(F.col("p.parse_error").isNotNull().cast("bigint")).alias("n_errors"))


def transform_kinds(spark: SparkSession, d: str) -> DataFrame:
    """Kinds of transformation of all selected columns."""
    c = _history(spark, d).select(lineage.parsed(F.col("query_sql_text")).alias("p")).select(F.explode("p.columns").alias("c"))
    return c.groupBy("c.transform").agg(F.count(F.lit(1)).alias("n_columns"), F.sum(F.col("c.is_aggregate").cast("bigint")).alias("n_aggregates"))


def _routine_statements(spark: SparkSession, d: str) -> DataFrame:
    """All definitions, each analyzed in its own dialect; file_path is the number of the routine. Unknown dialects count as T-SQL."""
    p = T(spark, d, "catalog_procedures").filter("definition is not null").select(F.col("procedure_id").cast("string").alias("file_path"), F.col("definition").alias("sql_text"), F.lower("dialect").alias("dialect")).distinct()
    known = F.coalesce(F.when(F.col("dialect").isin(*rules.DIALECTS), F.col("dialect")), F.lit("tsql"))
    p = p.select("file_path", "sql_text", known.alias("dialect"))
    parts = [lineage.analyze(p.filter(F.col("dialect") == x).select("file_path", "sql_text"), x) for x in rules.DIALECTS]
    return Scratch(spark, "routine_statements").save(reduce(DataFrame.unionByName, parts))


def routine_statement_types(spark: SparkSession, d: str) -> DataFrame:
    """Statements of all definitions and of their bodies, by dialect and kind."""
    s = _routine_statements(spark, d)
    kinds = F.concat(F.array("statement_type"), F.transform("body", lambda b: b["statement_type"]))
    return s.select("dialect", F.explode(kinds).alias("statement_type")).groupBy("dialect", "statement_type").agg(F.count(F.lit(1)).alias("n_statements"))


def routine_table_edges(spark: SparkSession, d: str) -> DataFrame:
    """Tables that each routine and its statements read, with the target."""
    e = lineage.table_edges(_routine_statements(spark, d))
    return e.select(F.col("file_path").alias("procedure_id"), "src_table", "dst_table", "is_self_edge").distinct()


def statement_kinds(spark: SparkSession, d: str) -> DataFrame:
    """Totals per kind and dialect."""
    s = T(spark, d, "statement_lineage").dropDuplicates(["statement_id"])
    return s.groupBy("dialect", "statement_type").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("is_dynamic").cast("bigint")).alias("n_dynamic"), F.count("parse_error").alias("n_errors"))


def _columns(spark: SparkSession, d: str) -> DataFrame:
    return T(spark, d, "column_lineage").dropDuplicates(["lineage_id"])


def _statements(spark: SparkSession, d: str) -> DataFrame:
    """statement_lineage as the operators have it: each statement once, names clean, without columns and CTEs."""
    none = lambda kind: F.from_json(F.lit("[]"), kind)
    sources = F.array_distinct(F.array_compact(F.transform(F.coalesce("source_tables", F.array()), clean_name)))
    s = T(spark, d, "statement_lineage").dropDuplicates(["statement_id"])
    return s.select(
        F.col("statement_id").alias("stmt_id"), "file_path", F.lower("dialect").alias("dialect"), "statement_type", clean_name(F.col("target_table")).alias("target_table"), sources.alias("source_tables"), "is_dynamic", "parse_error",
        none(lineage.COLUMNS).alias("columns"), none(lineage.CTES).alias("ctes"), none(lineage.BODY).alias("body"),
    )


def register_tables(spark: SparkSession, d: str) -> DataFrame:
    """Tables over all statements: scripts, kinds, numbers of tables they are made from and go into."""
    r = lineage.table_registry(_statements(spark, d))
    return r.select("table_name", F.size("scripts").alias("n_scripts"), F.array_join("definition_types", ",").alias("definition_types"), "depends_on_count", "referenced_by_count")


def merge_columns(spark: SparkSession, d: str) -> DataFrame:
    """Columns merged without regard to case, with their sources and confidence."""
    c = _columns(spark, d).filter("target_column is not null").select(F.col("target_table").alias("dst_table"), F.col("target_column").alias("dst_column"), "transform_type", "expression", "is_aggregate", "is_calculated", F.lit(False).alias("is_placeholder"), "file_path", "source_columns")
    e = c.select("dst_table", "dst_column", F.explode("source_columns").alias("s")).select("dst_table", "dst_column", F.col("s.table_name").alias("src_table"), F.col("s.column_name").alias("src_column"), "s.cte_reference")
    m = lineage.merged_columns(c, e)
    return m.select("table_key", "column_key", F.array_join("transforms", ",").alias("transforms"), "is_aggregate", "is_calculated", "n_scripts", "n_definitions", F.size("sources").alias("n_sources"), F.size("expressions").alias("n_expressions"), "confidence")


def confidence_scores(spark: SparkSession, d: str) -> DataFrame:
    """E6."""
    c = _columns(spark, d).filter("target_table is not null and target_column is not null")
    key = [F.lower("target_table").alias("table_key"), F.lower("target_column").alias("column_key")]
    base = c.groupBy(*key).agg(F.countDistinct("transform_type").alias("n_transforms"), F.max((F.col("transform_type") == "direct").cast("int")).alias("direct"), F.bool_or("is_aggregate").alias("agg"), F.countDistinct("file_path").alias("n_scripts"))
    src = c.select(*key, F.explode("source_columns").alias("s")).groupBy("table_key", "column_key").agg(F.countDistinct(F.lower(F.concat_ws(".", "s.table_name", "s.column_name"))).alias("n_sources"), F.max(F.col("s.cte_reference").isNotNull().cast("int")).alias("cte"))
    j = base.join(src, ["table_key", "column_key"], "left")
    zero = lambda x: F.coalesce(x, F.lit(0))
    score = lineage.confidence(F.col("n_transforms"), zero(F.col("direct")) == 1, F.col("agg"), zero(F.col("n_sources")), zero(F.col("cte")) == 1, F.col("n_scripts"))
    return j.select("table_key", "column_key", score.alias("confidence"))


def cte_expand(spark: SparkSession, d: str) -> DataFrame:
    """Columns that read a CTE, with the tables of its statement."""
    c = _columns(spark, d).select("lineage_id", "statement_id", F.explode("source_columns").alias("s")).filter("s.cte_reference is not null").select("lineage_id", "statement_id", F.lower("s.cte_reference").alias("cte"))
    s = T(spark, d, "statement_lineage").select("statement_id", F.explode("source_tables").alias("t")).select("statement_id", clean_name(F.col("t")).alias("table_name")).dropna().distinct()
    return c.join(s, "statement_id").filter(F.col("cte") != F.col("table_name")).select("lineage_id", "cte", "table_name").distinct()


def lineage_summary(spark: SparkSession, d: str) -> DataFrame:
    """E10, E11, E26."""
    return lineage.summary(_statements(spark, d))


def _script_facts(spark: SparkSession, d: str) -> DataFrame:
    """What each script reads and writes, in the form of a routine's facts."""
    s = T(spark, d, "statement_lineage")
    none = F.array().cast("array<string>")
    rows = s.select("file_path", F.explode_outer("source_tables").alias("t"), "target_table").select("file_path", clean_name(F.col("t")).alias("r"), clean_name(F.col("target_table")).alias("w"))
    return rows.groupBy(F.col("file_path").alias("name")).agg(F.collect_set("r").alias("reads"), F.collect_set("w").alias("writes")).withColumn("creates", none).withColumn("kind", F.lit("SCRIPT"))


def usage_report(spark: SparkSession, d: str) -> DataFrame:
    """Scripts that read and that write each table."""
    return reports.table_usage(_script_facts(spark, d)).select("table_name", "read_count", "write_count", "total_count", "n_routines")


def access_matrix(spark: SparkSession, d: str) -> DataFrame:
    """Scripts that read and that write each table."""
    return routines.access_matrix(_script_facts(spark, d)).select("table_name", F.size("read_by").alias("n_read_by"), F.size("written_by").alias("n_written_by"))


def usage_inversion(spark: SparkSession, d: str) -> DataFrame:
    """Statements per temporary table."""
    s = T(spark, d, "statement_lineage").select("statement_id", F.explode("temp_tables").alias("t"))
    return s.groupBy(F.lower("t").alias("temp_table")).agg(F.countDistinct("statement_id").alias("n_statements"), F.min("statement_id").alias("first_statement"))




def catalog_summary(spark: SparkSession, d: str) -> DataFrame:
    """E23."""
    c = T(spark, d, "catalog_columns")
    return c.groupBy("database_name").agg(F.countDistinct(clean_name(F.col("table_schema")), clean_name(F.col("table_name"))).alias("n_tables"), F.countDistinct("snapshot_no").alias("n_deliveries"), F.count(F.lit(1)).alias("n_lines"))




def history_top(spark: SparkSession, d: str) -> DataFrame:
    """A10: the thousand most executed queries of the last 30 days before a fixed date; the limit is the feature."""
    h = T(spark, d, "query_history").dropDuplicates(["query_text_id"])
    return corpus.history_top(h, "query_sql_text", "count_executions", "last_execution_time", "query_text_id", 365, now=F.lit("2025-01-01").cast("timestamp")).select("query_text_id", "count_executions")


def system_filter(spark: SparkSession, d: str) -> DataFrame:
    """A17."""
    t = T(spark, d, "catalog_tables").select(clean_name(F.col("table_schema")).alias("s"), clean_name(F.col("table_name")).alias("n")).distinct()
    return t.filter(cleaning.is_user_object(F.col("s"), F.col("n"))).groupBy("s").agg(F.count(F.lit(1)).alias("n_tables")).withColumnRenamed("s", "table_schema")


def dependencies(spark: SparkSession, d: str) -> DataFrame:
    """Distinct pairs of tables."""
    return _links(spark, d).withColumnRenamed("src", "source_table").withColumnRenamed("dst", "target_table")


def _links(spark: SparkSession, d: str) -> DataFrame:
    t = T(spark, d, "table_info").select(clean_name(F.col("table_name")).alias("dst"), F.explode("depends_on").alias("p")).select(clean_name(F.col("p")).alias("src"), "dst")
    return t.dropna().filter("src <> dst").distinct()


def exec_levels(spark: SparkSession, d: str) -> DataFrame:
    """levels over the keys of the sales tables, all acyclic."""
    n, r, c = T(spark, d, "nation"), T(spark, d, "region"), T(spark, d, "customer")
    region, nation, cust = (lambda x: F.concat(F.lit("r"), x)), (lambda x: F.concat(F.lit("n"), x)), (lambda x: F.concat(F.lit("c"), x))
    e = n.select(region(F.col("n_regionkey").cast("string")).alias("src"), nation(F.col("n_nationkey").cast("string")).alias("dst")).unionByName(c.select(nation(F.col("c_nationkey").cast("string")).alias("src"), cust(F.col("c_custkey").cast("string")).alias("dst")))
    return graphs.execution_levels(e).select("node", "level")


def circular_tables(spark: SparkSession, d: str) -> DataFrame:
    """tables on a circle or behind one, which no order can place."""
    return graphs.execution_levels(_links(spark, d)).filter("is_circular").select("node")


def table_levels(spark: SparkSession, d: str) -> DataFrame:
    """levels of tables by their links."""
    return graphs.execution_levels(_links(spark, d)).filter("not is_circular").select("node", "level")


def bfs_levels(spark: SparkSession, d: str) -> DataFrame:
    """tables within five links of the first root."""
    e = _links(spark, d)
    start = e.select(F.col("src").alias("n")).join(e.select(F.col("dst").alias("n")), "n", "left_anti").agg(F.min("n")).first()[0] or ""
    return graphs.bfs_levels(e, start).select("node", "depth")


def adjacency(spark: SparkSession, d: str) -> DataFrame:
    """F5, F6."""
    return graphs.adjacency(_links(spark, d))


def orphan_tables(spark: SparkSession, d: str) -> DataFrame:
    """F8: customers no order leads to."""
    c = T(spark, d, "customer").select(F.col("c_custkey").alias("node"))
    return graphs.orphans(c, T(spark, d, "orders").select(F.col("o_custkey").alias("dst")))


def graph_export(spark: SparkSession, d: str) -> DataFrame:
    """typed edges of statements."""
    s = T(spark, d, "statement_lineage")
    r = s.select(clean_name(F.col("target_table")).alias("src"), F.explode("source_tables").alias("t")).select("src", clean_name(F.col("t")).alias("dst"), F.lit("DEPENDS_ON").alias("edge_type"))
    w = s.select("file_path", clean_name(F.col("target_table")).alias("dst")).select(F.col("file_path").alias("src"), "dst", F.lit("WRITES").alias("edge_type"))
    return r.unionByName(w).dropna().distinct()




def connected_nodes(spark: SparkSession, d: str) -> DataFrame:
    """F13."""
    e = T(spark, d, "nation").select(F.col("n_regionkey").alias("src"), F.col("n_nationkey").alias("dst"))
    return graphs.connected_nodes(T(spark, d, "nation").select(F.col("n_nationkey").alias("node")), e)


def focus_one_hop(spark: SparkSession, d: str) -> DataFrame:
    """links of the table with the alphabetically first name."""
    e = _links(spark, d)
    node = e.agg(F.min(F.least("src", "dst"))).first()[0] or ""
    return graphs.focus(e, node)


def component_sizes(spark: SparkSession, d: str) -> DataFrame:
    """F16: connected components of tables."""
    return graphs.components(_links(spark, d)).groupBy("component").agg(F.count(F.lit(1)).alias("n_tables"))


def fuzzy_search(spark: SparkSession, d: str) -> DataFrame:
    """F17."""
    t = T(spark, d, "table_disambiguation")
    return t.filter(cleaning.fuzzy("cstsum", F.col("qualified_name")) | cleaning.fuzzy("invhist", F.col("qualified_name"))).select("qualified_name")


def top_dependencies(spark: SparkSession, d: str) -> DataFrame:
    """The ten tables with the most sources and the number of tables that use them; the limit is the feature."""
    a = graphs.adjacency(_links(spark, d))
    return a.select(F.col("node").alias("table_name"), F.col("n_in").alias("depends_on_count"), F.col("n_out").alias("referenced_by_count")).orderBy(F.desc("depends_on_count"), "table_name").limit(10)


def routine_summary(spark: SparkSession, d: str) -> DataFrame:
    """Statements, tables, references to columns and complexity of each routine."""
    p = T(spark, d, "catalog_procedures").filter("definition is not null").select(F.col("procedure_id").cast("string").alias("name"), "definition").distinct()
    return routines.routine_facts(p).select("name", F.size("reads").alias("n_reads"), F.size("writes").alias("n_writes"), F.size("calls").alias("n_calls"), F.array_join("writes", ",").alias("writes"), F.size("column_refs").alias("n_column_refs"), "n_outputs", "complexity")


def routine_writes(spark: SparkSession, d: str) -> DataFrame:
    """Tables that each routine writes."""
    p = T(spark, d, "catalog_procedures").filter("definition is not null").select(F.col("procedure_id").cast("string").alias("name"), "definition").distinct()
    return routines.routine_facts(p).select("name", F.explode("writes").alias("table_name"))


def routine_calls(spark: SparkSession, d: str) -> DataFrame:
    """Routines that each routine calls."""
    p = T(spark, d, "catalog_procedures").filter("definition is not null").select(F.col("procedure_id").cast("string").alias("name"), "definition").distinct()
    return routines.routine_facts(p).select("name", F.explode("calls").alias("called"))


def routine_parameters(spark: SparkSession, d: str) -> DataFrame:
    """J4."""
    p = T(spark, d, "catalog_procedures").filter("definition is not null").select("procedure_id", "definition").distinct()
    return p.select("procedure_id", F.explode(routines.signatures(F.col("definition"))).alias("p")).select("procedure_id", "p.ordinal", F.col("p.name").alias("name"), "p.data_type")


def schema_object_split(spark: SparkSession, d: str) -> DataFrame:
    """J2, J22."""
    t = T(spark, d, "table_disambiguation").select(F.col("full_name").alias("n"))
    return t.select(F.col("n").alias("full_name"), schema_of(F.col("n")).alias("schema_name"), object_of(F.col("n")).alias("object_name"))


def medallion_silver(spark: SparkSession, d: str) -> DataFrame:
    """Fixture views: orders with their customers."""
    o, c = T(spark, d, "orders"), T(spark, d, "customer")
    return o.join(c, o["o_custkey"] == c["c_custkey"], "left").select("o_orderkey", "o_custkey", F.round("o_totalprice", 2).alias("o_totalprice"), F.upper("c_mktsegment").alias("segment"), F.coalesce("c_name", F.lit("N/A")).alias("c_name"))


def medallion_gold(spark: SparkSession, d: str) -> DataFrame:
    """Fixture views: customer metrics."""
    o, l = T(spark, d, "orders"), T(spark, d, "lineitem")  # noqa: E741
    j = o.join(l, o["o_orderkey"] == l["l_orderkey"])
    return j.groupBy("o_custkey").agg(F.countDistinct("o_orderkey").alias("total_orders"), F.sum("l_quantity").cast("bigint").alias("total_quantity"), F.sum(F.col("l_extendedprice").cast("decimal(18,4)")).cast("double").alias("total_revenue"), F.min(F.to_date("o_orderdate")).alias("first_order"), F.max(F.to_date("o_orderdate")).alias("last_order"))


def medallion_kpi_cte(spark: SparkSession, d: str) -> DataFrame:
    """Fixture views: two CTEs joined."""
    for n in ("orders", "customer", "lineitem"):
        T(spark, d, n).createOrReplaceTempView(f"hw_{n}")
    return spark.sql("""
WITH sales AS (SELECT c_nationkey AS k, COUNT(DISTINCT o_orderkey) AS n_orders, SUM(CAST(o_totalprice AS DECIMAL(18, 2))) AS total FROM hw_orders JOIN hw_customer ON o_custkey = c_custkey GROUP BY c_nationkey),
returned AS (SELECT c_nationkey AS k, COUNT(*) AS n_returns FROM hw_lineitem JOIN hw_orders ON l_orderkey = o_orderkey JOIN hw_customer ON o_custkey = c_custkey WHERE l_returnflag = 'R' GROUP BY c_nationkey)
SELECT s.k AS nation_key, s.n_orders, CAST(s.total AS DOUBLE) AS total_sales, COALESCE(r.n_returns, 0) AS n_returns, ROUND(COALESCE(r.n_returns, 0) / CAST(s.n_orders AS DOUBLE), 4) AS return_ratio FROM sales s LEFT JOIN returned r ON s.k = r.k""")


def set_ops(spark: SparkSession, d: str) -> DataFrame:
    """G11."""
    s, c = T(spark, d, "supplier").select(F.col("s_nationkey").alias("k")), T(spark, d, "customer").select(F.col("c_nationkey").alias("k"))
    tag = lambda df, t: df.select("k", F.lit(t).alias("op"))
    return tag(s.union(c).distinct(), "union").unionByName(tag(s.intersect(c), "intersect")).unionByName(tag(c.subtract(s), "except"))


def window_rank(spark: SparkSession, d: str) -> DataFrame:
    """The latest order of each customer."""
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey"))
    return T(spark, d, "orders").select("o_custkey", "o_orderkey", F.row_number().over(w).alias("rn")).filter("rn = 1").drop("rn")


def pivot_status(spark: SparkSession, d: str) -> DataFrame:
    """G12."""
    return T(spark, d, "orders").groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O", "P"]).agg(F.count(F.lit(1))).select("o_orderpriority", *[F.coalesce(F.col(x), F.lit(0)).alias(f"n_{x.lower()}") for x in "FOP"])


def lateral_top1(spark: SparkSession, d: str) -> DataFrame:
    """D-13: the dearest line of each order, as a lateral lookup would find it."""
    top = T(spark, d, "lineitem").groupBy("l_orderkey").agg(F.max(F.struct("l_extendedprice", F.negate("l_linenumber").alias("m"))).alias("b"))
    o = T(spark, d, "orders").select("o_orderkey")
    return o.join(top, F.col("o_orderkey") == F.col("l_orderkey"), "left").select("o_orderkey", F.negate(F.col("b.m")).alias("l_linenumber"), F.round("b.l_extendedprice", 2).alias("price"))


def function_families(spark: SparkSession, d: str) -> DataFrame:
    """C29, 2.H: calls of functions in the query history, by family."""
    pairs = spark.createDataFrame([(k.lower(), v) for k, v in rules.FAMILY_OF.items()], "fn string, family string")
    q = T(spark, d, "query_history").select(F.explode(F.regexp_extract_all(F.lower("query_sql_text"), F.lit(r"([a-z_]\w*)\("), F.lit(1))).alias("fn"))
    return q.join(pairs, "fn").groupBy("fn", "family").agg(F.count(F.lit(1)).alias("n_calls"))


QUERIES = {
    f.__name__: f
    for f in (
        strip_comments, strip_noise, split_batches, normalize_whitespace, classify_documents, valid_statements, function_kinds, clean_stats, temp_names, feature_counts, regex_sources, parsed_sources, statement_types, transform_kinds, routine_statement_types, routine_table_edges,
        statement_kinds, register_tables, merge_columns, confidence_scores, cte_expand, lineage_summary, usage_report, access_matrix, usage_inversion, catalog_summary,
        history_top, system_filter, dependencies, exec_levels, table_levels, circular_tables, bfs_levels, adjacency, orphan_tables, graph_export, connected_nodes, focus_one_hop, component_sizes, fuzzy_search,
        top_dependencies, routine_summary, routine_writes, routine_calls, routine_parameters, schema_object_split, medallion_silver, medallion_gold, medallion_kpi_cte, set_ops, window_rank, pivot_status, lateral_top1, function_families,
    )
}
