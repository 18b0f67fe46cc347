"""Queries that run the operators over the corpus of scripts, and those for catalogs over the test tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from headwater.functions import execute, rules
from headwater.functions.names import clean_name, qualified
from headwater.operators import catalog, cleaning, lineage, reports, routines
from headwater.plans.corpus import SCRIPTS
from headwater.scratch import Scratch
from headwater.sources.tables import table

T = table


def _scripts(spark: SparkSession) -> dict[str, DataFrame]:
    return {d: spark.createDataFrame([(f"{d}/{f}", t) for (x, f), t in SCRIPTS.items() if x == d], "file_path string, sql_text string") for d in rules.DIALECTS}


def _statements(spark: SparkSession) -> DataFrame:
    parts = [lineage.analyze(s, d) for d, s in _scripts(spark).items()]
    return Scratch(spark, "corpus").save(reduce(DataFrame.unionByName, parts))


def _facts(spark: SparkSession) -> DataFrame:
    made = _statements(spark).filter("object_kind in ('PROCEDURE', 'FUNCTION', 'TRIGGER', 'MACRO')").select(F.lower("object_name").alias("name"), F.col("statement").alias("definition"))
    return Scratch(spark, "corpus-facts").save(routines.routine_facts(made))


def _list(c: str) -> Column:
    return F.array_join(c, ",").alias(c)


def corpus_statements(spark: SparkSession, d: str) -> DataFrame:
    """Statements of all scripts with kind, subtype, target and sources."""
    s = _statements(spark)
    return s.select("file_path", "ord", "stmt_ord", "object_kind", "statement_type", F.coalesce("statement_subtype", F.lit("-")).alias("subtype"), F.coalesce("target_table", F.lit("-")).alias("target"), F.array_join("source_tables", ",").alias("sources"), F.size("body").alias("n_body"), "is_dynamic")


def corpus_column_edges(spark: SparkSession, d: str) -> DataFrame:
    """C9 to C16, C23 to C25, C27, D-5, D-7, D-12, J14: sources of all target columns, down to stored tables."""
    s = _statements(spark)
    kinds = lineage.column_defs(s).select("stmt_id", "dst_table", "dst_column", "transform_type").distinct()
    e = lineage.column_edges(s, resolved=True).join(kinds, ["stmt_id", "dst_table", "dst_column"])
    return e.filter("dst_table is not null").select("file_path", "dst_table", "dst_column", "transform_type", "src_table", "src_column").distinct()


def corpus_table_edges(spark: SparkSession, d: str) -> DataFrame:
    """Tables that each target is made from."""
    return lineage.table_edges(_statements(spark)).select("file_path", "src_table", "dst_table", "is_self_edge").distinct()


def corpus_ctes(spark: SparkSession, d: str) -> DataFrame:
    """Common table expressions with their columns and tables."""
    return lineage.cte_table(_statements(spark)).select("file_path", "name", F.array_join("columns", ",").alias("columns"), F.array_join("source_tables", ",").alias("sources"))


def corpus_registry(spark: SparkSession, d: str) -> DataFrame:
    """Tables of all scripts."""
    r = lineage.table_registry(_statements(spark))
    return r.select("table_name", F.size("scripts").alias("n_scripts"), _list("definition_types"), "depends_on_count", "referenced_by_count", "is_temp")


def corpus_summary(spark: SparkSession, d: str) -> DataFrame:
    """Totals of statements and routines."""
    return reports.combined_summary(_statements(spark), _facts(spark))


def corpus_features(spark: SparkSession, d: str) -> DataFrame:
    """Statements per feature."""
    return reports.feature_report(_statements(spark))


def corpus_temp_tables(spark: SparkSession, d: str) -> DataFrame:
    """Temporary tables of each script and the statements that read them."""
    return lineage.temp_registry(_statements(spark)).select("file_path", "table_name", "n_uses")


def corpus_batches(spark: SparkSession, d: str) -> DataFrame:
    """Batches between GO lines."""
    return cleaning.split_batches(_scripts(spark)["tsql"]).select("file_path", "ord", F.regexp_extract("content", r"^\s*(\w+)", 1).alias("first_word"))


def corpus_routines(spark: SparkSession, d: str) -> DataFrame:
    """Facts of the routines of all scripts."""
    f = _facts(spark)
    return f.select("name", "kind", "n_parameters", "n_outputs", F.coalesce("return_type", F.lit("-")).alias("return_type"), F.array_join(F.transform("output_columns", lambda c: c["name"]), ",").alias("output_columns"), _list("reads"), _list("writes"), _list("creates"), _list("temps"), _list("calls"))


def corpus_routine_columns(spark: SparkSession, d: str) -> DataFrame:
    """Columns by routine and operation."""
    return reports.columns_by_operation(_facts(spark))


def corpus_routine_edges(spark: SparkSession, d: str) -> DataFrame:
    """typed edges of routines, tables and columns."""
    return reports.typed_edges(_facts(spark)).filter("edge_type <> 'column_of'")


def corpus_call_chains(spark: SparkSession, d: str) -> DataFrame:
    """circles of calls."""
    return reports.call_chains(_facts(spark))


def corpus_call_order(spark: SparkSession, d: str) -> DataFrame:
    """order of routines, callers first."""
    return reports.call_order(_facts(spark)).select("name", F.coalesce("level", F.lit(-1)).alias("level"), "is_circular")


def corpus_orphans(spark: SparkSession, d: str) -> DataFrame:
    """F8: procedures that nothing calls."""
    return reports.orphan_procedures(_facts(spark))


def corpus_complexity(spark: SparkSession, d: str) -> DataFrame:
    """The most complex routines; the limit is the feature."""
    return reports.top_complex(_facts(spark), 5).select("name", "weighted_complexity")


# ---- over the test tables
def _catalog_tables(spark: SparkSession, d: str) -> DataFrame:
    return T(spark, d, "table_disambiguation").select("database_name", "schema_name", "table_name")


def name_resolution(spark: SparkSession, d: str) -> DataFrame:
    """C43, C44, D-8, D-11, E21, J17: references resolved by any form of a name that one table alone has."""
    refs = T(spark, d, "statement_lineage").select(F.explode("source_tables").alias("t")).select(clean_name(F.col("t")).alias("ref")).dropna().distinct()
    return catalog.resolve_names(refs, "ref", _catalog_tables(spark, d)).select("ref", F.col("qualified_name").alias("resolved"), "resolved_by")


def name_disambiguation(spark: SparkSession, d: str) -> DataFrame:
    """Table names in one schema and in several."""
    return catalog.disambiguation(_catalog_tables(spark, d)).select("table_name", "n_schemas", "is_unique", _list("qualified_names"))


def _last_columns(spark: SparkSession, d: str) -> DataFrame:
    """Columns of the last delivery of each database; of repeated lines the latest."""
    c = T(spark, d, "catalog_columns").dropna(subset=["table_schema", "table_name", "column_name", "database_name", "snapshot_no"])
    last = c.groupBy("database_name").agg(F.max("snapshot_no").alias("snapshot_no"))
    c = c.join(last, ["database_name", "snapshot_no"]).select("database_name", clean_name(F.col("table_schema")).alias("schema_name"), clean_name(F.col("table_name")).alias("table_name"), clean_name(F.col("column_name")).alias("column_name"), F.struct("loaded_at", "data_type", "is_nullable", "ordinal_position").alias("l"))
    return c.groupBy("database_name", "schema_name", "table_name", "column_name").agg(F.max("l").alias("l")).select("database_name", "schema_name", "table_name", "column_name", "l.data_type", "l.is_nullable", "l.ordinal_position")


def column_map(spark: SparkSession, d: str) -> DataFrame:
    """Tables and types per column name, in the last deliveries."""
    return catalog.column_map(_last_columns(spark, d)).select("column_name", "n_tables", "n_types", "is_unique")


def edge_enrichment(spark: SparkSession, d: str) -> DataFrame:
    """Sources of column_lineage that foreign keys refer to, by what deleting the key does (its type here), counted."""
    e = T(spark, d, "column_lineage").dropDuplicates(["lineage_id"]).select("lineage_id", F.col("target_table").alias("dst_table"), F.col("target_column").alias("dst_column"), F.explode("source_columns").alias("s"))
    e = e.filter("s.cte_reference is null and s.table_name is not null").select("lineage_id", "dst_table", "dst_column", F.col("s.table_name").alias("src_table"), F.col("s.column_name").alias("src_column"))
    keys = T(spark, d, "foreign_keys").filter("referenced_table is not null").select(F.col("referenced_schema").alias("schema_name"), F.col("referenced_table").alias("table_name"), F.col("referenced_column").alias("column_name"), F.col("delete_action").alias("data_type"), F.lit(False).alias("is_nullable"))
    rich = catalog.enrich_edges(e, keys)
    return rich.groupBy("src_table_exists", "src_exists", F.coalesce("src_type", F.lit("-")).alias("src_type"), "dst_table_exists").agg(F.count(F.lit(1)).alias("n_edges"))


def key_assembly(spark: SparkSession, d: str) -> DataFrame:
    """D-10: tables with their columns and foreign keys."""
    k = T(spark, d, "foreign_keys").dropDuplicates(["fk_id"]).withColumn("referenced", qualified(F.col("referenced_schema"), F.col("referenced_table")))
    t = T(spark, d, "catalog_tables").select(F.lit("").alias("database_name"), F.col("table_schema").alias("schema_name"), "table_name")
    c = _last_columns(spark, d).dropDuplicates(["schema_name", "table_name", "column_name"])
    a = catalog.assemble(t, c, None, k)
    return a.select("qualified_name", F.size("columns").alias("n_columns"), F.size("foreign_keys").alias("n_keys"), F.array_join(F.array_sort(F.array_distinct(F.transform("foreign_keys", lambda f: f["column_name"]))), ",").alias("key_columns"))


def text_references(spark: SparkSession, d: str) -> DataFrame:
    """Tables of the catalog that each routine's text names in any form."""
    p = T(spark, d, "catalog_procedures").filter("definition is not null").select("procedure_id", "definition").distinct()
    t = T(spark, d, "catalog_tables").select(F.lit("db").alias("database_name"), F.col("table_schema").alias("schema_name"), "table_name")
    return catalog.references_in_text(p, "definition", t)


def virtual_source_nodes(spark: SparkSession, d: str) -> DataFrame:
    """nodes once each, those of the catalog before those only named."""
    n = _last_columns(spark, d).groupBy(F.concat_ws(".", "schema_name", "table_name").alias("table_name")).agg(F.countDistinct("column_name").alias("n_columns"))
    s = T(spark, d, "statement_lineage").select(F.explode("source_tables").alias("t"), clean_name(F.col("target_table")).alias("dst_table")).select(clean_name(F.col("t")).alias("src_table"), "dst_table")
    return catalog.virtual_sources(n, s).select("node", "in_catalog", "n_columns")


def _edges(spark: SparkSession, d: str) -> DataFrame:
    e = T(spark, d, "table_info").select(clean_name(F.col("table_name")).alias("dst"), F.explode("depends_on").alias("p")).select(clean_name(F.col("p")).alias("src"), "dst")
    return e.dropna().filter("src <> dst").distinct()


def expand_right(spark: SparkSession, d: str) -> DataFrame:
    """tables one link to the right of all tables without sources."""
    e = _edges(spark, d)
    return reports.expand(e, e.select(F.col("src").alias("node")).join(e.select(F.col("dst").alias("node")), "node", "left_anti").distinct())


def expand_left(spark: SparkSession, d: str) -> DataFrame:
    """tables one link to the left of all tables that nothing is made from."""
    e = _edges(spark, d)
    return reports.expand(e, e.select(F.col("dst").alias("node")).join(e.select(F.col("src").alias("node")), "node", "left_anti").distinct(), False)


def graph_layers(spark: SparkSession, d: str) -> DataFrame:
    """layer and place of regions, nations and customers in a drawing from left to right."""
    n, c = T(spark, d, "nation"), T(spark, d, "customer")
    name = lambda x, k: F.concat(F.lit(x), F.lpad(F.col(k).cast("string"), 9, "0"))
    e = n.select(name("r", "n_regionkey").alias("src"), name("n", "n_nationkey").alias("dst")).unionByName(c.select(name("n", "c_nationkey").alias("src"), name("c", "c_custkey").alias("dst")))
    return reports.layers(e)


def column_index(spark: SparkSession, d: str) -> DataFrame:
    """place of each column of the first deliveries in the table as last delivered, found in three steps."""
    c = T(spark, d, "catalog_columns").dropna(subset=["table_schema", "table_name", "column_name"])
    table_name = F.concat_ws(".", "database_name", clean_name(F.col("table_schema")), clean_name(F.col("table_name")))
    have = _last_columns(spark, d).select(F.concat_ws(".", "database_name", "schema_name", "table_name").alias("table_name"), "column_name", F.col("ordinal_position").alias("ordinal"))
    return reports.find_columns(c.filter("snapshot_no = 1").select(table_name.alias("table_name"), F.trim("column_name").alias("column_name")), have)


def hovered_column(spark: SparkSession, d: str) -> DataFrame:
    """column edges that touch the column most edges lead to, and the tables involved."""
    e = T(spark, d, "column_lineage").dropDuplicates(["lineage_id"]).filter("target_table is not null and target_column is not null").select(F.lower("target_table").alias("dst_table"), F.lower("target_column").alias("dst_column"), F.explode("source_columns").alias("s"))
    e = e.select(F.lower("s.table_name").alias("src_table"), F.lower("s.column_name").alias("src_column"), "dst_table", "dst_column").dropna().distinct()
    top = e.groupBy("dst_table", "dst_column").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "dst_table", "dst_column").first()
    return reports.touching(e, top.dst_table if top else "", top.dst_column if top else "")


def routine_subgraph(spark: SparkSession, d: str) -> DataFrame:
    """edges of one routine of the corpus, without those of columns."""
    return reports.routine_subgraph(reports.typed_edges(_facts(spark)), "dbo.step_two")


def function_calls(spark: SparkSession, d: str) -> DataFrame:
    """2.H: functions of the dialects run on parts and orders."""
    c, call = F.col, execute.call
    p = T(spark, d, "part").select(
        "p_partkey", call("IFF", c("p_size") > 25, F.lit("big"), F.lit("small")).alias("size_class"), call("DECODE", c("p_brand"), F.lit("Brand#11"), F.lit("a"), F.lit("Brand#12"), F.lit("b"), F.lit("other")).alias("brand_code"), call("SPLIT_PART", c("p_type"), F.lit(" "), F.lit(1)).alias("first_word"),
        call("ZEROIFNULL", call("NULLIFZERO", call("BITAND", c("p_size"), F.lit(12)))).alias("bits"), call("LEN", c("p_name")).cast("bigint").alias("name_length"), call("GREATEST", c("p_size"), F.lit(10)).alias("at_least_ten"), call("EDITDISTANCE", c("p_brand"), F.lit("Brand#11")).cast("bigint").alias("distance"), call("MD5_HEX", c("p_name")).alias("name_md5"),
        call("INITCAP", call("LOWER", c("p_brand"))).alias("brand"), call("LPAD", c("p_partkey").cast("string"), F.lit(8), F.lit("0")).alias("padded"), call("NVL2", c("p_type"), F.lit("y"), F.lit("n")).alias("has_type"), call("TRY_TO_DOUBLE", c("p_brand")).alias("no_number"),
    )
    return p


def date_functions(spark: SparkSession, d: str) -> DataFrame:
    """2.H: date functions run on orders."""
    c, call, at = F.col, execute.call, F.lit("2000-02-29").cast("timestamp")
    return T(spark, d, "orders").select(
        "o_orderkey", call("DATEDIFF", "month", c("o_orderdate"), at).cast("bigint").alias("months"), call("DATEDIFF", "day", c("o_orderdate"), at).cast("bigint").alias("days"), call("DATEDIFF", "year", c("o_orderdate"), at).cast("bigint").alias("years"),
        call("DATEADD", "month", F.lit(1), c("o_orderdate")).cast("date").alias("next_month"), call("LAST_DAY", c("o_orderdate")).alias("month_end"), call("DATE_TRUNC", "quarter", c("o_orderdate")).cast("date").alias("quarter_start"),
    )


QUERIES = {
    f.__name__: f
    for f in (
        corpus_statements, corpus_column_edges, corpus_table_edges, corpus_ctes, corpus_registry, corpus_summary, corpus_features, corpus_temp_tables, corpus_batches, corpus_routines, corpus_routine_columns, corpus_routine_edges, corpus_call_chains, corpus_call_order, corpus_orphans, corpus_complexity,
        name_resolution, name_disambiguation, column_map, edge_enrichment, key_assembly, text_references, virtual_source_nodes, expand_right, expand_left, graph_layers, column_index, hovered_column, routine_subgraph, function_calls, date_functions,
    )
}
