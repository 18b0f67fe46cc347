"""Reports on routines and statements: catalogs, usage, access, call graphs, typed edges, summaries.

``facts`` are the rows of ``routines.routine_facts``, ``statements`` those of ``lineage.analyze``. All reports are plain grouping and
joining of exploded facts; lists within a row are those of one routine or one table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from headwater.functions import rules
from headwater.functions.names import object_of, schema_of
from headwater.operators import graphs, lineage, local
from headwater.scratch import Scratch

#: Fixed value: from this complexity on a routine counts as complex.
COMPLEX = 15


def _items(facts: DataFrame, *lists: str) -> DataFrame:
    """name, kind, list, item."""

    def labelled(c: str) -> Column:
        return F.transform(c, lambda x: F.struct(F.lit(c).alias("list"), x.alias("item")))

    each = F.explode(F.flatten(F.array(*map(labelled, lists))))
    return facts.select(F.lower("name").alias("name"), "kind", each.alias("x")).select("name", "kind", "x.*")


def executable_catalog(facts: DataFrame, dialect: str = "tsql") -> DataFrame:
    """One row per routine: schema, object, kind, return type and the sizes of its facts, by kind and name."""
    default = rules.DEFAULT_SCHEMA[rules.dialect_of(dialect)]
    size = lambda c: F.size(c).alias("n_" + c)
    out = facts.select(
        "name", schema_of(F.col("name"), default).alias("schema_name"), object_of(F.col("name")).alias("object_name"), "kind", "return_type", "is_table_valued", "n_parameters", "n_outputs",
        *[size(c) for c in ("reads", "writes", "creates", "temps", "calls", "column_refs", "columns_read", "columns_written", "columns_updated")], "n_statements", "complexity", (F.col("complexity") > COMPLEX).alias("is_complex"), "error",
    )
    return out.orderBy("kind", "name")


def executable_summary(facts: DataFrame) -> DataFrame:
    """Routines per kind: number, complex ones, failed ones and the share that could be read."""
    failed = F.count("error")
    rate = F.format_string("%.2f%%", 100.0 * (F.count(F.lit(1)) - failed) / F.count(F.lit(1)))
    return facts.groupBy("kind").agg(F.count(F.lit(1)).alias("n_routines"), F.sum((F.col("complexity") > COMPLEX).cast("bigint")).alias("n_complex"), failed.alias("n_failed"), rate.alias("success_rate"))


def weighted_complexity(facts: DataFrame) -> DataFrame:
    """Complexity by what statements hold: tables + 2 joins + calculations + 10 aggregates + 10 windows + 5 subqueries + 5 CTEs. Fixed
    values: the weights."""
    tables = F.size(F.array_union("reads", "writes"))
    score = tables + 2 * F.col("n_joins") + F.col("n_calculations") + 10 * F.col("n_aggregates") + 10 * F.col("n_windows") + 5 * F.col("n_subqueries") + 5 * F.col("n_ctes")
    return facts.select("name", "kind", score.cast("bigint").alias("weighted_complexity"))


def top_complex(facts: DataFrame, n: int = 10) -> DataFrame:
    """The n most complex routines; the limit is the feature."""
    return weighted_complexity(facts).orderBy(F.desc("weighted_complexity"), "name").limit(n)


def columns_by_operation(facts: DataFrame) -> DataFrame:
    """Columns that each routine reads, writes or updates: name, operation, column_ref."""
    names = F.create_map(*[F.lit(x) for x in ("columns_read", "READ", "columns_written", "WRITE", "columns_updated", "UPDATE")])
    return _items(facts, "columns_read", "columns_written", "columns_updated").select("name", F.try_element_at(names, F.col("list")).alias("operation"), F.col("item").alias("column_ref")).distinct()


def column_access(facts: DataFrame) -> DataFrame:
    """Per column, the numbers of routines that read and that write it; an update counts as both."""
    a = columns_by_operation(facts)
    n = lambda op: F.countDistinct(F.when(F.col("operation") == op, F.col("name")))
    return a.groupBy("column_ref").agg(n("READ").alias("n_read_by"), n("WRITE").alias("n_written_by"))


def table_usage(facts: DataFrame) -> DataFrame:
    """Reads and writes of each table by routines, the most used first: how many procedures, functions and others use it."""
    used = _items(facts, "reads", "writes", "creates").withColumn("write", (F.col("list") != "reads").cast("bigint")).select("name", "kind", F.col("item").alias("table_name"), "write").distinct()
    by = lambda k: F.countDistinct(F.when(F.col("kind") == k, F.col("name")))
    out = used.groupBy("table_name").agg(F.sum(1 - F.col("write")).alias("read_count"), F.sum("write").alias("write_count"), by("PROCEDURE").alias("n_procedures"), by("FUNCTION").alias("n_functions"), F.countDistinct("name").alias("n_routines"))
    return out.withColumn("total_count", F.col("read_count") + F.col("write_count")).orderBy(F.desc("total_count"), "table_name")


def temp_usage(facts: DataFrame) -> DataFrame:
    """Per temporary table, the number of routines that use it and the first of them."""
    return _items(facts, "temps").groupBy(F.col("item").alias("temp_table")).agg(F.countDistinct("name").alias("n_routines"), F.min("name").alias("first_routine"))


# ---- calls
def calls(facts: DataFrame) -> DataFrame:
    """src calls dst, both routines that there are facts of; a callee named without schema is the only routine of that name."""
    own = facts.select(F.lower("name").alias("dst")).distinct()
    short = own.groupBy(object_of(F.col("dst")).alias("called")).agg(F.min("dst").alias("only"), F.count(F.lit(1)).alias("n")).filter("n = 1").select("called", "only")
    wanted = _items(facts, "calls").select(F.col("name").alias("src"), F.col("item").alias("called"))
    full = wanted.join(own, wanted["called"] == own["dst"], "left").join(short, "called", "left")
    return full.select("src", F.coalesce("dst", "only").alias("dst")).filter("dst is not null").distinct()


def call_graph(facts: DataFrame) -> DataFrame:
    """Per routine, the numbers of routines it calls and is called by."""
    e = calls(facts)
    out, into = e.groupBy(F.col("src").alias("name")).agg(F.count(F.lit(1)).alias("n_calls")), e.groupBy(F.col("dst").alias("name")).agg(F.count(F.lit(1)).alias("n_called_by"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return facts.select(F.lower("name").alias("name"), "kind").distinct().join(out, "name", "left").join(into, "name", "left").select("name", "kind", zero("n_calls"), zero("n_called_by"))


def orphan_procedures(facts: DataFrame) -> DataFrame:
    """Procedures that no other routine calls."""
    return graphs.orphans(facts.filter("kind = 'PROCEDURE'").select(F.lower("name").alias("name")).distinct(), calls(facts).filter("src <> dst"), "name")


def call_order(facts: DataFrame) -> DataFrame:
    """Levels of routines by their calls, callers first; those on a circle or behind one have none."""
    names = facts.select(F.lower("name").alias("node")).distinct()
    found = graphs.execution_levels(calls(facts))
    zero = F.when(F.col("is_circular").isNull(), F.lit(0)).otherwise(F.col("level"))
    return names.join(found, "node", "left").select(F.col("node").alias("name"), zero.alias("level"), F.coalesce("is_circular", F.lit(False)).alias("is_circular"))


def call_chains(facts: DataFrame) -> DataFrame:
    """Circles of calls, one of each group of routines that call each other: first, chain, n_links. Also a routine that calls itself.
    In a call graph of more than LOCAL_EDGES calls the chain isn't given (null), only the groups."""
    e = Scratch(facts.sparkSession, "calls").save(calls(facts))
    if e.count() <= local.LOCAL_EDGES:
        return local.in_one_task(e, local.chains, "first string, chain string, n_links int")
    from headwater.operators.hierarchy import Hierarchy

    groups = Hierarchy(e, "dst", "src").cycles().filter("node = first").select("first", F.lit(None).cast("string").alias("chain"), F.col("size").alias("n_links"))
    return groups.unionByName(e.filter("src = dst").select(F.col("src").alias("first"), F.lit(None).cast("string").alias("chain"), F.lit(1).alias("n_links"))).dropDuplicates(["first"])


# ---- graphs for a viewer
def typed_edges(facts: DataFrame) -> DataFrame:
    """Edges of routines, tables and columns: src, dst, edge_type (procedure_call, function_call, table_read, table_write,
    table_create, column_read, column_write, column_update, column_of)."""
    kinds = facts.select(F.lower("name").alias("dst"), F.col("kind").alias("dst_kind")).dropDuplicates(["dst"])
    called = calls(facts).join(kinds, "dst").select("src", "dst", F.when(F.col("dst_kind") == "FUNCTION", "function_call").otherwise("procedure_call").alias("edge_type"))
    types = {"reads": "table_read", "writes": "table_write", "creates": "table_create", "columns_read": "column_read", "columns_written": "column_write", "columns_updated": "column_update"}
    names = F.create_map(*[F.lit(x) for pair in types.items() for x in pair])
    own = _items(facts, *types).select(F.col("name").alias("src"), F.col("item").alias("dst"), F.try_element_at(names, F.col("list")).alias("edge_type"))
    columns = own.filter(F.col("edge_type").startswith("column")).select(F.col("dst").alias("src"), F.regexp_replace("dst", r"\.[^.]*$", "").alias("dst"), F.lit("column_of").alias("edge_type"))
    return called.unionByName(own).unionByName(columns).distinct()


def routine_subgraph(edges: DataFrame, name: str) -> DataFrame:
    """Edges from or to one routine, without those of columns."""
    return graphs.focus(edges, name.lower()).filter(~F.col("edge_type").startswith("column"))


def expand(edges: DataFrame, shown: DataFrame, to_right: bool = True) -> DataFrame:
    """Nodes one link to the right (or left) of those shown, without these. shown: node."""
    here, there = ("src", "dst") if to_right else ("dst", "src")
    near = edges.join(shown.select(F.col("node").alias(here)).distinct(), here, "left_semi").select(F.col(there).alias("node")).distinct()
    return near.join(shown.select("node"), "node", "left_anti")


def touching(edges: DataFrame, table: str, column: str) -> DataFrame:
    """Column edges that a column is the source or target of (rows of ``lineage.column_edges``), in any letter case."""
    is_ = lambda t, c: (F.lower(t) == table.lower()) & (F.lower(c) == column.lower())
    return edges.filter(is_("src_table", "src_column") | is_("dst_table", "dst_column"))


def find_columns(wanted: DataFrame, columns: DataFrame) -> DataFrame:
    """The place of each wanted column in its table: table_name, column_name, ordinal (null if it has none).

    A column is found by its exact name, else without regard to letter case, else without quotes either. wanted: table_name,
    column_name; columns: table_name, column_name, ordinal; of several columns alike, the first counts.
    """
    bare = lambda c: F.lower(F.regexp_replace(c, r"[\[\]\"`]", ""))
    keys = [lambda c: F.col(c), lambda c: F.lower(c), bare]
    out = wanted.select("table_name", "column_name").distinct()
    for i, key in enumerate(keys):
        by = columns.groupBy(F.lower("table_name").alias("_t"), key("column_name").alias("_c")).agg(F.min("ordinal").alias(f"_o{i}"))
        out = out.join(by, (F.lower("table_name") == F.col("_t")) & (key("column_name") == F.col("_c")), "left").drop("_t", "_c")
    return out.select("table_name", "column_name", F.coalesce("_o0", "_o1", "_o2").alias("ordinal"))


def layers(edges: DataFrame) -> DataFrame:
    """Places for a drawing from left to right: node, layer (its level; nodes on circles and behind them come last), place in the layer."""
    levels = graphs.execution_levels(edges)
    last = levels.agg(F.coalesce(F.max("level"), F.lit(-1)) + 1).scalar()
    return levels.select("node", F.coalesce("level", last).alias("layer")).withColumn("place", F.row_number().over(Window.partitionBy("layer").orderBy("node")))


# ---- statements
def column_lineage_catalog(statements: DataFrame) -> DataFrame:
    """Target columns with their transformation, the number of their sources, and whether they are calculated; by table and column."""
    defs = lineage.column_defs(statements).filter("dst_table is not null")
    n = lineage.column_edges(statements).groupBy("stmt_id", "dst_table", "dst_column").agg(F.countDistinct("src_table", "src_column").alias("num_sources"))
    out = defs.join(n, ["stmt_id", "dst_table", "dst_column"], "left")
    return out.select("file_path", "dst_table", "dst_column", "transform_type", F.coalesce("num_sources", F.lit(0)).alias("num_sources"), "is_aggregate", (~F.col("transform_type").isin("direct", "literal", "definition")).alias("is_calculated"), (F.col("is_aggregate") | F.col("is_calculated") | (F.coalesce("num_sources", F.lit(0)) > 1)).alias("is_derived")).orderBy("dst_table", "dst_column")


def feature_report(statements: DataFrame) -> DataFrame:
    """Number of statements that use each feature, by dialect."""
    return statements.select("dialect", F.explode("features").alias("feature")).groupBy("dialect", "feature").agg(F.count(F.lit(1)).alias("n_statements"))


def combined_summary(statements: DataFrame, facts: DataFrame) -> DataFrame:
    """Measures of all reports by name: measure, value."""
    a = lineage.summary(statements)
    b = facts.agg(F.count(F.lit(1)).alias("total_routines"), F.count("error").alias("failed_routines"), F.coalesce(F.sum((F.col("complexity") > COMPLEX).cast("bigint")), F.lit(0)).alias("complex_routines"), F.coalesce(F.sum(F.size("calls")), F.lit(0)).alias("total_calls"))
    tall = lambda df: df.select(F.explode(F.map_from_arrays(F.array(*[F.lit(c) for c in df.columns]), F.array(*[F.col(c).cast("string") for c in df.columns]))).alias("measure", "value"))
    return tall(a).unionByName(tall(b))


def summary_text(summary: DataFrame) -> DataFrame:
    """A summary as lines of text for people: line."""
    return summary.select(F.concat(F.rpad(F.initcap(F.replace(F.col("measure"), F.lit("_"), F.lit(" "))), 30, " "), "value").alias("line")).orderBy("line")


def confidence_with_features(columns: DataFrame, statements: DataFrame) -> DataFrame:
    """Merged columns with their confidence lowered where a statement for the table picks rows: by 0.95 for QUALIFY, 0.9 for SAMPLE."""
    f = statements.filter("target_table is not null").select(F.lower("target_table").alias("table_key"), F.explode("features").alias("f"))
    f = f.groupBy("table_key").agg(F.bool_or(F.col("f") == "QUALIFY").alias("_q"), F.bool_or(F.col("f") == "SAMPLE").alias("_s"))
    factor = lambda c, x: F.when(F.col(c), x).otherwise(1.0)
    out = columns.join(f, "table_key", "left")
    return out.withColumn("confidence", F.round(F.col("confidence") * factor("_q", 0.95) * factor("_s", 0.9), 2)).drop("_q", "_s")


def routine_reports(statements: DataFrame, facts: DataFrame, dialect: str) -> dict[str, DataFrame]:
    """All reports on routines by name."""
    summary = combined_summary(statements, facts)
    return {
        "executable_components_catalog": executable_catalog(facts, dialect), "executable_summary": executable_summary(facts), "top_complex": top_complex(facts), "columns_by_operation": columns_by_operation(facts), "column_access": column_access(facts),
        "tabular_components_usage": table_usage(facts), "temp_usage": temp_usage(facts), "call_graph": call_graph(facts), "call_chains": call_chains(facts), "orphan_procedures": orphan_procedures(facts), "call_order": call_order(facts), "dependency_graph": typed_edges(facts),
        "column_lineage": column_lineage_catalog(statements), "feature_report": feature_report(statements), "combined_summary": summary, "summary_text": summary_text(summary),
    }

