"""Queries on changes, hierarchies and references (problems 1, 2 and 5 of the test data)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from headwater.functions.names import clean_name, qualified
from headwater.operators import references, snapshots
from headwater.operators.hierarchy import Hierarchy
from headwater.scratch import Scratch
from headwater.sources.tables import table

SCOPE, KEY = ["database_name"], ["table_schema", "table_name", "column_name"]


def catalog_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of all deliveries with clean names, and the type in one spelling (_type)."""
    rows = table(spark, sf_dir, "catalog_columns").select("database_name", "snapshot_no", *[clean_name(F.col(c)).alias(c) for c in KEY], "data_type", "loaded_at")
    return snapshots.canonical_types(rows, "data_type", table(spark, sf_dir, "type_synonyms"))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns added, removed or changed in type between consecutive deliveries of each database."""
    out = snapshots.snapshot_changes(catalog_lines(spark, sf_dir), SCOPE, KEY, "snapshot_no", F.col("_type"), F.col("loaded_at"))
    return out.select(*SCOPE, *KEY, "snapshot_no", "change_kind")


def p1_deliveries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same, one delivery after the other: each run reads its own delivery and what the run before has left."""
    scratch, lines = Scratch(spark, "deliveries"), catalog_lines(spark, sf_dir)
    numbers = sorted(r[0] for r in lines.select("snapshot_no").dropna().distinct().collect())  # one row per delivery
    registry = last = found = None
    for n in numbers:
        changes, registry, last = snapshots.apply_delivery(lines.filter(F.col("snapshot_no") == n), SCOPE, KEY, "snapshot_no", F.col("_type"), F.col("loaded_at"), registry, last)
        changes = scratch.save(changes)
        found = changes if found is None else found.unionByName(changes)
    if found is None:
        return p1_found(spark, sf_dir)
    return found.select(*SCOPE, *KEY, "snapshot_no", "change_kind")


def table_links(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Links (child, parent) and all names of table_info."""
    rows = table(spark, sf_dir, "table_info").select(clean_name(F.col("table_name")).alias("child"), F.explode_outer("depends_on").alias("parent"))
    rows = rows.withColumn("parent", clean_name(F.col("parent")))
    names = rows.select(F.explode(F.array("child", "parent")).alias("node")).filter("node is not null").distinct()
    return rows, names


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Routes from roots to tables, and tables on circles."""
    links, names = table_links(spark, sf_dir)
    h = Hierarchy(links, nodes=names)
    routes = h.routes().select(F.lit("route").alias("case_kind"), F.col("node").alias("table_name"), F.col("root").alias("root_name"), "n_links")
    cycles = h.cycles().select(F.lit("cycle").alias("case_kind"), F.col("node").alias("table_name"), F.col("first").alias("root_name"), F.col("size").alias("n_links"))
    return routes.unionByName(cycles)


def p2_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Path of each table from every root table that leads to it, with its number of links."""
    links, names = table_links(spark, sf_dir)
    return Hierarchy(links, nodes=names).paths().select(F.col("node").alias("table_name"), F.col("root").alias("root_name"), "n_links", "path")


def p2_dependents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All tables that depend on each table, with the fewest links between."""
    links, names = table_links(spark, sf_dir)
    return Hierarchy(links, nodes=names).descendants().select(F.col("ancestor").alias("table_name"), F.col("node").alias("dependent_name"), F.col("distance").alias("n_links"))


def table_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References to tables: origin, record_id, ref_key, ref_at. CTEs and temporary tables of the statement are none."""
    statements = table(spark, sf_dir, "statement_lineage").select("statement_id", "source_tables", "cte_names", "temp_tables", "analyzed_at")
    own = statements.select("statement_id", F.explode(F.concat(F.coalesce("cte_names", F.array()), F.coalesce("temp_tables", F.array()))).alias("n"))
    own = own.select("statement_id", clean_name(F.col("n")).alias("ref_key")).dropna().distinct()
    from_statements = statements.select("statement_id", F.col("statement_id").alias("record_id"), F.explode("source_tables").alias("t"), F.col("analyzed_at").alias("ref_at"))
    from_statements = from_statements.select(F.lit("statement_lineage").alias("origin"), "record_id", "statement_id", clean_name(F.col("t")).alias("ref_key"), "ref_at")
    columns = table(spark, sf_dir, "column_lineage").select("lineage_id", "statement_id", F.explode("source_columns").alias("s"), "analyzed_at")
    from_columns = columns.filter("s.cte_reference is null and s.table_name is not null").select(
        F.lit("column_lineage").alias("origin"), F.col("lineage_id").alias("record_id"), "statement_id", clean_name(F.col("s.table_name")).alias("ref_key"), F.col("analyzed_at").alias("ref_at")
    )
    named = from_statements.unionByName(from_columns).join(own, ["statement_id", "ref_key"], "left_anti")
    keys = table(spark, sf_dir, "foreign_keys").select(
        F.lit("foreign_keys").alias("origin"), F.col("fk_id").alias("record_id"), qualified(F.col("referenced_schema"), F.col("referenced_table")).alias("ref_key"), F.col("captured_at").alias("ref_at")
    )
    return named.select("origin", "record_id", "ref_key", "ref_at").unionByName(keys)


def table_lifetimes(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "catalog_tables")
    return t.select(qualified(F.col("table_schema"), F.col("table_name")).alias("ref_key"), F.col("create_date").alias("starts"), F.col("drop_date").alias("ends"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References to tables that didn't exist at the date of the record."""
    found = references.orphan_references(table_references(spark, sf_dir), table_lifetimes(spark, sf_dir))
    return found.select("origin", "record_id", F.col("ref_key").alias("ref_table"), "reason", "ref_month")


def p5_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orphan references per table and month."""
    found = references.orphan_references(table_references(spark, sf_dir), table_lifetimes(spark, sf_dir))
    return references.orphan_report(found).select(F.col("ref_key").alias("ref_table"), "ref_month", "reason", "n_references")


QUERIES = {"p1_found": p1_found, "p1_deliveries": p1_deliveries, "p2_found": p2_found, "p5_found": p5_found, "p2_paths": p2_paths, "p2_dependents": p2_dependents, "p5_report": p5_report}
