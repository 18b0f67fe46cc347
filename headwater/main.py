"""Command line: lineage of a folder of scripts, or of a catalog description, written as reports.

python run.py --dialect tsql --input scripts/ --output reports/
python run.py --dialect snowflake --metadata description.json --output reports/
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from headwater.functions import rules
from headwater.operators import catalog, cleaning, graphs, lineage, reports, routines
from headwater.scratch import Scratch
from headwater.session import get_session
from headwater.sources import catalogs, corpus, sinks

ROUTINES = ("PROCEDURE", "FUNCTION", "TRIGGER", "MACRO", "TASK", "PACKAGE", "PACKAGE_BODY")


def analyze(texts: DataFrame, dialect: str, source_kind: str = "SCRIPT") -> dict[str, DataFrame]:
    """All report tables of texts (file_path, sql_text) by name."""
    spark = texts.sparkSession
    statements = Scratch(spark, "statements").save(lineage.analyze(texts.select("file_path", "sql_text"), dialect, source_kind))
    defs, edges = lineage.column_defs(statements), lineage.column_edges(statements)
    table_edges = lineage.table_edges(statements)
    made = statements.filter(F.col("object_kind").isin(*ROUTINES)).select(F.lower("object_name").alias("name"), F.col("statement").alias("definition"))
    facts = Scratch(spark, "routines").save(routines.routine_facts(made))
    columns = reports.confidence_with_features(lineage.merged_columns(defs, edges), statements)
    return {
        "statements": statements,
        "column_defs": defs,
        "column_edges": edges,
        "column_edges_resolved": lineage.column_edges(statements, resolved=True),
        "table_edges": table_edges,
        "ctes": lineage.cte_table(statements),
        "temp_tables": lineage.temp_registry(statements),
        "tables": lineage.table_registry(statements),
        "columns": columns,
        "execution_levels": graphs.execution_levels(table_edges.select(F.lower("src_table").alias("src"), F.lower("dst_table").alias("dst"))),
        "routines": facts,
        "access": routines.access_matrix(facts),
        "errors": lineage.errors(statements),
        "lineage_summary": lineage.summary(statements),
        **reports.routine_reports(statements, facts, dialect),
    }


def run(spark: SparkSession, path: str, dialect: str, output: str | None = None, kind: str = "json", max_files: int | None = None) -> dict[str, DataFrame]:
    """All report tables of a folder of scripts by name; written too if there is an output folder."""
    tables = analyze(corpus.read_corpus(spark, path, dialect, max_files), dialect)
    if output:
        sinks.write_reports(tables, output, kind)
    return tables


def run_metadata(spark: SparkSession, frames: dict[str, DataFrame], dialect: str, output: str | None = None, kind: str = "json") -> dict[str, DataFrame]:
    """All report tables of a catalog description; names are resolved, unqualified columns looked up and edges enriched by the catalog.

    Views, query history and routines are analysed; a description with none of them gets statements that read its tables. Objects
    of the system's own are left out.
    """
    frames = {k: v.filter(cleaning.is_user_object(F.col("schema_name"), F.coalesce(*[F.col(c) for c in v.columns if c.endswith("_name") and c != "schema_name"] or [F.lit("")]))) if "schema_name" in v.columns else v for k, v in frames.items()}
    texts = [x for x in (catalogs.components(frames, True), catalogs.components(frames, False)) if x is not None]
    if not texts:
        texts = [catalog.synthetic_statements(frames["tables"])]
    whole = texts[0] if len(texts) == 1 else texts[0].unionByName(texts[1])
    tables = analyze(whole, dialect, "METADATA")
    if "columns" in frames:
        c = frames["columns"]
        edges = catalog.resolve_unknown(tables["column_edges_resolved"], lineage.table_edges(tables["statements"]), c.select(F.concat_ws(".", "schema_name", "table_name").alias("table_name"), "column_name"))
        tables["column_edges_enriched"] = catalog.enrich_edges(edges, c)
        tables["column_map"] = catalog.column_map(c)
    if "tables" in frames:
        t = frames["tables"].select("database_name", "schema_name", "table_name")
        tables["table_names"] = catalog.name_forms(t)
        tables["source_tables_resolved"] = catalog.resolve_names(tables["table_edges"].select("src_table").distinct(), "src_table", t, dialect)
    if output:
        catalogs.write_description(frames, output)
        sinks.write_reports(tables, output, kind)
    return tables


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    p.add_argument("--dialect", required=True, choices=[*rules.DIALECTS, *rules.ALIASES])
    source = p.add_mutually_exclusive_group(required=True)
    source.add_argument("--input", help="folder of scripts")
    source.add_argument("--metadata", help="catalog description as JSON, or a pattern of which the last file counts")
    p.add_argument("--output", required=True)
    p.add_argument("--format", default="json", choices=["json", "parquet"])
    p.add_argument("--max-files", type=int)
    a = p.parse_args(argv)
    spark, dialect = get_session(), rules.dialect_of(a.dialect)
    if a.input:
        run(spark, a.input, dialect, a.output, a.format, a.max_files)
    else:
        run_metadata(spark, catalogs.description(spark, a.metadata), dialect, a.output, a.format)


if __name__ == "__main__":
    main()
