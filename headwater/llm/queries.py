"""Queries on problems 3, 4 and 6 to 9 of the test data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from headwater.llm import canonical, matching, mixing, packing, splitting, subjects, tokens
from headwater.scratch import Scratch
from headwater.sources.tables import table


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table that each hand-typed target_table means, or UNMATCHED."""
    reference = table(spark, sf_dir, "table_disambiguation")
    exact = reference.select(F.col("qualified_name").alias("target_table")).distinct()
    rows = table(spark, sf_dir, "column_lineage").select("lineage_id", "target_table").dropna().join(exact, "target_table", "left_anti")
    meant = matching.match_names(rows.select("target_table").distinct(), reference, "target_table")
    return rows.distinct().join(meant, "target_table").select("lineage_id", F.coalesce("qualified_name", F.lit("UNMATCHED")).alias("qualified_name"))


def _same_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return canonical.same_queries(table(spark, sf_dir, "query_history"), "query_text_id", "query_sql_text")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of the query history that are another writing of an earlier entry."""
    same = _same_queries(spark, sf_dir).filter("query_text_id <> first_key")
    return same.select(F.col("first_key").alias("first_id"), F.col("query_text_id").alias("copy_id"))


def p4_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each query once, with the number of its entries."""
    return _same_queries(spark, sf_dir).filter("query_text_id = first_key").select(F.col("first_key").alias("first_id"), F.col("copies").cast("bigint").alias("n_copies"))


def size_limit(spark: SparkSession, sf_dir: str, name: str) -> int:
    row = table(spark, sf_dir, "size_limits").filter(F.col("limit_name") == name).agg(F.max("limit_value").alias("v")).first()
    if row.v is None:
        raise ValueError(f"size_limits has no {name}")
    return int(row.v)


def p6_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all definitions that are longer than the limit."""
    limit, overlap = size_limit(spark, sf_dir, "definition_chars"), size_limit(spark, sf_dir, "overlap_chars")
    return splitting.split_long(table(spark, sf_dir, "catalog_procedures"), "procedure_id", "definition", limit, overlap)


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Definitions that had to be split, and whether a cut within a line was forced."""
    return p6_pieces(spark, sf_dir).groupBy("procedure_id").agg(F.max(F.col("is_forced").cast("int")).alias("forced_cut"))


def token_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, source and number of tokens of all documents, written once because texts are tokenized in Python."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", tokens.token_count(F.col("text")).alias("size"))
    return Scratch(spark, "tokens").save(docs)


def p7_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The container of each document, or of each part of documents larger than a container."""
    packed = packing.pack(token_sizes(spark, sf_dir), "doc_id", "size", size_limit(spark, sf_dir, "container_tokens"))
    return packed.select(F.col("container").alias("container_id"), "doc_id", "part", F.col("start").alias("start_token"), F.col("size").alias("n_tokens"))


def p7_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number of containers, their lower bound, and the share of unused room."""
    capacity = size_limit(spark, sf_dir, "container_tokens")
    return packing.packing_report(packing.pack(token_sizes(spark, sf_dir), "doc_id", "size", capacity), capacity)


def p8_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of the mixture and how often each is used."""
    return mixing.mix(token_sizes(spark, sf_dir), table(spark, sf_dir, "mix_targets"))


def p8_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target and actual shares of the sources in the mixture."""
    targets = table(spark, sf_dir, "mix_targets")
    return mixing.mix_report(mixing.mix(token_sizes(spark, sf_dir), targets), targets)


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Subjects that each document deals with."""
    docs = table(spark, sf_dir, "documents")
    areas = {r["subject"]: r["description"] for r in table(spark, sf_dir, "subject_areas").filter("subject is not null").limit(subjects.MAX_SUBJECTS + 1).collect()}
    hand, titled = subjects.labelled_sample(docs, table(spark, sf_dir, "subject_labels"), "doc_id", "text")
    return subjects.classify(docs, subjects.fit(hand, areas, titled), "doc_id", "text").distinct()


QUERIES = {
    "p3_found": p3_found,
    "p4_found": p4_found,
    "p6_found": p6_found,
    "p7_containers": p7_containers,
    "p8_mixture": p8_mixture,
    "p9_found": p9_found,
    "p4_counts": p4_counts,
    "p6_pieces": p6_pieces,
    "p7_report": p7_report,
    "p8_report": p8_report,
}
