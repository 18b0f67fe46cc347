"""SQL files and catalogs as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from headwater.functions import rules

#: File names read per dialect.
FILES = {"oracle": "*.{sql,pls,pkb,pks}"}
#: JDBC addresses per dialect.
JDBC = {
    "tsql": "jdbc:sqlserver://{host}:{port};databaseName={database}",
    "postgres": "jdbc:postgresql://{host}:{port}/{database}",
    "oracle": "jdbc:oracle:thin:@//{host}:{port}/{database}",
    "teradata": "jdbc:teradata://{host}/DATABASE={database},DBS_PORT={port}",
    "snowflake": "jdbc:snowflake://{host}/?db={database}",
}


def read_corpus(spark: SparkSession, path: str, dialect: str = "tsql", max_files: int | None = None) -> DataFrame:
    """All scripts below a folder: file_path, sql_text. Bytes that are no UTF-8 are replaced."""
    glob = FILES.get(rules.dialect_of(dialect), "*.sql")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path)
    if max_files is not None:  # the paths first, so that no content is sorted
        first = files.select("path").orderBy("path").limit(max_files)
        files = files.join(first, "path", "left_semi")
    return files.select(F.col("path").alias("file_path"), F.decode("content", "UTF-8").alias("sql_text"))


def stream_corpus(spark: SparkSession, path: str, dialect: str = "tsql") -> DataFrame:
    """The same as a stream: each new script once."""
    glob = FILES.get(rules.dialect_of(dialect), "*.sql")
    return spark.readStream.format("text").option("wholetext", True).option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path).select(F.col("_metadata.file_path").alias("file_path"), F.col("value").alias("sql_text"))


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """A catalog description written as JSON."""
    return spark.read.json(path, multiLine=True)


def jdbc_url(dialect: str, host: str, port: int, database: str) -> str:
    return JDBC[rules.dialect_of(dialect)].format(host=host, port=port, database=database)


def read_jdbc(spark: SparkSession, dialect: str, host: str, port: int, database: str, query: str, **options: str) -> DataFrame:
    """A catalog view over JDBC; the driver's jar must be on the class path."""
    return spark.read.format("jdbc").options(url=jdbc_url(dialect, host, port, database), query=query, **options).load()


def view_body(ddl):
    """The query of a view's definition."""
    return F.regexp_extract(ddl, r"(?is)\bAS\s+(.*)$", 1)


def history_top(history: DataFrame, text: str, executions: str, last: str, key: str | None = None, days: int | None = 30, n: int = 1000, now: Column | None = None) -> DataFrame:
    """The n most executed statements of a query history; the limit is the feature.

    Those of fewer than 50 characters, those on the system's own tables and, if days is given, those not run within so many days of
    ``now`` (a null time is none) don't count. Ties are broken by the key, else by the text.
    """
    keep = (F.length(text) >= 50) & ~F.lower(text).rlike(r"\b(?:sys|information_schema|pg_catalog|dbc)\.")
    if days is not None:
        keep = keep & (F.col(last) >= (F.current_timestamp() if now is None else now) - F.expr(f"interval {int(days)} days"))
    return history.filter(keep).orderBy(F.desc_nulls_last(executions), key or text).limit(n)
