"""A session with the settings the engine expects, for the command line, tests and the benchmark."""

from __future__ import annotations

import os

from pyspark import SparkConf, SparkContext
from pyspark.sql import SparkSession


def get_session(app: str = "headwater", master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """The running session, or a new one.

    What spark-submit, PYSPARK_SUBMIT_ARGS or spark-defaults.conf have set stays as it is; values are added only where there are
    none. Without a master the session is a local one, and only then the number of shuffle partitions is that of its threads.
    """
    active = SparkSession.getActiveSession()
    if active is not None:
        return active
    # The driver's memory counts when the JVM starts; this variable is what spark-submit takes if nothing else is given.
    os.environ.setdefault("SPARK_DRIVER_MEMORY", os.environ.get("HEADWATER_DRIVER_MEMORY", "8g"))
    started_here = "PYSPARK_GATEWAY_PORT" not in os.environ and "--master" not in os.environ.get("PYSPARK_SUBMIT_ARGS", "")
    SparkContext._ensure_initialized()
    given = SparkConf()
    # Where nothing names a master, spark-submit itself says local[*].
    has_master = given.contains("spark.master") and not (started_here and given.get("spark.master") == "local[*]")
    cpus = os.environ.get("BENCH_CPUS", str(min(8, os.cpu_count() or 1)))
    wanted = {
        "spark.app.name": app,
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.showConsoleProgress": "false",
    }
    if master or not has_master:
        wanted |= {"spark.master": master or f"local[{cpus}]", "spark.sql.shuffle.partitions": str(shuffle_partitions or cpus), "spark.ui.enabled": "false"}
    if shuffle_partitions:
        wanted["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    builder = SparkSession.builder
    for key, value in wanted.items():
        if key == "spark.master" or not given.contains(key) or given.get(key) == "pyspark-shell":
            builder = builder.config(key, value)
    return builder.getOrCreate()
