"""Session settings the jobs are meant to run with."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Of a key given twice the last counts, as in a browser.
    "spark.sql.variant.allowDuplicateKeys": "true",
    # Heavy rows: scans are split by size, small tables over the cores.
    "spark.sql.files.maxPartitionBytes": "64m",
    "spark.ui.showConsoleProgress": "false",
    # Recording a call site for every column expression dominates plan building.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def local_session(cores: int = 8, name: str = "rosterproof", **conf: str) -> SparkSession:
    """A local session for tests and benchmarks; a cluster brings its own."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(name)
    settings = {
        **SETTINGS,
        "spark.sql.shuffle.partitions": str(cores),
        "spark.driver.memory": "12g",
        "spark.ui.enabled": "false",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
