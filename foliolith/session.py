"""Session defaults shared by the tests, the benchmark and applications."""

from __future__ import annotations

from pyspark.sql import SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_session(master: str | None = None, shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A session with UTC time, adaptive execution and Arrow; ``conf`` overrides any default."""
    builder = SparkSession.builder.appName("foliolith")
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, "spark.sql.shuffle.partitions": str(shuffle_partitions), **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str):
    """One parquet table of a data folder; any path Spark's readers open."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
