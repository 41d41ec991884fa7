"""Sessions for tests and benchmarks on one machine."""

from __future__ import annotations

from pyspark.sql import SparkSession


def local_session(cpus: int = 8, memory: str = "8g", **conf: str) -> SparkSession:
    """A ``local[cpus]`` session, UTC, with as many shuffle partitions as CPUs; ``conf`` entries use ``__`` for dots."""
    settings = {
        "spark.master": f"local[{cpus}]",
        "spark.driver.memory": memory,
        "spark.sql.shuffle.partitions": str(cpus),
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    } | {k.replace("__", "."): v for k, v in conf.items()}
    spark = SparkSession.builder.config(map=settings).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
