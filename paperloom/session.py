"""Session construction for tests, benchmarks and interactive use."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession


def build_session(app: str = "paperloom", cpus: int | None = None, **extra: str) -> SparkSession:
    """A local session with the settings the library expects (UTC, AQE); a cluster brings its own."""
    cpus = cpus or int(os.environ.get("BENCH_CPUS", "8"))
    conf = {
        "spark.master": f"local[{cpus}]",
        "spark.app.name": app,
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "12g",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.shuffle.partitions": str(cpus),
        "spark.checkpoint.dir": tempfile.mkdtemp(prefix="paperloom-ckpt-"),
        "spark.sql.warehouse.dir": tempfile.mkdtemp(prefix="paperloom-wh-"),
    } | extra
    spark = SparkSession.builder.config(map=conf).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
