"""Session for tests, the benchmark and the command line."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def local_session(name: str = "graphcover", cores: str | None = None, partitions: int = 8) -> SparkSession:
    os.environ.setdefault("OPENBLAS_NUM_THREADS", "1")
    return (
        SparkSession.builder.master(f"local[{cores or os.environ.get('GRAPHCOVER_CORES', '8')}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "6g")
        .getOrCreate()
    )
