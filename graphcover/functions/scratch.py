"""Intermediate tables in the folder that driver and executors share.

Iterative operators cut their lineage here: a round is written as Parquet and
read back, so a lost executor costs a re-read and not a recomputation of every
earlier round. The folder is the cluster's ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import atexit
import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"
_paths: list[tuple[SparkSession, str]] = []


def shared_root(spark: SparkSession) -> str:
    """The cluster's shared folder; one of our own only where none is set."""
    root = spark.conf.get(SETTING, None)
    if not root:
        if spark.sparkContext.master.startswith("local"):
            root = "file://" + tempfile.mkdtemp(prefix="graphcover-")
        else:  # the warehouse is shared on every cluster, a temporary folder is not
            root = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"
        spark.conf.set(SETTING, root)
    return root.rstrip("/")


def new_path(spark: SparkSession, tag: str) -> str:
    """A fresh path below the shared folder, deleted when the driver ends."""
    path = f"{shared_root(spark)}/{tag}-{uuid.uuid4().hex}"
    _paths.append((spark, path))
    return path


def materialize(df: DataFrame, tag: str = "step") -> DataFrame:
    """Write ``df`` once to the shared folder and return the table just written."""
    spark = df.sparkSession
    path = new_path(spark, tag)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def delete_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    _paths[:] = [x for x in _paths if x[1] != path]


def release(*tables: DataFrame) -> None:
    """Delete tables made by :func:`materialize` that nothing reads any more."""
    for df in tables:
        if path := getattr(df, "_scratch_path", None):
            delete_path(df.sparkSession, path)


def sweep(spark: SparkSession) -> None:
    """Let go of finished steps' shuffle files.

    Spark deletes them once the driver's JVM has collected the steps, by itself only
    every half hour; operators of several large steps ask for it between them.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


@atexit.register
def _clean() -> None:
    for spark, path in list(_paths):
        try:
            if spark.sparkContext._jsc is not None:
                delete_path(spark, path)
        except Exception:  # noqa: BLE001  the JVM may be gone already
            return
