"""Tables that outlive lost executors: written to the folder in ``spark.checkpoint.dir``."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: str | None = None
_run = f"run-{uuid.uuid4().hex}"


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder. Only a local master, whose executors share the driver's disk, gets a temporary one where none is set."""
    global _own
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if _own is None:
        _own = tempfile.mkdtemp(prefix="tables-")
        atexit.register(shutil.rmtree, _own, ignore_errors=True)
    return f"file://{_own}"


def remove(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def settle(df: DataFrame) -> DataFrame:
    """The same rows as a written table: cuts lineage, and floating sums are computed once. ``release`` removes all of them."""
    path = f"{shared_dir(df.sparkSession)}/{_run}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Removes the tables that this process settled; frames that read them can't be used any more."""
    remove(spark, f"{shared_dir(spark)}/{_run}")
