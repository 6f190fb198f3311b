"""Session helpers: tables by folder and the folder that driver and executors share."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet table `name` of the folder `sf_dir`, by any path that Spark can read."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Folders made for applications that run on one machine and name none.
_made: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where that is unset and all runs on one machine (tests), a new local one per application."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        found = _made[app] = _made.get(app) or f"file://{tempfile.mkdtemp(prefix='recollect-')}"
    return found.rstrip("/")


def scratch_root(spark: SparkSession) -> str:
    """This application's own part of the shared folder."""
    return f"{shared_dir(spark)}/recollect-{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path there that no other call gets."""
    return f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"


def _delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def clear_scratch(spark: SparkSession) -> None:
    """Deletes all tables that this application has stored; to be called once results that rest on them are written."""
    _delete(spark, scratch_root(spark))


def stored(df: DataFrame, name: str) -> DataFrame:
    """`df` written to the shared folder and read again: a cut of the lineage that outlives lost executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def release(*tables: DataFrame) -> None:
    """Deletes tables that stored() has made, once nothing that is still to run reads them."""
    for t in tables:
        _delete(t.sparkSession, t.stored_at)


@contextlib.contextmanager
def small_batches(spark: SparkSession, most: str = "4m") -> Iterator[None]:
    """For jobs that run inside: Arrow batches of about `most` bytes, unless the session sets a limit of its own.

    A batch is built outside the heap, in buffers that double, and each Python worker holds two; by rows alone (10,000), batches of long texts take 30 MB and more.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name, None) is not None:
        yield
        return
    spark.conf.set(name, most)
    try:
        yield
    finally:
        spark.conf.unset(name)
