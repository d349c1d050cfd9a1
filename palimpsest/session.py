"""Settings that the library takes from the session."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which all executors share. Where the setting is missing, a local master gets a folder of
    this machine; on a cluster, where executors would not see that, this raises."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="palimpsest-")
        spark.conf.set("spark.checkpoint.dir", found)
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def work_dir(spark: SparkSession, name: str) -> str:
    """A folder of this call's own in the shared folder. Results may read from it lazily, so it stays until `remove`."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    made_dirs(spark).append(path)
    return path


def made_dirs(spark: SparkSession) -> list[str]:
    """The work folders of this session."""
    if not hasattr(spark, "_palimpsest_work"):
        spark._palimpsest_work = []
    return spark._palimpsest_work


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder that no result reads from any more."""
    if path in made_dirs(spark):
        made_dirs(spark).remove(path)
    gone = spark._jvm.org.apache.hadoop.fs.Path(path)
    gone.getFileSystem(spark._jsc.hadoopConfiguration()).delete(gone, True)
