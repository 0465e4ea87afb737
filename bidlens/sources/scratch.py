"""Where jobs write tables that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def scratch_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a local one only for local masters that have none set."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a shared folder on a cluster")
    found = "file://" + tempfile.mkdtemp(prefix="bidlens-")
    spark.conf.set("spark.checkpoint.dir", found)
    return found


def new_path(spark: SparkSession, tag: str) -> str:
    """A path of its own in the scratch folder, deleted when the JVM ends."""
    path = f"{scratch_dir(spark)}/bidlens/{tag}-{uuid.uuid4().hex}"
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(hadoop_path)
    return path
