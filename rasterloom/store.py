"""Where intermediate tables go: the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir as the session has it. Unset, a temporary folder serves a local session; a cluster needs the setting."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="shared-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder


def new_folder(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has yet; what is written there goes when the application ends."""
    context = spark.sparkContext
    place = context._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}")
    system = place.getFileSystem(context._jsc.hadoopConfiguration())
    place = system.makeQualified(place)
    system.deleteOnExit(place)
    return place.toString()


def settled(df: DataFrame) -> DataFrame:
    """``df`` computed once into the checkpoint folder that the cluster shares."""
    shared_dir(df.sparkSession)
    return df.checkpoint()
