"""Intermediate tables that several later steps read."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_place(spark: SparkSession) -> str:
    """A new folder below the session's checkpoint folder.

    That is the one named in ``spark.checkpoint.dir``. Only a local session may do without that
    setting; on a cluster the folder has to be shared, so its absence is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if base is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="checkpoint-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def settle_table(frame: DataFrame) -> DataFrame:
    """Write a frame as Parquet to the checkpoint folder and go on from the written copy.

    The copy outlives executors, has its size as statistics and carries nothing of the plan that made
    it; its folder is the ``place`` attribute of the result.
    """
    place = shared_place(frame.sparkSession)
    frame.write.parquet(place)
    copy = frame.sparkSession.read.schema(frame.schema).parquet(place)
    copy.place = place
    return copy


def discard_tables(*frames: DataFrame) -> None:
    """Delete the files of settled tables that nothing reads any more."""
    for frame in frames:
        jvm = frame.sparkSession.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(frame.place)
        path.getFileSystem(frame.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
