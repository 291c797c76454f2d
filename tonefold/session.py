"""What operators ask of the session."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder's path in the session's spark.checkpoint.dir, which driver and executors share.

    Where that is unset, a temporary folder serves if all runs on one machine; on a cluster it is an error.
    """
    context = spark.sparkContext
    where = context.getConf().get("spark.checkpoint.dir") or getattr(context, "_tonefold_shared", None)
    if where is None:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        where = context._tonefold_shared = tempfile.mkdtemp(prefix="tonefold-")
    return f"{where.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def checkpointed(df: DataFrame) -> DataFrame:
    """df cut off from its lineage, partitions and their order kept, in the folder that driver and executors share."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession, "checkpoints"))
    return df.checkpoint()


def bounded_batches(spark: SparkSession, records: int = 2000, size: int = 8 << 20) -> None:
    """Sets the session's Arrow batches to `records` rows and `size` bytes at most: rows of signals differ a thousandfold in length."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", records)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)
