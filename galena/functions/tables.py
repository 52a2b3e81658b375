"""Tables that a session writes for itself."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The session's folder for checkpoints, which all its executors share.

    It is that of ``spark.checkpoint.dir``. Only a local session, whose executors are the
    driver itself, gets a temporary one if it has none; a cluster without one is an error.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = sc.getConf().get("spark.checkpoint.dir")
        if not folder and not sc.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="galena-"))
    return sc.getCheckpointDir()


#: Bytes that a writer of a table holds before it puts them on disk.
ROW_GROUP = 16 << 20


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage through a table written in the shared folder.

    Unlike a checkpoint, the table comes back with its own size instead of the product of the
    sizes that its joins were guessed from, and is read by column.
    """
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.option("parquet.block.size", ROW_GROUP).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
