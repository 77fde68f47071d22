"""Reliable intermediate tables in the folder that the cluster names."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def checkpoint_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` or the folder set on the context.  A local
    session without either gets a folder of its own; a cluster must name one,
    since a machine's own folder dies with the machine."""
    context = spark.sparkContext
    if not context.getCheckpointDir():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoint-"))
    return context.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written to the checkpoint folder; its lineage ends there."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the checkpoint folder at which nothing is stored yet."""
    return f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4()}"


class Stored:
    """``df`` written as Parquet to the checkpoint folder: ``rows`` reads it,
    with no lineage before it; ``drop`` deletes the files, once nothing that
    reads them is to run any more."""

    def __init__(self, df: DataFrame, name: str = "rows"):
        self._spark = df.sparkSession
        self._path = new_path(self._spark, name)
        df.write.parquet(self._path)
        self.rows = self._spark.read.schema(df.schema).parquet(self._path)

    def drop(self) -> None:
        path = self._spark._jvm.org.apache.hadoop.fs.Path(self._path)
        path.getFileSystem(self._spark._jsc.hadoopConfiguration()).delete(path, True)
