"""Tables written into the folder that all executors share, to cut long lineages."""

from __future__ import annotations

import math
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a temporary one only where that is unset and the master is local (tests)."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="lakeloom-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def cut(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet into the shared folder and read again, so later plans start there and lost executors cost no more than their tasks."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows of a partition that ``dealt`` makes.
DEALT = 1_000_000


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` exchanged by ``keys`` into partitions of about DEALT rows, so that the memory of a task that groups or sorts by them doesn't grow with the table. Counts the rows first."""
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, math.ceil(df.count() / DEALT)), *keys)
