"""Several tables that change together: data files under a batch's own folder, and one manifest that is renamed into place.

Readers take the folders that manifests name and nothing else, so they see all tables before a batch or all after it. A batch that failed
between two writes leaves files that no manifest names; running it again writes new ones.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class ManifestTables:
    """A folder that holds the tables, and their schemas (DDL) by name."""

    folder: str
    schemas: Mapping[str, str]

    def _files(self, spark: SparkSession):
        path = spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        return path.getFileSystem(spark._jsc.hadoopConfiguration()), spark._jvm.org.apache.hadoop.fs.Path

    def manifests(self, spark: SparkSession) -> DataFrame:
        """batch, table and path of everything committed."""
        files, path = self._files(spark)
        folder = path(f"{self.folder}/manifests")
        schema = "batch long, table string, path string"
        if not files.exists(folder):
            return spark.createDataFrame([], schema)
        return spark.read.schema("batch long, tables map<string,string>").json(f"{self.folder}/manifests").select("batch", F.explode("tables").alias("table", "path"))

    def committed(self, spark: SparkSession, batch: int) -> bool:
        files, path = self._files(spark)
        return files.exists(path(f"{self.folder}/manifests/{batch:012d}.json"))

    def read(self, spark: SparkSession, table: str) -> DataFrame:
        """The rows of a table in all committed batches, with their ``batch``."""
        schema = self.schemas[table]
        # One row for each batch and table.
        paths = [r["path"] for r in self.manifests(spark).where(F.col("table") == table).orderBy("batch").collect()]
        if not paths:
            return spark.createDataFrame([], f"{schema}, batch long")
        return spark.read.schema(f"{schema}, batch long").parquet(*paths)

    def write(self, batch: int, frames: Mapping[str, DataFrame]) -> bool:
        """Commit a batch of rows for some of the tables; false if that batch is committed already. Batches are written by one writer at a time."""
        if unknown := sorted(set(frames) - set(self.schemas)):
            raise ValueError(f"unknown tables {unknown}")
        spark = next(iter(frames.values())).sparkSession
        if self.committed(spark, batch):
            return False
        tables = {}
        for name, df in frames.items():
            tables[name] = f"{self.folder}/data/{batch:012d}-{uuid.uuid4().hex}/{name}"
            own = spark.createDataFrame([], self.schemas[name]).columns
            df.select(*own).withColumn("batch", F.lit(batch).cast("long")).write.parquet(tables[name])
        return self._publish(spark, batch, tables)

    def _publish(self, spark: SparkSession, batch: int, tables: dict[str, str]) -> bool:
        files, path = self._files(spark)
        aside, final = path(f"{self.folder}/writing/{uuid.uuid4().hex}.json"), path(f"{self.folder}/manifests/{batch:012d}.json")
        files.mkdirs(final.getParent())
        out = files.create(aside, False)
        out.write(bytearray(json.dumps({"batch": batch, "tables": tables}).encode()))
        out.close()
        if files.exists(final) or not files.rename(aside, final):
            files.delete(aside, False)
            return False
        return True
