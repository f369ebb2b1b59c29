"""One pass at a time over a folder, by a file that only one can create."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import TypeVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

T = TypeVar("T")


@dataclass
class Lease:
    """A lease on a folder. A holder that died keeps it until ``seconds`` after its last renewal."""

    folder: str
    seconds: float = 3600.0
    owner: str = field(default_factory=lambda: uuid.uuid4().hex)

    def _files(self, spark: SparkSession):
        make = spark._jvm.org.apache.hadoop.fs.Path
        path = make(f"{self.folder}/lease")
        return path.getFileSystem(spark._jsc.hadoopConfiguration()), path, make

    def acquire(self, spark: SparkSession) -> bool:
        """Whether the lease is now this owner's. An outlived one is first renamed away, which also only one can do."""
        files, path, make = self._files(spark)
        if files.exists(path) and time.time() - files.getFileStatus(path).getModificationTime() / 1000 > self.seconds:
            aside = make(f"{self.folder}/lease-{self.owner}")
            if files.rename(path, aside):
                files.delete(aside, False)
        try:
            out = files.create(path, False)
        except Exception as e:  # someone holds it
            if "already exists" not in str(e).lower():
                raise
            return False
        out.write(bytearray(self.owner.encode()))
        out.close()
        return True

    def release(self, spark: SparkSession) -> None:
        files, path, _ = self._files(spark)
        files.delete(path, False)

    def run(self, spark: SparkSession, work: Callable[[], T]) -> T | None:
        """What ``work`` returns, or None without doing anything if another pass is running."""
        if not self.acquire(spark):
            return None
        try:
            return work()
        finally:
            self.release(spark)


def trimmed(stored: DataFrame, log: DataFrame, seq: str = "seq") -> DataFrame:
    """Stored rows that the log still reaches: those before its first row go, as nothing joins them any more. An empty log keeps all."""
    first = log.agg(F.min(seq).alias("_first"))  # one row
    return stored.join(F.broadcast(first), F.col(seq) >= F.coalesce(F.col("_first"), F.col(seq))).drop("_first")
