"""Readers with explicit schemas, and the tables of one folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN is a missing number: as null it is neither larger than all others nor equal to itself."""
    numbers = {f.name for f in df.schema.fields if isinstance(f.dataType, T.DoubleType | T.FloatType)}
    return df.select(*[F.nanvl(F.col(c), F.lit(None).cast("double")).alias(c) if c in numbers else F.col(c) for c in df.columns]) if numbers else df


class Tables:
    """Parquet tables of a folder, read on first use: ``Tables(spark, path).orders``."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.path}/{name}.parquet")


class SourceChangedError(ValueError):
    """A pinned file holds something else than before."""


def read_csv(spark: SparkSession, path: str, schema: T.StructType, md5: str | None = None) -> DataFrame:
    """A CSV file with header under an explicit schema; a changed header or (with ``md5``) changed bytes are refused."""
    if md5 is not None:
        found = spark.read.format("binaryFile").load(path).select(F.md5("content").alias("h")).first()["h"]
        if found != md5:
            raise SourceChangedError(f"{path} has md5 {found}, not {md5}")
    header = spark.read.text(path).limit(1).first()
    names = [] if header is None else [c.strip().strip('"') for c in header[0].split(",")]
    missing, extra = [n for n in schema.names if n not in names], [n for n in names if n not in schema.names]
    if missing or extra:
        raise SourceChangedError(f"missing columns {missing}, unexpected columns {extra}")
    by = {f.name: f for f in schema.fields}
    df = spark.read.schema(T.StructType([by[n] for n in names])).option("header", True).option("enforceSchema", False).option("multiLine", True).option("escape", '"').csv(path)
    return nan_to_null(df.select(*schema.names))


def read_parquet(spark: SparkSession, path: str, contract) -> DataFrame:
    """Parquet that must meet a contract."""
    return contract.validate(spark.read.parquet(path))


def read_json_lines(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """JSON lines, gzip or plain, under an explicit schema; lines that don't fit are refused."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_exposition(spark: SparkSession, path: str) -> DataFrame:
    """Samples of a Prometheus text file: metric, labels (text) and value."""
    p = r"^([a-zA-Z_:][a-zA-Z0-9_:]*)(\{[^}]*\})?\s+(\S+)"
    lines = spark.read.text(path).where(~F.col("value").startswith("#") & F.col("value").rlike(p))
    number = F.regexp_extract("value", p, 3)
    return lines.select(F.regexp_extract("value", p, 1).alias("metric"), F.regexp_extract("value", p, 2).alias("labels"), F.when(number == "+Inf", float("inf")).otherwise(number.cast("double")).alias("number")).withColumnRenamed("number", "value")


def read_latency_histograms(spark: SparkSession, path: str) -> DataFrame:
    """A load generator's JSON list of endpoints as rows (endpoint, ms, n) of their response-time histograms."""
    schema = "array<struct<name string, response_times map<string, bigint>>>"
    doc = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", schema)).alias("e"))
    return doc.select(F.col("e.name").alias("endpoint"), F.explode("e.response_times").alias("ms", "n")).withColumn("ms", F.col("ms").cast("double"))


SOURCES: dict[str, Callable[..., DataFrame]] = {}


def source(name: str) -> Callable:
    """Register a reader under a name that parameters can select."""
    return lambda f: SOURCES.setdefault(name, f)


def load(spark: SparkSession, name: str, **parameters) -> DataFrame:
    if name not in SOURCES:
        raise NotImplementedError(f"no source {name!r}; there are {sorted(SOURCES)}")
    return SOURCES[name](spark, **parameters)


source("csv")(read_csv)
source("json")(read_json_lines)
