"""Requests as rows: checks that name every fault, classes of what is accepted, bodies, and explanations."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakeloom.operators.lineage import dealt


@dataclass(frozen=True)
class FieldCheck:
    """A bound, a pattern or allowed values of one field; a field that wasn't sent breaks nothing unless required."""

    field: str
    low: float | None = None
    high: float | None = None
    pattern: str | None = None
    levels: tuple[str, ...] | None = None
    required: bool = False

    def faults(self) -> list[tuple[str, Column]]:
        c = F.col(self.field)
        out = [(f"{self.field}: missing", c.isNull())] if self.required else []
        if self.low is not None:
            out.append((f"{self.field}: below {self.low:g}", c < self.low))
        if self.high is not None:
            out.append((f"{self.field}: above {self.high:g}", c > self.high))
        if self.pattern is not None:
            out.append((f"{self.field}: malformed", ~c.cast("string").rlike(self.pattern)))
        if self.levels is not None:
            out.append((f"{self.field}: not one of {', '.join(self.levels)}", ~c.isin(list(self.levels))))
        return out


def with_faults(df: DataFrame, checks: Sequence[FieldCheck], name: str = "faults") -> DataFrame:
    """Every fault of each row, as an array of texts; empty for a good one."""
    found = [F.when(F.coalesce(broken, F.lit(False)), text) for check in checks for text, broken in check.faults()]
    return df.withColumn(name, F.array_compact(F.array(*found)))


def accepted(df: DataFrame, supported: DataFrame, key: str, checks: Sequence[FieldCheck]) -> DataFrame:
    """Each row's class: unsupported_make, invalid_request or accepted."""
    known = supported.select(F.col(key).alias("_k")).distinct().withColumn("_ok", F.lit(True))
    out = with_faults(df, checks, "_faults").join(known, F.col(key) == F.col("_k"), "left")
    return out.withColumn("class", F.when(F.col("_ok").isNull(), "unsupported_make").when(F.size("_faults") > 0, "invalid_request").otherwise("accepted")).drop("_k", "_ok", "_faults")


def to_body(df: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Each row's fields as JSON text; missing ones are left out."""
    return df.withColumn("body", F.to_json(F.struct(*fields)))


def from_body(df: DataFrame, schema: str, body: str = "body") -> DataFrame:
    """JSON bodies as columns again; a malformed body gives nulls."""
    return df.withColumn("_b", F.from_json(body, schema)).select("*", "_b.*").drop("_b")


def projected_bodies(bodies: DataFrame, endpoints: DataFrame) -> DataFrame:
    """Bodies (id, fields: map) cut down to each endpoint's fields (endpoint, allowed, required); those that lack a required one are left out."""
    # Endpoints are a handful of rows of configuration, so every task holds them all.
    both = bodies.join(F.broadcast(endpoints))
    kept = F.map_filter("fields", lambda k, v: F.array_contains("allowed", k) & v.isNotNull())
    return both.withColumn("fields", kept).where(F.forall("required", lambda r: F.map_contains_key("fields", r))).select("id", "endpoint", "fields")


def unseen_levels(df: DataFrame, levels: dict[str, Sequence[str]], name: str = "unseen") -> DataFrame:
    """Fields whose value was sent but isn't among its levels."""
    return df.withColumn(name, F.array_compact(F.array(*[F.when(F.col(c).isNotNull() & ~F.col(c).isin(list(v)), F.lit(c)) for c, v in levels.items()])))


def explained(contributions: DataFrame, row: str, field: str, effect: str, k: int = 5, unit: float = 1.0) -> DataFrame:
    """For each row its k fields of largest summed effect and the rest as ``(other)``, in percent of a log effect, which is the effect over ``unit``.

    Rows are dealt out once, into parts of a fixed size, and then summed, ranked and folded where they are.
    """
    sums = dealt(contributions, row).groupBy(row, field).agg(F.sum(effect).alias("_e"))
    n = F.row_number().over(Window.partitionBy(row).orderBy(F.desc(F.abs("_e")), field))
    folded = sums.withColumn("_n", n).groupBy(row, F.when(F.col("_n") <= k, F.col(field)).otherwise("(other)").alias(field)).agg(F.sum("_e").alias("_e"))
    return folded.select(row, field, (F.expm1(F.col("_e") / unit) * 100).alias("percent"))


def first_accepted(df: DataFrame, key: str, seed: str, accepted_: Column, n: int) -> DataFrame:
    """n accepted rows in hash order."""
    return df.where(accepted_).orderBy(F.sha2(F.concat_ws("|", F.lit(seed), F.col(key).cast("string")), 256)).limit(n)
