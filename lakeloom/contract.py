"""Typed contracts of tables: an ordered list of columns that a frame must have, and how to bring it there."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column as SparkColumn
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakeloom.functions.expressions import within_levels


class ContractError(ValueError):
    """Every way in which a frame departs from its contract."""


@dataclass(frozen=True)
class Column:
    """A column: name, Spark type in DDL, nullability, and the declared levels of a category (in order)."""

    name: str
    type: str
    nullable: bool = True
    description: str = ""
    levels: tuple[str, ...] | None = None

    def field(self) -> T.StructField:
        meta = {"description": self.description} | ({"levels": list(self.levels)} if self.levels is not None else {})
        return T.StructField(self.name, T.DataType.fromDDL(self.type), self.nullable, meta)


@dataclass(frozen=True)
class Contract:
    """An ordered set of columns, with the algebra that derives one contract from another."""

    name: str
    columns: tuple[Column, ...]

    def __post_init__(self) -> None:
        names = self.names
        if len(set(names)) != len(names):
            raise ContractError(f"{self.name}: a column is named twice")

    @property
    def names(self) -> list[str]:
        return [c.name for c in self.columns]

    def schema(self) -> T.StructType:
        return T.StructType([c.field() for c in self.columns])

    def _known(self, names: list[str]) -> None:
        if unknown := [n for n in names if n not in self.names]:
            raise ContractError(f"{self.name}: unknown columns {unknown}")

    def select(self, *names: str) -> Contract:
        self._known(list(names))
        by = {c.name: c for c in self.columns}
        return replace(self, columns=tuple(by[n] for n in names))

    def drop(self, *names: str) -> Contract:
        self._known(list(names))
        return replace(self, columns=tuple(c for c in self.columns if c.name not in names))

    def extend(self, *columns: Column) -> Contract:
        return replace(self, columns=(*self.columns, *columns))

    def with_type(self, name: str, type_: str) -> Contract:
        self._known([name])
        if any(c.name == name and c.levels is not None for c in self.columns):
            raise ContractError(f"{name} is a category; its type follows from its levels")
        return replace(self, columns=tuple(replace(c, type=type_) if c.name == name else c for c in self.columns))

    def as_category(self, name: str, levels: list[str]) -> Contract:
        self._known([name])
        return replace(self, columns=tuple(replace(c, type="string", levels=tuple(levels)) if c.name == name else c for c in self.columns))

    def renamed(self, name: str) -> Contract:
        return replace(self, name=name)

    def excludes(self, names: list[str]) -> None:
        """Refuse a contract that holds any of the names (personal data)."""
        if found := sorted(set(names) & set(self.names)):
            raise ContractError(f"{self.name} must not hold {found}")

    def to_dicts(self) -> list[dict]:
        return [{"name": c.name, "type": c.type, "nullable": c.nullable, "description": c.description, "levels": None if c.levels is None else list(c.levels)} for c in self.columns]

    @staticmethod
    def from_dicts(name: str, dicts: list[dict]) -> Contract:
        return Contract(name, tuple(Column(d["name"], d["type"], d["nullable"], d.get("description", ""), None if d.get("levels") is None else tuple(d["levels"])) for d in dicts))

    def problems(self, df: DataFrame) -> list[str]:
        """Missing, unexpected and mistyped columns, wrong order, nulls and foreign levels, all at once (one aggregate)."""
        out = [f"missing column {c.name}" for c in self.columns if c.name not in df.columns]
        out += [f"unexpected column {n}" for n in df.columns if n not in self.names]
        here = [c for c in self.columns if c.name in df.columns]
        types = dict(df.dtypes)
        out += [f"{c.name} is {types[c.name]}, not {T.DataType.fromDDL(c.type).simpleString()}" for c in here if types[c.name] != T.DataType.fromDDL(c.type).simpleString()]
        if not out and df.columns != self.names:
            out.append("the columns are in another order")
        checks: list[SparkColumn] = [F.sum(F.col(c.name).isNull().cast("long")).alias(f"null:{c.name}") for c in here if not c.nullable]
        checks += [F.sum((F.col(c.name).isNotNull() & within_levels(F.col(c.name), c.levels).isNull()).cast("long")).alias(f"level:{c.name}") for c in here if c.levels is not None]
        if checks:
            for key, n in df.agg(*checks).first().asDict().items():
                kind, _, column = key.partition(":")
                if n:
                    out.append(f"{column} has {n} nulls" if kind == "null" else f"{column} has {n} values outside its levels")
        return out

    def validate(self, df: DataFrame) -> DataFrame:
        if found := self.problems(df):
            raise ContractError(f"{self.name}: " + "; ".join(found))
        return df

    def conform(self, df: DataFrame) -> DataFrame:
        """Require the columns, select them in order, check nulls before casting, cast; foreign levels become null."""
        if missing := [n for n in self.names if n not in df.columns]:
            raise ContractError(f"{self.name}: missing columns {missing}")
        df = df.select(*self.names)
        hard = [F.sum(F.col(c.name).isNull().cast("long")).alias(c.name) for c in self.columns if not c.nullable]
        if hard and (nulls := {k: v for k, v in df.agg(*hard).first().asDict().items() if v}):
            raise ContractError(f"{self.name}: nulls in {nulls}")
        return df.select(*[(within_levels(F.col(c.name), c.levels) if c.levels is not None else F.col(c.name).cast(c.type)).alias(c.name) for c in self.columns])
