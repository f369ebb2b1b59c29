"""Request fields and the columns they become: expansion, omission by type, and drift features of JSON bodies."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeloom.functions.expressions import DAYS_PER_YEAR

# The level of a category that wasn't sent, and the two levels of an indicator.
UNSENT, ABSENT, PRESENT = "__MISSING__", "missing", "present"


class FieldError(ValueError):
    """Fields and columns don't fit each other."""


@dataclass(frozen=True)
class FieldMap:
    """What a model's columns come from: lists of items (field to its items' columns), and fields whose column has another name."""

    columns: tuple[str, ...]
    lists: Mapping[str, tuple[str, ...]]
    renamed: Mapping[str, str]
    required: tuple[str, ...] = ()

    def expanded(self) -> dict[str, tuple[str, ...]]:
        """Each request field with its columns, in the order in which columns first name them. A column that two fields claim is refused, as is a required field without a column."""
        owners: dict[str, set[str]] = {c: set() for c in self.columns}
        for field, items in self.lists.items():
            for c in items:
                if c in owners:
                    owners[c].add(field)
        for field, column in self.renamed.items():
            if field in owners:
                raise FieldError(f"{field} stands for {column}, and is a column of its own")
            if column in owners:
                owners[column].add(field)
        out: dict[str, list[str]] = {}
        for column, fields in owners.items():
            if len(fields) > 1:
                raise FieldError(f"{column} is claimed by {', '.join(sorted(fields))}")
            out.setdefault(next(iter(fields), column), []).append(column)
        if absent := [f for f in self.required if f not in out]:
            raise FieldError(f"no column for the required {', '.join(absent)}")
        return {f: tuple(c) for f, c in out.items()}

    def optional(self) -> list[str]:
        return sorted(set(self.expanded()) - set(self.required))


def omitted_value(kind: str) -> Column:
    """What a column of this type is when its field wasn't sent: a flag is false, an empty list of items; all else is unknown."""
    return F.lit(False) if kind == "boolean" else F.lit(None).cast(kind)


def omit(df: DataFrame, fields: Mapping[str, Sequence[str]], names: Sequence[str], where: Column | None = None) -> DataFrame:
    """``df`` as if the named fields had not been sent; ``where``, an array of flags in the order of ``names``, narrows it to single rows and fields.

    A null flag omits nothing; a name given twice is omitted where either says so. Unknown names are refused, and rows whose flags aren't as many as the names raise.
    """
    if unknown := [n for n in names if n not in fields]:
        raise FieldError(f"unknown fields {unknown}")
    kinds, cells = dict(df.dtypes), "_cells_of_omit"
    while cells in df.columns:
        cells += "_"
    flags: dict[str, Column] = {}
    out = df
    if where is not None:
        fits = F.size(where) == len(names)
        out = df.withColumn(cells, F.when(fits, where).otherwise(F.raise_error(F.lit(f"there must be {len(names)} flags")).cast("array<boolean>")))
    for i, n in enumerate(names):
        here = F.lit(True) if where is None else F.coalesce(F.col(cells)[i], F.lit(False))
        for c in fields[n]:
            flags[c] = flags[c] | here if c in flags else here
    return out.select(*[F.when(flags[c], omitted_value(kinds[c])).otherwise(F.col(c)).alias(c) if c in flags else F.col(c) for c in df.columns])


def random_flags(key: Sequence[Column], names: Sequence[str], seed: str) -> Column:
    """An array of flags for ``omit``: how many fields a row loses is uniform from 1 to all, and which follows from SHA-256 of seed, field and key."""
    text = F.concat_ws("|", *[k.cast("string") for k in key])
    place = lambda name: F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(seed), F.lit(name), text), 256), 1, 13), 16, 10).cast("long")
    n = place("") % len(names) + 1
    ranks = [place(x) for x in names]
    cutoff = F.element_at(F.array_sort(F.array(*ranks)), n.cast("int"))
    return F.array(*[r <= cutoff for r in ranks])


def body_features(df: DataFrame, body: str, as_of: Column, numbers: Sequence[str], categories: Sequence[str], date: str, age: str) -> DataFrame:
    """``df`` with the drift features of its JSON bodies: the age at ``as_of`` of the month in field ``date``, numbers, categories, and an indicator for each number.

    A field that a body doesn't carry, carries as null or as something that is no number is null for a number and UNSENT for a category; the indicators say ``missing`` or
    ``present``. Null and malformed bodies carry nothing.
    """
    fields = "_fields_of_body"
    while fields in df.columns:
        fields += "_"
    sent = df.withColumn(fields, F.from_json(body, "map<string,string>"))
    get = lambda name: F.col(fields)[name]
    values = {age: F.datediff(as_of.cast("date"), F.try_to_timestamp(F.concat(get(date), F.lit("-01")), F.lit("yyyy-MM-dd")).cast("date")) / DAYS_PER_YEAR}
    values |= {n: get(n).try_cast("double") for n in numbers}
    levels = {c: F.coalesce(get(c), F.lit(UNSENT)) for c in categories}
    flags = {f"{n}__missing": F.when(v.isNull(), ABSENT).otherwise(PRESENT) for n, v in values.items()}
    return sent.withColumns(values | levels | flags).drop(fields)
