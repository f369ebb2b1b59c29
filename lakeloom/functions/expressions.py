"""Column expressions. All stay in the JVM; none is a UDF."""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

SLOTS = 10_000
DAYS_PER_YEAR = 365.25


def group_key(company: Column, *place: tuple[Column, str]) -> Column:
    """The company, or ``private|`` and the parts of a place, each with what stands for a missing one."""
    return F.coalesce(company, F.concat(F.lit("private|"), F.concat_ws("|", *[F.coalesce(c.cast("string"), F.lit(gap)) for c, gap in place])))


def short_hash(value: Column) -> Column:
    """The first 16 hexadecimal digits of SHA-256."""
    return F.substring(F.sha2(value, 256), 1, 16)


def hash_position(seed: str, *keys: Column) -> Column:
    """A place in [0, 1) that depends on the seed and the keys alone, in steps of a ten-thousandth."""
    h = F.sha2(F.concat_ws("|", F.lit(seed), *[k.cast("string") for k in keys]), 256)
    return (F.conv(F.substring(h, 1, 8), 16, 10).cast("long") % SLOTS) / F.lit(float(SLOTS))


def assign_split(position: Column, ratios: Sequence[tuple[str, float]]) -> Column:
    """The set whose cumulative edge lies beyond the position; the last takes what rounding leaves."""
    if abs(sum(r for _, r in ratios) - 1) > 1e-9:
        raise ValueError("the ratios must sum to 1")
    out, edge = None, 0.0
    for name, ratio in ratios[:-1]:
        edge += ratio
        out = F.when(position < edge, name) if out is None else out.when(position < edge, name)
    last = ratios[-1][0]
    return F.lit(last) if out is None else out.otherwise(last)


def held_out(seed: str, country: Column, wanted: str, key: Column, share: float) -> Column:
    """Whether a row of the wanted country falls into the held-out share of its groups; null countries never do."""
    if not 0 < share <= 1:
        raise ValueError("the share must be in (0, 1]")
    here = F.coalesce(country == wanted, F.lit(False))
    return here if share == 1 else here & (hash_position(seed, F.lit(wanted), key) < share)


def age_years(date: Column, reference: str) -> Column:
    """Whole days up to the reference date in years of 365.25 days."""
    return F.datediff(F.to_date(F.lit(reference)), date) / F.lit(DAYS_PER_YEAR)


def bucket(value: Column, edges: Sequence[float]) -> Column:
    """Left-closed, right-open classes between the edges; ``over`` the last; null and too small have names of their own."""
    out = F.when(value.isNull(), "(missing)").when(value < edges[0], "(invalid)")
    for a, b in zip(edges, edges[1:], strict=False):
        out = out.when(value < b, f"{a:g} to {b:g}")
    return out.otherwise(f"over {edges[-1]:g}")


def whole_months(date: Column, reference: str) -> Column:
    """Complete months from the reference day (at 00:00) to the date."""
    ref = F.to_date(F.lit(reference))
    m = (F.year(date) - F.year(ref)) * 12 + F.month(date) - F.month(ref)
    return m - F.when(F.to_date(date) < F.add_months(ref, m), 1).otherwise(0)


def shifted_month(month: Column, months: Column | int) -> Column:
    """``YYYY-MM`` moved by whole months."""
    return F.date_format(F.add_months(F.to_date(F.concat(month, F.lit("-01"))), months), "yyyy-MM")


def as_of(date: Column, reference: str) -> Column:
    """The reference date moved by the complete months up to the date."""
    return F.add_months(F.to_date(F.lit(reference)), whole_months(date, reference))


#: A weight in kilograms with thousands separators.
WEIGHT = r"^\s*([0-9]{1,3}(?:,[0-9]{3})*)\s*kg\s*$"


def parsed_weight(text: Column) -> Column:
    """Kilograms from text like ``1,945 kg``; null for null and for anything else."""
    return F.when(text.rlike(WEIGHT), F.regexp_replace(F.regexp_extract(text, WEIGHT, 1), ",", "").cast("double"))


def _plain(c: str) -> str:
    return unicodedata.normalize("NFKD", c).encode("ascii", "ignore").decode()


# Compatibility decompositions of all characters that have ASCII in them: to one character, and to several.
_FOLDED = {chr(c): _plain(chr(c)) for c in range(0x80, 0x20000) if not 0xD800 <= c < 0xE000 and _plain(chr(c))}
_ONE = {c: p for c, p in _FOLDED.items() if len(p) == 1}
_SEVERAL = {c: p for c, p in _FOLDED.items() if len(p) > 1}


def folded(text: Column) -> Column:
    """Lower-case ASCII of the compatibility decomposition (NFKD): marks are dropped, and so is all else beyond ASCII."""
    one = F.translate(text, "".join(_ONE), "".join(_ONE.values()))
    several = F.from_json(F.lit(json.dumps(_SEVERAL)), "map<string,string>")
    spelled = F.array_join(F.transform(F.split(one, "(?!^)(?!$)"), lambda c: F.coalesce(F.try_element_at(several, c), c)), "")
    return F.lower(F.regexp_replace(F.when(one.rlike(r"[^\x00-\x7F]"), spelled).otherwise(one), r"[^\x00-\x7F]", ""))


def text_tokens(text: Column, n: int) -> Column:
    """The first ``n`` tokens of the folded text; dots count inside numbers only. No token: null."""
    t = F.regexp_replace(folded(text), r"(?<![0-9])\.|\.(?![0-9])", " ")
    t = F.trim(F.regexp_replace(t, r"[^0-9a-z.]+", " "))
    return F.nullif(F.array_join(F.slice(F.split(t, " +"), 1, n), " "), F.lit(""))


def feature_name(source: str, item: str) -> str:
    """The name of an item's indicator column."""
    plain = "".join(c if c.isascii() else _FOLDED.get(c, "") for c in item).lower()
    return f"{source}_{re.sub('[^0-9a-z]+', '_', plain).strip('_')}"


def parsed_list(text: Column) -> Column:
    """A list of strings written with single or double quotes."""
    return F.from_json(text, "array<string>", {"allowSingleQuotes": "true"})


def multi_hot(items: Column, wanted: Sequence[str], source: str) -> list[Column]:
    """One nullable indicator for each wanted item; a null list gives nulls, unknown items nothing."""
    return [F.array_contains(items, item).alias(feature_name(source, item)) for item in wanted]


def within_levels(value: Column, levels: Sequence[str]) -> Column:
    """The value if it is a declared level, else null."""
    return F.when(value.isin(list(levels)), value)


def level_code(value: Column, levels: Sequence[str]) -> Column:
    """The place of a value among its levels from 0; -1 for null and foreign values."""
    return F.coalesce(F.array_position(F.array(*map(F.lit, levels)), value), F.lit(0)).cast("int") - 1


def in_training_range(prediction: Column, low: float, high: float) -> Column:
    """exp of a log prediction kept within the training range."""
    return F.exp(F.greatest(F.least(prediction, F.lit(high)), F.lit(low)))


def widened(lower: Column, typical: Column, upper: Column) -> tuple[Column, Column]:
    """A range that holds its typical value; nulls stay."""
    return F.when(lower.isNotNull(), F.least(lower, typical)), F.when(upper.isNotNull(), F.greatest(upper, typical))


def relative_error(actual: Column, predicted: Column) -> Column:
    """Absolute error over the absolute actual value; a zero actual gives null."""
    return F.abs(predicted - actual) / F.nullif(F.abs(actual), F.lit(0.0))


def alert_ceiling(n: Column, m: Column) -> Column:
    """How many times the baseline a window's median error may reach."""
    return 1 + 3.55 * F.sqrt(1 / n + 1 / m)


def coverage_floor(p: Column, n: Column) -> Column:
    """The least coverage that chance allows at nominal level ``p``."""
    return p - 2.576 * F.sqrt(p * (1 - p) / n) - 0.5 / n


def effect_percent(effect: Column) -> Column:
    """A log effect in percent."""
    return F.expm1(effect) * 100


def sent_fields(fields: Column) -> Column:
    """Names of the fields of a map that are set."""
    return F.array_sort(F.map_keys(F.map_filter(fields, lambda _, v: v.isNotNull())))


def client_of(client: Column, known: Sequence[str]) -> Column:
    """A known client's name, else null."""
    return F.when(client.isin(list(known)), client)


def size_in_mib(text: Column) -> Column:
    """Sizes like ``157.3MiB`` in MiB."""
    number = F.regexp_extract(text, r"^([0-9.]+)([KMGT]?i?B)$", 1).cast("double")
    unit = F.regexp_extract(text, r"^([0-9.]+)([KMGT]?i?B)$", 2)
    out = None
    for name, factor in {"B": 1 / 1048576, "KiB": 1 / 1024, "MiB": 1.0, "GiB": 1024.0, "TiB": 1048576.0, "kB": 1e3 / 1048576, "KB": 1e3 / 1048576, "MB": 1e6 / 1048576, "GB": 1e9 / 1048576}.items():
        out = F.when(unit == name, number * factor) if out is None else out.when(unit == name, number * factor)
    return out


def mentions_number(text: Column, number: Column) -> Column:
    """Whether a text holds a whole number, written plainly or with a blank, point, comma, apostrophe or no-break space between thousands."""
    grouped = F.regexp_replace(F.format_number(number, 0), ",", "[ .,'\u00a0]?")
    return F.rlike(text, F.concat(F.lit("(?<![0-9])(?<![0-9][.,])"), grouped, F.lit("(?![0-9]|[.,][0-9])")))


def same_digits(a: Column, b: Column) -> Column:
    """Whether two texts hold the same digits in the same order, whatever stands between them."""
    return F.regexp_replace(a, "[^0-9]", "") == F.regexp_replace(b, "[^0-9]", "")


def json_pointer(*parts: Column) -> Column:
    """The JSON pointer to nested keys: ~ and / inside a key are escaped."""
    return F.concat(*[F.concat(F.lit("/"), F.replace(F.replace(p.cast("string"), F.lit("~"), F.lit("~0")), F.lit("/"), F.lit("~1"))) for p in parts])


def typical_price(complete: Column, point: Column, median: Column) -> Column:
    """A complete request has the point estimate, any other the median of its range; the other one where that is null."""
    return F.when(complete, F.coalesce(point, median)).otherwise(F.coalesce(median, point))


#: Metric horsepower in a kilowatt.
HORSEPOWER = 1.35962


def horsepower(kilowatts: Column) -> Column:
    """Whole metric horsepower, halves to even."""
    return F.rint(kilowatts * HORSEPOWER).cast("long")


def same_power(text: Column, kilowatts: Column) -> Column:
    """Whether the digits of a text are the horsepower of a number of kilowatts; null where either is missing or the text has no digit."""
    digits = F.regexp_replace(text, r"\D", "")
    return F.nullif(digits, F.lit("")).try_cast("long") == horsepower(kilowatts)
