"""The two suites of the listing pipeline as data: what a frame must be by its contract, and the rules on top of it."""

from __future__ import annotations

from dataclasses import dataclass

from lakeloom.contract import Contract
from lakeloom.operators.expectations import Expectation


@dataclass(frozen=True)
class SuiteParameters:
    """Bounds and tolerances, and which columns they are about."""

    reference: str
    least_price: float
    most_price: float
    least_mileage: float
    most_mileage: float
    min_rows: int
    raw_mostly: float = 0.99
    mileage_mostly: float = 0.999
    filled_mostly: float = 0.9
    required_mostly: float = 0.99
    date: str = "registration_date"
    mileage: str = "mileage_km_raw"
    price: str = "price"
    required: tuple[str, ...] = ("make", "body_type", "equipment_comfort", "equipment_entertainment", "equipment_extra", "equipment_safety")


def contract_rules(contract: Contract) -> list[Expectation]:
    """The columns in order, each column's type, and each column that may not be null."""
    out = [Expectation("columns", None, "columns", values=tuple(contract.names))]
    out += [Expectation(f"{c.name} type", c.name, "type", values=(c.type,)) for c in contract.columns]
    return out + [Expectation(f"{c.name} never null", c.name, "not_null") for c in contract.columns if not c.nullable]


def _filled(p: SuiteParameters) -> list[Expectation]:
    """Enough rows, as rules on columns hold over none, and the fill rates of what bounded rules read and of what is always there."""
    out = [Expectation("rows", None, "rows", low=p.min_rows)]
    out += [Expectation(f"{c} filled", c, "not_null", mostly=p.filled_mostly) for c in (p.date, p.mileage)]
    return out + [Expectation(f"{c} filled", c, "not_null", mostly=p.required_mostly) for c in p.required]


def _bounds(p: SuiteParameters, mostly: float) -> list[Expectation]:
    return [Expectation(f"{p.date} by reference", p.date, "between", high=p.reference, mostly=mostly), Expectation(f"{p.mileage} range", p.mileage, "between", p.least_mileage, p.most_mileage, mostly=p.mileage_mostly)]


def raw_suite(contract: Contract, p: SuiteParameters) -> list[Expectation]:
    """The frame as published (its date parsed): dates after the reference are tolerated up to ``raw_mostly``, as cleaning drops them."""
    return [*contract_rules(contract), *_filled(p), *_bounds(p, p.raw_mostly)]


def interim_suite(contract: Contract, p: SuiteParameters) -> list[Expectation]:
    """The cleaned frame: no date after the reference, and prices in the training range."""
    return [*contract_rules(contract), *_filled(p), *_bounds(p, 1.0), Expectation(f"{p.price} range", p.price, "between", p.least_price, p.most_price)]
