"""Generated listings: every value follows from a hash of seed, row and column, so rows don't depend on partitions.

The last rows are edge cases that every generated table holds.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeloom.sources.tables import source

# Shares of makes, countries and fuels.
MAKES = [("Volkswagen", 0.16), ("BMW", 0.12), ("Audi", 0.12), ("Mercedes-Benz", 0.11), ("Ford", 0.10), ("Opel", 0.09), ("Renault", 0.09), ("Peugeot", 0.08), ("Fiat", 0.07), ("Lancia", 0.06)]
COUNTRIES = [("DE", 0.55), ("IT", 0.16), ("ES", 0.12), ("FR", 0.09), ("NL", 0.08)]
FUELS = [("Gasoline", 0.48), ("Diesel", 0.38), ("Electric", 0.06), ("Hybrid", 0.08)]
REFERENCE, SELLER_ROWS = "2025-11-08", 7


def uniform(seed: int, column: str) -> Column:
    """A uniform draw in (0, 1) for a row and a column."""
    return (F.pmod(F.xxhash64(F.lit(f"{seed}|{column}"), F.col("row")), F.lit(1 << 53)) + 0.5) / float(1 << 53)


def normal(seed: int, column: str) -> Column:
    """A standard normal draw (Box and Muller)."""
    return F.sqrt(-2 * F.log(uniform(seed, column + "|a"))) * F.cos(2 * math.pi * uniform(seed, column + "|b"))


def weighted_choice(u: Column, weights: list[tuple[str, float]]) -> Column:
    """A level by its share."""
    out, edge = None, 0.0
    for name, share in weights[:-1]:
        edge += share
        out = F.when(u < edge, name) if out is None else out.when(u < edge, name)
    return F.lit(weights[-1][0]) if out is None else out.otherwise(weights[-1][0])


def maybe_null(u: Column, value: Column, fill: float) -> Column:
    """The value in a share ``fill`` of the rows."""
    return F.when(u < fill, value)


def noise_free_price(age: Column, mileage: Column, power: Column) -> Column:
    return (8000 + 180 * power) * F.exp(-0.09 * age - mileage / 900_000)


def generate_listings(spark: SparkSession, rows: int = 2000, seed: int = 20251108) -> DataFrame:
    """``rows`` listings (30 at least): random ones, then the edge cases."""
    if rows < 30:
        raise ValueError("at least 30 rows are needed")
    edge = _edge_cases(spark)
    n_edge = 12
    r = spark.range(rows - n_edge).withColumnRenamed("id", "row")
    u = lambda c: uniform(seed, c)
    df = r.select(
        F.format_string("L%09d", F.col("row")).alias("id"), weighted_choice(u("make"), MAKES).alias("make"), F.concat(F.lit("Model "), (F.floor(u("model") * u("model") * 12) + 1).cast("string")).alias("model"),
        maybe_null(u("version?"), F.concat_ws(" ", F.format_number(1 + F.floor(u("litres") * 20) / 10, 1), F.element_at(F.array(*map(F.lit, ["TDI", "TSI", "Été", "S line", "Sport"])), (F.floor(u("trim") * 5) + 1).cast("int"))), 0.9).alias("model_version"),
        maybe_null(u("date?"), F.date_format(F.add_months(F.lit("2025-10-01").cast("date"), -F.floor(u("age") * u("age") * 240).cast("int")), "yyyy-MM-dd"), 0.995).alias("registration_date"),
        maybe_null(u("km?"), F.round(F.greatest(F.lit(0.0), 15_000 * 20 * u("age") * u("age") * (1 + 0.3 * normal(seed, "km"))), -1), 0.995).alias("mileage_km_raw"),
        maybe_null(u("kw?"), F.round(F.greatest(F.lit(30.0), F.least(F.lit(450.0), 95 + 40 * normal(seed, "kw")))), 0.98).alias("power_kw"),
        weighted_choice(u("fuel"), FUELS).alias("fuel_category"), weighted_choice(u("country"), COUNTRIES).alias("country_code"), F.format_string("S%06d", F.floor(u("seller") * math.ceil(rows / SELLER_ROWS))).alias("seller_company_name"),
        maybe_null(u("kg?"), F.concat(F.format_number(F.floor(1000 + 900 * u("kg")), 0), F.lit(" kg")), 0.8).alias("weight_kg"),
        F.when(u("equipment") < 0.1, "[]").otherwise(F.concat(F.lit("['Air conditioning'"), F.when(u("e1") < 0.5, ", 'Cruise control'").otherwise(""), F.when(u("e2") < 0.05, ", '19\" wheels'").otherwise(""), F.lit("]"))).alias("equipment_comfort"),
        F.lit("Car").alias("vehicle_type"), F.lit("U").alias("offer_type"), F.lit(False).alias("is_preregistered"), "row",
    )
    age = F.datediff(F.lit(REFERENCE).cast("date"), F.col("registration_date").cast("date")) / 365.25
    price = noise_free_price(F.coalesce(age, F.lit(5.0)), F.coalesce(F.col("mileage_km_raw"), F.lit(80_000.0)), F.coalesce(F.col("power_kw"), F.lit(95.0))) * F.exp(0.12 * normal(seed, "price"))
    return df.withColumn("price", F.round(F.greatest(F.lit(600.0), price), -1)).drop("row").unionByName(edge)


def _edge_cases(spark: SparkSession) -> DataFrame:
    base = {"make": "BMW", "model": "Model 1", "model_version": "2.0 TDI", "registration_date": "2020-05-01", "mileage_km_raw": 60000.0, "power_kw": 110.0, "fuel_category": "Diesel", "country_code": "DE", "seller_company_name": "S999999", "weight_kg": "1,500 kg", "equipment_comfort": "[]", "vehicle_type": "Car", "offer_type": "U", "is_preregistered": False}
    changes = [
        {"registration_date": "2025-12-01"}, {"price": 15000.25}, {"price": 15000.25}, {"country_code": "ES"}, {"make": "Unsupported"}, {"price": 250.0}, {"price": 3_000_000.0}, {"offer_type": "N"},
        {"is_preregistered": True}, {"vehicle_type": "Transporter"}, {"registration_date": None}, {"seller_company_name": None, "price": 500.0},
    ]
    rows = [base | {"id": f"Z{i:09d}", "price": 20000.0 + i + i / 100} | c for i, c in enumerate(changes)]
    schema = "id string, make string, model string, model_version string, registration_date string, mileage_km_raw double, power_kw double, fuel_category string, country_code string, seller_company_name string, weight_kg string, equipment_comfort string, vehicle_type string, offer_type string, is_preregistered boolean, price double"
    names = [c.split()[0] for c in schema.split(", ")]
    return spark.createDataFrame([tuple(r[n] for n in names) for r in rows], schema)


source("synthetic")(generate_listings)
