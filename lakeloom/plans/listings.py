"""The listing pipeline from raw rows to evaluated prices, as one function for each stage."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeloom.functions import expressions as X
from lakeloom.operators import baseline, evaluation, rules, splitting
from lakeloom.operators.rules import RowRule


@dataclass(frozen=True)
class Parameters:
    """What the stages depend on."""

    seed: str = "20251108"
    reference: str = "2025-11-08"
    least_price: float = 500.0
    most_price: float = 2_000_000.0
    key: tuple[str, ...] = ("make", "model", "model_version", "mileage_km_raw", "registration_date", "price", "power_kw")
    holdout_country: str = "ES"
    holdout_share: float = 0.4
    least_listings: int = 30
    ratios: tuple[tuple[str, float], ...] = (("train", 0.6), ("validation", 0.1), ("calibration", 0.1), ("test", 0.2))


def row_rules(p: Parameters) -> list[RowRule]:
    date = F.col("registration_date").cast("date")
    return [
        RowRule("scope", (F.col("offer_type") == "U") & ~F.col("is_preregistered") & (F.col("vehicle_type") == "Car")),
        RowRule("date", date.isNull() | (date <= F.lit(p.reference).cast("date"))),
        RowRule("price", F.col("price").between(p.least_price, p.most_price)),
    ]


def cleaned(raw: DataFrame, p: Parameters) -> tuple[DataFrame, DataFrame]:
    """Clean rows with a hashed seller group in place of the seller, and the funnel."""
    key = X.group_key(F.col("seller_company_name"), (F.col("country_code"), "??"))
    df = raw.withColumn("seller_group", X.short_hash(key)).drop("seller_company_name")
    funnel = rules.funnel(df, row_rules(p), p.key)
    kept = rules.keep_first(rules.apply_rules(df, row_rules(p)), p.key, ["id"])
    return kept.withColumn("log_price", F.log("price")), funnel


def split(clean: DataFrame, p: Parameters) -> DataFrame:
    """Rows with their set; a country's held-out groups are a set of their own, the others go by seller group."""
    held = X.held_out(p.seed, F.col("country_code"), p.holdout_country, F.col("seller_group"), p.holdout_share)
    out = splitting.split_by_group(clean, "seller_group", p.seed, p.ratios)
    return out.withColumn("split", F.when(held, "holdout").otherwise(F.col("split")))


def supported(train: DataFrame, df: DataFrame, p: Parameters) -> DataFrame:
    """Rows of makes with enough training listings."""
    return df.join(splitting.levels_with_support(train, "make", p.least_listings).select("make"), "make", "left_semi")


def features(df: DataFrame, p: Parameters) -> DataFrame:
    """Age, weight and first trim token beside the raw columns. A weight that can't be read is refused, not lost."""
    rules.refuse_unparsed(df, "weight_kg", X.parsed_weight(F.col("weight_kg")))
    return df.select("*", X.age_years(F.col("registration_date").cast("date"), p.reference).alias("age"), X.parsed_weight(F.col("weight_kg")).alias("weight"), X.text_tokens(F.col("model_version"), 1).alias("trim"), X.parsed_list(F.col("equipment_comfort")).alias("comfort"))


def evaluated(frames: DataFrame, p: Parameters) -> DataFrame:
    """Baseline errors of the test set by make and price class."""
    own = features(frames, p)
    train = own.where("split = 'train'")
    bucket = F.floor(F.col("age") / 2)
    medians = baseline.fit_medians(train, "make", "model", bucket, "price")
    test = baseline.predict_medians(supported(train, own.where("split = 'test'"), p), medians, "make", "model", bucket)
    test = test.withColumn("price_class", X.bucket(F.col("price"), [0, 5000, 10000, 20000, 40000, 80000]))
    return evaluation.segment_metrics(test, "price", "predicted", ["make", "price_class"], least=20)
