"""Ridge and boosted-tree models on a log target, by MLlib."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import Imputer, OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeloom.operators.lineage import dealt


def prepared(df: DataFrame, numbers: list[str], categories: list[str]) -> DataFrame:
    """Numbers as doubles with indicators of what is missing; missing categories as a level of their own."""
    return df.select("*", *[F.col(c).isNull().cast("double").alias(f"{c}_missing") for c in numbers], *[F.col(c).cast("double").alias(f"{c}_number") for c in numbers], *[F.coalesce(F.col(c).cast("string"), F.lit("(missing)")).alias(f"{c}_level") for c in categories])


def _stages(numbers: list[str], categories: list[str], one_hot: bool) -> list:
    out = [Imputer(inputCols=[f"{c}_number" for c in numbers], outputCols=[f"{c}_filled" for c in numbers], strategy="mean")]
    out += [StringIndexer(inputCol=f"{c}_level", outputCol=f"{c}_index", handleInvalid="keep", stringOrderType="frequencyDesc") for c in categories]
    if one_hot:
        out.append(OneHotEncoder(inputCols=[f"{c}_index" for c in categories], outputCols=[f"{c}_hot" for c in categories], handleInvalid="keep"))
    columns = [f"{c}_filled" for c in numbers] + [f"{c}_missing" for c in numbers] + [f"{c}_{'hot' if one_hot else 'index'}" for c in categories]
    return [*out, VectorAssembler(inputCols=columns, outputCol="assembled", handleInvalid="keep")]


def fit_ridge(train: DataFrame, target: str, numbers: list[str], categories: list[str], alpha: float = 1.0) -> PipelineModel:
    """Ridge regression of the log target; ``alpha`` penalises the summed loss, so it is divided by the rows."""
    df = prepared(train, numbers, categories).withColumn("label", F.log(target))
    model = LinearRegression(featuresCol="features", labelCol="label", elasticNetParam=0.0, regParam=alpha / max(1, df.count()), standardization=False)
    return Pipeline(stages=[*_stages(numbers, categories, True), StandardScaler(inputCol="assembled", outputCol="features", withMean=False), model]).fit(df)


def fit_trees(train: DataFrame, target: str, numbers: list[str], categories: list[str], rounds: int = 20, depth: int = 5, validation: str | None = None, seed: int = 20251108) -> PipelineModel:
    """Boosted trees on the log target, stopped early on the rows that ``validation`` marks.

    The trees hold their rows in memory, by partition; these are dealt out into parts of a fixed size, so that no task's part grows with the table.
    """
    df = prepared(train, numbers, categories).withColumn("label", F.log(target))
    trees = GBTRegressor(featuresCol="assembled", labelCol="label", maxIter=rounds, maxDepth=depth, stepSize=0.1, maxBins=64, seed=seed, **({"validationIndicatorCol": validation} if validation else {}))
    features = Pipeline(stages=_stages(numbers, categories, False)).fit(df)
    rows = dealt(features.transform(df).select("assembled", "label", *([validation] if validation else [])))
    return PipelineModel([*features.stages, trees.fit(rows)])


def predict(model: PipelineModel, df: DataFrame, numbers: list[str], categories: list[str], name: str = "predicted") -> DataFrame:
    return model.transform(prepared(df, numbers, categories)).withColumn(name, F.exp("prediction")).select(*df.columns, name)
