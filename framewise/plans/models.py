"""Classifiers on pyspark.ml: imputation, scaling and weights as plans, models as pipelines."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass
class Model:
    features: list[str]
    inputs: list[str]
    medians: dict[str, float]
    scales: dict[str, tuple[float, float]]
    fitted: object


def _inputs(df: DataFrame, model: Model) -> DataFrame:
    """Missing values by the median with an indicator beside them, then centred and scaled."""
    known = {f: F.when(~F.isnan(F.col(f).cast("double")), F.col(f).cast("double")) for f in model.features}
    columns = {}
    for name in model.inputs:
        f = name.removeprefix("missing_")
        value = known[f].isNull().cast("double") if name.startswith("missing_") and name not in model.features else F.coalesce(known[f], F.lit(model.medians[f]))
        mean, deviation = model.scales.get(name, (0.0, 1.0))
        columns[f"_in_{name}"] = (value - mean) / (deviation or 1.0)
    return VectorAssembler(inputCols=[f"_in_{n}" for n in model.inputs], outputCol="_features").transform(df.withColumns(columns)).drop(*columns)


def _prepared(df: DataFrame, features: list[str], indicators: bool, scale: bool) -> Model:
    """One pass for medians and missing values, one for means and population deviations."""
    known = {f: F.when(~F.isnan(F.col(f).cast("double")), F.col(f).cast("double")) for f in features}
    told = df.agg(*[F.percentile(known[f], F.lit(0.5)).alias(f"m_{k}") for k, f in enumerate(features)], *[F.max(known[f].isNull().cast("int")).alias(f"n_{k}") for k, f in enumerate(features)]).first()
    medians = {f: told[f"m_{k}"] if told[f"m_{k}"] is not None else 0.0 for k, f in enumerate(features)}
    inputs = [*features, *[f"missing_{f}" for k, f in enumerate(features) if indicators and told[f"n_{k}"]]]
    model = Model(features, inputs, medians, {}, None)
    if scale:
        value = lambda n: known[n.removeprefix("missing_")].isNull().cast("double") if n not in features else F.coalesce(known[n], F.lit(medians[n]))
        stats = df.agg(*[x for k, n in enumerate(inputs) for x in (F.avg(value(n)).alias(f"a_{k}"), F.stddev_pop(value(n)).alias(f"s_{k}"))]).first()
        model.scales = {n: (stats[f"a_{k}"], stats[f"s_{k}"]) for k, n in enumerate(inputs)}
    return model


def logistic(df: DataFrame, features: list[str], label: str = "label", c: float = 1.0, balanced: bool = False, indicators: bool = True, iterations: int = 200) -> Model:
    """Ridge logistic regression on imputed, standardised inputs; ``c`` weighs the loss of all rows against the
    penalty, so the regularisation per row is 1 / (c * rows)."""
    model = _prepared(df, features, indicators, True)
    counts = {r[0]: r[1] for r in df.groupBy(F.col(label).cast("int")).count().collect()}
    n = sum(counts.values())
    rows = _inputs(df, model).withColumn("_label", F.col(label).cast("double"))
    learner = LogisticRegression(featuresCol="_features", labelCol="_label", regParam=1 / (c * n), elasticNetParam=0.0, standardization=False, maxIter=iterations)
    if balanced:
        weight = F.lit(1.0)
        for k, m in counts.items():
            weight = F.when(F.col("_label") == k, n / (len(counts) * m)).otherwise(weight)
        rows, learner = rows.withColumn("_weight", weight), learner.setWeightCol("_weight")
    model.fitted = learner.fit(rows)
    return model


def boosted(df: DataFrame, features: list[str], label: str = "label", trees: int = 100, depth: int = 3, rate: float = 0.05, leaf: int = 5) -> Model:
    """Gradient-boosted trees with missing indicators."""
    model = _prepared(df, features, True, False)
    rows = _inputs(df, model).withColumn("_label", F.col(label).cast("double"))
    learner = GBTClassifier(featuresCol="_features", labelCol="_label", maxIter=trees, maxDepth=depth, stepSize=rate, subsamplingRate=0.8, featureSubsetStrategy="0.8", minInstancesPerNode=leaf, seed=42)
    model.fitted = learner.fit(rows)
    return model


def learner(kind: str, quick: bool = False):
    """The fit behind a variant's learner name: a balanced linear model, or boosted trees with missing indicators in
    place of a route for missing values, with the depth, rate and number of trees of either kind."""
    if kind == "logreg":
        return lambda df, features: logistic(df, features, balanced=True, indicators=False, iterations=400)
    if kind == "hgb":
        return lambda df, features: boosted(df, features, trees=40 if quick else 150, depth=4, rate=0.1, leaf=40)
    if kind == "xgb":
        return lambda df, features: boosted(df, features, trees=80 if quick else 300, depth=4, rate=0.08, leaf=5)
    raise ValueError(f"no learner is named {kind}")


def predict(model: Model, df: DataFrame) -> DataFrame:
    """The rows with ``score``, the probability of class 1."""
    out = model.fitted.transform(_inputs(df, model))
    return out.withColumn("score", vector_to_array("probability")[1]).drop("_features", "rawPrediction", "probability", "prediction")


def coefficients(model: Model) -> list[tuple[str, float]]:
    """Inputs by signed coefficient, or by importance for trees, largest first."""
    values = model.fitted.coefficients if hasattr(model.fitted, "coefficients") else model.fitted.featureImportances
    return sorted(zip(model.inputs, values.toArray().tolist(), strict=True), key=lambda x: (-x[1], x[0]))
