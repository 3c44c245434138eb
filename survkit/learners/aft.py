"""Parametric baseline: accelerated failure time with Weibull errors and censoring, on assembled feature vectors."""

from __future__ import annotations

from pyspark.ml.regression import AFTSurvivalRegression, AFTSurvivalRegressionModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schema as S

#: Whole years are taken at their middle: a time of zero has no logarithm.
MIDDLE = 0.5


def fit(train: DataFrame, features: str = "features", rounds: int = 100) -> AFTSurvivalRegressionModel:
    rows = train.where(F.col(S.DURATION).isNotNull() & F.col(S.EVENT).isNotNull() & (F.col(S.DURATION) >= 0))
    rows = rows.select(features, (F.col(S.DURATION) + F.lit(MIDDLE)).alias("label"), F.col(S.EVENT).cast("double").alias("censor"))
    return AFTSurvivalRegression(featuresCol=features, labelCol="label", censorCol="censor", maxIter=rounds).fit(rows)


def scores(model: AFTSurvivalRegressionModel, test: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, proba): minus the logarithm of the predicted time."""
    return model.transform(test).select(*keys, (-F.log("prediction")).alias("proba"))
