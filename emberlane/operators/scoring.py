"""Learned scores: a text classifier of two models whose probabilities are blended, and pluggable scorers."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import IDF, HashingTF, RegexTokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from emberlane.operators import recurrent


def fit_text_classifier(df: DataFrame, text: str, label: str, features: int = 4096, trees: int = 20) -> PipelineModel:
    """TF-IDF with a random forest and a logistic regression."""
    return Pipeline(
        stages=[
            RegexTokenizer(inputCol=text, outputCol="_tokens", pattern=r"\W+"),
            HashingTF(inputCol="_tokens", outputCol="_tf", numFeatures=features),
            IDF(inputCol="_tf", outputCol="_x"),
            RandomForestClassifier(labelCol=label, featuresCol="_x", probabilityCol="_rf", predictionCol="_rfp", rawPredictionCol="_rfr", numTrees=trees, seed=7),
            LogisticRegression(labelCol=label, featuresCol="_x", probabilityCol="_lr", predictionCol="_lrp", rawPredictionCol="_lrr", regParam=0.01),
        ]
    ).fit(df)


def ml_score(df: DataFrame, model: PipelineModel, forest_weight: float = 0.4) -> DataFrame:
    """Adds ``ml_score``, the blended probability of the positive class."""
    out = model.transform(df).withColumn("ml_score", forest_weight * vector_to_array("_rf")[1] + (1 - forest_weight) * vector_to_array("_lr")[1])
    return out.select(*df.columns, "ml_score")


def plug_in(df: DataFrame, text: str, score: Callable[[list[str]], list[float]], fallback: float | None = None) -> DataFrame:
    """Adds ``plugin_score`` and ``plugin_error`` from any batch scorer.

    Where a fallback is given, a batch that fails gets it, and says why; without one the failure is raised.
    """

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in batches:
            try:
                values, error = score(s.fillna("").tolist()), None
            except Exception as e:
                if fallback is None:
                    raise
                values, error = [fallback] * len(s), f"{type(e).__name__}: {e}"
            yield pd.DataFrame({"score": pd.Series(values, dtype=float), "error": pd.Series([error] * len(s), dtype="string")})

    scored = F.pandas_udf(run, "score double, error string", F.PandasUDFType.SCALAR_ITER)(F.col(text))
    return df.withColumn("_p", scored).select(*df.columns, F.col("_p.score").alias("plugin_score"), F.col("_p.error").alias("plugin_error"))


FEATURES = ("iat", "payload", "risk", "depth", "fanout", "distinct_tools", "resource_freq")


def sequence_windows(features: DataFrame, rows: int = 10, decay: float = 0.9) -> DataFrame:
    """Adds ``sequence``, the last rows of features up to each step, whose risks fade with distance, and ``n_rows``."""
    near = Window.partitionBy("session_id").orderBy("step").rowsBetween(1 - rows, 0)
    df = features.withColumn("_seq", F.collect_list(F.array(*[F.col(c).cast("double") for c in FEATURES])).over(near))
    faded = F.transform("_seq", lambda r, i: F.transform(r, lambda v, k: F.when(k == 2, v * F.pow(F.lit(decay), F.size("_seq") - 1 - i)).otherwise(v)))
    return df.withColumn("n_rows", F.size("_seq")).withColumn("sequence", faded).drop("_seq")


BLOCK_AT = 0.98


def sequence_score(features: DataFrame, weights: recurrent.Weights | None = None, rows: int = 10, decay: float = 0.9) -> DataFrame:
    """Adds ``n_rows``, ``probability``, ``available`` and ``blocked`` of the recurrent model over the last rows of features.

    Without weights nothing is blocked: probability 0 and not available.
    """
    df = sequence_windows(features, rows, decay)
    if weights is None:
        return df.drop("sequence").withColumn("probability", F.lit(0.0)).withColumn("available", F.lit(False)).withColumn("blocked", F.lit(False))
    out = recurrent.score(df, "sequence", weights)
    return out.withColumn("available", F.lit(True)).withColumn("blocked", F.col("probability") >= BLOCK_AT)
