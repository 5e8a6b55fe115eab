"""Feature coding and two-stage models on the ml library."""

from __future__ import annotations

from functools import reduce

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.evaluation import MulticlassClassificationEvaluator, RegressionEvaluator
from pyspark.ml.feature import OneHotEncoder, QuantileDiscretizer, StringIndexer, VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import etl


def label_encoded(df: DataFrame, column: str, code: str, back: str) -> DataFrame:
    """Adds the number of each value in alphabetical order, and the value read back from the number; null has neither.

    The labels are a table that is joined by key both ways, however many there are.
    """
    labels = etl.numbered(df, column, code).withColumn(code, F.col(code).cast("int"))
    coded = df.join(labels, column, "left")
    return coded.join(labels.select(code, F.col(column).alias(back)), code, "left").select(*df.columns, code, back)


def fitted(stages: list, df: DataFrame) -> tuple[list, DataFrame]:
    """The stages' models, each fitted on what those before made of ``df``, and what all make of it."""
    models = []
    for stage in stages:
        models.append(stage.fit(df) if hasattr(stage, "fit") else stage)
        df = models[-1].transform(df)
    return models, df


def applied(models: list, df: DataFrame) -> DataFrame:
    return reduce(lambda rows, m: m.transform(rows), models, df)


def binned(df: DataFrame, column: str, name: str, bins: int) -> DataFrame:
    return QuantileDiscretizer(inputCol=column, outputCol=name, numBuckets=bins, handleInvalid="keep").fit(df).transform(df).withColumn(name, F.col(name).cast("int"))


def features(categories: list[str], numbers: list[str]) -> list:
    """Stages that code categories one-hot and put all features into one vector."""
    index = [StringIndexer(inputCol=c, outputCol=f"{c}_i", handleInvalid="keep") for c in categories]
    hot = [OneHotEncoder(inputCol=f"{c}_i", outputCol=f"{c}_v") for c in categories]
    return [*index, *hot, VectorAssembler(inputCols=[f"{c}_v" for c in categories] + numbers, outputCol="features")]


def split(df: DataFrame, id_col: str, share: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """(train, test) by a hash of the id, the same in every run."""
    place = F.pmod(F.xxhash64(id_col), F.lit(1000))
    return df.filter(place < 1000 * share), df.filter(place >= 1000 * share)


def outcome_metrics(df: DataFrame, categories: list[str], numbers: list[str], outcome: str, duration: str, id_col: str) -> DataFrame:
    """(metric, value): accuracy, precision and recall of the outcome, mean absolute error of the duration that takes it as input."""
    train, test = split(df, id_col)
    stages = [*features(categories, numbers), StringIndexer(inputCol=outcome, outputCol="label", handleInvalid="keep"), LogisticRegression(maxIter=20, predictionCol="outcome_p", probabilityCol="outcome_v", rawPredictionCol="outcome_r")]
    stages += [VectorAssembler(inputCols=["features", "outcome_v"], outputCol="features_2"), LinearRegression(featuresCol="features_2", labelCol=duration, predictionCol="duration_p", maxIter=20, regParam=0.1)]
    done = applied(fitted(stages, train)[0], test)
    grade = lambda m: MulticlassClassificationEvaluator(labelCol="label", predictionCol="outcome_p", metricName=m).evaluate(done)
    rows = [(m, float(grade(m))) for m in ("accuracy", "weightedPrecision", "weightedRecall")]
    rows.append(("mae", float(RegressionEvaluator(labelCol=duration, predictionCol="duration_p", metricName="mae").evaluate(done))))
    return df.sparkSession.createDataFrame(rows, "metric string, value double")


def phase_starts(df: DataFrame, days: list[str], this_year: int) -> DataFrame:
    """Adds the start year of each later phase: this year and the rounded years of the phases before, one at least."""
    def start(so_far: list[str]) -> Column:
        total = reduce(Column.__add__, [F.col(d) for d in so_far])
        return (this_year + F.greatest(F.lit(1), F.bround(total / 365.0, 0))).cast("long")

    return df.withColumns({f"phase_{i + 2}": start(days[: i + 1]) for i in range(len(days))})
