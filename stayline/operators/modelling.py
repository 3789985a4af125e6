"""Classifiers: boosted trees over the feature table, and one over flattened vital sequences."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stayline.functions import arrays
from stayline.operators.boosting import BoostedTrees, Settings, boost
from stayline.schema import MODEL_FEATURES
from stayline.session import materialize


def class_weight(train: DataFrame, label: str = "label") -> DataFrame:
    """One row: positives, negatives and the weight of a positive, negatives / positives (1 without any)."""
    counts = train.agg(F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) != 1).alias("neg"))
    ratio = F.coalesce(F.try_divide(F.col("neg").cast("double"), F.col("pos").cast("double")), F.lit(1.0))
    return counts.select("pos", "neg", ratio.alias("scale_pos_weight"))


def with_weights(df: DataFrame, weight: DataFrame, label: str = "label") -> DataFrame:
    """Add ``weight``: the class weight for positives, 1 for negatives."""
    ratio = weight.select("scale_pos_weight").scalar()
    return df.withColumn("weight", F.when(F.col(label) == 1, ratio).otherwise(1.0))


def fit_tabular(split: DataFrame, features: list[str] = MODEL_FEATURES, settings: Settings = Settings()) -> BoostedTrees:
    """Gradient-boosted trees on the train rows, with as many rounds as give the best AUC on the val rows.

    ``split`` holds filled features, ``label`` and ``split``, and ``encounter_id``, by which each tree's rows are drawn.
    """
    train = split.where(F.col("split") == "train")
    rows = with_weights(split.where(F.col("split") != "test"), class_weight(train)).withColumn(
        "held_out", F.col("split") == "val")
    return boost(rows, list(features), settings, [F.col("encounter_id")])


def positive_probability(probability: Column) -> Column:
    return vector_to_array(probability)[1]


def score_tabular(model: BoostedTrees, rows: DataFrame, output: str = "xgb_score") -> DataFrame:
    """Add the probability of readmission."""
    return model.score(rows, output)


def feature_importances(spark: SparkSession, model: BoostedTrees) -> DataFrame:
    """(feature, importance), most important first."""
    return spark.createDataFrame(model.importances(), "feature string, importance double").orderBy(
        F.col("importance").desc(), "feature"
    )


def _flat_vector() -> Column:
    return array_to_vector(arrays.cells(F.col("steps"))).alias("vector")


def fit_sequences(split: DataFrame, max_iterations: int = 100) -> PipelineModel:
    """A weighted logistic regression over the 288 scaled values of a sequence, fitted on the train rows."""
    train = split.where(F.col("split") == "train")
    rows = with_weights(train, class_weight(train)).select(
        _flat_vector(), F.col("label").cast("double").alias("label"), "weight"
    )
    classifier = LogisticRegression(featuresCol="vector", labelCol="label", weightCol="weight",
                                    maxIter=max_iterations, regParam=0.01, standardization=False)
    return Pipeline(stages=[classifier]).fit(materialize(rows, "training-sequences"))


def score_sequences(model: PipelineModel, rows: DataFrame, output: str = "lstm_score") -> DataFrame:
    """Add the raw probability of readmission for scaled sequences."""
    scored = model.transform(rows.withColumn("vector", _flat_vector()))
    return scored.withColumn(output, positive_probability(F.col("probability"))).drop(
        "vector", "rawPrediction", "probability", "prediction"
    )
