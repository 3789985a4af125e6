"""Model bundles: a fitted model with a row of metadata next to it."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession

from stayline.operators.boosting import BoostedTrees
from stayline.schema import SEQUENCE_HOURS

METADATA = "version string, feature_cols array<string>, seq_length int, test_auc double, test_prauc double"


@dataclass
class Bundle:
    """A fitted model, the columns it reads, and its test metrics; a sequence model also has its scaler."""

    model: PipelineModel | BoostedTrees
    version: str
    feature_cols: list[str]
    test_auc: float | None = None
    test_prauc: float | None = None
    scaler: DataFrame | None = None


def save_bundle(spark: SparkSession, bundle: Bundle, path: str) -> None:
    if isinstance(bundle.model, BoostedTrees):
        bundle.model.save(spark, f"{path}/model")
    else:
        bundle.model.write().overwrite().save(f"{path}/model")
    row = (bundle.version, bundle.feature_cols, SEQUENCE_HOURS, bundle.test_auc, bundle.test_prauc)
    spark.createDataFrame([row], METADATA).write.mode("overwrite").parquet(f"{path}/metadata")
    if bundle.scaler is not None:
        bundle.scaler.write.mode("overwrite").parquet(f"{path}/scaler")


def load_bundle(spark: SparkSession, path: str) -> Bundle | None:
    """The bundle, or None when there is none at ``path``: the model is then unavailable."""
    if not exists(spark, f"{path}/metadata"):
        return None
    meta = spark.read.parquet(f"{path}/metadata").first()
    scaler = spark.read.parquet(f"{path}/scaler") if exists(spark, f"{path}/scaler") else None
    boosted = exists(spark, f"{path}/model/trees")
    model = BoostedTrees.load(spark, f"{path}/model") if boosted else PipelineModel.load(f"{path}/model")
    return Bundle(model, meta["version"], list(meta["feature_cols"]),
                  meta["test_auc"], meta["test_prauc"], scaler)


def exists(spark: SparkSession, path: str) -> bool:
    hadoop_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop_path)
