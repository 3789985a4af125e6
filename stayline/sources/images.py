"""Images and the brightness rule."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

BRIGHT = 120.0  # fixed value: mean brightness above which an image counts as normal


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """(path, image): decoded images; one that cannot be decoded has ``nChannels`` -1."""
    return spark.read.format("image").load(path).select(F.col("image.origin").alias("path"), "image")


@F.pandas_udf(DoubleType())
def mean_brightness(channels: pd.Series, data: pd.Series) -> pd.Series:
    """Mean over all pixels of the colour channels; the alpha byte of four-channel pixels is left out."""

    def mean(n: int, raw: bytes) -> float | None:
        if raw is None or n is None or n < 1 or len(raw) == 0:
            return None
        pixels = np.frombuffer(raw, dtype=np.uint8)
        return float(pixels.reshape(-1, 4)[:, :3].mean() if n == 4 else pixels.mean())

    return pd.Series([mean(n, raw) for n, raw in zip(channels, data)], dtype="float64")


def brightness_score(image: Column) -> Column:
    """0.1 for bright images, 0.9 for dark ones, NULL if undecodable. A demo rule, not a clinical one."""
    brightness = mean_brightness(image["nChannels"], image["data"])
    return F.when(brightness > BRIGHT, 0.1).when(brightness.isNotNull(), 0.9)
