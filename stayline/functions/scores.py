"""Score arithmetic: squashing, clipping, rounding, risk bands and display values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Upper bounds (exclusive) of the LOW and MEDIUM bands under each policy.
BAND_BOUNDS = {"api": (0.50, 0.54), "offline": (0.3, 0.7)}
BAND_LABELS = {"LOW": "Low Risk", "MEDIUM": "Medium Risk", "HIGH": "High Risk"}


def sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def clip01(x: Column) -> Column:
    """Limited to 0..1; NULL stays NULL, which ``greatest`` alone would turn into 0."""
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0)))


def finite_or(x: Column, nan: float = 0.0, high: float | None = None, low: float | None = None) -> Column:
    """NaN and the infinities replaced by constants, all by ``nan`` unless given; NULL stays NULL."""
    inf = float("inf")
    return (
        F.when(F.isnan(x), F.lit(nan))
        .when(x == F.lit(inf), F.lit(nan if high is None else high))
        .when(x == F.lit(-inf), F.lit(nan if low is None else low))
        .otherwise(x)
    )


def zero_to_missing(x: Column) -> Column:
    return F.nullif(x.cast("double"), F.lit(0.0))


def risk_band(score: Column, policy: str) -> Column:
    """LOW / MEDIUM / HIGH; a NULL score has no band."""
    low, medium = BAND_BOUNDS[policy]
    return F.when(score.isNull(), None).when(score < low, "LOW").when(score < medium, "MEDIUM").otherwise("HIGH")


def percent(x: Column) -> Column:
    """A share as a whole percentage, halves rounded up."""
    return F.floor(x * 100 + F.lit(0.5)).cast("int")


def band_label(band: Column) -> Column:
    label = F.lit("Unknown")
    for name, text in BAND_LABELS.items():
        label = F.when(band == name, text).otherwise(label)
    return label


def path_score(path: Column, model_available: bool = True) -> Column:
    """Image score read off the file name. A demo rule, not a clinical one; first match wins."""
    if not model_available:
        return F.lit(None).cast("double")
    name = F.lower(path)
    return (
        F.when(path.isNull(), None)
        .when(name.contains("pneumonia") | name.contains("virus"), 0.9)
        .when(name.contains("normal"), 0.2)
        .otherwise(0.5)
    )
