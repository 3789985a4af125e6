"""Score fusion, risk bands and prediction records, under two named policies.

``api`` is the service's policy, ``offline`` that of bulk evaluation. They differ in weights, in what a
missing score means, in the bands and in whether the band looks at the rounded score.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stayline.functions.scores import clip01, risk_band
from stayline.schema import MODEL_VERSION

MODELS = ("xgb", "lstm", "cnn")

# Weights of (xgb, lstm, cnn).
API_WEIGHTS = {
    "all": (0.50, 0.30, 0.20),
    "no image": (0.60, 0.40, 0.00),
    "no sequence": (0.70, 0.00, 0.30),
    "tabular only": (1.00, 0.00, 0.00),
}
OFFLINE_WEIGHTS = {"image model": (0.1, 0.1, 0.8), "no image model": (0.5, 0.5, 0.0)}


def _weights(values: tuple[float, float, float]) -> Column:
    return F.struct(*[F.lit(w).alias(m) for m, w in zip(MODELS, values)])


def api_weights(lstm: Column, cnn: Column) -> Column:
    """Weights by which of the optional scores are present."""
    return (
        F.when(lstm.isNotNull() & cnn.isNotNull(), _weights(API_WEIGHTS["all"]))
        .when(lstm.isNotNull(), _weights(API_WEIGHTS["no image"]))
        .when(cnn.isNotNull(), _weights(API_WEIGHTS["no sequence"]))
        .otherwise(_weights(API_WEIGHTS["tabular only"]))
    )


def fuse(scores: DataFrame, policy: str, cnn_available: bool = False) -> DataFrame:
    """Add ``fusion_score``, ``risk_level`` and ``weights_used`` to xgb / lstm / cnn scores.

    api: weights depend on the scores present; the score is rounded to 4 places and the band is that of the
    rounded score. offline: weights depend on whether the image model is loaded; an image score that is
    missing all the same drops out without re-weighting, so such a score stays below 0.2; the band is that of
    the unrounded score. Scores themselves are shown rounded.
    """
    xgb, lstm, cnn = (F.col(f"{m}_score") for m in MODELS)
    if policy == "api":
        weights = api_weights(lstm, cnn)
    else:
        weights = _weights(OFFLINE_WEIGHTS["image model" if cnn_available else "no image model"])
    weighted = scores.withColumn("_w", weights)
    used_cnn = cnn if policy == "api" or cnn_available else F.lit(None).cast("double")
    total = (
        F.col("_w.xgb") * xgb
        + F.coalesce(F.col("_w.lstm") * lstm, F.lit(0.0))
        + F.coalesce(F.col("_w.cnn") * used_cnn, F.lit(0.0))
    )
    if policy == "api":
        weighted = weighted.withColumn("fusion_score", F.round(total, 4))
        band = risk_band(F.col("fusion_score"), "api")
    else:
        weighted = weighted.withColumn("_exact", clip01(total)).withColumn("fusion_score", F.round("_exact", 4))
        band = risk_band(F.col("_exact"), "offline")
    used = F.create_map(*[x for m in MODELS for x in (F.lit(m), F.col("_w")[m])])
    return weighted.withColumn("risk_level", band).withColumn("weights_used", used).drop("_w", "_exact")


def sequence_score(raw: Column, policy: str, flat: Column | None = None, amplify: bool = False) -> Column:
    """Post-process a sequence model's raw probability.

    api: clipped; NULL when there is none or the sequence is flat. offline: 0.5 when flat, undefined or below
    0.01; ``amplify`` doubles the distance from 0.5, a demo setting; clipped.
    """
    is_flat = F.lit(False) if flat is None else F.coalesce(flat, F.lit(False))
    if policy == "api":
        return F.when(~is_flat & ~F.isnan(raw), clip01(raw))
    stretched = (raw - 0.5) * 2 + 0.5 if amplify else raw
    return F.when(is_flat | raw.isNull() | F.isnan(raw) | (raw < 0.01), 0.5).otherwise(clip01(stretched))


def prediction_record(fused: DataFrame, features: list[str] = (), version: str = MODEL_VERSION) -> DataFrame:
    """The record returned for each encounter: rounded scores, band, weights, version and features used."""
    scores = [F.round(f"{m}_score", 4).alias(f"{m}_score") for m in MODELS]
    used = [F.struct(*features).alias("features_used")] if features else []
    return fused.select(
        "encounter_id", *scores, "fusion_score", "risk_level", "weights_used",
        F.lit(version).alias("model_version"), *used,
    )
