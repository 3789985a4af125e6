"""Bulk scoring: every requested encounter in one job, with a status instead of an error."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stayline.operators import sequences as seq
from stayline.operators.fusion import fuse, sequence_score
from stayline.operators.modelling import score_sequences, score_tabular
from stayline.schema import MODEL_FEATURES, SERVED_FEATURES
from stayline.sources.bundles import Bundle

OK, NO_FEATURES, NO_MODEL = "ok", "no features", "no model"
NEUTRAL = 0.5
LATENESS = "INTERVAL '30' DAY"  # by how much encounters may arrive out of order


def align_features(features: DataFrame, wanted: list[str] = MODEL_FEATURES,
                   serving_defaults: bool = False) -> DataFrame:
    """(encounter_id, wanted features as doubles): missing columns and NULLs are 0.

    ``serving_defaults`` also sets the features to 0 that the scoring service does not read.
    """
    readable = set(features.columns) & set(SERVED_FEATURES) if serving_defaults else set(features.columns)

    def value(name: str) -> Column:
        return F.coalesce(F.col(name).cast("double"), F.lit(0.0)) if name in readable else F.lit(0.0)

    return features.select("encounter_id", *[value(c).alias(c) for c in wanted])


def tabular_scores(wanted: DataFrame, features: DataFrame, bundle: Bundle | None, policy: str = "api",
                   serving_defaults: bool = False) -> DataFrame:
    """Wanted encounters with their aligned features, ``xgb_score`` and ``status``.

    Without a feature row the offline score is a neutral 0.5 and the api status ``no features``.
    """
    columns = bundle.feature_cols if bundle else MODEL_FEATURES
    aligned = align_features(features, columns, serving_defaults)
    if bundle:
        scored = score_tabular(bundle.model, aligned)
    else:
        scored = aligned.withColumn("xgb_score", F.lit(None).cast("double"))
    joined = wanted.select("encounter_id").join(scored.withColumn("_found", F.lit(True)), "encounter_id", "left")
    if policy == "offline":
        joined = joined.withColumn("xgb_score", F.when(F.col("_found"), F.col("xgb_score")).otherwise(NEUTRAL))
    no_features = F.lit(policy == "api") & F.col("_found").isNull()
    status = (
        F.when(no_features, NO_FEATURES).when(F.col("xgb_score").isNull(), NO_MODEL).otherwise(OK)
    )
    return joined.withColumn("status", status).drop("_found")


def sequence_scores(sequences: DataFrame, vitals: DataFrame, bundle: Bundle | None, policy: str = "api",
                    amplify: bool = False) -> DataFrame:
    """(encounter_id, lstm_score) for every encounter with vitals."""
    prepared = seq.inference_sequences(seq.resolve_sequences(sequences, vitals, policy), policy)
    if bundle is None:
        return prepared.select("encounter_id", F.lit(None).cast("double").alias("lstm_score"))
    scaled = seq.scale(prepared, bundle.scaler) if bundle.scaler is not None else prepared
    scored = score_sequences(bundle.model, scaled, "_raw")
    flat = seq.offline_flat(F.col("steps")) if policy == "offline" else F.col("flat")
    return scored.select("encounter_id", sequence_score(F.col("_raw"), policy, flat, amplify).alias("lstm_score"))


def score_batch(wanted: DataFrame, features: DataFrame, sequences: DataFrame, vitals: DataFrame,
                tabular: Bundle | None, sequence: Bundle | None, images: DataFrame | None = None,
                policy: str = "api", cnn_available: bool = False, amplify: bool = False,
                serving_defaults: bool = False) -> DataFrame:
    """Fused scores for all wanted encounters; those that cannot be scored carry a ``status`` and no score.

    ``images`` holds (encounter_id, cnn_score), at most one row per encounter. Features, sequences and vitals are
    reduced to the wanted encounters before anything is computed from them.
    """
    keys = wanted.select("encounter_id").distinct()
    features, sequences, vitals = (df.join(keys, "encounter_id", "left_semi") for df in (features, sequences, vitals))
    rows = tabular_scores(wanted, features, tabular, policy, serving_defaults)
    rows = rows.join(sequence_scores(sequences, vitals, sequence, policy, amplify), "encounter_id", "left")
    if policy == "offline":
        rows = rows.fillna(NEUTRAL, ["lstm_score"])
    if images is None:
        rows = rows.withColumn("cnn_score", F.lit(None).cast("double"))
    else:
        rows = rows.join(images.select("encounter_id", "cnn_score"), "encounter_id", "left")
    return fuse(rows, policy, cnn_available)


def scored_only(rows: DataFrame) -> DataFrame:
    """Rows that could be scored; a failed encounter does not fail the batch."""
    return rows.where(F.col("status") == OK)


def unscored(encounters: DataFrame, log: DataFrame | None, scored_to=None, lateness: str = LATENESS) -> DataFrame:
    """Encounters that aren't in ``log`` (encounter_id), of those admitted since ``scored_to`` less ``lateness``.

    The time bounds what is read; the log decides. Encounters without a time are always looked at.
    """
    recent = encounters
    if scored_to is not None:
        since = F.lit(scored_to).cast("timestamp_ntz") - F.expr(lateness)
        recent = encounters.where(F.col("admit_time").isNull() | (F.col("admit_time") >= since))
    # the files of a log are so much smaller than its rows that Spark would broadcast millions of keys
    return recent if log is None else recent.join(log.select("encounter_id").hint("merge"), "encounter_id", "left_anti")
