"""The training jobs: split, fill, fit and evaluate."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stayline.operators import metrics
from stayline.operators import sequences as seq
from stayline.operators.boosting import Settings
from stayline.operators.features import fill_from, training_medians
from stayline.operators.modelling import fit_sequences, fit_tabular, score_sequences, score_tabular
from stayline.operators.split import chronological_split, key_split
from stayline.schema import MODEL_FEATURES, SEQUENCE_VITALS
from stayline.session import materialize
from stayline.sources.bundles import Bundle


def in_train() -> Column:
    return F.col("split") == "train"



@dataclass
class Trained:
    """A bundle, its scored rows (score, label, split) and the metrics of the train and test rows."""

    bundle: Bundle
    scored: DataFrame
    train_metrics: DataFrame
    test_metrics: DataFrame


def prepare_training(training: DataFrame, train_only: bool = False) -> DataFrame:
    """Split by time and fill zeros with the train medians, in all splits or in the train rows only."""
    split = chronological_split(materialize(training, "training-set"))
    return fill_from(split, training_medians(split.where(in_train())), where=in_train() if train_only else None)


def train_tabular(training: DataFrame, settings: Settings = Settings(), train_only: bool = False) -> Trained:
    prepared = materialize(prepare_training(training, train_only), "prepared-training-set")
    model = fit_tabular(prepared, settings=settings)
    scored = score_tabular(model, prepared, "score").select("encounter_id", "score", "label", "split")
    return _evaluated(Bundle(model, "xgb_mimic_v1", MODEL_FEATURES), scored)


def prepare_sequences(sequences: DataFrame, normalise: bool = False) -> tuple[DataFrame, DataFrame]:
    """Training arrays, split by encounter key and scaled with the train rows' statistics, and the scaler.

    ``normalise`` first applies the z-score over all rows. The scaler then fits normalised values, so it must
    not be applied to raw ones.
    """
    rows = materialize(seq.training_sequences(sequences), "sequences")
    if normalise:
        rows = seq.scale(rows, seq.fit_scaler(rows), epsilon=1e-6)
    split = key_split(rows)
    scaler = materialize(seq.fit_scaler(split.where(in_train())), "scaler")
    return seq.scale(split, scaler), scaler


def train_sequences(sequences: DataFrame, normalise: bool = False) -> Trained:
    prepared, scaler = prepare_sequences(sequences, normalise)
    prepared = materialize(prepared, "prepared-sequences")
    model = fit_sequences(prepared)
    scored = score_sequences(model, prepared, "score").select("encounter_id", "score", "label", "split")
    return _evaluated(Bundle(model, "lstm_mimic_v1", SEQUENCE_VITALS, scaler=scaler), scored)


def _evaluated(bundle: Bundle, scored: DataFrame) -> Trained:
    scored = materialize(scored, "scored")
    train = metrics.ranking_metrics(scored.where(in_train()))
    test = metrics.ranking_metrics(scored.where(F.col("split") == "test"))
    row = test.first()
    bundle.test_auc, bundle.test_prauc = row["roc_auc"], row["average_precision"]
    return Trained(bundle, scored, train, test)
