"""Every operator as a query over the test tables: ``name -> callable(spark, sf_dir)``.

Means and other results of floating-point sums are rounded to 6 places, because the order of summation differs
between engines and partitionings.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stayline.functions import parsing, scores
from stayline.operators import (
    cohort, features, fusion, loading, metrics, modelling, quality, reports, scoring,
)
from stayline.operators import sequences as seq
from stayline.operators.boosting import Settings
from stayline.operators.split import chronological_split, key_split, split_summary
from stayline.plans import ingest, testdata, training
from stayline.plans import scoring as scoring_job
from stayline.plans.testdata import raw_extracts, typed_tables
from stayline.schema import MODEL_FEATURES, SEQUENCE_VITALS, TABLES
from stayline.session import materialize, scratch_path
from stayline.sources import bundles, documents, extracts, images, tables
from stayline.streaming import events as streams

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

SAMPLE_CAP = 3_000
_TRAINED: dict[tuple[str, str], training.Trained] = {}


def query(run: Query) -> Query:
    QUERIES[run.__name__] = run
    return run


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


def labels(spark, sf_dir):
    return cohort.readmission_label(testdata.encounter(spark, sf_dir))


def feature_table(spark, sf_dir):
    tables_in = typed_tables(spark, sf_dir) | {"diagnosis": testdata.coded_diagnosis(spark, sf_dir)}
    return features.encounter_features(tables_in)


def training_rows(spark, sf_dir, feature_rows=None):
    """The training set; ``feature_rows``: the feature table, where it is at hand."""
    if feature_rows is None:
        feature_rows = feature_table(spark, sf_dir)
    return features.training_set(feature_rows, labels(spark, sf_dir))


def trained_tabular(spark, sf_dir, feature_rows=None) -> training.Trained:
    """The tabular model of these tables, trained once per application."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _TRAINED:
        _TRAINED[key] = training.train_tabular(training_rows(spark, sf_dir, feature_rows))
    return _TRAINED[key]


def sequence_table(spark, sf_dir):
    return seq.vital_sequence(
        testdata.icu_stay(spark, sf_dir), testdata.vital_sign(spark, sf_dir), labels(spark, sf_dir)
    )


def scored_labels(spark, sf_dir, score="xgb_score"):
    """Labels with a score: the given column of the score table, or the number of prior admissions."""
    if score == "num_prior_admissions":
        scored = cohort.prior_admissions(testdata.encounter(spark, sf_dir))
    else:
        scored = testdata.score_input(spark, sf_dir)
    return (
        labels(spark, sf_dir).select("encounter_id", F.col("readmitted_30d").alias("label"))
        .join(scored.select("encounter_id", F.col(score).cast("double").alias("score")), "encounter_id")
    )


def by_step(df: DataFrame, *keep: str) -> DataFrame:
    """48 x 6 arrays as one row per step, with rounded values."""
    exploded = df.select("encounter_id", *keep, F.posexplode("steps").alias("pos", "step"))
    return exploded.select("encounter_id", *keep, "pos",
                           *[F.round(F.col("step")[i], 6).alias(v) for i, v in enumerate(SEQUENCE_VITALS)])


# --- sources and sinks -----------------------------------------------------------------------


@query
def csv_extract_scan(spark, sf_dir):
    root = scratch_path(spark, "raw")
    extracts.write_extract(testdata.raw_admissions(spark, sf_dir), root, "admissions")
    return loading.load_admissions(extracts.read_extract(spark, root, "admissions"))


@query
def csv_event_scan(spark, sf_dir):
    root = scratch_path(spark, "raw")
    extracts.write_extract(testdata.raw_chartevents(spark, sf_dir), root, "chartevents", compressed=False)
    return loading.load_vitals(extracts.read_extract(spark, root, "chartevents"))


@query
def table_append(spark, sf_dir):
    root = scratch_path(spark, "tables")
    rows = testdata.medication(spark, sf_dir)
    tables.append_table(rows.where("route = 'O'"), root, "medication")
    tables.append_table(rows.where("false"), root, "medication")
    tables.append_table(rows.where("route <> 'O'"), root, "medication")
    return tables.read_table(spark, root, "medication")


@query
def table_reload(spark, sf_dir):
    root = scratch_path(spark, "tables")
    tables.reload_tables({"patient": testdata.patient(spark, sf_dir).where("gender = 'M'")}, root)
    tables.reload_tables({"patient": testdata.patient(spark, sf_dir)}, root)
    return tables.read_table(spark, root, "patient")


@query
def failed_reload(spark, sf_dir):
    """Counts of all tables after a load of five, of which the last one fails: those of the load before."""
    root = scratch_path(spark, "tables")
    own = typed_tables(spark, sf_dir)
    tables.reload_tables(own, root)
    broken = own["vital_sign"].withColumn("unit", F.when(F.col("encounter_id") > 0, F.raise_error(F.lit("broken"))))
    changed = {name: own[name].where("encounter_id % 2 = 0") for name in ("encounter", "icu_stay", "diagnosis", "medication")}
    try:
        tables.reload_tables(changed | {"vital_sign": broken}, root)
    except Exception as e:
        if "broken" not in str(e):
            raise
    return reports.table_counts(tables.read_tables(spark, root, *own))


@query
def partition_reload(spark, sf_dir):
    path = f"{scratch_path(spark, 'tables')}/medication"
    rows = testdata.medication(spark, sf_dir).select("encounter_id", "drug_name", "route")
    tables.reload_partitions(rows, path, "route")
    tables.reload_partitions(rows.where("route = 'F'").withColumn("drug_name", F.upper("drug_name")), path, "route")
    return spark.read.parquet(path)


@query
def prediction_log_append(spark, sf_dir):
    root = scratch_path(spark, "tables")
    tables.append_predictions(fusion.fuse(testdata.score_input(spark, sf_dir), "api"), root)
    return tables.read_table(spark, root, "risk_prediction").drop("predicted_at")


@query
def embedding_lookup(spark, sf_dir):
    found = documents.find_documents(
        testdata.embedding_doc(spark, sf_dir), testdata.encounter(spark, sf_dir), embedding_type="cnn"
    )
    return found.select("encounter_id", "embedding_type", "vector")


@query
def note_lookup(spark, sf_dir):
    linked = documents.find_documents(testdata.note_doc(spark, sf_dir), testdata.encounter(spark, sf_dir))
    return linked.select("encounter_id", "note_type", "text")


@query
def model_bundle(spark, sf_dir):
    """Train, save and load: rows scored, and scores that the loaded model gives otherwise."""
    path = scratch_path(spark, "bundle")
    features_in = materialize(feature_table(spark, sf_dir), "features")  # for training and for scoring
    own = trained_tabular(spark, sf_dir, features_in).bundle
    bundles.save_bundle(spark, own, path)
    wanted = testdata.encounter(spark, sf_dir)
    before, after = (
        scoring.tabular_scores(wanted, features_in, b).select("encounter_id", F.col("xgb_score").alias(name), "status")
        for name, b in (("before", own), ("after", bundles.load_bundle(spark, path)))
    )
    both = before.join(after.drop("status"), "encounter_id")
    return both.groupBy("status").agg(
        F.count("*").alias("rows"), F.count_if(~F.col("before").eqNullSafe(F.col("after"))).alias("changed"))


@query
def present_columns(spark, sf_dir):
    wanted = [*TABLES["lab_result"].names, "storetime", "comments"]
    return parsing.select_present(testdata.lab_result(spark, sf_dir).drop("value"), wanted)


def _ingested(spark, sf_dir, cap=None):
    root = scratch_path(spark, "ingest")
    for name, df in raw_extracts(spark, sf_dir).items():
        extracts.write_extract(df, f"{root}/raw", name)
    return ingest.run_ingest(spark, f"{root}/raw", f"{root}/tables", cap=cap)


@query
def ingest_summary(spark, sf_dir):
    """The whole ingest: CSV extracts written, loaded into tables and counted."""
    return _ingested(spark, sf_dir)


@query
def sampled_ingest_summary(spark, sf_dir):
    """The same for a stratified sample of encounters."""
    return _ingested(spark, sf_dir, SAMPLE_CAP)


# --- loaders ---------------------------------------------------------------------------------


@query
def loaded_patients(spark, sf_dir):
    return loading.load_patients(testdata.raw_patients(spark, sf_dir))


@query
def loaded_encounters(spark, sf_dir):
    return loading.load_admissions(testdata.raw_admissions(spark, sf_dir))


@query
def loaded_icu_stays(spark, sf_dir):
    return rounded(loading.load_icu_stays(testdata.raw_icustays(spark, sf_dir)), "los_hours")


@query
def loaded_diagnoses(spark, sf_dir):
    return loading.load_diagnoses(
        testdata.raw_diagnoses_icd(spark, sf_dir), testdata.raw_d_icd_diagnoses(spark, sf_dir)
    )


@query
def loaded_medications(spark, sf_dir):
    return loading.load_medications(testdata.raw_prescriptions(spark, sf_dir))


@query
def loaded_vitals(spark, sf_dir):
    return loading.load_vitals(testdata.raw_chartevents(spark, sf_dir))


@query
def loaded_labs(spark, sf_dir):
    return loading.load_labs(testdata.raw_labevents(spark, sf_dir))


@query
def sampled_labs(spark, sf_dir):
    """Labs of the sampled encounters only."""
    return ingest.build_tables(raw_extracts(spark, sf_dir), SAMPLE_CAP)["lab_result"]


@query
def capped_vitals(spark, sf_dir):
    """A row cap at half of all readings, reached at the end of an encounter."""
    vitals = loading.load_vitals(testdata.raw_chartevents(spark, sf_dir))
    return cohort.cap_rows(vitals, vitals.count() // 2, "encounter_id")


# --- lookups and reports ---------------------------------------------------------------------


@query
def patient_lookup(spark, sf_dir):
    """Every second patient number up to twice the largest; half of them do not exist."""
    wanted = testdata.encounter(spark, sf_dir).select((F.col("patient_id") * 2).alias("patient_id")).distinct()
    return reports.lookup(wanted, testdata.patient(spark, sf_dir), "patient_id")


@query
def abnormal_labs(spark, sf_dir):
    return reports.abnormal_labs(testdata.lab_result(spark, sf_dir))


@query
def sequence_vital_rows(spark, sf_dir):
    return testdata.vital_sign(spark, sf_dir).where(F.col("vital_type").isin(SEQUENCE_VITALS))


@query
def positive_stays(spark, sf_dir):
    return rounded(
        feature_table(spark, sf_dir).where("length_of_stay > 0").select("encounter_id", "length_of_stay"),
        "length_of_stay",
    )


@query
def encounter_listing(spark, sf_dir):
    return rounded(reports.encounter_listing(testdata.encounter(spark, sf_dir)), "los_days")


@query
def random_encounter_listing(spark, sf_dir):
    return rounded(reports.random_listing(testdata.encounter(spark, sf_dir), 30), "los_days")


@query
def encounter_detail(spark, sf_dir):
    detail = reports.encounter_detail(testdata.encounter(spark, sf_dir), testdata.patient(spark, sf_dir))
    return rounded(detail, "los_days")


@query
def patient_listing(spark, sf_dir):
    return reports.list_patients(testdata.patient(spark, sf_dir), testdata.encounter(spark, sf_dir))


@query
def top_patients(spark, sf_dir):
    return reports.top_patients(testdata.patient(spark, sf_dir), testdata.encounter(spark, sf_dir), 50)


@query
def patient_encounters(spark, sf_dir):
    return rounded(reports.patient_encounters(testdata.encounter(spark, sf_dir)), "los_days")


@query
def diagnoses_in_order(spark, sf_dir):
    return reports.diagnoses_in_order(testdata.diagnosis(spark, sf_dir))


@query
def vitals_in_order(spark, sf_dir):
    return reports.vitals_in_order(testdata.vital_sign(spark, sf_dir))


@query
def distinct_medications(spark, sf_dir):
    return reports.distinct_medications(testdata.medication(spark, sf_dir))


@query
def lab_summary(spark, sf_dir):
    return rounded(reports.lab_summary(testdata.lab_result(spark, sf_dir)), "avg_value")


@query
def admission_type_counts(spark, sf_dir):
    return reports.admission_type_counts(testdata.encounter(spark, sf_dir))


@query
def readmission_check(spark, sf_dir):
    return reports.readmission_check(labels(spark, sf_dir))


@query
def readmission_by_type(spark, sf_dir):
    return reports.readmission_by_type(testdata.encounter(spark, sf_dir), labels(spark, sf_dir))


@query
def prediction_history(spark, sf_dir):
    return reports.prediction_history(testdata.risk_prediction(spark, sf_dir))


@query
def latest_predictions(spark, sf_dir):
    return reports.latest_predictions(testdata.risk_prediction(spark, sf_dir))


@query
def prediction_summary(spark, sf_dir):
    return rounded(reports.prediction_summary(testdata.risk_prediction(spark, sf_dir)), "avg_risk_score")


@query
def displayed_scores(spark, sf_dir):
    shown = reports.display_scores(fusion.fuse(testdata.score_input(spark, sf_dir), "api"))
    weights = [F.col("weights_pct")[m].alias(f"{m}_weight_pct") for m in fusion.MODELS]
    return shown.select("*", *weights).drop("weights_pct")


@query
def table_counts(spark, sf_dir):
    return reports.table_counts(typed_tables(spark, sf_dir))


# --- cohort, label, features -----------------------------------------------------------------


@query
def readmission_label(spark, sf_dir):
    return labels(spark, sf_dir)


@query
def prior_admissions(spark, sf_dir):
    counted = cohort.prior_admissions(testdata.encounter(spark, sf_dir))
    return counted.select("encounter_id", "num_prior_admissions")


@query
def stratified_sample(spark, sf_dir):
    discharged = testdata.encounter(spark, sf_dir).where(F.col("discharge_time").isNotNull())
    return cohort.stratified_sample(discharged, SAMPLE_CAP).select("encounter_id", "patient_id", "admission_type")


@query
def diagnosis_counts(spark, sf_dir):
    return features.diagnosis_counts(testdata.diagnosis(spark, sf_dir))


@query
def medication_counts(spark, sf_dir):
    return features.medication_counts(testdata.medication(spark, sf_dir))


@query
def vital_features(spark, sf_dir):
    return rounded(features.vital_features(testdata.vital_sign(spark, sf_dir)), "avg_hr", "avg_temp")


@query
def lab_features(spark, sf_dir):
    return features.lab_features(testdata.lab_result(spark, sf_dir))


@query
def encounter_features(spark, sf_dir):
    return rounded(feature_table(spark, sf_dir), "length_of_stay", "avg_hr", "avg_temp")


@query
def training_set(spark, sf_dir):
    return rounded(training_rows(spark, sf_dir), "length_of_stay", "avg_hr", "avg_temp")


@query
def feature_medians(spark, sf_dir):
    rows = materialize(training_rows(spark, sf_dir), "training-set")
    return rounded(features.exact_medians(rows), *MODEL_FEATURES)


@query
def chronological_split_of_encounters(spark, sf_dir):
    return chronological_split(training_rows(spark, sf_dir)).select("encounter_id", "admit_time", "split")


@query
def split_summary_of_encounters(spark, sf_dir):
    return rounded(split_summary(chronological_split(training_rows(spark, sf_dir))), "positive_rate")


@query
def class_weight(spark, sf_dir):
    return rounded(modelling.class_weight(training_rows(spark, sf_dir)), "scale_pos_weight")


@query
def training_matrix(spark, sf_dir):
    prepared = training.prepare_training(training_rows(spark, sf_dir))
    return rounded(prepared.select("encounter_id", "split", "label", *MODEL_FEATURES), *MODEL_FEATURES)


@query
def training_matrix_train_only(spark, sf_dir):
    """Zeros replaced in the train rows only."""
    prepared = training.prepare_training(training_rows(spark, sf_dir), train_only=True)
    return rounded(prepared.select("encounter_id", "split", "label", *MODEL_FEATURES), *MODEL_FEATURES)


# --- sequences -------------------------------------------------------------------------------


@query
def hourly_vitals(spark, sf_dir):
    return rounded(seq.hourly_vitals(testdata.vital_sign(spark, sf_dir)), *SEQUENCE_VITALS)


@query
def hourly_vitals_any_type(spark, sf_dir):
    return rounded(seq.hourly_vitals(testdata.vital_sign(spark, sf_dir), False), *SEQUENCE_VITALS)


@query
def vital_sequence(spark, sf_dir):
    return rounded(sequence_table(spark, sf_dir), *SEQUENCE_VITALS)


@query
def sequence_check(spark, sf_dir):
    return rounded(reports.sequence_check(sequence_table(spark, sf_dir)), "readmission_rate")


@query
def latest_hours(spark, sf_dir):
    hourly = seq.hourly_vitals(testdata.vital_sign(spark, sf_dir), False)
    return seq.latest_steps(hourly, "hour").select("encounter_id", "hour")


def _resolved(spark, sf_dir, **options):
    sequences = materialize(sequence_table(spark, sf_dir), "vital-sequence")  # read twice
    return seq.resolve_sequences(sequences, testdata.vital_sign(spark, sf_dir), **options)


@query
def resolved_sequences(spark, sf_dir):
    return rounded(_resolved(spark, sf_dir), *SEQUENCE_VITALS)


@query
def resolved_sequences_offline(spark, sf_dir):
    return rounded(_resolved(spark, sf_dir, policy="offline"), *SEQUENCE_VITALS)


@query
def resolved_sequences_newest_first(spark, sf_dir):
    return rounded(_resolved(spark, sf_dir, parity_order=True), *SEQUENCE_VITALS)


@query
def gathered_sequences(spark, sf_dir):
    return by_step(seq.gather(_resolved(spark, sf_dir)), "n_rows")


@query
def training_sequences(spark, sf_dir):
    return by_step(seq.training_sequences(sequence_table(spark, sf_dir)), "label", "n_rows")


@query
def inference_sequences(spark, sf_dir):
    return by_step(seq.inference_sequences(_resolved(spark, sf_dir)), "source", "n_rows", "flat")


@query
def inference_sequences_offline(spark, sf_dir):
    prepared = seq.inference_sequences(_resolved(spark, sf_dir, policy="offline"), "offline")
    return by_step(prepared, "source", "n_rows")


@query
def offline_flat_sequences(spark, sf_dir):
    """The offline flatness gate on unscaled sequences."""
    prepared = seq.inference_sequences(_resolved(spark, sf_dir, policy="offline"), "offline")
    return prepared.select("encounter_id", seq.offline_flat(F.col("steps")).alias("flat"))


@query
def sequence_key_split(spark, sf_dir):
    rows = seq.training_sequences(sequence_table(spark, sf_dir)).select("encounter_id", "label")
    return key_split(rows)


@query
def sequence_split_summary(spark, sf_dir):
    split = key_split(seq.training_sequences(sequence_table(spark, sf_dir)).select("encounter_id", "label"))
    return rounded(split_summary(split, date=None), "positive_rate")


@query
def sequence_scaler(spark, sf_dir):
    rows = seq.training_sequences(sequence_table(spark, sf_dir))
    return rounded(seq.fit_scaler(rows), "mean", "std")


@query
def normalised_sequences(spark, sf_dir):
    rows = seq.training_sequences(sequence_table(spark, sf_dir))
    return by_step(seq.scale(rows, seq.fit_scaler(rows), epsilon=1e-6))


@query
def scaled_sequences(spark, sf_dir):
    """Scaled with the statistics of the train rows."""
    prepared, _ = training.prepare_sequences(sequence_table(spark, sf_dir))
    return by_step(prepared, "split")


# --- models and metrics ----------------------------------------------------------------------


def _scored_splits(scored):
    """Rows per split, and those without a probability as score."""
    return scored.groupBy("split").agg(
        F.count("*").alias("rows"),
        F.count_if(~F.coalesce(F.col("score").between(0, 1), F.lit(False))).alias("no_probability"))


@query
def tabular_model_scores(spark, sf_dir):
    return _scored_splits(trained_tabular(spark, sf_dir).scored)


@query
def feature_importances(spark, sf_dir):
    """How many features are ranked, the sum of their importances, and those out of order."""
    ranked = modelling.feature_importances(spark, trained_tabular(spark, sf_dir).bundle.model)
    before = F.lag("importance").over(Window.orderBy(F.desc("importance"), "feature"))
    return ranked.withColumn("before", before).agg(
        F.count("*").alias("features"), F.round(F.sum("importance"), 6).alias("total"),
        F.count_if(F.col("before") < F.col("importance")).alias("out_of_order"))


@query
def boosted_signal(spark, sf_dir):
    """A model of a label that follows the length of stay, a fifth of the rows at random: its first feature, the split
    rows, and whether its test AUC is near the best that any score can have (0.9) and far above that of a constant."""
    rows = training_rows(spark, sf_dir)
    draw = F.pmod(F.col("encounter_id") * 7919, F.lit(1000))
    label = F.when(draw < 200, draw % 2).otherwise((F.col("length_of_stay") > 8.0).cast("int"))
    own = training.train_tabular(rows.withColumn("label", label.cast("int")), Settings(rounds=20, patience=5))
    return _scored_splits(own.scored).withColumns({
        "first": F.lit(own.bundle.model.importances() and max(own.bundle.model.importances(), key=lambda f: f[1])[0]),
        "good": F.lit(own.bundle.test_auc).between(0.85, 0.95)})


@query
def sequence_model_scores(spark, sf_dir):
    return _scored_splits(training.train_sequences(sequence_table(spark, sf_dir)).scored)


def _with_gaps(spark, sf_dir):
    """Scores and labels of which some are missing or not numbers."""
    scored, key = scored_labels(spark, sf_dir), F.col("encounter_id")
    score = F.when(key % 5 == 0, F.lit(None)).when(key % 5 == 1, F.lit(float("nan"))).otherwise(F.col("score"))
    return scored.select("encounter_id", F.when(key % 7 != 0, F.col("label")).alias("label"), score.alias("score"))


@query
def ranking_metrics_with_missing_scores(spark, sf_dir):
    return rounded(metrics.ranking_metrics(_with_gaps(spark, sf_dir)), "roc_auc", "average_precision")


@query
def roc_points_with_missing_scores(spark, sf_dir):
    return rounded(metrics.roc_points(_with_gaps(spark, sf_dir)), "fpr", "tpr")


@query
def unranked_rows(spark, sf_dir):
    return metrics.unranked_rows(_with_gaps(spark, sf_dir))


@query
def ranking_metrics(spark, sf_dir):
    return rounded(metrics.ranking_metrics(scored_labels(spark, sf_dir, "num_prior_admissions")),
                   "roc_auc", "average_precision")


@query
def roc_points(spark, sf_dir):
    return rounded(metrics.roc_points(scored_labels(spark, sf_dir)), "fpr", "tpr")


@query
def confusion_matrix(spark, sf_dir):
    return metrics.confusion_matrix(scored_labels(spark, sf_dir))


@query
def classification_report(spark, sf_dir):
    return rounded(metrics.classification_report(scored_labels(spark, sf_dir)), "precision", "recall", "f1")


@query
def baseline_comparison(spark, sf_dir):
    return rounded(metrics.baseline_comparison(scored_labels(spark, sf_dir)), "roc_auc")


@query
def overfit_check(spark, sf_dir):
    """Encounters with an even key against those with an odd one."""
    scored = scored_labels(spark, sf_dir)
    halves = [metrics.ranking_metrics(scored.where(F.col("encounter_id") % 2 == r)) for r in (0, 1)]
    return rounded(metrics.overfit_check(*halves), "train_auc", "test_auc", "gap")


# --- scoring and fusion ----------------------------------------------------------------------


@query
def score_functions(spark, sf_dir):
    raw = testdata.score_input(spark, sf_dir)
    wide = (F.col("xgb_score") - 0.5) * 8
    odd = F.when(F.col("encounter_id") % 7 == 0, F.lit(float("nan"))).when(
        F.col("encounter_id") % 7 == 1, F.lit(float("inf"))).otherwise(F.col("xgb_score"))
    return raw.select(
        "encounter_id",
        F.round(scores.sigmoid(wide), 6).alias("squashed"),
        scores.clip01(wide).alias("clipped"),
        scores.finite_or(odd, 0.5, 1.0, 0.0).alias("finite"),
        scores.zero_to_missing(F.col("xgb_score")).alias("nonzero"),
        scores.percent(F.col("lstm_score")).alias("lstm_pct"),
    )


@query
def aligned_features(spark, sf_dir):
    partial = feature_table(spark, sf_dir).drop("avg_temp")
    return rounded(scoring.align_features(partial), "length_of_stay", "avg_hr")


@query
def served_features(spark, sf_dir):
    """Features as the scoring service sees them: those it does not read are 0."""
    return rounded(scoring.align_features(feature_table(spark, sf_dir), serving_defaults=True), "length_of_stay")


@query
def sequence_score_rules(spark, sf_dir):
    raw = testdata.score_input(spark, sf_dir)
    flat = F.col("encounter_id") % 9 == 0
    return raw.select(
        "encounter_id",
        fusion.sequence_score(F.col("lstm_score"), "api", flat).alias("api"),
        F.round(fusion.sequence_score(F.col("lstm_score"), "offline", flat), 6).alias("offline"),
        F.round(fusion.sequence_score(F.col("lstm_score"), "offline", flat, amplify=True), 6).alias("amplified"),
    )


def _fused(df: DataFrame) -> DataFrame:
    weights = [F.col("weights_used")[m].alias(f"{m}_weight") for m in fusion.MODELS]
    return df.select("encounter_id", "fusion_score", "risk_level", *weights)


@query
def fused_scores(spark, sf_dir):
    return _fused(fusion.fuse(testdata.score_input(spark, sf_dir), "api"))


def _offline_input(spark, sf_dir):
    return testdata.score_input(spark, sf_dir).fillna(scoring.NEUTRAL, ["lstm_score"])


@query
def fused_scores_offline(spark, sf_dir):
    return _fused(fusion.fuse(_offline_input(spark, sf_dir), "offline"))


@query
def fused_scores_offline_with_images(spark, sf_dir):
    return _fused(fusion.fuse(_offline_input(spark, sf_dir), "offline", cnn_available=True))


@query
def image_path_scores(spark, sf_dir):
    return testdata.score_input(spark, sf_dir).select(
        "encounter_id", scores.path_score(F.col("image_path")).alias("cnn_score")
    )


@query
def image_brightness_scores(spark, sf_dir):
    return testdata.image_struct(spark, sf_dir).select(
        "doc_id", images.brightness_score(F.col("image")).alias("cnn_score")
    )


@query
def prediction_records(spark, sf_dir):
    fused = fusion.fuse(testdata.score_input(spark, sf_dir), "api")
    joined = fused.join(feature_table(spark, sf_dir), "encounter_id")
    record = fusion.prediction_record(joined, ["age_at_admission", "num_diagnoses", "num_prior_admissions"])
    return record.select(
        "encounter_id", "xgb_score", "lstm_score", "cnn_score", "fusion_score", "risk_level", "model_version",
        F.map_values("weights_used")[0].alias("xgb_weight"), "features_used.*",
    )


def _batch(spark, sf_dir, policy):
    tabular = trained_tabular(spark, sf_dir).bundle
    sequences = materialize(sequence_table(spark, sf_dir), "vital-sequence")
    sequence = training.train_sequences(sequences).bundle
    paths = testdata.score_input(spark, sf_dir).select(
        "encounter_id", scores.path_score(F.col("image_path")).alias("cnn_score")
    )
    return scoring.score_batch(
        testdata.encounter(spark, sf_dir), feature_table(spark, sf_dir), sequences,
        testdata.vital_sign(spark, sf_dir), tabular, sequence, images=paths, policy=policy,
        cnn_available=policy == "offline",
    )


def _batch_summary(rows):
    """Rows by the scores that went in; fused scores that aren't probabilities."""
    return rows.groupBy(
        F.col("xgb_score").isNotNull().alias("tabular"), F.col("lstm_score").isNotNull().alias("sequence"),
        F.col("cnn_score").isNotNull().alias("image"),
    ).agg(F.count("*").alias("rows"),
          F.count_if(~F.coalesce(F.col("fusion_score").between(0, 1), F.lit(False))).alias("no_probability"))


@query
def batch_scores(spark, sf_dir):
    return _batch_summary(scoring.scored_only(_batch(spark, sf_dir, "api")))


@query
def batch_scores_offline(spark, sf_dir):
    return _batch_summary(_batch(spark, sf_dir, "offline"))


@query
def scored_log(spark, sf_dir):
    """The scoring job's log for a third of the encounters, with given scores in place of the models'."""
    root = scratch_path(spark, "tables")
    wanted = testdata.encounter(spark, sf_dir).where("encounter_id % 3 = 0")
    given = testdata.score_input(spark, sf_dir).join(wanted.select("encounter_id"), "encounter_id", "left_semi")
    scoring_job.record_scores(fusion.fuse(given.withColumn("status", F.lit(scoring.OK)), "api"), root)
    return tables.read_table(spark, root, "risk_prediction").drop("predicted_at")


@query
def incremental_log(spark, sf_dir):
    """The log after the scoring job has run for early encounters, for all, and for all once more without its mark: how often
    each encounter is in it, and whether its score and band are sound."""
    root = scratch_path(spark, "tables")
    bundles.save_bundle(spark, trained_tabular(spark, sf_dir).bundle, f"{root}/bundle")
    given = {"features": materialize(feature_table(spark, sf_dir), "features"),
             "sequences": materialize(sequence_table(spark, sf_dir), "sequences"),
             "vital_sign": testdata.vital_sign(spark, sf_dir)}
    encounters = testdata.encounter(spark, sf_dir)
    for batch in (encounters.where("admit_time < DATE '1996-01-01'"), encounters):
        scoring_job.run_incremental(spark, batch, given, root, f"{root}/bundle", f"{root}/none")
    scoring_job.forget_mark(spark, root)
    scoring_job.run_incremental(spark, encounters, given, root, f"{root}/bundle", f"{root}/none")
    log = tables.read_table(spark, root, "risk_prediction")
    band = F.col("risk_level").isin("LOW", "MEDIUM", "HIGH")
    return log.groupBy("encounter_id").agg(
        F.count("*").alias("times"), F.min(F.col("fusion_score").between(0, 1) & band).alias("sound"))


@query
def tabular_score_status(spark, sf_dir):
    """Whether each encounter can be scored, without a model."""
    rows = scoring.tabular_scores(testdata.encounter(spark, sf_dir), feature_table(spark, sf_dir), None)
    return rows.select("encounter_id", "xgb_score", "status")


# --- quality ---------------------------------------------------------------------------------


@query
def stage_counts(spark, sf_dir):
    return quality.stage_counts(
        testdata.encounter(spark, sf_dir), feature_table(spark, sf_dir), labels(spark, sf_dir)
    )


@query
def threshold_checks(spark, sf_dir):
    return rounded(
        quality.threshold_checks(training_rows(spark, sf_dir), sequence_table(spark, sf_dir)), "value"
    )


@query
def orphan_counts(spark, sf_dir):
    return quality.orphan_counts(testdata.audited_tables(spark, sf_dir))


@query
def constraint_audit(spark, sf_dir):
    return quality.constraint_audit(testdata.audited_tables(spark, sf_dir))


@query
def constraint_audit_of_sound_tables(spark, sf_dir):
    return quality.constraint_audit(typed_tables(spark, sf_dir))


# --- streaming -------------------------------------------------------------------------------


def _event_stream(spark, sf_dir):
    # the braces make the path a glob: it then stands for a file as well as for a folder
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/{{events}}.parquet")


@query
def streamed_vitals(spark, sf_dir):
    """The event load as a stream, restricted to admitted encounters."""
    root = scratch_path(spark, "stream")
    kept = loading.load_admissions(testdata.raw_admissions(spark, sf_dir))
    raw = testdata.chartevents_of(_event_stream(spark, sf_dir))
    streams.stream_vitals(raw, f"{root}/vital_sign", f"{root}/checkpoint", kept).awaitTermination()
    return tables.read_table(spark, root, "vital_sign")


@query
def streamed_hourly_vitals(spark, sf_dir):
    """Hours the watermark has closed."""
    root = scratch_path(spark, "stream")
    hourly = streams.hourly_vitals_stream(testdata.vitals_of(_event_stream(spark, sf_dir)), "2 hours")
    streams.append_stream(hourly, f"{root}/hourly", f"{root}/checkpoint").awaitTermination()
    return rounded(spark.read.schema(hourly.schema).parquet(f"{root}/hourly"), *SEQUENCE_VITALS)


@query
def corrected_hours(spark, sf_dir):
    """Three deliveries with readings of all hours each, then the first once more: hours are corrected, repeats don't count."""
    root = scratch_path(spark, "stream")
    vitals = testdata.vital_sign(spark, sf_dir)
    delivery = F.pmod(F.xxhash64(*vitals.columns), F.lit(3))
    for number in (0, 1, 2, 0):
        vitals.where(delivery == number).write.mode("append").parquet(f"{root}/landing")
        stream = spark.readStream.schema(vitals.schema).parquet(f"{root}/landing")
        streams.publish_hours(stream, root, f"{root}/checkpoint", vitals.columns, parts=4).awaitTermination()
    return rounded(streams.published_hours(spark, root), *SEQUENCE_VITALS)
