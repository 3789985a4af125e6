"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) names the tables, BENCH_CPUS (default 8) the local threads. Every
query writes its whole result to the no-op sink. One short query runs first, untimed, to start the JVM.
"""

from __future__ import annotations

import json
import os
import time

from stayline.plans.catalog import QUERIES
from stayline.session import get_spark

HEADLINE = [
    "readmission_label", "prior_admissions", "encounter_features", "training_set", "stratified_sample",
    "chronological_split_of_encounters", "feature_medians", "training_matrix", "lab_summary",
    "distinct_medications", "patient_encounters", "top_patients", "hourly_vitals", "vital_sequence",
    "resolved_sequences", "training_sequences", "inference_sequences", "scaled_sequences", "ranking_metrics",
    "roc_points", "classification_report", "fused_scores", "prediction_summary", "latest_predictions",
    "csv_event_scan", "loaded_labs", "sampled_labs", "constraint_audit", "image_brightness_scores",
    "streamed_vitals", "tabular_model_scores", "ingest_summary",
]


def run(spark, name: str, sf_dir: str) -> float:
    start = time.perf_counter()
    QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return round(time.perf_counter() - start, 3)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = get_spark("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus,
        "spark.ui.enabled": "false",
        "spark.driver.memory": "16g",
    })
    spark.sparkContext.setLogLevel("ERROR")
    run(spark, "admission_type_counts", sf_dir)
    times = {name: run(spark, name, sf_dir) for name in HEADLINE}
    print(json.dumps({
        "metric": "total time of the headline queries", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")),
    }))


if __name__ == "__main__":
    main()
