"""Hospital stay timelines on Spark: cohorts, labels, features, sequences, scores and reports."""
