"""Jobs composed of the operators: ingest, training, scoring, and the clinical view of the test tables."""
