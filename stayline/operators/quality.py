"""Data quality: stage counts, threshold warnings and declared constraints."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stayline.operators.features import training_set
from stayline.operators.reports import sequence_check, table_counts
from stayline.schema import FOREIGN_KEYS, PRIMARY_KEYS, TEXT_LIMITS

# Sizes and rates below which a result looks wrong.
MIN_TRAINING_ROWS = 50_000
MIN_READMISSION_RATE = 0.05
MIN_SEQUENCE_ENCOUNTERS = 1_000


def stage_counts(encounters: DataFrame, features: DataFrame, labels: DataFrame) -> DataFrame:
    """(tbl, n): rows at each stage, to see where encounters get lost."""
    return table_counts({
        "encounters": encounters,
        "with features": features,
        "with label": labels,
        "readmitted": labels.where(F.col("readmitted_30d") == 1),
        "training rows": training_set(features, labels),
    }).withColumnRenamed("tbl", "stage")


def threshold_checks(training: DataFrame, sequences: DataFrame, min_rows: int = MIN_TRAINING_ROWS,
                     min_rate: float = MIN_READMISSION_RATE,
                     min_encounters: int = MIN_SEQUENCE_ENCOUNTERS) -> DataFrame:
    """(check, value, threshold, ok) for training size, readmission rate and sequence encounters."""
    trained = training.agg(
        F.count(F.lit(1)).cast("double").alias("rows"), F.avg("label").alias("rate")
    )
    checks = trained.select(F.inline(F.array(
        _check("training rows", F.col("rows"), min_rows), _check("readmission rate", F.col("rate"), min_rate)
    )))
    counted = sequence_check(sequences).select(
        F.inline(F.array(_check("sequence encounters", F.col("encounters").cast("double"), min_encounters)))
    )
    return checks.unionByName(counted)


def _check(name, value, threshold):
    return F.struct(
        F.lit(name).alias("check"), value.alias("value"), F.lit(float(threshold)).alias("threshold"),
        F.coalesce(value >= threshold, F.lit(False)).alias("ok"),
    )


def orphans(child: DataFrame, key: str, parent: DataFrame) -> DataFrame:
    """Child rows whose key has no parent row. A NULL key refers to nothing and is no orphan."""
    return child.where(F.col(key).isNotNull()).join(parent.select(key), key, "left_anti")


def duplicate_keys(df: DataFrame, key: str) -> DataFrame:
    """Keys that are NULL or occur more than once."""
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    return counts.where(F.col(key).isNull() | (F.col("n") > 1))


def orphan_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """(constraint, violations) for every declared foreign key: rows whose key has no parent row."""
    return _audited(tables, keys=False, lengths=False)


def constraint_audit(tables: dict[str, DataFrame]) -> DataFrame:
    """(constraint, violations): primary keys, foreign keys and text lengths as declared.

    Counted are keys that are NULL or occur more than once, rows without a parent row, and texts that are too long.
    """
    return _audited(tables)


def _audited(tables: dict[str, DataFrame], keys: bool = True, lengths: bool = True) -> DataFrame:
    """Every table is read once. Its rows become counts per (key, constraint), so tasks pass on a few numbers per key; children and
    parents then meet by key in one shuffle for all constraints."""
    counted, names = None, []
    for name, df in tables.items():
        tags = []
        if name in PRIMARY_KEYS:
            tags.append(_tag(name, PRIMARY_KEYS[name], f"{name}.{PRIMARY_KEYS[name]} unique", F.lit(True)))
            names += [f"{name}.{PRIMARY_KEYS[name]} unique"] if keys else []
        for child, key, parent in FOREIGN_KEYS:
            if child == name:
                tags.append(_tag(parent, key, f"{child}.{key} -> {parent}", F.col(key).isNotNull()))
                names.append(f"{child}.{key} -> {parent}")
        for column, most in TEXT_LIMITS.get(name, {}).items() if lengths else []:
            tags.append(_tag("", None, f"{name}.{column} length", F.length(column) > most))
            names.append(f"{name}.{column} length")
        if tags:
            found = df.select(F.inline(F.filter(F.array(*tags), lambda t: t["holds"]))).groupBy(
                "domain", "key", "constraint").agg(F.count("*").alias("n"))
            counted = found if counted is None else counted.unionByName(found)
    parent = F.col("constraint").endswith(" unique")
    met = counted.groupBy("domain", "key").agg(
        F.coalesce(F.sum(F.when(parent, F.col("n"))), F.lit(0)).alias("parents"), F.collect_list(F.struct("constraint", "n")).alias("found"))
    each = met.select("domain", "key", "parents", F.inline("found"))
    wrong = (
        F.when(F.col("domain") == "", F.col("n"))
        .when(parent, ((F.col("parents") > 1) | F.col("key").isNull()).cast("long"))
        .otherwise(F.when(F.col("parents") == 0, F.col("n")).otherwise(0))
    )
    sums = each.groupBy("constraint").agg(F.sum(wrong).alias("violations"))
    every = counted.sparkSession.createDataFrame([(n,) for n in names], "constraint string")
    return every.join(F.broadcast(sums), "constraint", "left").select(
        "constraint", F.coalesce("violations", F.lit(0).cast("long")).alias("violations"))


def _tag(domain: str, key: str | None, constraint: str, holds):
    value = F.col(key).cast("long") if key else F.lit(None).cast("long")
    return F.struct(F.lit(domain).alias("domain"), value.alias("key"), F.lit(constraint).alias("constraint"),
                    F.coalesce(holds, F.lit(False)).alias("holds"))
