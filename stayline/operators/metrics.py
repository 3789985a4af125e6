"""Exact binary-classification metrics from per-score counts.

Rows are first counted per distinct score, so equal scores travel as one row; everything that needs an order
works on running totals of those counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stayline.operators.ranking import RANGE_ROWS, running_totals

THRESHOLD = 0.5
OVERFIT_GAP = 0.05


def rankable(scored: DataFrame, score: str = "score", label: str = "label") -> DataFrame:
    """Rows with a score that is a number and a label; all metrics leave the others out, see ``unranked_rows``."""
    return scored.where(F.col(score).isNotNull() & ~F.isnan(F.col(score).cast("double")) & F.col(label).isNotNull())


def unranked_rows(scored: DataFrame, score: str = "score", label: str = "label") -> DataFrame:
    """One row: how many rows the metrics leave out, by reason; a row without label counts as such only."""
    has_label, value = F.col(label).isNotNull(), F.col(score).cast("double")
    return scored.agg(
        F.count_if(~has_label).alias("no_label"),
        F.count_if(has_label & value.isNull()).alias("no_score"),
        F.count_if(has_label & F.coalesce(F.isnan(value), F.lit(False))).alias("not_a_number"),
    )


def score_counts(scored: DataFrame, score: str = "score", label: str = "label") -> DataFrame:
    """(score, pos, neg): rankable rows per distinct score."""
    # adding 0 makes -0.0 and 0.0 one score
    return rankable(scored, score, label).groupBy((F.col(score).cast("double") + 0.0).alias("score")).agg(
        F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) != 1).alias("neg"),
    )


def ranking_metrics(scored: DataFrame, score: str = "score", label: str = "label",
                    rows_each: int = RANGE_ROWS) -> DataFrame:
    """One row: rows, positives, ROC-AUC (ties count one half) and average precision (stepwise sum).

    Both metrics are NULL when a class is missing, except average precision, which is 0 without positives.
    """
    counts = running_totals(score_counts(scored, score, label), "score", ["pos", "neg"], rows_each=rows_each)
    sums = counts.agg(F.struct(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))).scalar()
    pos, neg = F.col("pos").cast("double"), F.col("neg").cast("double")
    # rows scored at least as high as this score
    hits = sums["pos"] - F.col("pos_before")
    called = hits + sums["neg"] - F.col("neg_before")
    result = counts.agg(
        F.coalesce(F.sum(F.col("pos") + F.col("neg")), F.lit(0)).alias("rows"),
        F.coalesce(F.sum("pos"), F.lit(0)).alias("positives"),
        F.sum(pos * (F.col("neg_before") + neg / 2)).alias("_wins"),
        F.sum(pos).alias("_pos"),
        F.sum(neg).alias("_neg"),
        F.sum(pos * hits / called).alias("_precision"),
    )
    return result.select(
        "rows",
        "positives",
        F.try_divide("_wins", F.col("_pos") * F.col("_neg")).alias("roc_auc"),
        F.when(F.col("_pos") > 0, F.try_divide("_precision", "_pos")).when(F.col("rows") > 0, 0.0)
        .alias("average_precision"),
    )


def roc_points(scored: DataFrame, score: str = "score", label: str = "label",
               rows_each: int = RANGE_ROWS) -> DataFrame:
    """(threshold, fpr, tpr) per distinct score, and the start (infinity, 0, 0)."""
    counts = running_totals(score_counts(scored, score, label), "score", ["pos", "neg"], rows_each=rows_each)
    sums = counts.agg(F.struct(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))).scalar()
    points = counts.select(
        F.col("score").alias("threshold"),
        F.try_divide(sums["neg"] - F.col("neg_before"), sums["neg"]).alias("fpr"),
        F.try_divide(sums["pos"] - F.col("pos_before"), sums["pos"]).alias("tpr"),
    )
    start = points.sparkSession.range(1).select(
        F.lit(float("inf")).alias("threshold"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr")
    )
    return start.unionByName(points)


def predicted(score: Column, threshold: float = THRESHOLD) -> Column:
    return F.when(score > threshold, 1).otherwise(0)


def _cells(scored: DataFrame, score: str, label: str, threshold: float) -> DataFrame:
    """One row with the four cells tn, fp, fn, tp."""
    actual, called = F.col(label) == 1, predicted(F.col(score), threshold) == 1
    return rankable(scored, score, label).agg(
        F.count_if(~actual & ~called).alias("tn"),
        F.count_if(~actual & called).alias("fp"),
        F.count_if(actual & ~called).alias("fn"),
        F.count_if(actual & called).alias("tp"),
    )


def confusion_matrix(scored: DataFrame, score: str = "score", label: str = "label",
                     threshold: float = THRESHOLD) -> DataFrame:
    """(label, predicted, n) for all four combinations, absent ones with 0."""
    return _cells(scored, score, label, threshold).select(
        F.inline(F.array(*[
            F.struct(F.lit(y).alias("label"), F.lit(p).alias("predicted"), F.col(cell).alias("n"))
            for y, p, cell in ((0, 0, "tn"), (0, 1, "fp"), (1, 0, "fn"), (1, 1, "tp"))
        ]))
    )


def classification_report(scored: DataFrame, score: str = "score", label: str = "label",
                          threshold: float = THRESHOLD) -> DataFrame:
    """Precision, recall, F1 and support per class with accuracy and both averages; 0 where undefined."""
    cells = _cells(scored, score, label, threshold)

    def ratio(top: Column, bottom: Column) -> Column:
        return F.coalesce(F.try_divide(top.cast("double"), bottom.cast("double")), F.lit(0.0))

    def per_class(hit: str, other_called: str, missed: str) -> tuple[Column, Column, Column, Column]:
        p = ratio(F.col(hit), F.col(hit) + F.col(other_called))
        r = ratio(F.col(hit), F.col(hit) + F.col(missed))
        return p, r, ratio(2 * p * r, p + r), F.col(hit) + F.col(missed)

    negative, positive = per_class("tn", "fn", "fp"), per_class("tp", "fp", "fn")
    total = negative[3] + positive[3]
    accuracy = ratio(F.col("tn") + F.col("tp"), total)
    macro = [(negative[i] + positive[i]) / 2 for i in range(3)]
    weighted = [ratio(negative[i] * negative[3] + positive[i] * positive[3], total) for i in range(3)]

    def line(name: str, precision: Column, recall: Column, f1: Column, support: Column) -> Column:
        return F.struct(
            F.lit(name).alias("class"), precision.alias("precision"), recall.alias("recall"),
            f1.alias("f1"), support.alias("support"),
        )

    return cells.select(F.inline(F.array(
        line("Not Readmitted", *negative),
        line("Readmitted", *positive),
        line("accuracy", accuracy, accuracy, accuracy, total),
        line("macro avg", *macro, total),
        line("weighted avg", *weighted, total),
    )))


def baseline_comparison(scored: DataFrame, score: str = "score", label: str = "label") -> DataFrame:
    """ROC-AUC of a constant score next to the model's; an undefined value counts as 0.5."""
    constant = ranking_metrics(scored.withColumn("_constant", F.lit(0.0)), "_constant", label)
    model = ranking_metrics(scored, score, label)
    named = [
        m.select(F.lit(name).alias("model"), F.coalesce("roc_auc", F.lit(0.5)).alias("roc_auc"))
        for name, m in (("baseline", constant), ("model", model))
    ]
    return named[0].unionByName(named[1])


def overfit_check(train: DataFrame, test: DataFrame, tolerance: float = OVERFIT_GAP) -> DataFrame:
    """Train and test ROC-AUC, their gap and whether it stays below the tolerance."""
    train_auc, test_auc = train.select("roc_auc").scalar(), test.select("roc_auc").scalar()
    return train.sparkSession.range(1).select(
        train_auc.alias("train_auc"), test_auc.alias("test_auc"), (train_auc - test_auc).alias("gap"),
        (train_auc - test_auc < tolerance).alias("ok"),
    )
