from __future__ import annotations

import random
import statistics

import pytest
from pyspark.sql import functions as F

from stayline.operators import features, metrics
from stayline.operators.ranking import nth_keys, running_totals, time_levels
from stayline.operators.split import chronological_split, key_split


@pytest.mark.parametrize("rows_each", [1_000, 17, 1])
def test_running_totals(frame, rows_each):
    rng = random.Random(1)
    values = rng.sample(range(10_000), 60)
    rows = [(g, float(v), rng.randrange(5)) for g in ("a", "b") for v in values]
    df = frame(rows, g="string", v="double", n="bigint")
    got = {(r["g"], r["v"]): r["n_before"] for r in running_totals(df, "v", ["n"], "g", rows_each).collect()}
    assert got == {(g, v): sum(m for h, w, m in rows if h == g and w < v) for g, v, _ in rows}


def test_nth_keys(frame):
    rng = random.Random(2)
    rows = [(f"20{rng.randrange(10, 12)}-01-0{rng.randrange(1, 4)} 0{rng.randrange(3)}:00:0{rng.randrange(2)}.5",
             rng.randrange(-5, 5) << rng.choice((0, 20, 40))) for _ in range(80)]
    rows += [("2011-01-02 00:00:00", 3)] * 30
    df = frame(rows, t="timestamp_ntz", k="bigint")
    ordered = sorted((tuple(r) for r in df.collect()))
    wanted = [0, 1, 17, 50, 77, 109, 400]
    found = nth_keys(df, ["t", "k"], time_levels("t", "k"), wanted)
    assert found == {p: ordered[p] if p < len(ordered) else None for p in wanted}


@pytest.mark.parametrize("n", [0, 1, 2, 3, 7, 100])
def test_chronological_split(frame, n):
    # many ties on the time
    rows = [(i, f"2020-01-0{1 + i % 3} 00:00:00") for i in range(n)]
    df = frame(rows, encounter_id="bigint", admit_time="timestamp_ntz")
    split = chronological_split(df)
    got = [r["split"] for r in split.orderBy("admit_time", "encounter_id").collect()]
    train, val = int(n * 0.70), int(n * 0.85)
    assert got == ["train"] * train + ["val"] * (val - train) + ["test"] * (n - val)


def test_key_split_sorts_negative_keys_first(frame):
    keys = [-(2**62), -5, -1, 0, 1, 70_000, 2**40, 2**62, 2**62 + 1, 2**62 + 2]
    df = frame([(k,) for k in keys], encounter_id="bigint")
    got = {r["encounter_id"]: r["split"] for r in key_split(df).collect()}
    assert [got[k] for k in keys] == ["train"] * 7 + ["val"] + ["test"] * 2


@pytest.mark.parametrize("rows_each", [1_000_000, 5])
@pytest.mark.parametrize("band", [0.001, 0.3])
def test_medians(frame, rows_each, band):
    rng = random.Random(4)
    rows = [(rng.choice([None, 0.0, 1.5, rng.random()]), float(rng.randrange(9)), None) for _ in range(75)]
    df = frame(rows, a="double", b="double", c="double")
    got = features.exact_medians(df, ["a", "b", "c"], band, rows_each).first()
    for i, name in enumerate("ab"):
        assert got[name] == pytest.approx(statistics.median(r[i] for r in rows if r[i] is not None))
    assert got["c"] is None


def test_median_interpolates(frame):
    df = frame([(1.0,), (2.0,), (3.0,), (10.0,)], x="double")
    assert features.exact_medians(df, ["x"]).first()["x"] == 2.5


@pytest.mark.parametrize("n", [1, 2, 3, 10, 999, 1000, 30_001])
def test_medians_of_many_sizes(spark, n):
    df = spark.range(n).select(F.pmod(F.xxhash64("id"), F.lit(1_000_003)).cast("double").alias("x"))
    expected = statistics.median(r["x"] for r in df.collect())
    assert features.exact_medians(df, ["x"], rows_each=900).first()["x"] == expected


def test_medians_when_the_bracket_misses(spark):
    df = spark.range(101).select(F.col("id").cast("double").alias("x"))
    # a negative band swaps the limits, so nothing lies between them
    assert features.exact_medians(df, ["x"], band=-0.3, rows_each=20).first()["x"] == 50.0


def scored(frame, rows):
    return frame(rows, score="double", label="int")


def brute_auc(rows):
    pos = [s for s, y in rows if y == 1]
    neg = [s for s, y in rows if y == 0]
    return sum((p > n) + (p == n) / 2 for p in pos for n in neg) / (len(pos) * len(neg))


def brute_ap(rows):
    pos, total, recall = sum(y for _, y in rows), 0.0, 0.0
    for t in sorted({s for s, _ in rows}, reverse=True):
        called = [y for s, y in rows if s >= t]
        r = sum(called) / pos
        total, recall = total + (r - recall) * sum(called) / len(called), r
    return total


@pytest.mark.parametrize("rows_each", [1_000_000, 20, 1])
@pytest.mark.parametrize("digits", [1, 6])
def test_auc_and_average_precision(frame, rows_each, digits):
    rng = random.Random(digits)
    rows = [(round(rng.random(), digits), int(rng.random() < 0.3)) for _ in range(120)]
    got = metrics.ranking_metrics(scored(frame, rows), rows_each=rows_each).first()
    assert got["roc_auc"] == pytest.approx(brute_auc(rows))
    assert got["average_precision"] == pytest.approx(brute_ap(rows))
    assert (got["rows"], got["positives"]) == (120, sum(y for _, y in rows))


def test_degenerate_metrics(frame):
    one_class = metrics.ranking_metrics(scored(frame, [(0.1, 0), (0.9, 0)])).first()
    assert one_class["roc_auc"] is None and one_class["average_precision"] == 0.0
    equal = metrics.ranking_metrics(scored(frame, [(0.4, 0), (0.4, 1), (0.4, 0)])).first()
    assert equal["roc_auc"] == 0.5 and equal["average_precision"] == pytest.approx(1 / 3)
    empty = metrics.ranking_metrics(scored(frame, [])).first()
    assert empty["rows"] == 0 and empty["roc_auc"] is None
    table = {r["model"]: r["roc_auc"] for r in metrics.baseline_comparison(scored(frame, [(0.1, 0)])).collect()}
    assert table == {"baseline": 0.5, "model": 0.5}


def test_threshold_is_exclusive(frame):
    cells = {(r["label"], r["predicted"]): r["n"]
             for r in metrics.confusion_matrix(scored(frame, [(0.5, 1), (0.51, 1), (0.2, 0)])).collect()}
    assert cells == {(0, 0): 1, (0, 1): 0, (1, 0): 1, (1, 1): 1}


def test_report_of_one_class(frame):
    lines = {r["class"]: r for r in metrics.classification_report(scored(frame, [(0.2, 0), (0.3, 0)])).collect()}
    assert lines["Readmitted"]["f1"] == 0.0 and lines["Readmitted"]["support"] == 0
    assert lines["accuracy"]["f1"] == 1.0 and lines["weighted avg"]["precision"] == 1.0


def test_overfit_gap(frame):
    train = metrics.ranking_metrics(scored(frame, [(0.1, 0), (0.9, 1)]))
    test = metrics.ranking_metrics(scored(frame, [(0.4, 0), (0.4, 1)]))
    row = metrics.overfit_check(train, test).first()
    assert (row["gap"], row["ok"]) == (0.5, False)


def test_fill_from(frame):
    df = frame([("train", 0.0), ("train", None), ("train", 4.0), ("test", 0.0)], split="string", x="double")
    fills = features.training_medians(df.where("split = 'train'"), ["x"])
    everywhere = [r["x"] for r in features.fill_from(df, fills, ["x"]).collect()]
    train_only = [r["x"] for r in features.fill_from(df, fills, ["x"], F.col("split") == "train").collect()]
    assert (everywhere, train_only) == ([4.0, 4.0, 4.0, 4.0], [4.0, 4.0, 4.0, 0.0])


@pytest.mark.parametrize("rows_each", [1_000_000, 10])
def test_missing_scores_and_labels_are_left_out_and_counted(frame, rows_each):
    rng = random.Random(9)
    rows = [(round(rng.random(), 2), int(rng.random() < 0.4)) for _ in range(60)]
    odd = [(None, 1), (float("nan"), 0), (None, None), (0.3, None), (float("inf"), 1), (-0.0, 0), (0.0, 1)]
    df = scored(frame, rows + odd)
    ranked = [r for r in rows + odd[4:]]
    got = metrics.ranking_metrics(df, rows_each=rows_each).first()
    assert (got["rows"], got["roc_auc"]) == (63, pytest.approx(brute_auc(ranked)))
    assert got["average_precision"] == pytest.approx(brute_ap(ranked))
    assert len(metrics.roc_points(df, rows_each=rows_each).collect()) == 1 + len({s for s, _ in ranked})
    assert tuple(metrics.unranked_rows(df).first()) == (2, 1, 1)
    cells = metrics.confusion_matrix(df).agg(F.sum("n")).first()[0]
    assert cells == 63


def test_medians_ignore_nan(frame):
    df = frame([(1.0,), (float("nan"),), (3.0,), (None,), (10.0,)], x="double")
    assert features.exact_medians(df, ["x"]).first()["x"] == 3.0


def test_null_keys_come_last(frame):
    df = frame([(1, "2020-01-01 00:00:00"), (2, None), (3, "2020-01-02 00:00:00"), (4, None)],
               encounter_id="bigint", admit_time="timestamp_ntz")
    found = nth_keys(df, ["admit_time", "encounter_id"], time_levels("admit_time", "encounter_id"), [0, 1, 2, 3])
    assert [found[p][1] for p in range(4)] == [1, 3, 2, 4]
    split = {r["encounter_id"]: r["split"] for r in chronological_split(df).collect()}
    assert split == {1: "train", 3: "train", 2: "val", 4: "test"}
