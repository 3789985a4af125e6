from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from stayline.operators import boosting
from stayline.operators.boosting import Held, Request, Settings, Tree, best_split, boost

FEATURES = ["a", "b", "c", "d"]


@pytest.fixture(scope="module")
def rows(spark):
    """Class 1 goes with a, with a missing c, and with b where d is high; every fifth row is held out."""
    values = [F.pmod(F.xxhash64("id", F.lit(f)), F.lit(1000)) / 1000.0 for f in FEATURES]
    df = spark.range(4000).select("id", *[v.alias(f) for v, f in zip(values, FEATURES, strict=True)])
    df = df.withColumn("c", F.when(F.pmod(F.xxhash64("id", F.lit("m")), F.lit(4)) > 0, F.col("c")))
    chance = 0.1 + 0.4 * (F.col("a") > 0.6).cast("int") + 0.2 * F.col("c").isNull().cast("int") + 0.25 * (
        (F.col("b") > 0.5) & (F.col("d") > 0.5)).cast("int")
    label = (F.pmod(F.xxhash64("id", F.lit("y")), F.lit(1000)) / 1000.0 < chance).cast("int")
    df = df.withColumns({"label": label, "weight": F.lit(1.0), "held_out": F.col("id") % 5 == 0})
    return boosting.materialize(df, "boosting-rows")


def auc(scored, score):
    got = scored.where("held_out").select("label", score).toPandas()
    pos, neg = (got[got.label == k][score].to_numpy() for k in (1, 0))
    return (pos[:, None] > neg).mean() + 0.5 * (pos[:, None] == neg).mean()


@pytest.fixture(scope="module")
def model(rows):
    return boost(rows, FEATURES, Settings(rounds=25, patience=8, rate=0.1), [F.col("id")])


def test_auc_is_that_of_the_scores_and_importances_follow_the_signal(rows, model):
    assert 0 < len(model.trees) <= 25 and model.best() == len(model.trees)
    found = auc(model.score(rows, "s"), "s")
    assert found == pytest.approx(max(model.aucs), abs=1e-3) and found > 0.7
    shares = dict(model.importances())
    assert sum(shares.values()) == pytest.approx(1.0) and max(shares, key=shares.get) == "a"


def test_not_behind_spark_trees_of_equal_rounds(rows, model):
    filled = rows.fillna(-1.0, ["c"])
    vectors = VectorAssembler(inputCols=FEATURES, outputCol="v").transform(filled)
    other = GBTClassifier(featuresCol="v", labelCol="label", maxIter=len(model.trees), maxDepth=4, stepSize=0.1, seed=1).fit(
        vectors.where("NOT held_out")).transform(vectors)
    from pyspark.ml.functions import vector_to_array
    own = auc(model.score(rows, "s"), "s")
    assert own > auc(other.withColumn("t", vector_to_array("probability")[1]), "t") - 0.01


def test_neither_the_sample_nor_the_tasks_decide(rows, model):
    again = boost(rows, FEATURES, Settings(rounds=6, patience=8, rate=0.1), [F.col("id")], sample=50, rows_each=900)
    for one, other in zip(again.trees, model.trees, strict=False):
        # nodes may come in another order, the leaves of rows have the same values
        columns = np.random.default_rng(0).integers(0, 128, (4, 500)).astype(np.uint8)
        assert one.values(columns, True) == pytest.approx(other.values(columns, True))
    assert again.aucs[:6] == pytest.approx(model.aucs[:6]) and len(again.trees) >= 1


def plain_best(values, gradient, curvature, settings):
    """The best split by trying every one."""
    def quality(g, h):
        return max(abs(g) - settings.l1, 0) ** 2 / (h + settings.l2)

    best = (-1.0, None)
    for f in range(values.shape[0]):
        for at in range(1, 127):
            for missing_left in (False, True):
                left = np.where(values[f] == 0, missing_left, values[f] <= at)
                g, h, rest_g, rest_h = (x[m].sum() for m in (left, ~left) for x in (gradient, curvature))
                if min(h, rest_h) >= settings.min_child_weight:
                    gain = (quality(g, h) + quality(rest_g, rest_h) - quality(g + rest_g, h + rest_h)) / 2
                    best = max(best, (gain, (f, at, missing_left)), key=lambda b: round(b[0], 9))
    return best


@pytest.mark.parametrize("seed", range(3))
def test_splits_against_trying_all(spark, seed):
    rng = np.random.default_rng(seed)
    n, settings = 300, Settings(rows=1.0, min_child_weight=4.0)
    held = Held([], 3)
    held.label, held.weight = (rng.random(n) < 0.4).astype(float), rng.integers(1, 3, n).astype(float)
    held.held_out, held.draw, held.margin = np.zeros(n, bool), rng.integers(0, 1 << 60, n), rng.normal(size=n)
    held.columns = rng.integers(0, 12, (3, n)).astype(np.uint8)
    sums, _ = held.sums(Request(settings, 0, Tree(), [0], [0, 1, 2], False))
    p = 1 / (1 + np.exp(-held.margin))
    gain, _ = plain_best(held.columns, held.weight * (p - held.label), held.weight * p * (1 - p), settings)
    found = best_split(sums[0], settings)
    assert found["gain"] == pytest.approx(gain) and found["column"] >= 0


def test_bins_and_thresholds_agree(rows, model):
    """A row ends in the same leaf by its bins as by its values."""
    cuts = boosting.cut_points(rows.where("NOT held_out"), FEATURES)
    assert all(len(c) <= boosting.MAX_BINS - 2 and (np.diff(c) > 0).all() for c in cuts)
    held = Held(boosting.binned_rows(rows, FEATURES, cuts, [F.col("id")]).toArrow().to_batches(), 4)
    values = np.array([[math.nan if v is None else v for v in r] for r in rows.select(*FEATURES).collect()]).T
    for tree in model.trees[:5]:
        assert (tree.leaves(held.columns, True) == tree.leaves(values, False)).all()


def test_no_rows_one_class_and_constant_features(spark, rows):
    empty = boost(rows.where("false"), FEATURES)
    assert empty.trees == [] and {r.s for r in empty.score(rows.limit(3), "s").collect()} == {0.5}
    one = boost(rows.withColumn("held_out", F.lit(False)), FEATURES, Settings(rounds=3), [F.col("id")])
    assert len(one.trees) == 3 and one.aucs == []
    same = boost(rows.withColumns({f: F.lit(1.0) for f in FEATURES}), FEATURES, Settings(rounds=3), [F.col("id")])
    assert same.trees == []


def test_saved_and_loaded(spark, rows, model, tmp_path):
    model.save(spark, str(tmp_path / "m"))
    loaded = boosting.BoostedTrees.load(spark, str(tmp_path / "m"))
    assert loaded == model


@pytest.mark.parametrize("tasks", [1, 3])
def test_rows_at_rest_are_blocks_and_give_the_sums_of_all_rows(rows, model, tasks):
    """Jobs read a few buffers a block, not rows, also after margins are written anew; a node's sums are those of its rows."""
    cuts = boosting.cut_points(rows.where("NOT held_out"), FEATURES)
    binned = boosting.materialize(boosting.binned_rows(rows, FEATURES, cuts, [F.col("id")]), "binned")
    held, whole = Held(binned.toArrow().to_batches(), 4), boosting.Rows(binned, 4, tasks)
    for tree in model.trees[:boosting.SNAPSHOT + 1]:
        held.add(tree)
        whole.add(tree)
    assert whole.rows.count() < 100
    tree = model.trees[-1]
    inner = [n for n, f in enumerate(tree.feature) if f >= 0]
    request = Request(Settings(), 7, tree, inner, [0, 2, 3], False)
    sums, _ = held.sums(request)
    p = 1 / (1 + np.exp(-held.margin))
    drawn = ~held.held_out & boosting.in_sample(held.draw, 7, 0.8, 42)
    leaf = tree.leaves(held.columns, True)
    for node, own in zip(inner, sums, strict=True):
        at = drawn & np.isin(leaf, tree.below(node))
        assert own[1, 0] == pytest.approx(np.bincount(held.columns[2][at], (p - held.label)[at], boosting.MAX_BINS))
    found = whole.find(request)
    assert {n: found[n]["gain"] for n in inner} == pytest.approx(
        {n: best_split(own, Settings())["gain"] for n, own in zip(inner, sums, strict=True)})
    whole.remove()


def test_tasks_read_their_own_files_and_find_what_spark_reads(rows, model):
    """Jobs over copies on a local file system don't send blocks through Spark's reader; both ways see each row once."""
    cuts = boosting.cut_points(rows.where("NOT held_out"), FEATURES)
    whole = boosting.Rows(boosting.binned_rows(rows, FEATURES, cuts, [F.col("id")]), 4, 3)
    request = Request(Settings(), 2, Tree(), [0], [0, 1, 3], True)
    for tree in model.trees[:boosting.SNAPSHOT + 2]:
        whole.add(tree)
    assert "parquet" not in whole.source._jdf.queryExecution().toString().lower()
    own = whole.find(request)
    whole.source, whole.read = whole.rows, iter
    other = whole.find(request)
    assert own[-1] == other[-1] and own[-1]["auc"] > 0.5
    assert own[0] == pytest.approx(other[0]) and own[0]["curvature"] > 0
    whole.remove()
