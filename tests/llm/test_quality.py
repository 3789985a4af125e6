from __future__ import annotations

import random
import zlib

import numpy as np
import pytest

from stayline.llm import quality
from stayline.llm.quality import Features, Model

from .conftest import sentence


def labelled(spark, n=500, seed=4):
    """Clean and shouted texts, some labels wrong, some ids labelled twice or with other values."""
    rng = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        good = rng.random() < 0.7
        text = sentence(rng, rng.randint(4, 60))
        docs.append((i, text if good else " ".join(w.upper() + "!!" for w in text.split()), "other"))
        if i % 3:
            labels.append((i, int(good), 0))
    labels += [(1, 1, 0), (2, 0, 0), (2, 1, 0), (None, 1, 0), (0, 7, 0), (3, None, 0)]
    return (spark.createDataFrame(docs, "doc_id long, text string, score string"),
            spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))


def test_held_out_documents(spark):
    docs, labels = labelled(spark)
    got = quality.quality_scores(docs, labels)
    assert got.columns == ["doc_id", "held_out", "score", "predicted"]
    rows = got.collect()
    assert len(rows) == 500
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    good = {r.doc_id: "!!" not in r.text for r in docs.collect()}
    right = [r.predicted == good[r.doc_id] for r in rows if r.held_out]
    assert np.mean(right) > 0.97 and len(right) > 60
    again = {r.doc_id: r.score for r in quality.quality_scores(docs.repartition(7), labels).collect()}
    assert again == pytest.approx({r.doc_id: r.score for r in rows})


def test_only_labels_of_other_folds_matter(spark):
    docs, labels = labelled(spark, 200)
    changed = labels.selectExpr("doc_id", "CASE WHEN crc32(CAST(CAST(doc_id AS STRING) AS BINARY)) % 5 = 0 THEN 1 - quality ELSE quality END AS quality")
    first, second = ({r.doc_id: r.score for r in quality.quality_scores(docs, x).collect()} for x in (labels, changed))
    assert first == pytest.approx(second)


def test_usable_labels(spark):
    _, labels = labelled(spark)
    found = {r.doc_id: r.label for r in quality.training_labels(labels).collect()}
    assert 2 not in found and None not in found and 0 not in found and 3 not in found
    assert all(zlib.crc32(str(i).encode()) % 5 for i in found)


def test_bounded_sample(spark):
    docs, labels = labelled(spark)
    sample = quality.sampled_features(docs.unionAll(docs), quality.training_labels(labels), 20)
    assert sorted((r[0], r[1]) for r in sample.groupBy("label").count().collect()) == [(0, 20), (1, 20)]


def test_odd_texts_and_tables(spark, documents, nothing):
    _, labels = labelled(spark)
    rows = quality.quality_scores(documents, labels).collect()
    assert len(rows) == documents.count() and all(0 <= r.score <= 1 for r in rows)
    empty = {r.score for r in rows if r.doc_id in (0, 1)}
    assert len(empty) == 1  # NULL and empty texts
    assert quality.quality_scores(nothing, labels).count() == 0
    untold = quality.quality_scores(documents, labels.where("false")).collect()
    assert [r.score for r in untold] == pytest.approx([0.5] * len(rows))
    one_class = labels.where("quality = 1")
    assert len({r.score for r in quality.quality_scores(documents, one_class).collect()}) == 1


def test_features_of_pieces_and_packing(monkeypatch):
    features = Features()
    text = sentence(random.Random(1), 3000)
    whole = features(text)
    assert np.array_equal(whole, features(text)) and not features.flags.any()
    assert np.array_equal(quality.unpacked(quality.packed(whole)), whole)
    many = np.arange(0, quality.BUCKETS, 3, dtype=np.int32)
    assert len(quality.packed(many)) == quality.BUCKETS // 8 and np.array_equal(quality.unpacked(quality.packed(many)), many)
    monkeypatch.setattr(quality, "PIECE", 500)
    assert set(whole) <= set(features(text))
    assert len(features("")) == len(features(None)) == 0


def test_shapes():
    def shape(text):
        return quality.shape_of(np.frombuffer(text.encode(), np.uint8)).astype(np.uint8).tobytes()

    assert shape("Word WORD 123!!!! é") == b"Aaa AA 00!! \x80\x80"
    assert shape("ab ab ab\nab  cd") == b"aa \x81 \x81\n\x81  aa"
    assert shape("ab ba") == b"aa aa" and shape("") == b"" and shape("   ") == b"  "


def brute_ratio(rows):
    counts = np.zeros((2, quality.BUCKETS))
    for label, found in rows:
        counts[label, found] += 1
    size = counts.sum(1)
    return np.log((counts[1] + 2 * size[1] / size.sum()) / size[1]) - np.log((counts[0] + 2 * size[0] / size.sum()) / size[0])


def test_ratios_and_margin_against_plain_versions(spark):
    docs, labels = labelled(spark, 300)
    features = quality.sampled_features(docs, quality.training_labels(labels))
    rows = [(r.label, quality.unpacked(bytes(r.features))) for r in features.orderBy("doc_id").collect()]
    ratio = quality.log_count_ratios(features)
    assert np.allclose(ratio, brute_ratio(rows)) and ratio[np.setdiff1d(np.arange(quality.BUCKETS), np.concatenate([f for _, f in rows]))].max() == pytest.approx(0)
    # the distributed fit comes near the best objective that plain coordinate descent over all rows finds
    values = [quality.scaled(f, ratio) for _, f in rows]
    sign = np.array([2.0 * label - 1 for label, _ in rows])
    best, alpha = np.zeros(quality.BUCKETS + 1), np.zeros(len(rows))
    quality.descend([f for _, f in rows], values, sign, np.ones(len(rows)), best, alpha, 300)

    def objective(weights):
        margin = np.array([weights[f] @ v + weights[-1] for (_, f), v in zip(rows, values, strict=True)])
        return weights @ weights / 2 + np.maximum(0, 1 - sign * margin).sum()

    assert objective(best) == pytest.approx(alpha.sum() - best @ best / 2, rel=0.01)  # no duality gap
    fitted = quality.fit_margin(features, ratio, (1.0, 1.0))
    assert objective(best) <= objective(fitted) < 1.5 * objective(best) < objective(np.zeros(quality.BUCKETS + 1))


def test_curve_follows_the_true_class_sizes():
    rng = np.random.default_rng(0)
    label = np.repeat([0, 1], 400)
    margin = rng.normal(2.0 * label - 1, 1)
    even = Model(np.zeros(1), np.zeros(2), quality.fit_curve(margin, label, (400, 400)))
    rare = Model(np.zeros(1), np.zeros(2), quality.fit_curve(margin, label, (400, 40_000)))
    assert even.score(np.array([0.0]))[0] == pytest.approx(0.5, abs=0.05) and rare.score(np.array([0.0]))[0] > 0.9
    assert even.curve[0] == pytest.approx(2, abs=0.4)
