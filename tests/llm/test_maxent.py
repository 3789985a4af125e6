from __future__ import annotations

import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from stayline.llm import maxent

from .conftest import sentence


def words(text):
    return (text or "").encode().lower().split()


def brute(rows):
    counts = Counter()
    learned = [r for r in rows if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 != 1]
    for _, text, *_ in learned:
        counts.update([*words(text), b"\n"])
    total, size = sum(counts.values()), sum(counts.values()) + 0.5 * (len(counts) + 1)
    out = []
    for doc, text, *_ in rows:
        tokens = [*words(text), b"\n"]
        out.append((doc, doc is not None and zlib.crc32(str(doc).encode()) % 5 == 1, len(tokens), sum(t in counts for t in tokens),
                    total, sum(np.log10((counts[t] + 0.5) / size) for t in tokens)))
    return out


@pytest.mark.parametrize("head", [100_000, 30])
def test_base_scores(documents, rows, head):
    got = sorted(map(tuple, maxent.score_documents(documents, head=head).collect()), key=lambda r: (str(r[:4]), r[5]))
    expected = sorted(brute(rows), key=lambda r: (str(r[:4]), r[5]))
    assert [g[:5] for g in got] == [e[:5] for e in expected]
    assert [g[5] for g in got] == pytest.approx([e[5] for e in expected])
    assert all(g[6] < 0 for g in got)


def test_held_out_texts_are_likelier_than_by_word_counts(spark):
    rng = random.Random(3)
    common, rare = sentence(rng, 30).split(), sentence(rng, 400, "fr").split()
    rows = [(i, " ".join(w for _ in range(60) for w in (rng.choice(common), rng.choice(rare)))) for i in range(600)]
    got = maxent.score_documents(spark.createDataFrame(rows, "doc_id long, text string")).where("held_out").collect()
    assert sum(r.score for r in got) > sum(r.base_score for r in got)


def test_the_model_is_a_distribution():
    """Over all words, the end and one unknown word per tail class, probabilities sum to one at any weights."""
    rng = np.random.default_rng(0)
    weights = rng.standard_normal((maxent.ROWS, maxent.WIDTH)).astype(np.float32)
    p1, p2, p3 = (np.array([s]) for s in (5, maxent.START, maxent.HEAD_WORDS + 4))
    classes = np.exp(maxent.log_softmax(weights, maxent.class_rows(p1, p2, p3)))[0]
    assert classes.sum() == pytest.approx(1.0, abs=1e-5)
    head = np.arange(maxent.HEAD_WORDS)
    many = [np.repeat(x, len(head)) for x in (p1, p2, p3)]
    found = np.exp(maxent.Scorer(weights).score(head, *many))
    assert found.sum() == pytest.approx(classes[:maxent.HEAD_CLASSES].sum(), rel=1e-4)


def test_segment_sums():
    rows = np.random.default_rng(1).standard_normal((200, 4)).astype(np.float32)
    first = np.array([0, 1, 3, 60, 61, 199])
    assert np.allclose(maxent.segment_sums(rows, first), np.add.reduceat(rows, first, axis=0), atol=1e-4)


def test_empty_table(nothing):
    assert maxent.score_documents(nothing).count() == 0


def model(head_words, seed=2):
    weights = np.random.default_rng(seed).standard_normal((maxent.ROWS, maxent.WIDTH)).astype(np.float32)
    values = np.arange(1.0, len(head_words) + 1)
    return weights, maxent.Lexicon(head_words, values, -values)


def test_texts_are_read_by_arrow_as_by_splitting():
    texts = pa.array(["skipped", None, "", " \n", "A b\tC\nb b", "é́ ÑÉ x", "İstanbul ſtraße ΑΣ rare", "a\x0b\x0cb \x1c \x85 \xa0 z ", "z" * 300,
                      "rare rare a RARE"], pa.string())[1:]
    place = {w: i for i, w in enumerate([b"b", b"a", *(b"w%d" % i for i in range(maxent.HEAD_WORDS)), b"x", b"z"])}
    found = model(list(place))[1].read(texts)
    split = [words(t) for t in texts.to_pylist()]
    flat = [(i, w) for i, text in enumerate(split) for w in text]
    assert found.owner.tolist() == [i for i, _ in flat]
    assert found.place.tolist() == [place.get(w, -1) for _, w in flat]
    symbol = {w: i if i < maxent.HEAD_WORDS else maxent.HEAD_WORDS + maxent.tail_class(w) for w, i in place.items()}
    symbols = [[symbol.get(w, maxent.HEAD_WORDS + maxent.tail_class(w)) for w in text] for text in split]
    pad = [maxent.START] * 3
    expected = [tuple([*pad, *s, maxent.START][k - back] for back in range(4)) for s in symbols for k in range(3, len(s) + 4)]
    assert list(zip(*(x.tolist() for x in found.histories()), strict=True)) == expected
    assert found.owners().tolist() == [i for i, s in enumerate(symbols) for _ in range(len(s) + 1)]
    assert [dict(x) for x in found.others().to_pylist()] == [Counter(w for w in text if w not in place) for text in split]
    assert model([])[1].read(texts).place.tolist() == [-1] * len(flat)


def test_word_softmaxes_are_not_computed_for_each_word(monkeypatch):
    """Their norms are computed once for a model; scores are those of the whole softmax."""
    weights, _ = model([])
    rng = np.random.default_rng(4)
    symbols, p1, p2, p3 = rng.integers(0, maxent.SYMBOLS, (4, 3000))
    target, at = maxent.class_of(symbols), np.arange(3000)
    expected = maxent.log_softmax(weights, maxent.class_rows(p1, p2, p3))[at, target].astype(float)
    head = np.flatnonzero(symbols < maxent.HEAD_WORDS)
    within = maxent.log_softmax(weights, maxent.word_rows(target[head], p1[head], p2[head]))
    expected[head] += within[np.arange(len(head)), symbols[head] % maxent.WIDTH]
    scorer, seen, sums = maxent.Scorer(weights), [], maxent.centred_sums
    monkeypatch.setattr(maxent, "centred_sums", lambda w, rows: seen.append(len(rows[0])) or sums(w, rows))
    assert np.array_equal(scorer.score(symbols, p1, p2, p3), expected)
    assert sum(seen) == 3000


def test_long_runs_in_an_order():
    rng = np.random.default_rng(1)
    rows, order = rng.standard_normal((900, 4)).astype(np.float32), rng.integers(0, 900, 2000)
    first = np.array([0, 1, 13, 25, 38, 86, 134, 183, 500, 501, 1200])
    expected = [rows[run].astype(float).sum(0) for run in np.split(order, first[1:])]
    assert np.allclose(maxent.segment_sums(rows, first, order=order), expected, atol=1e-3)


def test_a_step_moves_each_row_by_its_gradient():
    weights, _ = model([])
    trainer, rng = maxent.Trainer(weights), np.random.default_rng(6)
    rows = maxent.class_rows(*rng.integers(0, 40, (3, 700)))
    target = rng.integers(0, maxent.WIDTH, 700)
    residual = -np.exp(maxent.log_softmax(weights, rows).astype(float))
    residual[np.arange(700), target] += 1
    gradient, touched = np.zeros((maxent.ROWS, maxent.WIDTH)), np.zeros(maxent.ROWS, int)
    for r in rows:
        np.add.at(gradient, r, residual)
        np.add.at(touched, r, 1)
    energy = 1 + (gradient ** 2).sum(1, keepdims=True) / 8
    trainer._step(rows, target)
    assert trainer.touched.tolist() == touched.tolist()
    assert np.allclose(trainer.weights, weights + gradient * maxent.STEP / np.sqrt(energy), atol=1e-4)
