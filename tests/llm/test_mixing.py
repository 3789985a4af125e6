from __future__ import annotations

from collections import defaultdict

import numpy as np
import pytest

from stayline.llm import mixing


def words(text):
    return len((text or "").encode().split())


def brute_targets(sizes):
    """Sources' targets by sharing the excess again and again."""
    names = sorted([s for s in sizes if s is not None], key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    left, target, full = 1.5 * sum(sizes.values()), {}, set()
    while True:
        free = [s for s in names if s not in full]
        level = (left - sum(2 * sizes[s] for s in full)) / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] > 2 * sizes[s]}
        if not over:
            return {s: 2 * sizes[s] if s in full else level * weight[s] for s in names}
        full |= over


@pytest.mark.parametrize("leaf, fan", [(1024, 256), (4, 2)])
def test_mix(documents, rows, leaf, fan):
    got = mixing.mix(documents, leaf=leaf, fan=fan).collect()
    assert sorted(map(str, (r.doc_id for r in got))) == sorted(map(str, (r.doc_id for r in rows)))
    sizes, taken, largest, source = defaultdict(int), defaultdict(int), defaultdict(int), {}
    for r in rows:
        sizes[r.source] += words(r.text)
        largest[r.source] = max(largest[r.source], words(r.text))
    by_target = {round(t, 6): s for s, t in brute_targets(sizes).items()}
    for r in got:
        s = by_target[round(r.target, 6)]
        assert r.source_size == sizes[s] and r.taken in (0, r["size"], 2 * r["size"])
        taken[s] += r.taken
    for t, s in by_target.items():
        assert abs(taken[s] - t) <= largest[s]


def test_reruns_agree_for_other_partitions(documents):
    first, again = (sorted(map(str, mixing.mix(d).collect())) for d in (documents, documents.repartition(3)))
    assert first == again


def test_expectation_is_kept():
    size = np.array([5.0, 3.0, 9.0, 1.0, 4.0])
    share, total = 0.3, np.zeros(5)
    for seed in range(4000):
        mass = share * size
        left = mixing.settle(size, mass, np.random.default_rng(seed))
        assert mass.sum() == pytest.approx(share * size.sum())
        assert all(0 <= m <= s and (m in (0, s) or i == left) for i, (m, s) in enumerate(zip(mass, size)))
        total += mass / size
    assert np.abs(total / 4000 - share).max() < 0.03


def test_documents_of_the_mix(documents, nothing):
    mixed = mixing.mixed_documents(documents)
    assert mixed.columns == documents.columns
    drawn = sum(r.taken for r in mixing.mix(documents).collect())
    assert sum(words(r.text) for r in mixed.collect()) == drawn
    assert mixing.mixed_documents(nothing).count() == 0 and mixing.mix(nothing).count() == 0
