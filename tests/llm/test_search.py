from __future__ import annotations

import numpy as np

from stayline.llm import one_bit_search as obs


def rows_of(dim=24, n=900):
    rng = np.random.default_rng(6)
    centres = rng.standard_normal((12, dim))
    vectors = (centres[rng.integers(0, 12, n)] + rng.standard_normal((n, dim))).tolist()
    rows = [(i, v) for i, v in enumerate(vectors)]
    rows[50] = (50, vectors[7])  # ties
    rows[51] = (51, vectors[7])
    rows += [(3000, None), (3001, []), (3050, [0.0] * dim), (3100, [float("nan")] * dim), (3150, [None] * dim),
             (3200, [1.0, 2.0, 3.0]), (3201, [1.0, 2.0, 3.5]), (None, vectors[3]), (100, vectors[100]), (3250, [float("inf")] * dim)]
    return rows


def brute(rows, k=5):
    sound = [(i, np.array(v, float)) for i, v in rows if i is not None and v and None not in v
             and np.isfinite(np.array(v, float)).all() and np.any(np.array(v, float))]
    out = {}
    for i, q in sound:
        if i % 50 == 0:
            near = sorted({(-(q @ v) / np.linalg.norm(q) / np.linalg.norm(v), j, n) for n, (j, v) in enumerate(sound)
                           if j != i and len(v) == len(q)})
            out[i] = [(j, -s) for s, j, _ in near[:k]]
    return out


def test_recall_and_scores(spark, monkeypatch):
    monkeypatch.setattr(obs, "BLOCK", 128)
    rows = rows_of()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 AS score", "2 AS rank").repartition(4)
    got = {}
    for r in obs.nearest(df).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    expected = brute(rows)
    assert set(got) == set(expected)
    hits = sum(len({j for j, _ in expected[q]} & {j for _, j, _ in got[q]}) for q in got)
    assert hits >= 0.97 * sum(map(len, expected.values()))
    vectors = {i: np.array(v, float) for i, v in rows if v and i is not None and None not in v}
    for q, found in got.items():
        assert [r for r, *_ in found] == list(range(1, len(found) + 1))
        assert [(-s, j) for _, j, s in found] == sorted((-s, j) for _, j, s in found)
        for _, j, s in found:
            assert abs(s - vectors[q] @ vectors[j] / np.linalg.norm(vectors[q]) / np.linalg.norm(vectors[j])) < 1e-12
    assert [(j, round(s, 9)) for _, j, s in got[50]][:2] == [(7, 1.0), (51, 1.0)] and len(got[3200]) == 1


def test_rounds_of_queries_give_the_same(spark):
    df = spark.createDataFrame(rows_of(n=400), "vec_id long, embedding array<double>")
    blocks, queries = obs.index(df), df.where("vec_id % 50 = 0")
    whole, parts = (sorted(map(tuple, obs.search(blocks, queries, size=n).collect())) for n in (4096, 2))
    assert whole == parts
    assert obs.nearest(df.where("false")).count() == 0


def test_bounds_hold_for_most():
    rng = np.random.default_rng(1)
    vectors, queries = rng.standard_normal((500, 64)), rng.standard_normal((20, 64))
    turn = obs.rotation(64)
    assert np.allclose(turn @ turn.T, np.eye(64))
    codes, scalars = obs.encode(vectors, turn)
    signs = np.unpackbits(codes, axis=1).astype(float) * 2 - 1
    estimate = (obs.unit(queries) @ turn) @ signs.T / (8 * scalars)
    exact = obs.unit(queries) @ obs.unit(vectors).T
    error = np.sqrt(1 - scalars**2) / scalars * obs.EPSILON / np.sqrt(63)
    assert (np.abs(estimate - exact) <= error).mean() > 0.9 and abs((estimate - exact).mean()) < 0.01


def test_cosine_of_extreme_vectors():
    assert np.allclose(obs.cosines(np.array([[1e-200, 0.0], [1e200, 1e200]]), np.array([1e-200, 1e-200])), [0.5**0.5, 1.0])


def test_own_rows_do_not_prune_others():
    rng = np.random.default_rng(2)
    dim, query = 32, rng.standard_normal(32)
    others = rng.standard_normal((40, dim))
    vectors = np.concatenate([np.tile(query, (10, 1)), others])
    ids = np.array([50] * 10 + list(range(100, 140)))
    turn = obs.rotation(dim)
    codes, scalars = obs.encode(vectors, turn)
    signs = np.unpackbits(codes, axis=1, count=dim).astype(float) * 2 - 1
    found = list(obs.search_block(query[None], np.array([50]), obs.unit(query[None]) @ turn, vectors, ids, signs, scalars, 5, 10.0))
    exact = obs.cosines(others, query)
    assert len(found) == 1 and found[0][1].tolist() == (100 + np.argsort(-exact)[:5]).tolist()
    few = list(obs.search_block(query[None], np.array([50]), obs.unit(query[None]) @ turn, vectors[:12], ids[:12], signs[:12], scalars[:12], 5, 1.9))
    assert sorted(few[0][1].tolist()) == [100, 101]
