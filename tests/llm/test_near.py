from __future__ import annotations

import random

import numpy as np
import pytest
import xxhash

from stayline.llm import near_documents, simhash


def fingerprint(text):
    w = (text or "").encode().lower().split()
    runs = [b" ".join(w[i:i + 4]) for i in range(len(w) - 3)] if len(w) >= 4 else [b" ".join(w)] if w else []
    hashes = [xxhash.xxh64_intdigest(x, 42) for x in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_groups(values, radius):
    root = list(range(len(values)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(values)):
        for j in range(i):
            if (values[i] ^ values[j]).bit_count() <= radius:
                root[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(len(values))]


@pytest.mark.parametrize("shard", [4096, 3])
def test_against_brute_force(documents, rows, shard, monkeypatch):
    monkeypatch.setattr(simhash.links, "__defaults__", (shard,))
    prints = [fingerprint(r.text) for r in rows]
    groups = brute_groups(prints, 4)
    least = {}
    for r, g in zip(rows, groups):
        if r.doc_id is not None:
            least[g] = min(least.get(g, r.doc_id), r.doc_id)
    expected = [(r.doc_id, f"{p:016x}", least.get(g)) for r, p, g in zip(rows, prints, groups)]
    got = [tuple(r) for r in simhash.near_duplicates(documents).collect()]
    assert sorted(map(str, got)) == sorted(map(str, expected))
    assert len(set(groups)) < len(set(prints)) < len(rows)


def test_keys_meet_within_the_radius():
    rng = random.Random(3)
    keys = simhash.exact_keys(64, 4, 2)
    for _ in range(200):
        flipped = set(rng.sample(range(64), 4))
        assert any(not flipped & set(k.tolist()) for k in keys)


def test_tree_search_finds_all_and_follows_near_edges_only():
    rng = np.random.default_rng(4)
    base = rng.integers(0, 2**63, 300).astype(np.uint64)
    fps = np.unique(np.concatenate([base, base[:150] ^ np.uint64(5), base[:90] ^ np.uint64(1 << 40)]))[:, None]
    group = np.sort(rng.integers(0, 3, len(fps)))
    found = {(int(q), int(n)) for a, b in simhash.Forest(fps, group).search(fps, group, 4, most=50) for q, n in zip(a, b)}
    expected = {(i, j) for i in range(len(fps)) for j in range(len(fps))
                if group[i] == group[j] and int(fps[i, 0] ^ fps[j, 0]).bit_count() <= 4}
    assert found == expected


def test_components_of_long_chains_and_stars(spark):
    chain = [(bytes([i, 0]), bytes([i + 1, 0])) for i in range(60)]
    star = [(bytes([7, 9]), bytes([i, 9])) for i in range(60) if i != 7]
    edges = spark.createDataFrame(chain + star, "a binary, b binary")
    got = {bytes(r.node): bytes(r.root) for r in simhash.components(edges).collect()}
    assert got == {bytes([i, 0]): bytes([0, 0]) for i in range(1, 61)} | {bytes([i, 9]): bytes([0, 9]) for i in range(1, 60)}


def test_one_document_of_each_group_stays(documents, rows, nothing):
    kept = near_documents.distinct_documents(documents)
    assert kept.columns == documents.columns
    ids = [r.doc_id for r in kept.collect()]
    near = {r.doc_id for r in rows if r.doc_id is not None and 100 <= r.doc_id < 140} | {351, 352}
    assert near & set(ids) == {100} and None not in {i for i in ids if i == 351}
    clean = {r.doc_id for r in rows if r.doc_id is not None and 200 <= r.doc_id < 260}
    long_enough = {r.doc_id for r in rows if r.doc_id in clean and len(r.text.split()) > 12}
    assert long_enough <= set(ids) and 0 in ids and 1 not in ids
    assert near_documents.distinct_documents(nothing).count() == 0
    assert simhash.near_duplicates(nothing).count() == 0


def jaccard(a, b):
    one, other = (set(near_documents.shingle_set(t).tolist()) for t in (a, b))
    return len(one & other) / len(one | other)


def brute_kept(texts, least=0.8):
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if jaccard(texts[i], texts[j]) >= least and find(i) != find(j):
                root[max(find(i), find(j))] = min(find(i), find(j))
    return {find(i) for i in range(len(texts))}


@pytest.mark.parametrize("part", [128, 4])
def test_shingle_sets_decide(spark, monkeypatch, part):
    monkeypatch.setattr(near_documents, "PART", part)
    rng = random.Random(8)
    texts = []
    for _ in range(30):  # a changed word takes 5 of 196 shingles
        words = [f"w{rng.randrange(10**6)}" for _ in range(200)]
        texts.append(" ".join(words))
        for changes in (2, 4, 5, 6):
            other = list(words)
            for at in rng.sample(range(10, 190, 6), changes):
                other[at] = "changed"
            texts.append(" ".join(other))
    words = [f"v{k}" for k in range(300)]
    for step in range(12):  # a chain: only neighbours are similar
        texts.append(" ".join(words[12 * step:12 * step + 150]))
    once, often = [f"r{k}" for k in range(50)], [f"s{k}" for k in range(5)] * 400
    texts += [" ".join(often + once[:20]), " ".join(often + once[20:])]  # equal fingerprints if repeats counted
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id for r in near_documents.distinct_documents(df).collect()}
    kept = brute_kept(texts)
    assert got == kept and {150, 162, 163} <= kept and 40 < len(kept) < len(texts) - 60
