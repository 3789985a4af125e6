from __future__ import annotations

import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from stayline.llm import collocations, lexicon
from stayline.llm.collocations import CountTransducer

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, least, share=50, top=2000):
    counts, sizes = defaultdict(Counter), Counter()
    for row in rows:
        lang = "und" if row["lang"] is None else row["lang"]
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", (row["text"] or "").translate(LOWER)):
            words = [w for w in re.split(r"[ \t]+", piece) if w]
            sizes[lang] += len(words)
            for n in (1, 2, 3):
                for i in range(len(words) - n + 1):
                    counts[lang][tuple(words[i:i + n])] += 1
    out = []
    for lang, found in counts.items():
        chosen = {p: a for p, a in found.items() if len(p) > 1 and a >= least}
        best = []
        for p, a in chosen.items():
            around = [f for q, f in chosen.items() if len(q) > len(p) and p in (q[:2], q[1:])]
            if any(100 * f >= share * a for f in around):
                continue
            cuts = [(1_000_000 * a * a // (found[p[:k]] * found[p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            best.append((-score, -a, " ".join(p).encode(), found[p[:k]], found[p[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(best)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, sizes[lang], -score))
    return sorted(out)


@pytest.mark.parametrize("how", [{}, {"shard_tokens": 150, "range_tokens": 40, "head": 7}, {"top": 5, "head": 0}])
def test_brute_force(documents, rows, how):
    got = collocations.collocations(documents, least=3, **how)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    expected = brute(rows, 3, top=how.get("top", 2000))
    assert sorted(map(tuple, got.collect())) == expected and len(expected) > 5


def test_separators_cuts_and_longer_phrases(spark):
    texts = ["a b c. a b c; a b c", "A\tB  C\na b\rc x y", "x y! x y? x y:x y,x\x0by", "x\x00 y x\x00 y x\x00 y", None, ""]
    rows = [(i, t, None if i % 2 else "en", "other") for i, t in enumerate(texts)] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, rank string")
    got = collocations.collocations(docs, least=2)
    assert sorted(map(tuple, got.collect())) == brute([r.asDict() for r in docs.collect()], 2)
    assert {r.lang for r in got.collect()} == {"en", "und"}


def test_long_text_and_repeated_words(spark):
    docs = spark.createDataFrame([("z " * 60_000, "en"), ("z z z", "fr")], "text string, lang string")
    got = collocations.collocations(docs, shard_tokens=1000).collect()
    assert [(r.phrase, r.a, r.l, r.r, r.n) for r in got] == [("z z z", 59_998, 60_000, 59_999, 60_000)]


def test_empty_and_nothing_common(spark, nothing):
    assert collocations.collocations(nothing).count() == 0
    assert collocations.collocations(spark.createDataFrame([("a b c d", "en")], "text string, lang string")).count() == 0


def phrases(one):
    words, one = one.with_words(HEAD)
    first, second, third, weight = one.phrases()
    return Counter({(words[a], words[b], words[c] if c >= 0 else None): n
                    for a, b, c, n in zip(first, second, third, weight.tolist(), strict=True)})


HEAD = [collocations.symbol("en", b"h%d" % i) for i in range(3)]


def random_transducer(seed, n=400, words=9):
    """Labels of the shared head and own ones, in an order of the transducer's own."""
    rng = np.random.default_rng(seed)
    symbols = [("en", b"w%d" % i) for i in rng.permutation(words)] + [("en", b"h%d" % i) for i in range(3)]
    labels = np.concatenate([collocations.HEAD + np.arange(words), np.arange(3), [-1]])
    words += 3
    first, second = rng.integers(0, words, (2, n))
    third = rng.integers(-1, words, n)
    weight = rng.integers(1, 5, n)
    expected = Counter()
    for a, b, c, k in zip(first, second, third, weight.tolist(), strict=True):
        expected[symbols[a], symbols[b], symbols[c] if c >= 0 else None] += k
    return CountTransducer.build(
        pa.array([collocations.symbol(*s) for s in symbols[:-3]], pa.binary()), labels[first], labels[second], labels[third], weight), expected


def test_transducers_hold_add_and_return_what_was_put_in():
    made = [random_transducer(s, n) for s, n in ((1, 400), (2, 30), (3, 1))]
    for one, expected in made:
        assert phrases(one) == expected == phrases(CountTransducer.of(one.row()))
    united = CountTransducer.union([one for one, _ in made])
    total = sum((e for _, e in made), Counter())
    assert phrases(united) == total
    hapax, _ = random_transducer(4, 300, words=30)
    assert len(hapax.weights) < len(hapax.phrases()[0])  # states with one equal arc are one
    pairs = Counter()
    for (a, b, _), n in total.items():
        pairs[a, b] += n
    some = united.frequent(6)
    words, united = united.with_words(HEAD)
    first, second, count = united.pairs()
    assert {(words[a], words[b]): n for a, b, n in zip(first, second, count, strict=True)} == pairs
    kept = {p: n for p, n in phrases(some).items() if p[2] is not None}
    assert kept == {p: n for p, n in total.items() if p[2] is not None and n >= 6} and kept
    left, small = some.with_words(HEAD)
    first, second, count = small.pairs()
    assert {(left[a], left[b]): n for a, b, n in zip(first, second, count, strict=True)} == {
        p: n for p, n in pairs.items() if n >= 6}
    asked = united.compose(np.array([0, 0, 99]), np.array([1, 77, 1]))
    assert asked.tolist() == [pairs[words[0], words[1]], 0, 0]
    assert not phrases(some.frequent(10**9)) and not len(CountTransducer.of(some.frequent(10**9).row()).symbols)


def test_exact_scores_beyond_64_bits(spark):
    a, left, right = 987_654_321_098_765, 999_999_999_999_999, 987_654_321_098_777
    row = spark.createDataFrame([(a, left, right)], "a long, l long, r long")
    assert row.select(collocations.score(F.col("a"), F.col("l"), F.col("r"))).first()[0] == 1_000_000 * a * a // (left * right)


def test_codes_and_bitmap_agree_with_spark(spark):
    rows = [("en", b"word"), ("", "é".encode()), ("fr", b"")]
    words = spark.createDataFrame(rows, "lang string, word binary")
    found = {(r[0], bytes(r[1])): r[2] % (1 << 64) for r in words.select("lang", "word", F.xxhash64("lang", "word")).collect()}
    assert found == {r: lexicon.code(*r) for r in rows}
    bitmap = lexicon.word_bitmap(words, 1 << 20)
    assert all(lexicon.is_set(bitmap, lexicon.code(*r)) for r in rows) and np.bitwise_count(bitmap).sum() == 3
