from __future__ import annotations

import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.ml.feature import CountVectorizer
from pyspark.sql import functions as F

from stayline.llm import divergence

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def brute(rows, min_df, top):
    df, sums, groups = defaultdict(Counter), defaultdict(Counter), set()
    for r in rows:
        lang, source = r["lang"] or "", r["source"] or ""
        df[lang].update(set(terms(r["text"])))
        sums[lang, source].update(terms(r["text"]))
        groups.add((lang, source))
    out = []
    for lang in {lang for lang, _ in groups}:
        kept = [t for t, n in df[lang].items() if n >= min_df]

        def shares(count, kept=kept):
            total = sum(count[t] for t in kept)
            return {t: 1 + 10**9 * (count[t] + 5) // (total + 5 * len(kept)) for t in kept}

        own = [s for a, s in groups if a == lang]
        p = {s: shares(sums[lang, s]) for s in own}
        q = shares(sum((sums[lang, s] for s in own), Counter()))
        for s in own:
            pairs = [(-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode()) for o in own if o != s]
            found = [(q[t] - p[s][t], t.encode()) for t in kept if sums[lang, s][t] and p[s][t] > q[t]]
            for part, items in (("pair", sorted(pairs)), ("term", sorted(found)[:top])):
                out += [(lang, s, part, item.decode(), -value, rank) for rank, (value, item) in enumerate(items, 1)]
    return sorted(out)


@pytest.mark.parametrize("min_df,top", [(2, 50), (3, 4), (1, 50), (1000, 50)])
def test_brute_force(documents, rows, min_df, top):
    got = divergence.divergence(documents, min_df, top)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(map(tuple, got.collect())) == brute(rows, min_df, top)


def test_vectors_are_those_of_a_count_vectorizer_per_language(spark, documents):
    docs = documents.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"]).select(
        "doc_id", F.coalesce("lang", F.lit("")).alias("lang"), "text")
    own = defaultdict(dict)
    for r in divergence.Vectorizer(3).fit(docs).transform(docs, "doc_id").collect():
        own[r.lang, r.doc_id][bytes(r.term).decode()] = r["count"]
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    words = F.regexp_extract_all(F.translate(F.coalesce("text", F.lit("")), upper, upper.lower()),
                                 F.lit(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"), F.lit(0))
    expected = {}
    for (lang,) in docs.select("lang").distinct().collect():
        some = docs.where(F.col("lang") == lang).withColumn("terms", words)
        model = CountVectorizer(inputCol="terms", outputCol="v", minDF=3, vocabSize=(1 << 31) - 1).fit(some)
        for r in model.transform(some).collect():
            found = {model.vocabulary[i]: n for i, n in zip(r.v.indices, r.v.values, strict=True)}
            if found:
                expected[lang, r.doc_id] = found
    assert dict(own) == expected and expected


def test_bounded_vocabulary(spark):
    docs = spark.createDataFrame([("en", "a b c"), ("en", "a b"), ("en", "b"), ("fr", "x")], "lang string, text string")
    kept = divergence.Vectorizer(1, vocab_size=2).fit(docs).vocabulary.collect()
    assert {(r.lang, bytes(r.term), r.df) for r in kept} == {("en", b"b", 3), ("en", b"a", 2), ("fr", b"x", 1)}


def test_a_hot_term_in_many_sources_with_little_held(spark):
    rows = [("en", f"s{i % 40}", "the the " + "w" + "x" * (i % 7)) for i in range(200)]
    docs = spark.createDataFrame(rows, "lang string, source string, text string")
    got = divergence.divergence(docs, 2, 3)
    expected = brute([dict(zip(("lang", "source", "text"), r, strict=True)) for r in rows], 2, 3)
    assert sorted(map(tuple, got.collect())) == expected
    entries = spark.createDataFrame([("en", [(i, 10 * i, 5) for i in range(40)])], "lang string, own array<struct<i:int,p:long,p0:long>>")
    whole = {(r.i, r.j): r.value for r in divergence.sums_of_both(entries).collect()}
    parts = Counter()
    for r in divergence.sums_of_both(entries, held=50).collect():
        parts[r.i, r.j] += r.value
    assert whole == {k: parts[k] for k in whole} and len(whole) == 40 * 39


def test_exact_shares(spark):
    count, total, size = 123_456_789_012_345, 999_999_999_999_999, 77_777
    row = spark.createDataFrame([(count, total, size)], "c long, n long, v long")
    got = row.select(divergence.share(F.col("c"), F.col("n"), F.col("v"))).first()[0]
    assert got == 1 + 10**9 * (count + 5) // (total + 5 * size)


def test_empty_table(nothing):
    assert divergence.divergence(nothing).count() == 0


def test_terms():
    assert divergence.terms_of("Ab-cÉ 1x\x7fy_Ź") == [w.encode() for w in ("ab", "cÉ", "x", "y", "ź")]
    assert np.array_equal(divergence.terms_of(None), [])
