from __future__ import annotations

import random
import zlib

import numpy as np

from stayline.llm import cross_parse

from .conftest import sentence


def brute_phrases(sample, text):
    n, i = 0, 0
    while i < len(text):
        j = i + 1
        while j <= len(text) and text[i:j] in sample:
            j += 1
        i, n = max(i + 1, j - 1), n + 1
    return n


def test_phrases_against_brute_force():
    rng = random.Random(1)
    for _ in range(150):
        sample = bytes(rng.choices(b"abc ", k=rng.randint(1, 60)))
        texts = sorted((bytes(rng.choices(b"abcd ", k=rng.randint(1, 40))) for _ in range(5)), key=len, reverse=True)
        length = np.array([len(t) for t in texts])
        found = cross_parse.Automaton(sample).phrases(
            np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *length[:-1]]), length)
        assert found.tolist() == [brute_phrases(sample, t) for t in texts]


def test_pieces_of_long_texts():
    model = cross_parse.Model({"a": b"abcabc" * 9, "x": b"xyzzy" * 9})
    langs, scores = model.predict(["abc " * 900, "XYZ", None, "", "12 ²!", "abc xyz " * 400], piece=64)
    assert langs[:5] == ["a", "x", "und", "und", "und"] and scores[2:5] == [0.0] * 3 and all(0 <= s <= 1 for s in scores)


def test_held_out_accuracy(spark):
    rng = random.Random(2)
    rows = [(i, sentence(rng, rng.randint(8, 60), lang), lang, "s") for i in range(200) for lang in [("en", "fr")[i % 2]]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    got = cross_parse.identify(docs, sample_bytes=4000).collect()
    held = [r for r in got if r.held_out]
    assert {r.doc_id for r in held} == {i for i in range(200) if zlib.crc32(str(i).encode()) % 4 == 2}
    assert sum(r.lang_pred == rows[r.doc_id][2] for r in held) >= 0.95 * len(held)


def test_odd_rows(documents, rows, nothing):
    got = {(r.doc_id, r.lang_pred) for r in cross_parse.identify(documents).collect()}
    assert {(0, "und"), (1, "und"), (3, "und"), (9, "und")} <= got and len(rows) == cross_parse.identify(documents).count()
    assert not any(r.held_out for r in cross_parse.identify(documents).where("doc_id IS NULL").collect())
    assert cross_parse.identify(nothing).count() == 0
    unlabelled = documents.withColumn("lang", documents.lang.substr(99, 1)).selectExpr("doc_id", "text", "nullif(lang, '') AS lang")
    assert {r.lang_pred for r in cross_parse.identify(unlabelled).collect()} == {"und"}
