from __future__ import annotations

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from stayline.session import materialize

from .conftest import sentence
from .test_tokens import place


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("corpus")
    rng = random.Random(11)
    passage = sentence(rng, 30)
    rows = [(i, sentence(rng, rng.randint(20, 120)), "en", f"src{i % 3}", 0) for i in range(60)]
    rows += [(100 + i, rows[5][1], "en", "src0", 0) for i in range(9)]
    rows += [(200 + i, sentence(rng, 25) + " " + passage + " " + sentence(rng, 25), "en", None, 0) for i in range(4)]
    rows += [(300, None, "en", "src1", 0), (301, "", None, "src1", 0), (302, "123 !!", "en", "src1", 0), (None, sentence(rng, 50), None, "src1", 0)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame([(1, passage), (2, None)], "item_id long, text string").write.parquet(f"{root}/benchmark.parquet")
    return str(root)


def test_every_stage_takes_effect(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, seen = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, materialize(stage(spark, docs, folder), "stage")
        seen.append({r.doc_id for r in docs.collect()})
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns
    clean = set(range(60)) | {None}
    assert seen[0] == clean | set(range(100, 109)) | set(range(200, 204))
    assert seen[1] == clean | set(range(200, 204))
    assert seen[2] == clean and seen[3] <= clean
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    expected, start = [], 0
    for r in sorted(before.collect(), key=place):
        ids = library.encode(r.text, add_special_tokens=False).ids + [0]
        expected.append((r.doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(map(tuple, docs.collect()), key=lambda r: r[1]) == expected


def test_columns_of_any_name_come_back_as_they_were(spark, folder):
    """Names that the operators use themselves, and ones that need quoting."""
    names = ["_row", "_size", "_key", "_copies", "_copy", "_lang", "_score", "_doc", "_hash", "node", "fp", "text_hash", "key", "a.b", "c d", "column 0"]
    docs = spark.read.parquet(f"{folder}/documents.parquet").selectExpr("*", *[f"concat('{n} of ', doc_id) AS `{n}`" for n in names])
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = materialize(stage(spark, docs, folder), "stage")
        assert docs.columns == columns
        rows = docs.where("doc_id IS NOT NULL").collect()
        assert rows and all(r[n] == f"{n} of {r.doc_id}" for r in rows for n in names)


def test_run_is_the_stages_in_order(spark, folder):
    got = corpus_pipeline.run(spark, folder)
    again = corpus_pipeline.run(spark, folder)
    assert got.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    assert sorted(map(str, got.collect())) == sorted(map(str, again.collect()))


def test_empty_documents(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").where("false")
    for _, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, folder), "stage")
        assert docs.count() == 0
