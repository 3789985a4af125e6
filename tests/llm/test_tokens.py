from __future__ import annotations

import zlib

import numpy as np
import public_tokenizers
import pytest
import xxhash
from tokenizers import Tokenizer

from stayline.llm import binary_ids, token_counts
from stayline.llm.common import scratch_path


@pytest.mark.parametrize("head", [100_000, 20, 0])
def test_counts_are_the_librarys(documents, rows, head):
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got = token_counts.token_counts(documents, head=head, limit=200).collect()
    expected = []
    for r in rows:
        n = len(library.encode(r.text or "", add_special_tokens=False).ids)
        expected.append((r.doc_id, len((r.text or "").encode()), n, n > 200))
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, expected))


def test_empty_table(nothing):
    assert token_counts.token_counts(nothing).count() == 0
    assert binary_ids.token_id_table(nothing).count() == 0


def place(row):
    """doc_id, NULL first, then the signed hash of the text."""
    own = xxhash.xxh64_intdigest((row.text or "").encode(), 42)
    return row.doc_id is not None, row.doc_id or 0, own - (1 << 64) * (own >> 63)


@pytest.mark.parametrize("how", [{}, dict(shard_docs=9, block_ids=500), dict(shard_docs=1000, block_ids=1)])
def test_round_trip(spark, documents, rows, how):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    path = scratch_path(spark, "ids")
    got = binary_ids.token_id_table(documents, path, **how).collect()
    ordered = sorted(rows, key=place)
    expected, start, first = [], 0, None
    for r in ordered:
        ids = library.encode(r.text or "", add_special_tokens=False).ids + [0]
        first = ids if r.doc_id == 205 else first
        expected.append((r.doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(map(tuple, got), key=lambda r: r[1]) == expected
    assert binary_ids.document_ids(spark, path, 205) == [first]
    assert len(binary_ids.document_ids(spark, path, 351)) == 2 and not binary_ids.document_ids(spark, path, 99_999)


def test_null_and_equal_ids_take_several_shards(spark):
    """10,000 rows without an id and 10,000 with one and the same are dealt by their texts."""
    rows = spark.range(20_000).selectExpr("CASE WHEN id % 2 = 0 THEN 7 END AS doc_id", "concat('text ', id) AS text")
    sizes = binary_ids.in_shards(rows, 1000).groupBy("shard", "doc_id").count().collect()
    assert max(r["count"] for r in sizes) < 3000 and len({r.shard for r in sizes if r.doc_id is None}) > 3
    path = scratch_path(spark, "ids")
    got = binary_ids.token_id_table(rows, path, shard_docs=1000)
    assert got.count() == 20_000 and got.select("start").distinct().count() == 20_000
    assert got.where("doc_id IS NULL").agg({"start": "max"}).first()[0] < got.where("doc_id = 7").agg({"start": "min"}).first()[0]


def test_a_very_long_text(spark):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    text = "".join(f"word{i % 977} and, more.\n" for i in range(40_000))
    docs = spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string")
    got = {r.doc_id: (r.start, r.n_tokens) for r in binary_ids.token_id_table(docs).collect()}
    n = len(library.encode(text, add_special_tokens=False).ids) + 1
    assert got == {1: (0, n), 2: (n, 1)}


@pytest.mark.parametrize("n, top", [(0, 0), (1, 0), (1, 9), (6, 5), (2000, 10**7), (3000, 40), (700, 2**62)])
def test_elias_fano(n, top):
    values = np.sort(np.random.default_rng(n).integers(0, top + 1, n)).astype(np.uint64)
    data = binary_ids.EliasFano.encode(values)
    found = binary_ids.EliasFano(data)
    assert (found.all() == values).all() and [found.select(i) for i in range(n)] == values.tolist()
    if n:
        assert len(data) <= 24 + n * (3 + max(0, np.log2((top + 1) / n))) / 8 + 16
    with pytest.raises(IndexError):
        found.select(n)
