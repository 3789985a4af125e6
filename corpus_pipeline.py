"""From raw documents to token files: language ID, near-dedup, decontamination, mixing, token ids.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet and read again as the next one's ``docs``. All but the last give rows of ``docs`` with all their columns,
whatever those are called, and an empty table for an empty one. So when a stage begins, the intermediate copies of the
stage before aren't needed any more, and are deleted.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from stayline.llm.binary_ids import token_id_table
from stayline.llm.common import materialize, table
from stayline.llm.cross_parse import documents_with_language
from stayline.llm.decontamination import clean_documents
from stayline.llm.mixing import mixed_documents
from stayline.llm.near_documents import distinct_documents
from stayline.session import copies_made, remove_copies

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
_MADE: list[str] = []


def staged(stage: Stage) -> Stage:
    """``stage``, after deleting the copies of the stage before."""

    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        remove_copies(spark, _MADE)
        before = set(copies_made())
        result = stage(spark, docs, sf_dir)
        _MADE[:] = [path for path in copies_made() if path not in before]
        return result

    return run_stage



@staged
def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language; NULL and empty texts and those without a letter are rejected."""
    return documents_with_language(docs)


@staged
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that with the smallest doc_id; NULL ids come last, ties are open."""
    return distinct_documents(docs)


@staged
def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap no benchmark passage; NULL and empty texts overlap none, repeated rows share their fate."""
    return clean_documents(docs, table(spark, sf_dir, "benchmark"))


@staged
def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, up to twice; texts without words are never taken."""
    return mixed_documents(docs)


@staged
def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 from the written files."""
    return token_id_table(docs)


STAGES = [
    ("language ID", language_id),
    ("SimHash near-dedup", near_dedup),
    ("benchmark decontamination", decontaminate),
    ("mixing to target weights", mix),
    ("token ids", token_ids),
]

#: SQL can't express hashed fingerprints, trees and tokenizers; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-").lower())
    return STAGES[-1][1](spark, docs, sf_dir)
