"""Language ID by cross-parsing: which language's text describes a document in the fewest phrases.

Per language a suffix automaton of a bounded sample of labelled text answers longest-match queries. A document is
parsed greedily into phrases, each the longest string that occurs in the sample (or one unknown byte). Phrases,
times the bits to name a place in the sample, over the letters parsed, estimate the cross entropy; the
language with the least wins.

Texts are reduced to lower-case letters with one space between words, as UTF-8 bytes. They are parsed whole, in
pieces of ``PIECE`` bytes that each begin a new phrase, so thousands of pieces advance together, a byte a
step, in numpy; a very long text is merely more pieces.

The sample is the only part of the corpus the model keeps: at most ``SAMPLE_BYTES`` bytes of each language and
``TOTAL_BYTES`` in all, from at most ``DOC_BYTES`` of each sampled document. Which documents are sampled follows
a hash of their id. The sample is broadcast; each Python worker builds the automata once. A dense automaton takes
about ``2 * bytes * alphabet * 4`` bytes, some 15 MB per language here.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from stayline.llm.common import id_remainder, keeps_columns, per_worker, small_batches

SAMPLE_BYTES = 40_000
TOTAL_BYTES = 2_000_000
DOC_BYTES = 1_500
PIECE = 2048
FOLDS, HELD_OUT = 4, 2
UNKNOWN = "und"

_NOT_LETTERS = re.compile(r"[\W\d_]+")


def letters(text: str | None) -> bytes:
    """Lower-case letters, one space for whatever lies between; empty if there is no letter."""
    found = _NOT_LETTERS.sub(" ", text.lower()).strip() if text else ""
    return found.encode("utf-8", "replace") if any(map(str.isalpha, found)) else b""


class Automaton:
    """Suffix automaton of a text as a dense table: ``step[state, byte class]`` is a state, or -1."""

    def __init__(self, text: bytes):
        link, length, step = [-1], [0], [{}]
        last = 0
        for c in text:
            now = len(step)
            step.append({})
            length.append(length[last] + 1)
            link.append(0)
            p = last
            while p != -1 and c not in step[p]:
                step[p][c] = now
                p = link[p]
            if p != -1:
                q = step[p][c]
                if length[p] + 1 == length[q]:
                    link[now] = q
                else:
                    copy = len(step)
                    step.append(dict(step[q]))
                    length.append(length[p] + 1)
                    link.append(link[q])
                    while p != -1 and step[p].get(c) == q:
                        step[p][c] = copy
                        p = link[p]
                    link[q] = link[now] = copy
            last = now
        used = sorted(set(text))
        self.classes = np.zeros(256, np.int32)
        self.classes[used] = np.arange(1, len(used) + 1)
        self.width = len(used) + 1
        self.step = np.full((len(step), self.width), -1, np.int32)
        for state, out in enumerate(step):
            for c, to in out.items():
                self.step[state, self.classes[c]] = to
        self.flat = self.step.ravel()
        self.bits = float(np.log2(max(2, len(text))))

    def phrases(self, data: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Phrases of each piece ``data[start:start + length]``; pieces come longest first."""
        classes, width, flat, root = self.classes[data], self.width, self.flat, self.step[0]
        state = np.zeros(len(start), np.int32)
        count = np.ones(len(start), np.int64)
        active = np.searchsorted(-length, -np.arange(int(length[0]) if len(length) else 0), "left")
        for at, n in enumerate(active.tolist()):
            c = classes[start[:n] + at]
            to = flat[state[:n] * width + c]
            broken = to < 0
            if at:  # the first phrase is counted; state 0 is that after an unknown byte
                count[:n] += broken | (state[:n] == 0)
            to[broken] = np.maximum(root[c[broken]], 0)
            state[:n] = to
        return count


class Model:
    """Automata by language; ``texts`` is the sample."""

    def __init__(self, texts: dict[str, bytes]):
        self.languages = sorted(texts)
        self.automata = [Automaton(texts[x]) for x in self.languages]

    def predict(self, texts: list[str | None], piece: int = PIECE) -> tuple[list[str], list[float]]:
        """Language and score of each text. Score: the runner-up's share of both entropies, 0.5 to 1."""
        raws = [letters(t) for t in texts]
        cuts = [(i, at, min(piece, len(r) - at)) for i, r in enumerate(raws) for at in range(0, len(r), piece)]
        offset = np.cumsum([0, *map(len, raws)])
        data = np.frombuffer(b"".join(raws), np.uint8)
        owner = np.array([c[0] for c in cuts], np.int64)
        start = np.array([offset[c[0]] + c[1] for c in cuts], np.int64)
        length = np.array([c[2] for c in cuts], np.int64)
        order = np.argsort(-length, kind="stable")
        owner, start, length = owner[order], start[order], length[order]
        cost = np.empty((len(self.automata), len(texts)))
        size = np.array([max(1, len(r)) for r in raws])
        for k, automaton in enumerate(self.automata):
            found = np.bincount(owner, automaton.phrases(data, start, length), len(texts))
            cost[k] = found * automaton.bits / size
        langs, scores = [], []
        for i, raw in enumerate(raws):
            if not raw or not self.languages:
                langs.append(UNKNOWN)
                scores.append(0.0)
                continue
            best = int(np.argmin(cost[:, i]))
            others = np.delete(cost[:, i], best)
            rival = float(others.min()) if len(others) else 0.0
            langs.append(self.languages[best])
            scores.append(rival / (rival + float(cost[best, i])) if len(others) else 1.0)
        return langs, scores


def training_sample(docs: DataFrame, sample_bytes: int = SAMPLE_BYTES, total_bytes: int = TOTAL_BYTES,
                    doc_bytes: int = DOC_BYTES) -> dict[str, bytes]:
    """At most ``sample_bytes`` of reduced text per language of ``docs`` (doc_id, text, lang)."""
    known = docs.where("lang IS NOT NULL AND text IS NOT NULL AND doc_id IS NOT NULL")
    sizes = known.groupBy("lang").count()
    langs = {r["lang"]: r["count"] for r in sizes.orderBy(F.desc("count"), "lang").limit(total_bytes // 1000).collect()}
    if not langs:
        return {}
    each = min(sample_bytes, total_bytes // len(langs))
    wanted = 4 * (each // doc_bytes + 1) + 20  # documents, as many are shorter than doc_bytes
    share = F.create_map(*[x for k, n in langs.items() for x in (F.lit(k), F.lit(min(1.0, wanted / n)))])
    draw = F.pmod(F.xxhash64(F.lit("language sample"), "doc_id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    drawn = known.where(draw < share[F.col("lang")]).select(
        "lang", F.substring("text", 1, doc_bytes).alias("text"), draw.alias("draw"), "doc_id")
    parts: dict[str, list[bytes]] = {k: [] for k in langs}
    for r in drawn.orderBy("draw", "doc_id", "text").toLocalIterator():
        parts[r["lang"]].append(letters(r["text"])[:doc_bytes])
    return {k: b" ".join(v)[:each] for k, v in parts.items() if any(v)}


def predict_languages(docs: DataFrame, model_texts: dict[str, bytes]) -> DataFrame:
    """All columns of ``docs`` with ``_lang`` and ``_score`` from the whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model_texts)
    key = tuple(sorted((k, zlib.crc32(v)) for k, v in model_texts.items()))
    at = docs.columns.index("text")
    names = [*docs.columns, "_lang", "_score"]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = per_worker(("languages", key), lambda: Model(shared.value))
        for batch in batches:
            for part in small_batches(batch):
                langs, scores = model.predict(part.column(at).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=names)

    schema = StructType([*docs.schema.fields, StructField("_lang", StringType()), StructField("_score", DoubleType())])
    return docs.mapInArrow(task, schema)


@keeps_columns("doc_id", "text", "lang")
def documents_with_language(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` (doc_id, text, lang, ...) whose text has a language, learned from all of them.

    Texts that are NULL or without a letter go, and all do where no row has a lang. Repeated rows stay repeated.
    """
    return predict_languages(docs, training_sample(docs)).where(F.col("_lang") != UNKNOWN)


def identify(docs: DataFrame, folds: int = FOLDS, held_out: int = HELD_OUT, **sizes) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row of ``docs`` (doc_id, text, lang).

    Learns from rows with a lang whose crc32(doc_id) modulo ``folds`` isn't ``held_out``; rows without doc_id or
    lang aren't learned from, and a row without doc_id isn't held out. NULL texts and texts without a letter are
    ``und`` with score 0, as is everything if there is nothing to learn from. Repeated rows are rows of
    their own; other columns aren't looked at; an empty table gives an empty result.
    """
    rest = id_remainder(folds)
    texts = training_sample(docs.where(rest != held_out).select("doc_id", "text", "lang"), **sizes)
    found = predict_languages(docs.select("doc_id", "text"), texts)
    return found.select("doc_id", F.coalesce(id_remainder(folds) == held_out, F.lit(False)).alias("held_out"),
                        F.col("_lang").alias("lang_pred"), F.col("_score").alias("score"))
