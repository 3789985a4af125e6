"""Hashed maximum-entropy language model with a class-factored softmax.

``P(word | history) = P(class | history) * P(word | class, history)``.

* The commonest words (``HEAD_CLASSES * WIDTH``) lie in classes of ``WIDTH`` words. All other words lie in
  ``TAIL_CLASSES`` classes by the hash of their last two bytes, and the end of a text is a class of its own.
* The class is a softmax over features of the history: the previous word, two skips, a hashed word pair and a bias.
* Within a head class the word is a softmax over features of the classes before it. Within a tail class it has
  the share ``(c + 0.5) / (N_k + 0.5 * (V_k + 1))`` of the class, which leaves one place for unknown words.

Counts are of all training texts. Weights are trained by rounds of distributed updates: each task takes gradient
steps over its share of the training texts, in numpy minibatches, and passes on the changes of the rows it
touched; changes are averaged by touches, row by row, in a shuffle, and those of rarely touched rows are damped. Each training text is used in one round.
The model is ``rows x WIDTH`` floats, whatever the corpus, and is what is broadcast.

A text's score sums, beside the model's factors, values of its words from the table of counts. Those of the
``HEAD`` commonest words are broadcast (a fixed number); those of the others come by a shuffled join.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stayline.llm.common import id_remainder, materialize, numbered, per_worker, small_batches
from stayline.llm.token_counts import distinct_words, head_of

WIDTH = 64
HEAD_CLASSES = 32
TAIL_CLASSES = 31
HEAD_WORDS = HEAD_CLASSES * WIDTH
END_CLASS = HEAD_CLASSES + TAIL_CLASSES
START = HEAD_WORDS + TAIL_CLASSES
SYMBOLS = START + 1
PAIRS = 8192  # a power of two
HEAD = 100_000
ROUNDS = 2
STEP = 0.4
RARE = 20  # touches at which a row's change counts by half
BATCH = 4096
BLOCK = 512
FOLDS, HELD_OUT = 5, 1

#: first row of each kind of feature
SKIP2, SKIP3, PAIR, BIAS = SYMBOLS, 2 * SYMBOLS, 3 * SYMBOLS, 3 * SYMBOLS + PAIRS
WORD_BIAS = BIAS + 1
WORD_PREVIOUS = WORD_BIAS + HEAD_CLASSES
WORD_SKIP = WORD_PREVIOUS + WIDTH * HEAD_CLASSES
ROWS = WORD_SKIP + WIDTH * HEAD_CLASSES


def tail_class(word: bytes) -> int:
    return zlib.crc32(word[-2:]) % TAIL_CLASSES


def class_of(symbol: np.ndarray) -> np.ndarray:
    """Class of each symbol: a head word, a tail class or the start; the start counts as the end's class."""
    return np.where(symbol < HEAD_WORDS, symbol // WIDTH, symbol - HEAD_WORDS + HEAD_CLASSES)


def class_rows(p1: np.ndarray, p2: np.ndarray, p3: np.ndarray) -> list[np.ndarray]:
    pair = (p1.astype(np.uint64) * np.uint64(SYMBOLS) + p2.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
    return [p1, SKIP2 + p2, SKIP3 + p3, PAIR + (pair >> np.uint64(40) & np.uint64(PAIRS - 1)).astype(np.int64),
            np.full(len(p1), BIAS)]


def word_rows(target: np.ndarray, p1: np.ndarray, p2: np.ndarray) -> list[np.ndarray]:
    return [WORD_BIAS + target, WORD_PREVIOUS + class_of(p1) * HEAD_CLASSES + target,
            WORD_SKIP + class_of(p2) * HEAD_CLASSES + target]


def centred_sums(weights: np.ndarray, rows: list[np.ndarray]) -> Iterator[tuple[slice, ...]]:
    """For ``BLOCK`` places at a time, which stay in the processor's cache: the places, sums of the rows of their
    features less the largest sum, that sum, and the sums of exponentials. The arrays are used again for the next block.
    """
    size = min(BLOCK, len(rows[0]))
    totals, others = np.empty((2, size, weights.shape[1]), weights.dtype)
    for at in range(0, len(rows[0]), BLOCK):
        places = slice(at, min(at + BLOCK, len(rows[0])))
        total, other = totals[:places.stop - at], others[:places.stop - at]
        np.take(weights, rows[0][places], axis=0, out=total, mode="clip")  # clip: no copy to check the places first
        for r in rows[1:]:
            total += np.take(weights, r[places], axis=0, out=other, mode="clip")
        largest = total.max(1, keepdims=True)
        total -= largest
        yield places, total, largest, np.exp(total, out=other).sum(1, keepdims=True)


def log_softmax(weights: np.ndarray, rows: list[np.ndarray]) -> np.ndarray:
    out = np.empty((len(rows[0]), weights.shape[1]), weights.dtype)
    for places, total, _, norm in centred_sums(weights, rows):
        np.subtract(total, np.log(norm), out=out[places])
    return out


def log_softmax_at(weights: np.ndarray, rows: list[np.ndarray], target: np.ndarray) -> np.ndarray:
    """One column of ``log_softmax`` for each place."""
    out = np.empty(len(target), weights.dtype)
    for places, total, _, norm in centred_sums(weights, rows):
        out[places] = total[np.arange(len(total)), target[places]] - np.log(norm[:, 0])
    return out


def segment_sums(rows: np.ndarray, first: np.ndarray, near: int = 12, far: int = 48,
                 order: np.ndarray | None = None) -> np.ndarray:
    """Sums of the runs of ``rows`` that begin at ``first``: of the first ``near`` rows, and of the rest.

    Rows are added in their order, the first ``far`` rows of all runs together, those after them run by run. With
    ``order`` the runs are of ``rows[order]``, which is never made whole.
    """
    order = np.arange(len(rows)) if order is None else order
    length = np.diff(first, append=len(order))
    short = np.minimum(length, far + 1)
    long = np.argsort((far + 1 - short).astype(np.uint8), kind="stable")  # long runs first; 8 bits are sorted by radix
    start, length = first[long], length[long]
    more = len(first) - np.cumsum(np.bincount(short, minlength=far + 2))  # runs of more than k rows

    def add(total: np.ndarray, begin: int, end: int) -> np.ndarray:
        for k in range(begin, end):
            n = more[k]
            if not n:
                break
            total[:n] += rows.take(order[start[:n] + k], axis=0)
        return total

    total = add(rows.take(order[start], axis=0), 1, near)
    if n := more[near]:
        rest = add(rows.take(order[start[:n] + near], axis=0), near + 1, far)
        for i, (a, b) in enumerate(zip((start[:more[far]] + far).tolist(), (start + length).tolist(), strict=False)):
            rest[i] = np.add.reduce(np.concatenate([rest[i:i + 1], rows.take(order[a:b], axis=0)]), axis=0)
        total[:n] += rest
    out = np.empty_like(total)
    out[long] = total
    return out


class Trainer:
    """Gradient steps on a copy of the weights, with step sizes that fall per row."""

    def __init__(self, weights: np.ndarray, step: float = STEP):
        self.start, self.weights, self.step = weights, weights.copy(), step
        self.energy, self.touched = np.full(len(weights), 1.0, np.float32), np.zeros(len(weights), np.int64)

    def learn(self, symbols: np.ndarray, p1: np.ndarray, p2: np.ndarray, p3: np.ndarray) -> None:
        """``symbols`` are the targets; the end of a text is START."""
        for at in range(0, len(symbols), BATCH):
            s, a, b, c = (x[at:at + BATCH] for x in (symbols, p1, p2, p3))
            target = class_of(s)
            self._step(class_rows(a, b, c), target)
            head = np.flatnonzero(s < HEAD_WORDS)
            if len(head):
                self._step(word_rows(target[head], a[head], b[head]), s[head] % WIDTH)

    def _step(self, rows: list[np.ndarray], target: np.ndarray) -> None:
        n = len(target)
        residual = log_softmax(self.weights, rows)
        for at in range(0, n, BLOCK):
            block = residual[at:at + BLOCK]
            np.negative(np.exp(block, out=block), out=block)
        residual[np.arange(n), target] += 1
        if rows[-1][0] == BIAS:
            rows = rows[:-1]
            self._move(np.array([BIAS]), residual.sum(0, keepdims=True), np.array([n]))
        touched = np.concatenate(rows).astype(np.int16)  # ROWS fits, and 16 bits are sorted by radix
        order = np.argsort(touched, kind="stable")
        ordered = touched[order]
        first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
        self._move(ordered[first].astype(np.int64), segment_sums(residual, first, order=order % n),
                   np.diff(first, append=len(ordered)))

    def _move(self, row: np.ndarray, gradient: np.ndarray, times: np.ndarray) -> None:
        """Rows differ from each other; ``gradient`` is used up."""
        self.energy[row] += np.einsum("ij,ij->i", gradient, gradient) / 8
        gradient *= (self.step / np.sqrt(self.energy[row]))[:, None]
        gradient += self.weights.take(row, axis=0)
        self.weights[row] = gradient
        self.touched[row] += times

    def changes(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        row = np.flatnonzero(self.touched)
        return row, self.touched[row], self.weights[row] - self.start[row]


class Lexicon:
    """The broadcast part: words with their places, and per place a symbol and two values (zero: not broadcast)."""

    def __init__(self, words: list[bytes], base: np.ndarray, share: np.ndarray):
        self.words = pa.array(words, pa.binary())
        self.base, self.share = np.append(base, 0.0), np.append(share, 0.0)
        self.symbols = np.append(np.array([i if i < HEAD_WORDS else HEAD_WORDS + tail_class(w)
                                           for i, w in enumerate(words)], np.int64), START)

    def read(self, texts: pa.Array) -> Reading:
        """Words are split, lowered and looked up by Arrow, a batch at a time; no Python object is made of a common word."""
        pieces = pc.ascii_split_whitespace(pc.ascii_lower(texts))
        words, sizes = pieces.flatten().cast(pa.binary()), pc.fill_null(pc.list_value_length(pieces), 0).to_numpy()
        whole = pc.binary_length(words).to_numpy() > 0  # white space at the ends of a text leaves empty words
        owner = np.repeat(np.arange(len(texts)), sizes)
        if not whole.all():
            words, owner = words.filter(pa.array(whole)), owner[whole]
        place = pc.fill_null(pc.index_in(words, value_set=self.words), -1).to_numpy().astype(np.int64)
        rare = np.flatnonzero(place < 0)
        unknown = words.take(pa.array(rare))
        symbols = self.symbols[place]
        endings = pc.binary_slice(unknown, -2).dictionary_encode()
        classes = np.array([HEAD_WORDS + tail_class(w) for w in endings.dictionary.to_pylist()], np.int64)
        symbols[rare] = classes[endings.indices.to_numpy()]
        return Reading(len(texts), owner, place, symbols, owner[rare], unknown)


class Reading:
    """The words of some texts: per word its text, place (-1: not broadcast) and symbol; words not broadcast, their texts."""

    def __init__(self, n: int, owner: np.ndarray, place: np.ndarray, symbols: np.ndarray, rare: np.ndarray,
                 unknown: pa.Array):
        self.n, self.owner, self.place, self.symbols, self.rare, self.unknown = n, owner, place, symbols, rare, unknown

    def histories(self) -> tuple[np.ndarray, ...]:
        """Targets, text by text, each text's end (START) after its words, and the one, two and three symbols before them."""
        flat = np.full(len(self.symbols) + 4 * self.n, START)
        flat[np.arange(len(self.symbols)) + 4 * self.owner + 3] = self.symbols
        owner = self.owners()
        at = np.arange(len(owner)) + 3 * (owner + 1)
        return flat[at], flat[at - 1], flat[at - 2], flat[at - 3]

    def owners(self) -> np.ndarray:
        """The text of each target."""
        return np.repeat(np.arange(self.n), np.bincount(self.owner, minlength=self.n) + 1)

    def others(self) -> pa.Array:
        """Per text the words that aren't broadcast, with how often it has them."""
        coded = self.unknown.dictionary_encode()
        size = max(1, len(coded.dictionary))
        key, times = np.unique(self.rare * size + coded.indices.to_numpy(), return_counts=True)
        edges = np.searchsorted(key, np.arange(self.n + 1) * size)
        return pa.MapArray.from_arrays(pa.array(edges.astype(np.int32)), coded.dictionary.take(pa.array(key % size)),
                                       pa.array(times.astype(np.int64)))


class Scorer:
    """Natural log probabilities of the model's factors.

    Word softmaxes have few histories, (a class and the two classes before it), so their norms are computed once.
    """

    def __init__(self, weights: np.ndarray):
        self.weights = weights
        kinds = np.arange(HEAD_CLASSES * WIDTH * WIDTH)
        rows = [WORD_BIAS + kinds // WIDTH ** 2, WORD_PREVIOUS + kinds // WIDTH % WIDTH * HEAD_CLASSES + kinds // WIDTH ** 2,
                WORD_SKIP + kinds % WIDTH * HEAD_CLASSES + kinds // WIDTH ** 2]
        self.largest, self.norm = np.empty((2, len(kinds)), weights.dtype)
        for places, _, largest, norm in centred_sums(weights, rows):
            self.largest[places], self.norm[places] = largest[:, 0], np.log(norm[:, 0])

    def score(self, symbols, p1, p2, p3) -> np.ndarray:
        out = np.empty(len(symbols))
        for at in range(0, len(symbols), BATCH):
            s, a, b, c = (x[at:at + BATCH] for x in (symbols, p1, p2, p3))
            target = class_of(s)
            found = log_softmax_at(self.weights, class_rows(a, b, c), target).astype(float)
            head = np.flatnonzero(s < HEAD_WORDS)
            found[head] += self.within(s[head], a[head], b[head])
            out[at:at + BATCH] = found
        return out

    def within(self, symbols: np.ndarray, p1: np.ndarray, p2: np.ndarray) -> np.ndarray:
        """Of head words in their classes."""
        target, word = np.divmod(symbols, WIDTH)
        bias, *more = (self.weights[r, word] for r in word_rows(target, p1, p2))
        for m in more:
            bias += m
        kind = (target * WIDTH + class_of(p1)) * WIDTH + class_of(p2)
        return bias - self.largest[kind] - self.norm[kind]


def first_weights(head_counts: np.ndarray, class_counts: np.ndarray) -> np.ndarray:
    """Weights at which the model is the smoothed unigram model: biases only."""
    weights = np.zeros((ROWS, WIDTH), np.float32)
    weights[BIAS] = np.log((class_counts + 0.5) / (class_counts.sum() + 0.5 * WIDTH))
    counts = np.zeros(HEAD_WORDS)
    counts[:len(head_counts)] = head_counts
    counts = counts.reshape(HEAD_CLASSES, WIDTH)
    logs = np.log(np.maximum(counts, 1e-3) / np.maximum(counts, 1e-3).sum(1, keepdims=True))
    weights[WORD_BIAS:WORD_BIAS + HEAD_CLASSES] = logs
    return weights


# --- training --------------------------------------------------------------------------------


def train_round(texts: DataFrame, lexicon, weights: np.ndarray, key: str, step: float = STEP) -> np.ndarray:
    """Weights after all tasks have learned from their share of ``texts`` (text), averaged by touches."""
    shared = texts.sparkSession.sparkContext.broadcast(weights)
    schema = "row int, touched long, change binary"
    fields = ["row", "touched", "change"]

    def rows_of(row, touched, change) -> Iterator[pa.RecordBatch]:
        for at in range(0, len(row), 4096):
            block = np.ascontiguousarray(change[at:at + 4096], np.float32)
            yield pa.RecordBatch.from_arrays(
                [pa.array(row[at:at + 4096].astype(np.int32)), pa.array(touched[at:at + 4096].astype(np.int64)),
                 pa.array([x.tobytes() for x in block], pa.binary())], names=fields)

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = per_worker(("lexicon", key), lambda: Lexicon(*lexicon.value))
        trainer = Trainer(shared.value, step)
        for batch in batches:
            for part in small_batches(batch, 1 << 20):
                trainer.learn(*words.read(part.column(0)).histories())
        yield from rows_of(*trainer.changes())

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, touched = np.zeros((ROWS, WIDTH)), np.zeros(ROWS, np.int64)
        for batch in batches:
            changes = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.float32).reshape(-1, WIDTH)
            row, times = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            np.add.at(total, row, changes * times[:, None])
            np.add.at(touched, row, times)
        found = np.flatnonzero(touched)
        yield from rows_of(found, touched[found], total[found] / (touched[found] + RARE)[:, None])

    n = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    merged = texts.select("text").mapInArrow(learn, schema).repartition(n, "row").mapInArrow(add, schema)
    after = weights.copy()
    for row, _, change in merged.collect():
        after[row] += np.frombuffer(change, np.float32)
    shared.unpersist()
    return after


TAIL_CLASS = (f"CAST(crc32(CASE WHEN length(word) < 2 THEN word ELSE substring(word, length(word) - 1, 2) END) "
              f"% {TAIL_CLASSES} AS int)")


def score_documents(docs: DataFrame, folds: int = FOLDS, held_out: int = HELD_OUT, rounds: int = ROUNDS,
                    head: int = HEAD) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row of ``docs`` (doc_id, text).

    Learns from rows whose crc32(doc_id) modulo ``folds`` isn't ``held_out``; a row without doc_id isn't learned
    from and not held out. NULL and empty texts are an end alone. Words are lower-cased (A-Z) runs without ASCII white space.
    Repeated rows count each; other columns aren't looked at; an empty table gives an empty result, and if there
    is nothing to learn from, all words are unknown.
    """
    spark = docs.sparkSession
    rest = id_remainder(folds)
    texts = docs.select(F.col("doc_id").cast("long"), "text")
    training = texts.where(rest != held_out)
    counts = materialize(distinct_words(training, lower=True), "counts")
    n_docs = training.count()
    by_class = {r[0]: (r[1], r[2]) for r in counts.groupBy(F.expr(TAIL_CLASS)).agg(F.sum("n"), F.count("*")).collect()}
    total = sum(n for n, _ in by_class.values()) + n_docs
    distinct = sum(v for _, v in by_class.values()) + (n_docs > 0)
    base_size = total + 0.5 * (distinct + 1)

    common = head_of(counts, "n", head)
    words, own = list(common), np.array(list(common.values()), np.int64)
    tail = np.array([by_class.get(k, (0, 0)) for k in range(TAIL_CLASSES)], float)
    for word, n in zip(words[:HEAD_WORDS], own[:HEAD_WORDS].tolist(), strict=True):
        tail[tail_class(word)] -= (n, 1)
    classes = np.zeros(WIDTH)
    first = np.zeros(HEAD_WORDS)
    first[:min(HEAD_WORDS, len(own))] = own[:HEAD_WORDS]
    classes[:HEAD_CLASSES] = first.reshape(HEAD_CLASSES, WIDTH).sum(1)
    classes[HEAD_CLASSES:END_CLASS], classes[END_CLASS] = tail[:, 0], n_docs
    tail_size = tail[:, 0] + 0.5 * (tail[:, 1] + 1)
    base = np.log10((own + 0.5) / base_size)
    share = np.array([0.0 if i < HEAD_WORDS else np.log10((n + 0.5) / tail_size[tail_class(w)])
                      for i, (w, n) in enumerate(zip(words, own.tolist(), strict=True))])
    lexicon, key = spark.sparkContext.broadcast((words, base, share)), uuid.uuid4().hex

    weights = first_weights(first, classes)
    for number in range(rounds):
        turn = F.pmod(F.xxhash64("doc_id"), F.lit(rounds)) == number
        weights = train_round(training.where(turn), lexicon, weights, key)
    model = spark.sparkContext.broadcast(weights)
    end_base = float(np.log10((n_docs + 0.5) / base_size))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex, scorer = per_worker(("scorer", key), lambda: (Lexicon(*lexicon.value), Scorer(model.value)))
        for batch in batches:
            for part in small_batches(batch, 2 << 20):
                found = lex.read(part.column(1))
                factors = scorer.score(*found.histories()) / np.log(10)

                def sums(owner: np.ndarray, values: np.ndarray | None = None, n: int = found.n) -> np.ndarray:
                    return np.bincount(owner, values, n)

                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(sums(found.owner) + 1, pa.int64()),
                     pa.array(sums(found.owner[found.place >= 0]) + int(n_docs > 0), pa.int64()),
                     pa.array(sums(found.owner, lex.base[found.place]) + end_base),
                     pa.array(sums(found.owners(), factors) + sums(found.owner, lex.share[found.place])),
                     found.others()], names=["doc_id", "n_tokens", "known", "base", "model", "others"])

    scored = numbered(texts.mapInArrow(task, "doc_id long, n_tokens long, known long, base double, model double, "
                                             "others map<binary, bigint>"), "scored")
    sizes = F.array(*[F.lit(float(x)) for x in tail_size])
    n = F.coalesce("n", F.lit(0)) + 0.5
    more = (
        scored.select("_row", F.explode("others").alias("word", "times")).join(counts, "word", "left")
        .groupBy("_row").agg(
            F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("more_known"),
            F.sum(F.col("times") * F.log10(n / base_size)).alias("more_base"),
            F.sum(F.col("times") * F.log10(n / F.element_at(sizes, F.expr(TAIL_CLASS) + 1))).alias("more_model"))
    )
    zero = F.lit(0.0)
    return scored.drop("others").join(more, "_row", "left").select(
        "doc_id", F.coalesce(rest == held_out, F.lit(False)).alias("held_out"), "n_tokens",
        (F.col("known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        F.lit(int(total)).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more_base", zero)).alias("base_score"),
        (F.col("model") + F.coalesce("more_model", zero)).alias("score"))
