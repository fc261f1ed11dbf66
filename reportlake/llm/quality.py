"""Quality classifier: supervised subword embeddings.

A document's vector is the average of the learned vectors of its words and of
their character n-grams, hashed into buckets; a softmax layer reads it. Both
are trained by stochastic gradient descent in numpy, on a bounded sample of
labelled rows. The layers being linear up to the softmax, executors keep one
number a word, so scoring a text is a sum over its words.

Null and empty texts have no features and get the score of the bias. Repeated
rows are scored alike; empty tables give no rows; null ids are kept as they
are. Only texts leave the JVM: ids and other columns stay as they are, and their
names may clash with anything.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reportlake.llm.common import WordRows, labelled_texts

BUCKETS = 1 << 16
DIM = 8
EPOCHS = 6
RATE = 0.5
TRAINING_ROWS = 3000  # labelled rows at most that are learned from
TRAINING_MB = 64  # of their texts together
THRESHOLD = 0.3
SEED = 7
LONG = 64  # bytes; longer words are added up in pieces and not kept
PIECE = 1 << 16  # n-grams of a long word that are added up together
RUN = 1 << 12  # words of a training text that are added up together
KEPT_MB = 32  # of training texts' counts that are kept from one epoch to the next; the others' are made anew
WORD = re.compile(rb"\S+")  # what split() gives, one at a time


def buckets(word: bytes, size: int = BUCKETS) -> list[int]:
    """The word's own bucket and those of its character (byte) 3- and 4-grams, with marks at both ends."""
    crc, marked = zlib.crc32, b"<" + word + b">"
    n = len(marked)
    return [crc(word) % size, *[crc(marked[i : i + 3]) % size for i in range(n - 2)], *[crc(marked[i : i + 4]) % size for i in range(n - 3)]]


def crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1)
    return table


CRC = crc_table()


def crcs(marked: np.ndarray, n: int) -> np.ndarray:
    """crc32 of each n-gram of some bytes."""
    crc = np.full(max(0, len(marked) - n + 1), 0xFFFFFFFF, dtype=np.uint32)
    for k in range(n):
        crc = CRC[(crc ^ marked[k : k + len(crc)]) & 255] ^ (crc >> 8)
    return crc ^ np.uint32(0xFFFFFFFF)


def pieces(word: bytes, size: int = BUCKETS) -> Iterator[np.ndarray]:
    """buckets() of a long word, in parts of bounded size."""
    yield np.array([zlib.crc32(word) % size])
    marked = np.frombuffer(b"<" + word + b">", dtype=np.uint8)
    for n in (3, 4):
        for at in range(0, len(marked) - n + 1, PIECE):
            yield (crcs(marked[at : at + PIECE + n - 1], n) % size).astype(np.int64)


def buckets_of(words: list[bytes], size: int = BUCKETS) -> np.ndarray:
    """buckets() of words one after another; a word of n bytes has 2 n."""
    marked = np.frombuffer(b"<" + b"><".join(words) + b">", dtype=np.uint8)
    n = np.fromiter(map(len, words), np.int64, len(words))
    before = np.cumsum(n) - n
    each = np.repeat(np.arange(len(words)), n)
    at = np.arange(len(each)) - before[each]  # of an n-gram in its word
    start = before[each] + 2 * each + at  # in marked
    put = 2 * before[each] + 1 + at
    four = at < n[each] - 1
    out = np.empty(2 * len(each), np.int64)
    out[2 * before] = np.fromiter(map(zlib.crc32, words), np.int64, len(words))
    out[put] = crcs(marked, 3)[start]
    out[(put + n[each])[four]] = crcs(marked, 4)[start[four]]
    return out % size


def counted(text: str | None, zeros: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A text's buckets, as they first occur, and how often each does, in as few bytes as hold them.

    zeros: one for each bucket; they are zeros again afterwards.
    """
    size, order = len(zeros), [np.zeros(0, np.int64)]

    def add(found: np.ndarray, times: np.ndarray) -> None:
        some, first = np.unique(found, return_index=True)
        order.append(found[np.sort(first[zeros[some] == 0])])
        np.add.at(zeros, found, times)

    def add_words(words: dict[bytes, int]) -> None:
        if words:
            add(buckets_of(list(words), size), np.repeat(np.fromiter(words.values(), np.int64), [2 * len(w) for w in words]))

    words = (m[0] for m in WORD.finditer((text or "").encode()))
    while run := Counter(islice(words, RUN)):
        short: dict[bytes, int] = {}
        for w, c in run.items():
            if len(w) <= LONG:
                short[w] = c
                continue
            add_words(short)
            short = {}
            for piece in pieces(w, size):
                some, times = np.unique(piece, return_counts=True)
                add(some, c * times)
        add_words(short)
    ids = np.concatenate(order)
    counts = zeros[ids]
    zeros[ids] = 0
    return ids.astype(np.min_scalar_type(size - 1)), counts.astype(np.min_scalar_type(counts.max(initial=0)))


@dataclass
class Model:
    vectors: np.ndarray  # a vector for each bucket
    weights: np.ndarray  # of the softmax: dim x 2
    bias: np.ndarray

    def margins(self) -> tuple[np.ndarray, float]:
        """For each bucket what it adds to the log-odds of label 1, and the bias."""
        return (self.vectors @ (self.weights[:, 1] - self.weights[:, 0])).astype(np.float64), float(self.bias[1] - self.bias[0])


def train(texts: list[str | None], labels: list[int], *, size: int = BUCKETS, epochs: int = EPOCHS, rate: float = RATE, seed: int = SEED) -> Model:
    rng = np.random.default_rng(seed)
    model = Model(rng.uniform(-1 / DIM, 1 / DIM, (size, DIM)), np.zeros((DIM, 2)), np.zeros(2))
    zeros, room = np.zeros(size, np.int64), int(KEPT_MB * (1 << 20))
    kept: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    steps, at = epochs * len(texts), 0
    for _ in range(epochs):
        for i in rng.permutation(len(texts)).tolist():
            ids, counts = found = kept.get(i) or counted(texts[i], zeros)
            if i not in kept and (need := ids.nbytes + counts.nbytes + 256) <= room:
                kept[i], room = found, room - need
            share = counts.astype(np.float64)
            share /= max(1.0, share.sum())
            lr = rate * (1 - at / steps)
            at += 1
            hidden = share @ model.vectors[ids]
            z = hidden @ model.weights + model.bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[labels[i]] -= 1.0
            back = model.weights @ p
            model.weights -= lr * np.outer(hidden, p)
            model.bias -= lr * p
            model.vectors[ids] -= lr * len(ids) ** 0.5 * share[:, None] * back
    return model


def score_texts(texts: list[str | None], margin: np.ndarray, bias: float, known: WordRows) -> np.ndarray:
    """Scores; known keeps each word's log-odds and number of buckets between calls, but for long words."""
    runs = [t.encode().split() if t else [] for t in texts]
    long: dict[int, np.ndarray] = {}
    for i, r in enumerate(runs):
        if max(map(len, r), default=0) > LONG:
            long[i] = sum(c * np.array([margin[b].sum(), len(b)]) for w, c in Counter(w for w in r if len(w) > LONG).items() for b in pieces(w, len(margin)))
            runs[i] = [w for w in r if len(w) <= LONG]
    if new := known.new(runs):
        found = [buckets(w, len(margin)) for w in new]
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        flat = margin[np.fromiter((b for f in found for b in f), np.int64, int(sizes.sum()))]
        known.add(new, np.stack([np.add.reduceat(flat, np.cumsum(sizes) - sizes), sizes], axis=1))
    out = np.full(len(texts), bias)
    for i, r in enumerate(runs):
        if r or i in long:
            total, n = known.sum(r) + long.get(i, 0.0)
            out[i] += total / n
    return 1 / (1 + np.exp(-out))


def fit(docs: DataFrame, labels: DataFrame, learn, *, label: str = "quality", rows: int = TRAINING_ROWS, mb: float = TRAINING_MB) -> Model:
    """Learn from at most `rows` labelled documents for which learn(id column) holds, of at most `mb` together.

    Rows without a label or text are left out, as are labels other than 0 and 1;
    with nothing to learn from, every document scores 0.5.
    """
    some = labels.select(labels["doc_id"].alias("k"), labels[label].cast("int").alias("y")).where(F.col("y").isin(0, 1) & learn(F.col("k")))
    got = labelled_texts(some, docs, rows, mb)
    return train(list(got["t"]), [int(y) for y in got["y"]])


def scored(text: Column, model: Model) -> Column:
    """The score of a text; only texts travel to Python."""
    margin, bias = model.margins()

    @F.pandas_udf("double")
    def score_of(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known = WordRows(2)
        for part in texts:
            some = [x if isinstance(x, str) else None for x in part]
            yield pd.Series(np.concatenate([score_texts(some[at : at + 500], margin, bias, known) for at in range(0, len(some), 500)] or [np.zeros(0)]))

    return score_of.asNondeterministic()(text)  # which keeps the optimiser from running it twice


def score(docs: DataFrame, model: Model, *, threshold: float = THRESHOLD, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The id, score (0 to 1) and predicted (1 if score >= threshold)."""
    found = docs.select(docs[doc_id].alias("doc_id"), scored(docs[text], model).alias("score"))
    return found.select("doc_id", "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, model: Model, *, threshold: float = THRESHOLD, text: str = "text") -> DataFrame:
    """The rows whose text is not rejected, with all their columns, whatever these are called."""
    name = "__score"
    while name in docs.columns:
        name += "_"
    return docs.withColumn(name, scored(docs[text], model)).where(F.col(name) >= threshold).drop(name)
