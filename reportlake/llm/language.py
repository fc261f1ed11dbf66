"""Language identification by word-first backoff.

A word that the model knows is scored by its log frequency in each language.
An unseen word falls back to its character n-grams, the longest for which the
model knows any, down to single characters. A text's score is the share of its
best language in the softmax of the summed scores.

Null texts and texts without a letter give `und` and score 0. Repeated rows
are judged alike; empty tables give no rows; null ids are kept as they are;
other columns are not read. Ties go to the language that sorts first. A letter is what Unicode calls
one (category L): a number sign such as a half or a Roman numeral is none.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reportlake.llm.common import WordRows, labelled_texts

ORDERS = (5, 4, 3, 2, 1)
TRAINING_ROWS = 3000  # labelled rows at most that are learned from
TRAINING_MB = 64  # of their texts together
LEAST = 2  # a word or n-gram seen less often is unknown
PIECE = 1 << 16  # n-grams of an unseen word that are looked up together
WORD = regex.compile(r"\p{L}+")


@dataclass
class Model:
    languages: list[str] = field(default_factory=list)
    words: dict[str, np.ndarray] = field(default_factory=dict)  # log frequency by language
    grams: dict[str, np.ndarray] = field(default_factory=dict)

    def of(self, word: str) -> np.ndarray:
        if (known := self.words.get(word)) is not None:
            return known
        marked = f"<{word}>"
        for n in ORDERS:
            total, found = np.zeros(len(self.languages)), 0
            for at in range(0, len(marked) - n + 1, PIECE):
                part = [g for i in range(at, min(at + PIECE, len(marked) - n + 1)) if (g := self.grams.get(marked[i : i + n])) is not None]
                if part:
                    total, found = total + np.sum(part, axis=0), found + len(part)
            if found:
                return total / found
        return np.zeros(len(self.languages))


def words_of(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def train(rows: list[tuple[str | None, str]]) -> Model:
    """rows: text and language."""
    words: dict[str, Counter] = defaultdict(Counter)
    for text, lang in rows:
        words[lang].update(words_of(text))
    model = Model(sorted(lang for lang in words))
    if not model.languages:
        return model

    def logs(counts: list[Counter]) -> dict[str, np.ndarray]:
        """Log frequencies, smoothed by half a count, relative to the mean over the languages."""
        seen = sum(counts, Counter())
        kept = [x for x, c in seen.items() if c >= LEAST]
        total = np.array([sum(c.values()) + 0.5 * len(kept) + 1 for c in counts])
        table = np.log((np.array([[c[x] for c in counts] for x in kept]).reshape(-1, len(counts)) + 0.5) / total)
        table -= table.mean(axis=1, keepdims=True)
        return dict(zip(kept, table))

    model.words = logs([words[lang] for lang in model.languages])
    for n in ORDERS:
        grams = []
        for lang in model.languages:
            counts: Counter = Counter()
            for w, c in words[lang].items():
                marked = f"<{w}>"
                for i in range(len(marked) - n + 1):
                    counts[marked[i : i + n]] += c
            grams.append(counts)
        model.grams |= logs(grams)
    return model


def predict_texts(texts: list[str | None], model: Model, known: WordRows) -> tuple[list[str], list[float]]:
    split = [words_of(t) for t in texts]
    if model.languages and (new := known.new(split)):
        known.add(new, np.array([model.of(w) for w in new]))
    langs, scores = [], []
    for s in split:
        if not s or not model.languages:
            langs.append("und"), scores.append(0.0)
            continue
        total = known.sum(s)
        p = np.exp(total - total.max())
        langs.append(model.languages[int(p.argmax())]), scores.append(float(p.max() / p.sum()))
    return langs, scores


def fit(docs: DataFrame, learn, *, rows: int = TRAINING_ROWS, mb: float = TRAINING_MB) -> Model:
    """Learn from at most `rows` documents with a text and a language for which learn(id column) holds, of at most `mb` together."""
    some = docs.where(docs["text"].isNotNull() & docs["lang"].isNotNull()).select(docs["doc_id"].alias("k"), docs["lang"].alias("y")).where(learn(F.col("k")))
    got = labelled_texts(some, docs, rows, mb)
    return train(sorted(zip(got["t"], got["y"]), key=lambda x: (x[1], x[0])))


def predict(docs: DataFrame, model: Model, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The id, lang_pred and score. Only texts travel to Python."""

    @F.pandas_udf("lang_pred string, score double")
    def judge(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        known = WordRows(len(model.languages))
        for part in texts:
            some = [x if isinstance(x, str) else None for x in part]
            parts = [predict_texts(some[at : at + 500], model, known) for at in range(0, len(some), 500)]
            yield pd.DataFrame({"lang_pred": [x for p in parts for x in p[0]], "score": np.array([x for p in parts for x in p[1]], dtype=np.float64)})

    found = docs.select(docs[doc_id].alias("doc_id"), judge.asNondeterministic()(docs[text]).alias("j"))
    return found.select("doc_id", "j.lang_pred", "j.score")
