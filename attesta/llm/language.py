"""Language identification by word-first backoff.

A known word is scored by its log frequency in each language. An unseen word falls back to
character n-grams: at every position the longest known n-gram ending there (4, 3, 2, 1
characters) gives its log frequency, and their mean stands for the word. Log scores of a text
add up; the score is the posterior of the best language.

The model is fitted on a bounded sample: about ``SAMPLE_ROWS`` rows of each language, chosen by the
hash of their id among rows that are not held out. Texts of over ``SAMPLE_CHARS`` characters are
learned from only where a language has no shorter one; then its shortest texts are taken.
Words seen twice or more in the sample are known; so the model's size is bounded as well. Only
text and labels are learned from, and only the text is used to predict.

Defined results: a null text, or one without any letter, is ``und`` with score 0; without any
training row every text is ``und``; ties go to the language that sorts first; repeated rows are
predicted alike; an empty table gives an empty result. Whole texts are scored.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attesta.llm.common import hash_below, texts, trainable, with_arrow_columns

UNDETERMINED = "und"
SAMPLE_ROWS = 1500
SAMPLE_CHARS = 20_000
MAX_WORD_CHARS = 40
LONGEST_GRAM = 4
#: Scored words a worker process remembers before it starts anew.
HELD_WORDS = 300_000

LETTERS = r"\p{L}+"
_WORDS = regex.compile(LETTERS)


@dataclass
class Model:
    languages: list[str]
    words: dict[str, int]  # row of word_scores
    word_scores: np.ndarray  # (word, language) log frequencies
    grams: dict[str, int]
    gram_scores: np.ndarray


def training_rows(docs: DataFrame, sample_rows: int = SAMPLE_ROWS, sample_chars: int = SAMPLE_CHARS) -> DataFrame:
    rows = docs.where(trainable(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")).select("doc_id", "lang", "text")
    over = F.greatest(F.length("text") - sample_chars, F.lit(0))  # 0 for every text that is short enough
    sizes = rows.groupBy("lang", over.alias("over")).count().groupBy("lang").agg(F.min(F.struct("over", "count")).alias("least"))
    chosen = F.lit(False)
    for lang, (least, n) in sorted((r["lang"], r["least"]) for r in sizes.collect()):  # one row for each language
        chosen = chosen | ((F.col("lang") == lang) & (over == least) & hash_below(F.col("doc_id"), min(1.0, sample_rows / n)))
    return rows.where(chosen)


def fit(docs: DataFrame, **sample) -> Model:
    words = training_rows(docs, **sample).select("lang", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(LETTERS), F.lit(0))).alias("word"))
    counted = words.where(F.length("word") <= MAX_WORD_CHARS).groupBy("word", "lang").count().where("count > 1")
    return build([(r["word"], r["lang"], r["count"]) for r in counted.collect()])


def build(rows: list[tuple[str, str, int]]) -> Model:
    languages = sorted({lang for _, lang, _ in rows})
    column = {lang: i for i, lang in enumerate(languages)}
    words: dict[str, np.ndarray] = {}
    grams: list[dict[str, np.ndarray]] = [{} for _ in range(LONGEST_GRAM)]
    zero = np.zeros(len(languages))
    for word, lang, count in sorted(rows):
        words.setdefault(word, zero.copy())[column[lang]] += count
        for gram, n in Counter(pieces(word)).items():
            grams[len(gram) - 1].setdefault(gram, zero.copy())[column[lang]] += n * count
    tables = [log_frequencies(g) for g in grams]
    gram_rows: dict[str, int] = {}
    for table in grams:
        for gram in table:
            gram_rows[gram] = len(gram_rows)
    return Model(languages, {w: i for i, w in enumerate(words)}, log_frequencies(words), gram_rows, np.concatenate(tables) if gram_rows else np.zeros((0, len(languages))))


def log_frequencies(counts: dict[str, np.ndarray]) -> np.ndarray:
    if not counts:
        return np.zeros((0, 0))
    table = np.array(list(counts.values())) + 0.5
    return np.log(table / table.sum(axis=0))


def pieces(word: str) -> list[str]:
    """All n-grams up to LONGEST_GRAM of the word with its ends marked."""
    marked = f"<{word}>"
    return [marked[i : i + n] for n in range(1, LONGEST_GRAM + 1) for i in range(len(marked) - n + 1)]


class Scorer:
    def __init__(self, model: Model):
        self.model = model
        self.extra: dict[str, np.ndarray] = {}

    def backoff(self, word: str) -> np.ndarray:
        """Mean over the positions of the longest known n-gram that ends there; zeros if none is known."""
        marked, grams = f"<{word}>", self.model.grams
        rows = []
        for end in range(2, len(marked) + 1):
            for n in range(min(LONGEST_GRAM, end), 0, -1):
                row = grams.get(marked[end - n : end])
                if row is not None:
                    rows.append(row)
                    break
        return self.model.gram_scores[rows].mean(axis=0) if rows else np.zeros(len(self.model.languages))

    def totals(self, text: str | None) -> np.ndarray | None:
        """Log score of each language, None for a text without letters."""
        counts = Counter(_WORDS.findall(text.lower())) if text else None
        if not counts or not self.model.languages:
            return None
        known, weights, total = [], [], np.zeros(len(self.model.languages))
        words, extra = self.model.words, self.extra
        for word, n in counts.items():
            row = words.get(word)
            if row is not None:
                known.append(row)
                weights.append(n)
                continue
            scores = extra.get(word)
            if scores is None:
                scores = self.backoff(word)
                if len(extra) >= HELD_WORDS:
                    extra.clear()
                if len(word) <= MAX_WORD_CHARS:
                    extra[word] = scores
            total += n * scores
        if known:
            total += np.array(weights, float) @ self.model.word_scores[known]
        return total

    def predict(self, text: str | None) -> tuple[str, float]:
        total = self.totals(text)
        if total is None:
            return UNDETERMINED, 0.0
        best = int(total.argmax())
        return self.model.languages[best], float(1.0 / np.exp(total - total[best]).sum())


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """All columns of ``docs`` plus lang_pred and score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        predict = Scorer(shared.value).predict

        def compute(batch: pa.RecordBatch) -> list[pa.Array]:
            found = [predict(text) for text in texts(batch)]
            return [pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())]

        return compute

    return with_arrow_columns(docs, [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())], make)
