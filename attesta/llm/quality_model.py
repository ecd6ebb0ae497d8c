"""Quality classifier: hashed word n-gram logistic regression trained by FTRL-proximal.

Features are hashed word 1- and 2-grams, and the same n-grams of word shapes (runs of capitals,
small letters and digits become one mark each; a word equal to its predecessor becomes its own
mark), with weights 1 + log(count), scaled to unit length by family. A text is scored by one
sparse dot product.

Training takes a bounded sample of about ``SAMPLE_ROWS`` labelled rows of at most
``SAMPLE_CHARS`` characters each, chosen by the hash of their id among rows that are not held
out. The sample is dealt into ``SHARDS`` groups; every epoch each group runs the FTRL updates from
the shared state, and the states are averaged (parameter mixing), so an epoch is one Spark job.

Defined results: a null or empty text has only the bias; without labels every score is 0.5;
rows with a null label or id are not learned from; a document with several labels counts with
each; repeated rows are scored alike; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attesta.llm.common import hash_below, save, texts, trainable, with_arrow_columns

BITS = 18
SIZE = 1 << BITS
BIAS = SIZE
SAMPLE_ROWS = 6000
SAMPLE_CHARS = 20_000
SHARDS = 4
EPOCHS = 3
ALPHA, BETA, L1, L2 = 0.5, 1.0, 1e-4, 1e-3
THRESHOLD = 0.7
HELD_WORDS = 500_000

_RUNS = ((regex.compile(r"\p{Lu}\p{Ll}+"), "T"), (regex.compile(r"\p{Lu}+"), "A"), (regex.compile(r"\p{L}+"), "a"), (regex.compile(r"\p{N}+"), "0"))


def shape(word: str) -> str:
    for run, mark in _RUNS:
        word = run.sub(mark, word)
    return word[:12]


class Features:
    """Texts to sparse vectors; remembers the hashes of words it has seen, up to a bound."""

    def __init__(self):
        self.seen: dict[str, tuple[int, int]] = {}

    def __call__(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        words = text.split() if text else []
        seen, both = self.seen, []
        if len(seen) > HELD_WORDS:
            seen.clear()
        for word in words:
            h = seen.get(word)
            if h is None:
                h = (zlib.crc32(word.encode("utf-8", "surrogatepass")), zlib.crc32(shape(word).encode("utf-8", "surrogatepass"), 7))
                if len(word) <= 64:
                    seen[word] = h
            both.append(h)
        if not both:
            return np.array([BIAS]), np.array([1.0])
        ids = np.array(both, dtype=np.uint64)
        word, kind = ids[:, 0], ids[:, 1].copy()
        kind[1:][word[1:] == word[:-1]] = 99
        index, value = [np.array([BIAS])], [np.array([1.0])]
        for salt, grams in enumerate((word, self.pairs(word), kind, self.pairs(kind))):
            slot, count = np.unique((grams * np.uint64(2654435761) + np.uint64(salt * 40503)) % np.uint64(2**32) >> np.uint64(32 - BITS), return_counts=True)
            if len(slot):
                weight = 1.0 + np.log(count)
                index.append(slot.astype(np.int64))
                value.append(weight / math.sqrt(float(weight @ weight)))
        return np.concatenate(index), np.concatenate(value)

    @staticmethod
    def pairs(ids: np.ndarray) -> np.ndarray:
        return (ids[:-1] * np.uint64(0x9E3779B1) + ids[1:]) % np.uint64(2**32)


def weights_of(z: np.ndarray, n: np.ndarray) -> np.ndarray:
    return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))


def sigmoid(x: float) -> float:
    return 1.0 / (1.0 + math.exp(-max(-35.0, min(35.0, x))))


def ftrl_pass(rows: list[tuple[np.ndarray, np.ndarray, int]], z: np.ndarray, n: np.ndarray) -> None:
    """One pass of per-coordinate FTRL-proximal updates, in place."""
    for index, value, label in rows:
        w = weights_of(z[index], n[index])
        gradient = (sigmoid(float(w @ value)) - label) * value
        sigma = (np.sqrt(n[index] + gradient**2) - np.sqrt(n[index])) / ALPHA
        np.add.at(z, index, gradient - sigma * w)
        np.add.at(n, index, gradient**2)


def training_rows(docs: DataFrame, labels: DataFrame, target: str, sample_rows: int, sample_chars: int) -> DataFrame:
    """(doc_id, text, label): the ids of the sample are few, so they are broadcast to the documents."""
    labelled = labels.where(trainable(F.col("doc_id")) & F.col(target).isNotNull()).select(F.col("doc_id").alias("labelled_id"), F.col(target).cast("int").alias("label"))
    total = labelled.count()
    chosen = labelled.where(hash_below(F.col("labelled_id"), min(1.0, sample_rows / max(1, total)))).limit(2 * sample_rows)
    rows = docs.select("doc_id", "text").where(F.length("text") <= sample_chars)
    return rows.join(F.broadcast(chosen), F.col("doc_id") == F.col("labelled_id")).select("doc_id", "text", "label")


def fit(docs: DataFrame, labels: DataFrame, target: str = "quality", sample_rows: int = SAMPLE_ROWS, sample_chars: int = SAMPLE_CHARS, epochs: int = EPOCHS) -> np.ndarray:
    """The weights, the bias last."""
    shard = F.pmod(F.xxhash64("doc_id", F.lit("shard")), F.lit(SHARDS)).cast("int")
    sample = save(training_rows(docs, labels, target, sample_rows, sample_chars).withColumn("shard", shard), "labelled")
    z, n = np.zeros(SIZE + 1), np.zeros(SIZE + 1)
    for _ in range(epochs):
        shared = docs.sparkSession.sparkContext.broadcast((z.astype(np.float32), n.astype(np.float32)))

        def one_pass(frame: pd.DataFrame) -> pd.DataFrame:
            own_z, own_n = (x.astype(np.float64) for x in shared.value)
            features, frame = Features(), frame.sort_values(["doc_id", "text", "label"])
            order = np.random.default_rng(0).permutation(len(frame))
            ftrl_pass([(*features(frame["text"].iloc[i]), int(frame["label"].iloc[i])) for i in order], own_z, own_n)
            return pd.DataFrame({"rows": [len(frame)], "z": [own_z.astype("<f4").tobytes()], "n": [own_n.astype("<f4").tobytes()]})

        states = sample.groupBy("shard").applyInPandas(one_pass, "rows long, z binary, n binary").collect()  # SHARDS rows of fixed size
        total = sum(s["rows"] for s in states)
        if not total:
            break
        z, n = (sum(np.frombuffer(s[c], "<f4").astype(np.float64) * (s["rows"] / total) for s in states) for c in ("z", "n"))
    return weights_of(z, n)


def score(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """All columns of ``docs`` plus score, the probability of label 1."""
    shared = docs.sparkSession.sparkContext.broadcast(weights.astype(np.float32))

    def make():
        w, features = shared.value, Features()

        def compute(batch: pa.RecordBatch) -> list[pa.Array]:
            out = []
            for text in texts(batch):
                index, value = features(text)
                out.append(sigmoid(float(w[index] @ value)))
            return [pa.array(out, pa.float64())]

        return compute

    return with_arrow_columns(docs, [T.StructField("score", T.DoubleType())], make)
