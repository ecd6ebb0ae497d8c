"""Toxicity: subword-bag embeddings averaged into a linear softmax.

A word is the bag of its character n-grams (``GRAMS`` characters, word borders included), hashed
into a table of embeddings; its vector is their mean, so a misspelling that was never seen shares
most of its vectors with the word it stands for. A passage is the mean of ``PASSAGE`` word vectors
(zero vectors where a text is shorter), and a linear softmax over two classes scores it. A word that
is one of the two before it is left out, so one word said over and over is no passage of its own. A text is as toxic as its most toxic
passage: a few words in a long text are not averaged away. Passages overlap by half and cover the
whole text.

Embeddings and softmax are trained together in numpy (Adagrad on the cross entropy). Labels belong
to texts, not to passages, so after some epochs over random passages each text is represented by the
passage the model itself finds most toxic; for texts of label 0 these are its worst mistakes. At
last a line over the greatest logits turns them into probabilities at the labels' real shares.

Training takes a bounded sample: about ``SAMPLE_ROWS`` labelled ids that are not held out, half of
each label, chosen by the hash of the id, and of those, in hash order, as many as have
``SAMPLE_CHARS`` characters together. Only text and labels are learned from.

Scoring needs one number for each n-gram, the embedding's part of the logit in fixed point, so
sums are exact and equal texts get equal scores wherever they stand.

Defined results: null, empty and wordless texts are scored as an empty passage; labels that are null
or belong to no id are not learned from; of a repeated id the least text is learned, with each label
it has; without labels of both kinds every score is the share of label 1, 0.5 without any. A run of
letters beyond ``SLICE`` characters counts as several words. An empty table gives an empty result;
other columns are passed through, but for a column ``score``, which is replaced.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from attesta.llm.common import hash_below, save, texts, trainable, with_arrow_columns

GRAMS = (3, 4, 5)
BITS, DIMS = 18, 8
SIZE = 1 << BITS
PASSAGE = 24
SAMPLE_ROWS, SAMPLE_CHARS = 6000, 30_000_000
EPOCHS, WARM, BATCH, RATE = 14, 5, 64, 0.1
#: Texts of the sample that an n-gram must occur in: rarer ones would tell single texts apart, not labels.
#: What the sums of squared gradients of the embeddings begin with: a few sights of an n-gram say little.
DAMPING = 1e-4
MIN_TEXTS = 6
#: Passages of each text in the first epochs.
RANDOM = 8
#: Logits of a passage without words, which is held to be clean; words have to speak against it.
EMPTY = np.array([0.0, -2.0], np.float32)
THRESHOLD = 0.3
#: Characters that are turned into n-grams at once, and parts of one in fixed point.
SLICE, FIXED = 1 << 19, 1 << 20


@cache
def _word_characters() -> np.ndarray:
    return np.array([chr(i).isalnum() for i in range(0x110000)])


def codes(text: str) -> np.ndarray:
    """Code points of the lower-cased text; all that is not part of a word is 0."""
    c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(_word_characters()[c], c, np.uint32(0))


@dataclass
class Words:
    """Words of some characters: where each begins, and the hashed n-grams by first character."""

    starts: np.ndarray  # the border before each word
    at: np.ndarray  # first character of each word
    grams: list[tuple[np.ndarray, np.ndarray]]  # for each length: hash and whether it is part of one word

    @classmethod
    def of(cls, c: np.ndarray) -> Words:
        c = np.concatenate([[0], c, [0]]).astype(np.uint64)
        place = np.flatnonzero(np.concatenate([[True], (c[1:] != 0) | (c[:-1] != 0)]))  # one border between words
        c = c[place]
        border = c == 0
        grams, h = [], c * np.uint64(0x9E3779B97F4A7C15)
        inner = np.zeros(len(c), bool)  # a border inside
        for n in range(2, max(GRAMS) + 1):
            if len(c) < n:
                break
            h = (h[:-1] ^ (h[:-1] >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + c[n - 1 :]
            inner = inner[:-1] | border[n - 2 : -1] if n > 2 else inner[:-1]
            if n in GRAMS:
                grams.append(((h * np.uint64(0x94D049BB133111EB)) ^ np.uint64(n), ~inner))
        starts = np.flatnonzero(border[:-1])
        return cls(starts, place[starts + 1] - 1, grams)

    def bags(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(word, bucket) of all n-grams, ordered by word, and a hash of each word's bag."""
        word, bucket, mixed = [], [], np.zeros(len(self.starts), np.uint64)
        for h, whole in self.grams:
            at = np.flatnonzero(whole)
            own = np.searchsorted(self.starts, at, side="right") - 1
            np.add.at(mixed, own, h[at] * (h[at] | np.uint64(1)))
            word.append(own)
            bucket.append((h[at] >> np.uint64(64 - BITS)).astype(np.int64))
        word, bucket = np.concatenate(word), np.concatenate(bucket)
        order = np.argsort(word, kind="stable")
        return word[order], bucket[order], mixed


def fresh(bag: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Words that are not one of the two before them in the same text."""
    new = np.ones(len(bag), bool)
    for back in (1, 2):
        new[back:] &= (bag[back:] != bag[:-back]) | (text[back:] != text[:-back])
    return new


def word_scores(c: np.ndarray, table: np.ndarray) -> np.ndarray:
    """For each word its first character, the mean of the n-grams' numbers in fixed point, and a hash of the n-grams."""
    out = [np.zeros((3, 0), np.int64)]
    for at in range(0, len(c), SLICE):
        part = c[at : at + SLICE]
        words = Words.of(part)
        if not len(words.starts):
            continue
        length = words.starts[-1] + 1 + len(part)
        total, count, bag = np.zeros(length, np.int64), np.zeros(length, np.int64), np.zeros(length, np.uint64)
        for h, whole in words.grams:
            bag[: len(h)] += np.where(whole, h * (h | np.uint64(1)), 0)
            total[: len(h)] += np.where(whole, table[(h >> np.uint64(64 - BITS)).astype(np.int64)], 0)
            count[: len(h)] += whole
        total, count = np.add.reduceat(total, words.starts), np.add.reduceat(count, words.starts)
        out.append(np.stack([words.at + at, total // np.maximum(count, 1), np.add.reduceat(bag, words.starts).view(np.int64)]))
    return np.concatenate(out, axis=1)


def scored(each: list[np.ndarray], table: np.ndarray) -> np.ndarray:
    """Greatest passage score of texts (as codes) that are worked on together, a border between texts."""
    at, scores, bag = word_scores(np.concatenate([x for c in each for x in (c, [0])]).astype(np.uint32), table)
    text = np.searchsorted(np.cumsum([len(c) + 1 for c in each]), at, side="right")
    new = fresh(bag, text)
    return greatest(scores[new], np.bincount(text[new], minlength=len(each)))[0]


def passages(n_words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, first word within the text) of the passages of texts of so many words."""
    step = PASSAGE // 2
    each = np.maximum(1, -(-(n_words - PASSAGE) // step) + 1) * (n_words > 0)
    text = np.repeat(np.arange(len(n_words)), each)
    number = np.arange(len(text)) - np.repeat(np.cumsum(each) - each, each)
    return text, np.minimum(number * step, np.maximum(n_words[text] - PASSAGE, 0))


def greatest(scores: np.ndarray, n_words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By text, the greatest mean of a passage (0 without words); and text and mean of all passages."""
    text, first = passages(n_words)
    begin = (np.cumsum(n_words) - n_words)[text] + first
    sums = np.concatenate([[0], np.cumsum(scores)])
    mean = (sums[begin + np.minimum(PASSAGE, n_words[text])] - sums[begin]) / PASSAGE
    best = np.full(len(n_words), -np.inf)
    np.maximum.at(best, text, mean)
    return np.where(n_words > 0, best, 0.0), text, mean


@dataclass(frozen=True)
class Model:
    table: np.ndarray  # by bucket, the part of the logit in fixed point
    slope: float
    intercept: float

    def probability(self, logit: float) -> float:
        x = self.slope * logit / FIXED + self.intercept
        return 1.0 / (1.0 + math.exp(-max(-35.0, min(35.0, x))))


class Trainer:
    """Embeddings and softmax over the passages of labelled texts."""

    def __init__(self, rows: list[tuple[str, int]], seed: int = 0):
        self.random = np.random.default_rng(seed)
        self.label = np.array([y for _, y in rows])
        known: dict[int, int] = {}
        parts, buckets, sizes, words_of = [], [], [], []
        for text, _ in rows:
            c, own = codes(text), []
            for at in range(0, len(c), SLICE):
                words = Words.of(c[at : at + SLICE])
                if not len(words.starts):
                    continue
                word, bucket, mixed = words.bags()
                cuts = np.searchsorted(word, np.arange(len(mixed) + 1))
                for i, key in enumerate(mixed.tolist()):
                    if key not in known:
                        known[key] = len(known)
                        buckets.append(bucket[cuts[i] : cuts[i + 1]])
                    own.append(known[key])
            own = np.array(own, np.int32)
            own = own[fresh(own, np.zeros(len(own)))]
            parts.append(own)
            words_of.append(len(own))
        sizes = np.array([len(b) for b in buckets], np.int64)
        self.words, self.n_words = np.concatenate(parts), np.array(words_of)
        self.buckets, self.first, self.sizes = np.concatenate(buckets), np.cumsum(sizes) - sizes, sizes
        self.common = self.texts_with() >= MIN_TEXTS
        self.text, first = passages(self.n_words)
        self.begin, self.length = (np.cumsum(self.n_words) - self.n_words)[self.text] + first, np.minimum(PASSAGE, self.n_words[self.text])
        self.embeddings = np.zeros((SIZE, DIMS), np.float32)  # n-grams that are never seen say nothing
        self.squares = np.full((SIZE, DIMS), DAMPING, np.float32)
        self.softmax, self.softmax_squares = self.random.normal(0, 0.5, (DIMS, 2)).astype(np.float32), np.full((DIMS, 2), 1e-8, np.float32)

    def texts_with(self) -> np.ndarray:
        """Number of texts with an n-gram of the bucket."""
        count, place = np.zeros(SIZE, np.int64), np.zeros(SIZE, np.int64)
        ends = np.cumsum(self.n_words)
        for words in (np.unique(self.words[a:b]) for a, b in zip(ends - self.n_words, ends)):
            n = self.sizes[words]
            held = self.buckets[np.repeat(self.first[words] - np.cumsum(n) + n, n) + np.arange(n.sum())]
            place[held] = np.arange(len(held))
            count[held[place[held] == np.arange(len(held))]] += 1
        return count

    def parts(self) -> np.ndarray:
        """What each n-gram adds to the difference of the two logits."""
        return self.embeddings @ (self.softmax[:, 1] - self.softmax[:, 0])

    def logits(self) -> np.ndarray:
        """Difference of the two logits by passage, over that of an empty one."""
        by_word = np.add.reduceat(self.parts()[self.buckets], self.first) / self.sizes
        sums = np.concatenate([[0], np.cumsum(by_word[self.words])])
        return (sums[self.begin + self.length] - sums[self.begin]) / PASSAGE

    def chosen(self, epoch: int) -> np.ndarray:
        """Passages of this epoch: some of each text at random at first, then the greatest, and one at random of those of label 0."""
        order = self.random.permutation(len(self.text))
        key = order if epoch < WARM else np.argsort(-self.logits(), kind="stable")
        by_text = key[np.argsort(self.text[key], kind="stable")]
        rank = np.arange(len(by_text)) - np.searchsorted(self.text[by_text], self.text[by_text])
        top = by_text[rank < (RANDOM if epoch < WARM else 1)]
        if epoch >= WARM:
            clean = order[self.label[self.text[order]] == 0]
            top = np.concatenate([top, clean[np.unique(self.text[clean], return_index=True)[1]]])
        return self.random.permutation(top)

    def step(self, batch: np.ndarray, rate: float) -> None:
        size = self.length[batch]
        word = self.words[np.repeat(self.begin[batch] - np.cumsum(size) + size, size) + np.arange(size.sum())]
        passage = np.repeat(np.arange(len(batch)), size)
        n = self.sizes[word]
        at = self.buckets[np.repeat(self.first[word] - np.cumsum(n) + n, n) + np.arange(n.sum())]
        share = np.repeat((1 / (n * PASSAGE)).astype(np.float32), n)
        owner = np.repeat(passage, n)
        mean = np.add.reduceat(self.embeddings[at] * share[:, None], np.searchsorted(owner, np.arange(len(batch))))
        logit = mean @ self.softmax + EMPTY
        p = np.exp(logit - logit.max(axis=1, keepdims=True))
        gradient = p / p.sum(axis=1, keepdims=True)
        gradient[np.arange(len(batch)), self.label[self.text[batch]]] -= 1
        to_mean = gradient @ self.softmax.T
        outer = mean.T @ gradient / len(batch)
        self.softmax_squares += outer**2
        self.softmax -= rate * outer / np.sqrt(self.softmax_squares)
        share = np.where(self.common[at], share, np.float32(0))
        held, place = np.unique(at, return_inverse=True)
        each = np.stack([np.bincount(place, weights=share * to_mean[owner, d], minlength=len(held)) for d in range(DIMS)], axis=1).astype(np.float32)
        self.squares[held] += each**2
        self.embeddings[held] -= rate * each / np.sqrt(self.squares[held])

    def train(self, epochs: int) -> None:
        for epoch in range(epochs):
            passages_ = self.chosen(epoch)
            for at in range(0, len(passages_), BATCH):
                self.step(passages_[at : at + BATCH], RATE * (1 - epoch / epochs))

    def model(self, weight: tuple[float, float]) -> Model:
        """The line over the greatest logits is fitted with the rows weighted by label."""
        table = np.clip(np.round(self.parts() * FIXED), -(1 << 46), 1 << 46).astype(np.int64)
        found = np.full(len(self.label), -np.inf)
        np.maximum.at(found, self.text, self.logits())
        best = np.where(np.isfinite(found), found, 0.0)
        few = max(1, len(best) // 20)  # empty texts, label 0
        slope, intercept = fit_line(np.append(best, np.zeros(few)), np.append(self.label, np.zeros(few)), np.append(np.array(weight)[self.label], np.ones(few)))
        return Model(table, slope, intercept)


def fit_line(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and intercept of a weighted logistic regression, by Newton steps with a little ridge."""
    scale = max(float(np.abs(x).max()), 1e-9)
    z, theta = np.stack([x / scale, np.ones(len(x))], axis=1), np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ theta, -35, 35)))
        gradient = z.T @ (weight * (p - y)) + 1e-3 * theta
        hessian = (z * (weight * p * (1 - p))[:, None]).T @ z + 1e-3 * np.eye(2)
        move = np.linalg.solve(hessian, gradient)
        theta -= np.clip(move, -5, 5)
        if np.abs(move).max() < 1e-9:
            break
    return float(theta[0] / scale), float(theta[1])


def training_rows(docs: DataFrame, labels: DataFrame, target: str, sample_rows: int, sample_chars: int) -> tuple[DataFrame, dict[int, int]]:
    """(doc_id, label, text) of the sample, and the number of labelled ids by label."""
    label = F.col(target).cast("int")
    labelled = labels.where(trainable(F.col("doc_id")) & label.isin(0, 1)).select(F.col("doc_id").alias("labelled_id"), label.alias("label")).distinct()
    sizes = {r["label"]: r["count"] for r in labelled.groupBy("label").count().collect()}  # two rows
    chosen = F.lit(False)
    for value, n in sorted(sizes.items()):
        chosen = chosen | ((F.col("label") == value) & hash_below(F.col("labelled_id"), min(1.0, sample_rows / 2 / n)))
    # some sample_rows ids and labels, so the broadcast is bounded; one text each, however often an id stands in the table
    rows = docs.select("doc_id", "text").join(F.broadcast(labelled.where(chosen)), F.col("doc_id") == F.col("labelled_id"))
    rows = rows.groupBy("doc_id", "label").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))
    order = Window.orderBy(F.xxhash64("doc_id", F.lit("sample")), "doc_id", "label")  # of the bounded sample
    until = rows.withColumns({"_until": F.sum(F.length("text")).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)), "_number": F.row_number().over(order)})
    return until.where((F.col("_until") <= sample_chars) | (F.col("_number") == 1)).drop("_until", "_number"), sizes


def fit(docs: DataFrame, labels: DataFrame, target: str = "toxic", sample_rows: int = SAMPLE_ROWS, sample_chars: int = SAMPLE_CHARS, epochs: int = EPOCHS) -> Model:
    sample, sizes = training_rows(docs, labels, target, sample_rows, sample_chars)
    total = sum(sizes.values())
    if len(sizes) < 2:
        share = 0.5 if not total else float(max(sizes))
        return Model(np.zeros(SIZE, np.int64), 0.0, math.log((share + 1e-6) / (1 - share + 1e-6)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [(t, y) for batch in batches for t, y in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
        if not rows:
            return
        share = [sum(y == v for _, y in rows) / len(rows) for v in (0, 1)]
        trainer = Trainer(rows)
        trainer.train(epochs)
        model = trainer.model(tuple(sizes[v] / total / max(share[v], 1e-9) for v in (0, 1)))
        yield pa.RecordBatch.from_pydict({"table": [model.table.astype("<i8").tobytes()], "slope": [model.slope], "intercept": [model.intercept]})

    # the sample is bounded, so one task trains on it
    ordered = save(sample.select("doc_id", "text", "label"), "labelled").repartition(1).sortWithinPartitions("doc_id", "label")
    found = ordered.mapInArrow(run, "table binary, slope double, intercept double").first()  # one row of fixed size
    if found is None:
        return Model(np.zeros(SIZE, np.int64), 0.0, math.log((sizes[1] + 1) / (sizes[0] + 1)))
    return Model(np.frombuffer(found["table"], "<i8"), found["slope"], found["intercept"])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """All columns of ``docs`` plus score, the probability of label 1."""
    docs = docs.drop("score")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        model = shared.value

        def group(held: list[str | None]) -> list[float]:
            each = [codes(t) if t else np.zeros(0, np.uint32) for t in held]
            return [model.probability(x) for x in scored(each, model.table).tolist()]

        def compute(batch: pa.RecordBatch) -> list[pa.Array]:
            out, held, size = [], [], 0
            for text in texts(batch):
                n = len(text or "") + 1
                if held and size + n > SLICE // 2:
                    out += group(held)
                    held, size = [], 0
                held.append(text)
                size += n
            if held:
                out += group(held)
            return [pa.array(out, pa.float64())]

        return compute

    return with_arrow_columns(docs, [T.StructField("score", T.DoubleType())], make)
