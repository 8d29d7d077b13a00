"""Toxicity by subword bags.

A word is the mean of the vectors of its character n-grams (hashed to buckets) and of the whole word, so misspellings that
were never seen share most of a known word's vectors. A bag of words is the mean of its words, and a linear softmax
reads the mean. Vectors and softmax are trained jointly in numpy by AdaGrad: first on the bags of whole texts, then, since a few words in
a long text are averaged away, on each text's window of WINDOW words that scores highest at the time. A text is as toxic as its worst window.

Since the softmax is linear, a trained word has one number, its share of the logit, and a window's logit is the mean of
these: scoring a text is one lookup a word and one running sum.

Scale: training takes at most SAMPLE_ROWS labelled texts, chosen by the hash of their ids; scoring is one pass, no shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from agentmeter.llm.common import id_bucket, md5_key

#: The bound of what is learned: labelled texts.
SAMPLE_ROWS = 5000
BUCKET_BITS, WIDTH, GRAMS = 15, 12, (3, 5)
BUCKETS = 1 << BUCKET_BITS
WINDOW = 3
#: Subwords left out at random in training, so that a word's weight is spread over all of them.
DROP = 0.5
#: Epochs over whole texts' bags, then over each text's window that scores highest.
WHOLE_EPOCHS, WINDOW_EPOCHS = 2, 7
RATE, DECAY, SEED = 0.5, 1e-4, 7
#: Words whose number is kept by a task while it scores; beyond that it starts anew.
MEMO = 400_000
#: Texts whose words are met at once.
PART = 64

_WORD = re.compile(r"[^\W_]+(?:['’*@$!1-9][^\W_]+)*")


def words_of(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def subwords(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of each word and of its character n-grams, ends marked, and for each bucket the number of its word; by word."""
    marked = [f"<{w}>" for w in words]
    points = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    lengths = np.fromiter(map(len, marked), np.int64, len(marked))
    word = np.repeat(np.arange(len(marked)), lengths)
    buckets, owners = [np.fromiter((xxhash.xxh32_intdigest(w) for w in words), np.uint64, len(words))], [np.arange(len(words))]
    rolled = points
    for n in range(2, GRAMS[1] + 1):
        rolled = rolled[:-1] * np.uint64(0x9E3779B97F4A7C15) + points[n - 1 :]
        if n >= GRAMS[0]:
            inside = word[: len(rolled)] == word[n - 1 :]
            buckets.append(rolled[inside] + np.uint64(n))
            owners.append(word[: len(rolled)][inside])
    owner = np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    mixed = np.concatenate(buckets)[order] * np.uint64(0xD6E8FEB86659FD93)
    return (mixed >> np.uint64(64 - BUCKET_BITS)).astype(np.int64), owner[order]


def window_sums(values: np.ndarray) -> np.ndarray:
    """Sums over each run of WINDOW values; over all of them if there are no more."""
    sums = np.concatenate([[0.0], np.cumsum(values)])
    return sums[-1:] if len(values) <= WINDOW else sums[WINDOW:] - sums[:-WINDOW]


#: Words' numbers by model; a worker that runs several tasks keeps them.
_MEMOS: dict[bytes, dict[str, float]] = {}


class Bag:
    """Trained numbers: each bucket's share of the logit, and the bias."""

    def __init__(self, weights: np.ndarray, bias: float):
        self.weights, self.bias = weights.astype(np.float32), bias
        self._ready()

    def _ready(self) -> None:
        name = xxhash.xxh3_128_digest(self.weights.tobytes())
        if name not in _MEMOS:
            _MEMOS.clear()
        self._memo = _MEMOS.setdefault(name, {})

    def meet(self, words: set[str]) -> None:
        """Works out the numbers of words that weren't met before."""
        if len(self._memo) >= MEMO:
            self._memo.clear()
        new = list(words.difference(self._memo))
        if new:
            bucket, owner = subwords(new)
            n = np.bincount(owner, minlength=len(new))
            self._memo.update(zip(new, (np.bincount(owner, self.weights[bucket], len(new)) / n).tolist(), strict=True))

    def scores(self, texts: list[str | None]) -> np.ndarray:
        """score() of each text; the words of all are met at once."""
        words = [words_of(t) for t in texts]
        self.meet(set().union(*words) if words else set())
        return np.array([self._score(w) for w in words])

    def score(self, text: str | None) -> float:
        """The probability of label 1: that of the worst window; without words that of the bias."""
        return float(self.scores([text])[0])

    def _score(self, words: list[str]) -> float:
        if not words:
            return _logistic(self.bias)
        values = np.fromiter(map(self._memo.__getitem__, words), float, len(words))
        return _logistic(self.bias + float(window_sums(values).max()) / WINDOW)

    def __getstate__(self):
        return {"weights": self.weights, "bias": self.bias}

    def __setstate__(self, state):
        self.weights, self.bias = state["weights"], state["bias"]
        self._ready()


def _logistic(x: float) -> float:
    return float(1 / (1 + np.exp(-np.clip(x, -50, 50))))


class Training:
    """Vectors and softmax that learn together, and what AdaGrad remembers of their gradients."""

    def __init__(self, vocabulary: list[str], bias: float, rng: np.random.Generator):
        self.rng = rng
        self.bucket, owner = subwords(vocabulary)
        self.lengths = np.bincount(owner, minlength=len(vocabulary))
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)])
        self.softmax = rng.normal(0, 1 / WIDTH**0.5, (2, WIDTH))
        self.vectors = rng.normal(0, 0.02, (BUCKETS, WIDTH))
        self.bias = np.array([0.0, bias])
        self.seen, self.seen_s, self.seen_b = np.full(BUCKETS, 1e-6), np.full(2, 1e-6), 1e-6

    def across(self) -> np.ndarray:
        """Each bucket's share of the logit."""
        return self.vectors @ (self.softmax[1] - self.softmax[0])

    def word_logits(self) -> np.ndarray:
        return np.add.reduceat(self.across()[self.bucket], self.starts[:-1]) / self.lengths

    def gradients(self, shares: np.ndarray, words: np.ndarray, target: np.ndarray, drop: float = 0.0):
        """Of the cross entropy of a batch: (buckets met, theirs, the softmax's, the bias's). shares: texts by words, each text's adding up to 1."""
        reach = self.lengths[words]
        at = np.repeat(self.starts[words] - np.concatenate([[0], np.cumsum(reach)[:-1]]), reach) + np.arange(reach.sum())
        bucket = self.bucket[at]
        part = np.repeat(1.0 / reach, reach)
        if drop:
            part = part * (self.rng.random(len(part)) >= drop) / (1 - drop)
        first = np.concatenate([[0], np.cumsum(reach)[:-1]])
        mean = shares @ np.add.reduceat(self.vectors[bucket] * part[:, None], first)
        z = mean @ self.softmax.T + self.bias
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        error = p - np.stack([1 - target, target], axis=1)
        back = np.repeat(shares.T @ (error @ self.softmax), reach, axis=0) * part[:, None]
        met, where = np.unique(bucket, return_inverse=True)
        return met, np.stack([np.bincount(where, back[:, i], len(met)) for i in range(WIDTH)], axis=1), error.T @ mean, error.sum(axis=0)

    def step(self, rows: list[tuple[np.ndarray, np.ndarray]], target: np.ndarray, rate: float, drop: float) -> None:
        """One update from texts as (words, their shares)."""
        words, where = np.unique(np.concatenate([w for w, _ in rows]), return_inverse=True)
        shares = np.zeros((len(rows), len(words)))
        shares[np.repeat(np.arange(len(rows)), [len(w) for w, _ in rows]), where] = np.concatenate([s for _, s in rows])
        met, vectors, softmax, bias = self.gradients(shares, words, target, drop)
        vectors, softmax = vectors + DECAY * self.vectors[met], softmax + DECAY * self.softmax
        self.seen[met] += (vectors**2).mean(axis=1)
        self.seen_s += (softmax**2).mean(axis=1)
        self.seen_b += float((bias**2).mean())
        self.vectors[met] -= rate * vectors / np.sqrt(self.seen[met])[:, None]
        self.softmax -= rate * softmax / np.sqrt(self.seen_s)[:, None]
        self.bias -= rate * bias / np.sqrt(self.seen_b)


def _counted(code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    words, times = np.unique(code, return_counts=True)
    return words, times / max(1, len(code))


def train(texts: list[str], labels: list[int], whole: int = WHOLE_EPOCHS, windows: int = WINDOW_EPOCHS) -> Bag:
    """Vectors and softmax of the bag, trained together. Without both labels every score is the share of label 1, smoothed."""
    y = np.array(labels, float)
    prior = (y.sum() + 1) / (len(y) + 2)
    bias = float(np.log(prior / (1 - prior)))
    if len(set(labels)) < 2:
        return Bag(np.zeros(BUCKETS), bias)
    vocabulary: dict[str, int] = {}
    coded = [np.array([vocabulary.setdefault(w, len(vocabulary)) for w in words_of(t)], np.int64) for t in texts]
    if not vocabulary:
        return Bag(np.zeros(BUCKETS), bias)
    rng = np.random.default_rng(SEED)
    learned = Training(list(vocabulary), bias, rng)
    bags = [_counted(c) for c in coded]
    for epoch in range(whole + windows):
        if epoch >= whole:  # each text's window that scores highest now
            logits = learned.word_logits()
            best = [int(window_sums(logits[c]).argmax()) for c in coded]
            bags = [_counted(c[b : b + WINDOW]) for b, c in zip(best, coded, strict=True)]
        rate = RATE * (1 - 0.7 * epoch / (whole + windows))
        for batch in np.array_split(rng.permutation(len(coded)), max(1, len(coded) // 32)):
            some = [i for i in batch if len(coded[i])]
            if some:
                learned.step([bags[i] for i in some], y[some], rate, DROP if epoch >= whole else 0.0)
    return Bag(learned.across(), float(learned.bias[1] - learned.bias[0]))


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Bag:
    """A bag learned from up to sample_rows rows of docs that have a label in labels (doc_id, label 0 or 1), by the hash of the id."""
    known = labels.where("doc_id IS NOT NULL AND label IN (0, 1)").select(F.col("doc_id").alias("label_id"), "label")
    picked = known.orderBy(md5_key("label_id"), "label_id", "label").limit(sample_rows)
    joined = docs.where("text IS NOT NULL").join(F.broadcast(picked), docs.doc_id == picked.label_id).select("doc_id", "text", "label")
    rows = joined.orderBy(md5_key("doc_id"), "doc_id", "text", "label").limit(sample_rows).collect()  # ids may be repeated
    return train([r["text"] for r in rows], [int(r["label"]) for r in rows])


def _scores(bag: Bag, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [batch.column("text").slice(i, PART).to_pylist() for i in range(0, batch.num_rows, PART)]
            score = np.concatenate([np.zeros(0), *map(bag.scores, parts)])
            columns = [batch.column("doc_id"), batch.column("held_out"), pa.array(score, pa.float64()), pa.array((score >= threshold).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "held_out", "score", "predicted"])

    return run


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """Toxicity scores of all documents, learned from labels (doc_id, label) of ids whose crc32 modulo 4 is not 2.

    docs: doc_id, text; other columns are ignored and are no inputs. Returns doc_id, held_out, score (0 to 1) and predicted (1
    from threshold on). Texts without words, null ones included, have the score of the bias. Without labels of both kinds
    every score is the smoothed share of label 1. Repeated rows score alike. An empty table gives no rows.
    """
    bag = fit(docs.select("doc_id", "text"), labels.where(id_bucket("doc_id", 4) != 2), sample_rows)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (id_bucket("doc_id", 4) == 2).alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_scores(bag, threshold), "doc_id long, held_out boolean, score double, predicted int")
