"""Quality classification by regularised quadratic discriminant analysis.

A text becomes a vector of transformed document statistics. Each class has a mean and a covariance, shrunk towards the pooled
covariance and that towards its diagonal; the score is the logistic of the difference of the class log densities, from
Mahalanobis distances by cached Cholesky factors, plus the log prior odds.

Scale: texts are read once; the statistics are a narrow table. Class moments are sums over all labelled rows (partial
aggregation), so nothing is sampled and the driver gets one row a class.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from agentmeter.llm.common import id_bucket, written

FEATURES = ("log_words", "word_length", "upper", "symbols", "digits", "marks", "distinct", "log_repeat", "lines", "bars", "short_share", "runs")
#: Weight of the pooled covariance in a class's, of its diagonal in the pooled one, and what is added to variances.
POOL, DIAGONAL, RIDGE = 0.3, 0.1, 1e-3
#: Log density differences count this much, since statistics of one text aren't independent.
TEMPER = 0.25
#: Features are standardised and held within this many pooled standard deviations.
CLIP = 6.0

_SYMBOLS = re.compile(r"[#$%&*@^~<>=+_\\{}\[\]]")
_MARKS = re.compile(r"[!?]")
_DIGITS = re.compile(r"[0-9]")
_UPPER = re.compile(r"[A-Z]")


def statistics(text: str | None) -> list[float]:
    """The transformed statistics of a whole text; those of null and white texts are those of no words."""
    text = text or ""
    words = text.split()
    n, chars = len(words), max(1, len(text))
    rate = lambda count: float(np.log1p(1000 * count / chars))
    lowered = [w.lower() for w in words]
    distinct = len(set(lowered))
    again = sum(a == b for a, b in zip(lowered, lowered[1:], strict=False))
    lines = text.split("\n")
    many = [x for x in lines if len(x) >= 20]
    return [
        float(np.log1p(n)),
        float(np.log1p(sum(map(len, words)) / max(1, n))),
        rate(len(_UPPER.findall(text))),
        rate(len(_SYMBOLS.findall(text))),
        rate(len(_DIGITS.findall(text))),
        rate(len(_MARKS.findall(text))),
        distinct / max(1, n) ** 0.8,
        float(np.log1p(1000 * again / max(1, n))),
        float(np.log1p(n / len(lines))),
        rate(text.count("|")),
        sum(len(w) <= 2 for w in words) / max(1, n),
        len(many) / max(1, len(set(many))) - 1.0,
    ]


def _statistics(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        values = [statistics(x.as_py()) for x in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values, pa.list_(pa.float64()))], ["doc_id", "x"])


def measured(docs: DataFrame) -> DataFrame:
    """doc_id and x, the statistics of each document."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_statistics, "doc_id long, x array<double>")


class Discriminant:
    """Two classes' Gaussians over standardised statistics, from their counts, sums and sums of products."""

    def __init__(self, moments: dict[int, tuple[float, np.ndarray, np.ndarray]]):
        d = len(FEATURES)
        self.known = sorted(k for k, (n, _, _) in moments.items() if n >= 2)
        if len(self.known) < 2:  # one class or none: its share of the labels is all there is
            total = sum(n for n, _, _ in moments.values())
            self.constant = (moments.get(1, (0.0,))[0] + 1) / (total + 2)
            return
        n_all = sum(moments[k][0] for k in self.known)
        self.mean = sum(moments[k][1] for k in self.known) / n_all
        second = sum(moments[k][2] for k in self.known) / n_all
        self.scale = np.sqrt(np.maximum(np.diag(second) - self.mean**2, 1e-9))
        unit = np.outer(self.scale, self.scale)
        means = {k: moments[k][1] / moments[k][0] for k in self.known}
        within = {k: (moments[k][2] / moments[k][0] - np.outer(means[k], means[k])) / unit for k in self.known}
        pooled = sum(within[k] * moments[k][0] for k in self.known) / n_all
        pooled = (1 - DIAGONAL) * pooled + DIAGONAL * np.diag(np.diag(pooled))
        self.parts = []
        for k in self.known:
            factor = np.linalg.cholesky((1 - POOL) * within[k] + POOL * pooled + RIDGE * np.eye(d))
            self.parts.append(((means[k] - self.mean) / self.scale, factor, 2 * np.log(np.diag(factor)).sum(), np.log(moments[k][0] / n_all)))

    def score(self, x: np.ndarray) -> np.ndarray:
        """The probability of class 1 for each row."""
        if len(self.known) < 2:
            return np.full(len(x), self.constant)
        z = np.clip((x - self.mean) / self.scale, -CLIP, CLIP)
        density, prior = [], []
        for mean, factor, logdet, log_prior in self.parts:
            away = np.linalg.solve(factor, (z - mean).T)
            density.append(-0.5 * ((away**2).sum(axis=0) + logdet))
            prior.append(log_prior)
        odds = TEMPER * (density[1] - density[0]) + prior[1] - prior[0]
        return 1 / (1 + np.exp(-np.clip(odds, -50, 50)))


def fit(features: DataFrame, labels: DataFrame) -> Discriminant:
    """The discriminant of all rows of labels (doc_id, label 0 or 1) that features have.

    Ids with contrary labels count once for each; null ids and labels are left out.
    """
    known = labels.where("doc_id IS NOT NULL AND label IN (0, 1)").select(F.col("doc_id").alias("label_id"), F.col("label").cast("int").alias("label")).distinct()
    rows = features.join(known, features.doc_id == known.label_id)
    d = len(FEATURES)
    x = [F.get("x", F.lit(i)) for i in range(d)]
    sums = [F.sum(x[i]).alias(f"s{i}") for i in range(d)]
    products = [F.sum(x[i] * x[j]).alias(f"p{i}_{j}") for i in range(d) for j in range(i + 1)]
    moments = {}
    for r in rows.groupBy("label").agg(F.count(F.lit(1)).alias("n"), *sums, *products).collect():
        second = np.array([[r[f"p{max(i, j)}_{min(i, j)}"] for j in range(d)] for i in range(d)])
        moments[r["label"]] = (float(r["n"]), np.array([r[f"s{i}"] for i in range(d)]), second)
    return Discriminant(moments)


def _scores(model: Discriminant, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, len(FEATURES))
            score = model.score(x)
            columns = [batch.column("doc_id"), batch.column("held_out"), pa.array(score), pa.array((score >= threshold).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "held_out", "score", "predicted"])

    return run


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """Quality scores of all documents, learned from labels (doc_id, label) of ids whose crc32 modulo 4 is not 2.

    docs: doc_id, text; other columns are ignored and are no inputs. Returns doc_id, held_out, score (0 to 1) and predicted (1
    from threshold on). Null and empty texts have the statistics of no words. With labels of one class only, or none,
    every score is that class's share, smoothed. Repeated rows score alike. An empty table gives no rows.
    """
    features = written(measured(docs), "quality-statistics")
    model = fit(features.where(id_bucket("doc_id", 4) != 2), labels)
    rows = features.select("doc_id", (id_bucket("doc_id", 4) == 2).alias("held_out"), "x")
    return rows.mapInArrow(_scores(model, threshold), "doc_id long, held_out boolean, score double, predicted int")
