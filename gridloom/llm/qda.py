"""Quality classifier: regularised quadratic discriminant analysis of document statistics.

Each document becomes a few transformed statistics. Class means and covariances
are sums over all labelled training rows, made on the cluster. Covariances shrink
towards the pooled one and towards a multiple of the identity; their Cholesky
factors are kept in the model, and a score is the logistic of the scaled
difference of Mahalanobis log-densities.

Defined cases: a null text counts as empty and gets a score like any other;
labels without doc_id or quality are left out, and so is a document whose labels
disagree; repeated label rows count once, and repeated documents each; a score of
exactly 0.5 accepts; without rows of both classes all scores are 0.5, and documents
are kept. A very long text is read whole, by one task, like any other. Further columns
never enter a score and are kept by `accepted`.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded, packed, written

STATISTICS = ("words", "word_chars", "unlike_words", "unlike_trigrams", "upper", "digits", "marks", "odd_marks", "stops", "lines", "unlike_lines", "words_a_stop", "shouts")
_MARKS = re.compile(r"[^\w\s]+")
_ODD = re.compile(r"[^\w\s.,;:'\"!?()-]")
_SHOUT = re.compile(r"[!?*#$%&@~^=+<>{}|\\/]{2,}")


def statistics(text: str | None) -> list[float]:
    """The transformed statistics of a whole text; counts enter as logarithms, shares as square roots."""
    text = text or ""
    tokens = text.split()
    n, chars = len(tokens), max(len(text), 1)
    plain = [t.strip(".,;:!?'\"()").lower() for t in tokens]
    lines = [x for x in text.split("\n") if x.strip()]
    upper = sum(map(str.isupper, text)) if n else 0
    trigrams = set(zip(plain, plain[1:], plain[2:], strict=False))
    sentences = text.count(".") + text.count("!") + text.count("?")
    share = lambda a, b: float(np.sqrt(a / b)) if b else 0.0
    return [
        float(np.log1p(n)),
        float(np.log1p(len(text) / n)) if n else 0.0,
        share(len(set(plain)), n),
        share(len(trigrams), n - 2) if n > 2 else 1.0,
        share(upper, chars),
        share(sum(map(str.isdigit, text)), chars),
        share(sum(map(len, _MARKS.findall(text))), chars),
        share(len(_ODD.findall(text)), chars),
        share(sum(len(t) <= 3 for t in plain), n),
        float(np.log1p(len(lines))),
        share(len(set(lines)), len(lines)),
        float(np.log1p(n / (1 + sentences))),
        share(len(_SHOUT.findall(text)), n),
    ]


DIMENSIONS = len(STATISTICS)


@dataclass
class Model:
    """Class means, lower Cholesky factors of the covariances and log priors; the factors' inverses are made once."""

    means: np.ndarray
    factors: np.ndarray
    log_prior: np.ndarray

    def __post_init__(self) -> None:
        self.inverses = np.linalg.inv(self.factors)
        self.log_roots = np.log(np.diagonal(self.factors, axis1=1, axis2=2)).sum(axis=1)

    def scores(self, x: np.ndarray) -> np.ndarray:
        logs = [prior - root - 0.5 * (((x - mean) @ inverse.T) ** 2).sum(axis=1) for mean, inverse, root, prior in zip(self.means, self.inverses, self.log_roots, self.log_prior, strict=True)]
        return 1 / (1 + np.exp(np.clip((logs[0] - logs[1]) / x.shape[1], -500, 500)))


def batches(docs: DataFrame, key: str) -> DataFrame:
    """A key column and x, the statistics, of every row (key, text)."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            x = [statistics(t.as_py()) for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column(key), pa.array(x, pa.list_(pa.float64()))], [key, "x"])

    return docs.select(key, "text").mapInArrow(run, T.StructType([docs.schema[key], T.StructField("x", T.ArrayType(T.DoubleType()))]))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


#: Labelled rows that a model is fitted on, about; of more, those with the smallest hashes of their doc_id.
SAMPLE = 50_000


def training(labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, y of the labelled documents that a model may learn from, a written table."""
    known = labels.where("doc_id is not null and quality is not null").where(~held_out(F.col("doc_id")))
    known = written(known.groupBy("doc_id").agg(F.min("quality").alias("y"), F.max("quality").alias("most")).where("y = most and y in (0, 1)").drop("most"), "labels")
    share = sample / max(known.count(), 1)
    return known if share >= 1 else known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(share * (1 << 30)))


def fit(docs: DataFrame, labels: DataFrame, shrink: float = 0.2, ridge: float = 0.02, sample: int = SAMPLE) -> Model | None:
    """The model of the labelled rows of docs that aren't held out, at most about `sample`; None without both classes."""
    d = DIMENSIONS
    rows = batches(docs.select("doc_id", "text").join(bounded(training(labels, sample)), "doc_id"), "y")
    pairs = [(i, j) for i in range(d) for j in range(i, d)]
    sums = rows.groupBy("y").agg(F.count("*").alias("n"), *(F.sum(F.col("x")[i]).alias(f"s{i}") for i in range(d)), *(F.sum(F.col("x")[i] * F.col("x")[j]).alias(f"p{i}_{j}") for i, j in pairs))
    got = {r["y"]: r for r in sums.collect()}
    if set(got) != {0, 1}:
        return None
    means, spreads, counts = [], [], []
    for y in (0, 1):
        r, n = got[y], got[y]["n"]
        mean, second = np.array([r[f"s{i}"] for i in range(d)]) / n, np.zeros((d, d))
        for i, j in pairs:
            second[i, j] = second[j, i] = r[f"p{i}_{j}"] / n
        means.append(mean)
        spreads.append(second - np.outer(mean, mean))
        counts.append(n)
    pooled = sum(n * s for n, s in zip(counts, spreads, strict=True)) / sum(counts)
    scale = np.diag(np.maximum(np.diag(pooled), 1e-9))
    factors = [np.linalg.cholesky((1 - ridge) * ((1 - shrink) * s + shrink * pooled) + ridge * scale + 1e-9 * np.eye(d)) for s in spreads]
    return Model(np.array(means), np.array(factors), np.log(np.array(counts) / sum(counts)))


def scored(docs: DataFrame, model: Model | None, key: str) -> DataFrame:
    """A key column and score of every row (key, text): one pass, nothing shuffled."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            x = np.array([statistics(t.as_py()) for t in b.column("text")]).reshape(-1, DIMENSIONS)
            s = model.scores(x) if model and len(x) else np.full(len(x), 0.5)
            yield pa.RecordBatch.from_arrays([b.column(key), pa.array(s, pa.float64())], [key, "score"])

    return docs.select(key, "text").mapInArrow(run, T.StructType([docs.schema[key], T.StructField("score", T.DoubleType())]))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every document."""
    out = scored(docs, fit(docs, labels), "doc_id")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents with a score of at least 0.5, with all their columns."""
    model = fit(docs, labels)
    return docs if model is None else scored(packed(docs, "text"), model, "row").where("score >= 0.5").select("row.*")
