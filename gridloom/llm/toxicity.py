"""Toxicity by multiple-instance learning: sentences are scored, and labels of whole documents teach it.

A document is toxic if any of its sentences is. A sentence has a probability q, the
logistic of a bias and the weights of its words' features, and a document's score is
the noisy-or 1 - (1 - q1)(1 - q2)... of its sentences. The features of a word are
the word and its beginnings, on a fixed number of cells. Only the
cells that best tell the classes of labelled documents apart get a weight. Weights
are fitted by gradient steps over all sentences of the labelled sample: each step is
a pass over a small written table, whose tasks send one gradient each. Sentences of
probability 1/2 and more are the ones that offend; so is the worst sentence
of a document that is toxic by many weak ones only.

Defined cases: a null text is empty; a text without sentences scores 0; labels without
doc_id or toxic are left out, and so is a document whose labels disagree; repeated label rows count
once, and repeated documents each; a score of exactly 0.5 is toxic; equally bad
sentences are told by the first; without rows of both classes all scores are 0. A very
long text is read sentence by sentence. Further columns never enter a score and are
kept by `clean`. An empty table gives no row.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded, done_with, packed, written

_SENTENCE = re.compile(r"[^\s.!?。！？][^.!?\n。！？]*[.!?。！？]*")
#: Marks that are cut from the ends of words.
_EDGES = ".,;:!?'\"()[]{}<>|*_-/\\#&%$=+~^@`…„“”‚‘’«»¿¡。！？"


@dataclass(frozen=True)
class Fit:
    """How a model is fitted."""

    #: Labelled rows that it is fitted on, about; of more, those with the smallest hashes of their doc_id.
    sample: int = 20_000
    cells: int = 1 << 18
    #: Cells that get a weight, and the least documents of the sample in which they are.
    features: int = 4096
    documents: int = 3
    steps: int = 40
    rate: float = 0.5
    ridge: float = 1e-5
    #: Parts of the sample, each of which sends a gradient for a step.
    parts: int = 8


def features(token: str, cells: int) -> list[int]:
    """The cells of a word: itself, and its first three to six letters."""
    w = token.strip(_EDGES)
    if not w:
        return []
    found = [zlib.crc32(w.encode(), 1) % cells]
    for n in range(3, min(7, len(w))):
        found.append(zlib.crc32(w[:n].encode()) % cells)
    return found


def sentences(text: str) -> Iterator[tuple[int, int, list[str]]]:
    """Start, end and words, in lower case, of each sentence."""
    for m in _SENTENCE.finditer(text):
        if words := m[0].lower().split():
            yield m.start(), m.end(), words


class Known(dict):
    """What is known of each word as it is written; made anew when it holds too many."""

    def __init__(self, make, most: int = 600_000) -> None:
        self.make, self.most = make, most

    def __missing__(self, word: str):
        if len(self) >= self.most:
            self.clear()
        self[word] = out = self.make(word)
        return out


@dataclass
class Model:
    """bias, and the weight of each cell that has one."""

    bias: float
    cells: np.ndarray
    weights: np.ndarray
    size: int

    def words(self) -> Known:
        own = dict(zip(self.cells.tolist(), self.weights.tolist(), strict=True))
        return Known(lambda w: sum(own.get(c, 0.0) for c in features(w, self.size)))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def training(docs: DataFrame, labels: DataFrame, how: Fit) -> DataFrame:
    """text, y of the labelled documents that a model may learn from, about `sample` at most."""
    known = labels.where("doc_id is not null and toxic is not null").where(~held_out(F.col("doc_id")))
    known = written(known.groupBy("doc_id").agg(F.min("toxic").cast("int").alias("y"), F.max("toxic").cast("int").alias("most")).where("y = most and y in (0, 1)").drop("most"), "toxic-labels")
    share = how.sample / max(known.count(), 1)
    few = known if share >= 1 else known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(share * (1 << 30)))
    return docs.select("doc_id", "text").join(bounded(few), "doc_id").select(F.coalesce("text", F.lit("")).alias("text"), "y")


def chosen(rows: DataFrame, how: Fit) -> tuple[np.ndarray, np.ndarray] | None:
    """The cells that tell the classes apart best, by a chi-square of the documents they are in, with their log-odds; None without both classes."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, sums, n = Known(lambda w: features(w, how.cells)), np.zeros((2, how.cells), np.int64), [0, 0]
        for b in it:
            for text, y in zip(b.column("text"), b.column("y").to_pylist(), strict=True):
                own = {c for _, _, words in sentences(text.as_py()) for w in set(words) for c in seen[w]}
                sums[y, np.fromiter(own, np.int64, len(own))] += 1
                n[y] += 1
        at = np.flatnonzero(sums.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array([-1, *at.tolist()], pa.int32()), *(pa.array([n[y], *sums[y, at].tolist()], pa.int64()) for y in (0, 1))], ["cell", "n0", "n1"])

    found = written(rows.mapInArrow(run, "cell int, n0 long, n1 long").groupBy("cell").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")), "toxic-cells")
    every = found.where("cell = -1").first()
    if not every or not every["n0"] or not every["n1"]:
        return None
    a, b = every["n0"], every["n1"]
    apart = F.pow(F.col("n1") * float(a) - F.col("n0") * float(b), 2) / ((F.col("n0") + F.col("n1")) * (a + b - F.col("n0") - F.col("n1") + 1.0))
    best = found.where(F.col("cell") >= 0).where(F.col("n0") + F.col("n1") >= how.documents).orderBy(apart.desc(), "cell").limit(how.features).collect()
    odds = [np.log((r["n1"] + 0.5) / (b + 1)) - np.log((r["n0"] + 0.5) / (a + 1)) for r in best]
    return np.array([r["cell"] for r in best], np.int64), np.array(odds)


def instances(rows: DataFrame, cells: np.ndarray, how: Fit) -> DataFrame:
    """part, y, plain, found: a document's sentences without chosen cells by number, and the others as places in `cells`, each closed by -1."""
    place = {c: k for k, c in enumerate(cells.tolist())}

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = Known(lambda w: [place[c] for c in features(w, how.cells) if c in place])
        for b in it:
            plain, found = [], []
            for text in b.column("text"):
                own, n = [], 0
                for _, _, words in sentences(text.as_py()):
                    if here := [k for w in set(words) for k in seen[w]]:
                        own += [*here, -1]
                    else:
                        n += 1
                plain.append(n)
                found.append(np.array(own, np.int16).tobytes())
            yield pa.RecordBatch.from_arrays([b.column("y"), pa.array(plain, pa.int64()), pa.array(found, pa.binary())], ["y", "plain", "found"])

    return rows.mapInArrow(run, "y int, plain long, found binary").withColumn("part", F.pmod(F.xxhash64("found", "plain"), F.lit(how.parts)).cast("int"))


def gradient(table: pa.Table, bias: float, weights: np.ndarray) -> np.ndarray:
    """Documents, loss, and the sums of the loss's derivatives by the bias and by each weight, over some documents."""
    out = np.zeros(3 + len(weights))
    for y, plain, found in zip(table["y"].to_pylist(), table["plain"].to_pylist(), table["found"], strict=True):
        at = np.frombuffer(found.as_py(), np.int16)
        own = at >= 0
        which = np.cumsum(~own)[own]
        n = int((~own).sum())
        z = bias + np.bincount(which, weights[at[own]], n) if n else np.zeros(0)
        q, q0 = 1 / (1 + np.exp(-np.clip(z, -50, 50))), 1 / (1 + np.exp(-bias))
        # -log(1 - q) of all sentences; the noisy-or is 1 - exp(-a).
        a = float(-np.log1p(-np.minimum(q, 1 - 1e-15)).sum() - plain * np.log1p(-q0))
        a = max(a, 1e-12)
        slope = 1.0 if y == 0 else -1 / np.expm1(min(a, 500.0))
        out[0] += 1
        out[1] += a if y == 0 else -np.log(-np.expm1(-a))
        out[2] += slope * (float(q.sum()) + plain * q0)
        if n:
            out[3:] += slope * np.bincount(at[own], q[which], len(weights))
    return out


def fit(docs: DataFrame, labels: DataFrame, how: Fit = Fit()) -> Model | None:
    """The model of the labelled documents that aren't held out; None without both classes."""
    rows = written(training(docs, labels, how), "toxic-sample")
    best = chosen(rows, how)
    if best is None:
        return None
    cells, odds = best
    bags = written(instances(rows, cells, how).repartition(how.parts, "part"), "toxic-sentences")
    done_with(rows)
    at = np.concatenate(([-5.0], 0.5 * np.clip(odds, -2, 8)))
    first, second = np.zeros(len(at)), np.zeros(len(at))
    for step in range(1, how.steps + 1):
        now = at.copy()

        def part(it: Iterator[pa.RecordBatch], now=now) -> Iterator[pa.RecordBatch]:
            sums = sum((gradient(pa.Table.from_batches([b]), now[0], now[1:]) for b in it), np.zeros(2 + len(now)))
            yield pa.RecordBatch.from_arrays([pa.array([sums.tolist()], pa.list_(pa.float64()))], ["sums"])

        # One row of each of the `parts` parts.
        sums = np.sum([r["sums"] for r in bags.select("y", "plain", "found").mapInArrow(part, "sums array<double>").collect()], axis=0)
        slope = sums[2:] / max(sums[0], 1) + how.ridge * np.concatenate(([0.0], now[1:]))
        first, second = 0.9 * first + 0.1 * slope, 0.99 * second + 0.01 * slope**2
        at -= how.rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-6)
    done_with(bags)
    return Model(float(at[0]), cells, at[1:], how.cells)


def scored(docs: DataFrame, model: Model | None, *keep: str) -> DataFrame:
    """The columns of keep, and score, n_sentences, n_offending, offending of every row with a text: one pass, nothing shuffled.

    offending has start:end of the sentences that offend, in code points, joined by commas.
    """
    told = docs.sparkSession.sparkContext.broadcast(model)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = told.value
        seen = own.words() if own else {}
        for b in it:
            rows = []
            for text in b.column("text"):
                a, n, spans, worst = 0.0, 0, [], (0.0, "")
                for start, end, words in sentences(text.as_py() or ""):
                    n += 1
                    if own:
                        z = own.bias + sum(map(seen.__getitem__, set(words)))
                        a += np.logaddexp(0.0, z)
                        if z >= 0:
                            spans.append(f"{start}:{end}")
                        elif not worst[1] or z > worst[0]:
                            worst = (z, f"{start}:{end}")
                score = float(-np.expm1(-a))
                spans = spans or [worst[1]] * (score >= 0.5)
                rows.append((score, n, len(spans), ",".join(spans)))
            columns = zip(*rows, strict=True) if rows else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), *(pa.array(c, k) for c, k in zip(columns, (pa.float64(), pa.int64(), pa.int64(), pa.string()), strict=True))], [*keep, "score", "n_sentences", "n_offending", "offending"])

    schema = T.StructType([*(docs.schema[c] for c in keep), *T._parse_datatype_string("score double, n_sentences long, n_offending long, offending string").fields])
    return docs.select(*keep, "text").mapInArrow(run, schema)


def classify(docs: DataFrame, labels: DataFrame, how: Fit = Fit()) -> DataFrame:
    """doc_id, held_out, score, predicted, and the sentences that offend, for every document."""
    out = scored(docs, fit(docs, labels, how), "doc_id")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_sentences", "n_offending", "offending")


def clean(docs: DataFrame, labels: DataFrame, how: Fit = Fit()) -> DataFrame:
    """The documents that score below 0.5, with all their columns."""
    return scored(packed(docs, "text"), fit(docs, labels, how), "row").where("score < 0.5").select("row.*")
