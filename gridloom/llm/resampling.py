"""Importance resampling: documents drawn without replacement towards the word distribution of a target table.

Words fall on a fixed number of buckets. Both tables' bucket counts give each bucket
a gain, the logarithm of its share in the target by its share in the documents, as
an integer of thousandths. All gains are one array, and a document's weight is the
floored mean over its features. A score is the weight and Gumbel noise that the
doc_id alone decides, so the highest scores are a draw by weight, and reruns agree.

No global sort is made. Scores are integers, so an exact histogram of them is small
however many documents there are. Summed from the top, its counts say how many
documents stand above each score; the scores above which fewer than the quota stand
survive, the last of them is the cutoff, and a document's rank is that number and its
place by doc_id among the rows of its own score.

Defined cases: null text has no words, weight 0, and isn't among the documents that
are drawn from unless `least` is 0; a null doc_id draws its noise as an empty one and
stands last among equal scores; repeated rows are documents of their own, and their
ranks go in any order; a target without words has even gains, as the counts are smoothed.
A very long text is read in pieces of PIECE bytes. An empty table gives no row.
Extra columns are ignored by `resampled` and kept by `drawn`.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded, done_with, packed, written

#: Bytes of a text that are cut into words at once.
PIECE = 1 << 20
#: Scores of a coarse bin of the histogram.
COARSE = 256
#: Bytes that aren't words become spaces, and A-Z become a-z. All bytes of other code points are parts of words.
_PLAIN = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or 48 <= c <= 57 or c >= 128 else 32 for c in range(256))


@dataclass(frozen=True)
class Draw:
    buckets: int = 10_000
    #: Documents of fewer words are scored, not drawn.
    least: int = 20
    percent: int = 10
    seed: int = 2024
    #: Words that a task knows the buckets of; it starts anew when they are more.
    known: int = 400_000


def pieces(data: bytes) -> Iterator[list[bytes]]:
    """The words of a text, a list for each piece of it; pieces end between words."""
    at = 0
    while at < len(data):
        stop = at + PIECE
        while (end := data[at:stop].translate(_PLAIN).rfind(b" ") if stop < len(data) else stop - at) < 0:
            stop += stop - at
        yield data[at : at + end].translate(_PLAIN).split()
        at += max(end, 1)


class Buckets(dict):
    """The bucket of each word, by its bytes."""

    def __init__(self, how: Draw) -> None:
        self.how = how

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.how.known:
            self.clear()
        self[word] = b = zlib.crc32(word) % self.how.buckets
        return b

    def of(self, text: bytes | None) -> Iterator[np.ndarray]:
        for words in pieces(text or b""):
            yield np.fromiter(map(self.__getitem__, words), np.int64, len(words))


def tallies(docs: DataFrame, how: Draw = Draw()) -> DataFrame:
    """bucket, n: features of all texts on each bucket. A task sends its sums only."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, sums = Buckets(how), np.zeros(how.buckets, np.int64)
        for b in it:
            for text in b.column("text"):
                for found in known.of(text.as_py()):
                    sums += np.bincount(found, minlength=how.buckets)
        there = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(there), pa.array(sums[there])], ["bucket", "n"])

    return docs.select(F.col("text").cast("binary").alias("text")).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(docs: DataFrame, target: DataFrame, how: Draw = Draw()) -> np.ndarray:
    """The gain of each bucket: thousandths of the logarithm of smoothed shares, floored. The driver gets `buckets` sums of each table."""
    held = []
    for df in (docs, target):
        sums = np.zeros(how.buckets)
        for r in tallies(df, how).collect():
            sums[r["bucket"]] = r["n"]
        held.append(sums)
    (s, t), n = held, float(how.buckets)
    return np.array([math.floor(1000 * math.log((b + 1) * (s.sum() + n) / ((a + 1) * (t.sum() + n)))) for a, b in zip(s.tolist(), t.tolist(), strict=True)], np.int64)


def noise(doc_id: object, seed: int) -> int:
    """Thousandths of a Gumbel number, floored; the first 32 bits of a hash stand for the uniform one."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scored(docs: DataFrame, gain: np.ndarray, how: Draw = Draw()) -> DataFrame:
    """docs (doc_id, text and perhaps more) without text, with n_features, weight and score: one pass, nothing shuffled."""
    names = [c for c in docs.columns if c != "text"]
    told = docs.sparkSession.sparkContext.broadcast(gain)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, own = Buckets(how), told.value
        for b in it:
            rows = []
            for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text"), strict=True):
                n = total = 0
                for found in known.of(text.as_py()):
                    n, total = n + len(found), total + int(own[found].sum())
                weight = total // n if n else 0
                rows.append((n, weight, weight + noise(doc_id, how.seed)))
            columns = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), *(pa.array(c, pa.int64()) for c in columns)], [*names, "n_features", "weight", "score"])

    schema = T.StructType([*(docs.schema[c] for c in names), *(T.StructField(c, T.LongType()) for c in ("n_features", "weight", "score"))])
    return docs.withColumn("text", F.col("text").cast("binary")).mapInArrow(run, schema)


def offsets(able: DataFrame, how: Draw = Draw()) -> tuple[DataFrame, int]:
    """score, above: the surviving scores with the number of rows above each; and the quota.

    The histogram has a row for each integer between the least and the highest score.
    It is summed in two steps, by coarse bins and inside them.
    """
    counts = written(able.groupBy("score").agg(F.count("*").alias("n")), "score-histogram")
    quota = (counts.agg(F.sum("n")).first()[0] or 0) * how.percent // 100
    binned = counts.withColumn("bin", F.floor(F.col("score") / COARSE))
    before = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    coarse = binned.groupBy("bin").agg(F.sum("n").alias("n")).select("bin", before(Window.orderBy(F.desc("bin"))).alias("bins_above"))
    inside = before(Window.partitionBy("bin").orderBy(F.desc("score")))
    above = binned.withColumn("inside", inside).join(F.broadcast(coarse), "bin").select("score", (F.col("inside") + F.col("bins_above")).alias("above"))
    alive = written(above.where(F.col("above") < quota), "surviving-scores")
    done_with(counts)
    return alive, quota


def ranked(found: DataFrame, order: Column, how: Draw = Draw()) -> DataFrame:
    """A table of scored rows with rank; null where a row isn't drawn. found is a written table."""
    able = F.col("n_features") >= how.least
    alive, quota = offsets(found.where(able), how)
    met = found.join(bounded(alive), "score", "left").withColumn("above", F.when(able, F.col("above")))
    place = F.row_number().over(Window.partitionBy("score").orderBy(F.col("doc_id").asc_nulls_last(), order))
    rank = (F.col("above") + place).cast("long")
    stay = met.where("above is not null").withColumn("rank", F.when(rank <= quota, rank))
    return stay.unionByName(met.where("above is null").withColumn("rank", F.lit(None).cast("long"))).drop("above")


def resampled(docs: DataFrame, target: DataFrame, how: Draw = Draw()) -> DataFrame:
    """doc_id, n_features, weight, score, rank of every document; rank is null unless it is drawn."""
    own = docs.select("doc_id", "text")
    found = written(scored(own, gains(own, target.select("text"), how), how), "scores")
    return ranked(found, F.col("weight"), how).select("doc_id", "n_features", "weight", "score", "rank")


def drawn(docs: DataFrame, target: DataFrame, how: Draw = Draw()) -> DataFrame:
    """The documents drawn, with all their columns."""
    found = written(scored(packed(docs, "doc_id", "text"), gains(docs, target, how), how), "scores")
    return ranked(found, F.col("weight"), how).where("rank is not null").select("row.*")
