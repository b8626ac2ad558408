"""Phrase collocations: phrases whose words stand together more often than their parts foretell.

Texts are cut into pieces at punctuation and line ends. Phrases are counted in levels,
from single words to the longest phrases. At each level a task counts the phrases of
its pieces, weighted, and sends each different one once; they are dealt to partitions
by hash, and DuckDB counts each partition's, spilling to disk beyond a fixed memory. A
phrase can only be frequent if both phrases of one word less in it are, so that level's
frequent ones, as a bit filter, say what the next one looks at. Before pairs are
counted, the pairs of frequent words are counted by buckets of their hash; a pair whose
bucket is rare is rare. Texts shrink to their runs of the other pairs, and equal ones
that a task holds at once become one with a multiplicity. What passes the filters by
mistake is counted and found rare; counts are exact.

Tasks work on the bytes and offsets of Arrow's columns, about a million words at a
time; only the different words of a lot and the frequent phrases become Python objects.

Every part of a frequent phrase is frequent too, so the tables of the levels hold all
that scores need. A phrase sends a request for each of its parts; requests are
shuffled to the parts' counts, and the answers come back to the phrase. Parts of one
word, which many phrases ask for, are met in SALTS places.

Defined cases: null text has no pieces; a null lang is `und`; pieces without words are
left out; repeated rows count as often as they are there; equal scores go by count, then
phrase by its bytes. A long text is cut into stretches of STRETCH words with
the following words of the longest phrase but one; starts are counted in one stretch only. A very long
text is cut at ends of pieces as it is read; without any, it stays whole there. An empty table gives no row. Extra columns are ignored.
"""

from __future__ import annotations

import os
import re
import shutil
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property
from urllib.parse import urlparse

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.storage import shared_dir
from .common import done_with, partitions, written

#: Words of a text that one row holds at most, besides those that follow them.
STRETCH = 1024
#: Bytes of texts or pieces that a task looks at together.
LOT = 6 << 20
#: Bits of a bucket's number inside its block; a block is counted at once.
BLOCK = 16
#: The starts of a text that isn't cut yet.
WHOLE = (1 << 31) - 1
SALTS = 32
#: Most phrases of a part that one task looks at when the first of each language are taken.
PARTS = 64

#: 0 for bytes of words, 1 for blanks, 2 for ends of pieces.
_KIND = np.array([2 if c in b".,;:!?\n\x0b\x0c\r" else 1 if c in b" \t" else 0 for c in range(256)], np.uint8)
_LOWER = np.array([c + 32 if 65 <= c <= 90 else c for c in range(256)], np.uint8)
_END = re.compile(rb"[.,;:!?\n\x0b\x0c\r]")


@dataclass(frozen=True)
class Mining:
    longest: int = 5
    #: Least occurrences of a phrase.
    least: int = 100
    #: Phrases of each language that are given.
    first: int = 2000
    #: Memory that DuckDB takes in one task before it spills.
    memory: str = "200MB"
    #: Bits of the filter for each frequent phrase of a level, and bits at most, which are the buckets of pairs, too. More phrases only make it pass more.
    bits_each: int = 16
    bits: int = 1 << 27


_ODD, _ALL = 0x9E3779B97F4A7C15, (1 << 64) - 1


def word_hash(word: bytes) -> int:
    return xxhash.xxh3_64_intdigest(word)


def place_of(lang: str, phrase: bytes) -> int:
    """63 bits for a phrase, from those of its words in turn."""
    h = word_hash(lang.encode())
    for w in phrase.split(b" "):
        h = (h ^ word_hash(w)) * _ODD & _ALL
        h ^= h >> 29
    return h >> 1


def mixed(h: np.ndarray, word: np.ndarray) -> np.ndarray:
    """A step of place_of for many phrases: their hashes with one word more."""
    h = (h ^ word) * np.uint64(_ODD)
    return h ^ h >> np.uint64(29)


class Filter:
    """Bits of the phrases of a level that may be frequent, for tasks that look at longer ones."""

    def __init__(self, spark: SparkSession, bits: np.ndarray) -> None:
        self.size = len(bits) << 3
        self.told = spark.sparkContext.broadcast(bits)

    @staticmethod
    def of(kept: DataFrame, how: Mining) -> Filter:
        """That of a level's frequent phrases."""
        n = max(1, kept.count())
        size = min(how.bits, max(1 << 16, 1 << (n * how.bits_each - 1).bit_length()))
        at = F.col("h") % size
        bit = F.expr(f"shiftleft(1, CAST(h % {size} & 7 AS INT))")
        found = kept.select(F.shiftright(at, 3).alias("at"), bit.alias("bit")).groupBy("at").agg(F.bit_or("bit").alias("bits")).toArrow()
        bits = np.zeros(size >> 3, np.uint8)
        bits[found["at"].to_numpy()] = found["bits"].to_numpy().astype(np.uint8)
        return Filter(kept.sparkSession, bits)

    @staticmethod
    def of_buckets(pieces: DataFrame, known: list[Filter], how: Mining) -> Filter:
        """That of the pairs whose bucket is frequent; every frequent pair's is."""
        found = frequent_buckets(pieces, known, how).toArrow()
        bits = np.zeros(how.bits >> 3, np.uint8)
        for block, own in zip(found["block"].to_pylist(), found["bits"].to_pylist(), strict=True):
            own = np.frombuffer(own, np.uint8)[: len(bits)]
            bits[block << BLOCK - 3 :][: len(own)] = own
        return Filter(pieces.sparkSession, bits)

    def has(self, places: np.ndarray) -> np.ndarray:
        at = places & np.uint64(self.size - 1)
        return (self.told.value[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & np.uint8(1)).astype(bool)


def binaries(data: np.ndarray, offsets: np.ndarray) -> pa.BinaryArray:
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])


def counting(sizes: np.ndarray) -> np.ndarray:
    """0, 1, 2... for each size in turn, so many numbers."""
    return np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)


class Words:
    """The lower-cased words of some texts or pieces, one after another: of each its number and its language's, and whether its piece ends with it."""

    def __init__(self, lang: pa.Array, text: pa.Array) -> None:
        _, ends, data = text.buffers()
        ends = np.frombuffer(ends, np.int32)[text.offset : text.offset + len(text) + 1].astype(np.int64)
        data = np.frombuffer(data or b"", np.uint8)[ends[0] : ends[-1]]
        ends -= ends[0]
        kind = _KIND[data]
        inside = kind == 0
        begins = inside.copy()
        begins[1:] &= ~inside[:-1]
        heads = ends[:-1][ends[:-1] < ends[1:]]
        begins[heads] = inside[heads]
        at = np.flatnonzero(begins)
        self.n = len(at)
        ends_too = inside.copy()
        ends_too[:-1] &= begins[1:] | ~inside[1:]
        letters, sizes = _LOWER[data[inside]], np.flatnonzero(ends_too) + 1 - at
        words = binaries(letters, np.concatenate(([0], np.cumsum(sizes)))).dictionary_encode()
        self.names, self.word = words.dictionary, words.indices.to_numpy().astype(np.int64)
        #: Words before each row, and of each row.
        self.before = np.searchsorted(at, ends)
        self.each = np.diff(self.before)
        self.last = np.bitwise_or.reduceat(kind, at) > 1 if self.n else np.zeros(0, bool)
        self.last[self.before[1:][self.each > 0] - 1] = True
        langs = lang.dictionary_encode()
        self.langs, self.of_row = langs.dictionary, langs.indices.to_numpy().astype(np.int64)
        self.lang = np.repeat(self.of_row, self.each)

    @cached_property
    def hashes(self) -> tuple[np.ndarray, np.ndarray]:
        """word_hash of each word, and of its language."""
        words = np.fromiter(map(word_hash, self.names.to_pylist()), np.uint64, len(self.names))
        langs = np.fromiter((word_hash(x.encode()) for x in self.langs.to_pylist()), np.uint64, len(self.langs))
        return words[self.word], langs[self.lang]

    def places(self, at: np.ndarray, n: int) -> np.ndarray:
        """place_of the phrases of n words that begin at the given places."""
        words, langs = self.hashes
        h = langs[at]
        for j in range(n):
            h = mixed(h, words[at + j])
        return h >> np.uint64(1)

    def begins(self, n: int, known: list[Filter]) -> np.ndarray:
        """Where a phrase of n words begins of which no filter rules out a part."""
        at = np.arange(self.n)
        h = self.hashes[1] if known else np.zeros(self.n, np.uint64)
        able = np.zeros(self.n + 1, bool)
        for k in range(1, n + 1):
            if k > 1:
                good = able[at + 1] & ~self.last[at] if k == 2 else able[at + 1]
                at, h = at[good], h[good]
            if k <= len(known):
                h = mixed(h, self.hashes[0][at + k - 1])
                good = known[k - 1].has(h >> np.uint64(1))
                at, h = at[good], h[good]
            able[:] = False
            able[at] = True
        return at

    def phrases(self, at: np.ndarray, n: int) -> pa.Array:
        """The n words from each place on."""
        return pc.binary_join_element_wise(*(self.names.take(pa.array(self.word[at + j])) for j in range(n)), b" ")

    def counts(self, at: np.ndarray, n: int, times: np.ndarray | None = None) -> tuple[pa.Array, pa.Array, pa.Array]:
        """lang, phrase and number of the different phrases of n words that begin at some places, which count once or so many times.

        Phrases are numbered word by word, and numbers made dense before they could overflow, so that equal numbers are equal phrases.
        """
        number = self.lang[at]
        for j in range(n):
            if len(number) and int(number.max()) >= (1 << 62) // len(self.names):
                number = np.unique(number, return_inverse=True)[1]
            number = number * len(self.names) + self.word[at + j]
        order = np.argsort(number)
        number = number[order]
        heads = np.flatnonzero(np.diff(number, prepend=-1))
        if times is None:
            sums = np.diff(heads, append=len(order))
        else:
            sums = np.add.reduceat(times[order], heads) if len(heads) else np.zeros(0, np.int64)
        first = at[order[heads]]
        return self.langs.take(pa.array(self.lang[first])), self.phrases(first, n), pa.array(sums)

    def stretches(self, joined: np.ndarray, alone: bool, stretch: int, over: int) -> tuple[pa.Array, pa.Array, pa.Array, pa.Array]:
        """lang, starts, piece and number of the different stretches of the texts. A word that isn't joined with the next ends a piece; words joined with none are left out unless alone."""
        keep = joined | np.concatenate(([alone], joined[:-1]))[: self.n] | alone
        before = np.concatenate(([0], np.cumsum(keep)))[self.before]
        sizes = np.diff(before)
        parts = -(-sizes // stretch)
        skipped = counting(parts) * stretch
        left, heads = np.repeat(sizes, parts) - skipped, np.repeat(before[:-1], parts) + skipped
        own = np.minimum(left, stretch + over)
        kept = np.flatnonzero(keep)[np.repeat(heads, own) + counting(own)]
        # Each word with what follows it, so that pieces are cut from the words' bytes by offsets.
        names = pa.concat_arrays([pc.binary_join_element_wise(self.names, pa.scalar(end, pa.binary()), pa.scalar(b"", pa.binary())) for end in (b" ", b"\n")])
        words = names.take(pa.array(self.word[kept] + len(self.names) * ~joined[kept]))
        _, offsets, data = words.buffers()
        offsets = np.frombuffer(offsets, np.int32)[: len(words) + 1] if len(words) else np.zeros(1, np.int32)
        pieces = binaries(np.frombuffer(data or b"", np.uint8)[: offsets[-1]], offsets[np.concatenate(([0], np.cumsum(own)))])
        rows = pa.table({"lang": np.repeat(self.of_row, parts), "starts": np.minimum(left, stretch), "piece": pieces})
        found = rows.group_by(["lang", "starts", "piece"], use_threads=False).aggregate([([], "count_all")])
        lang, starts, piece, m = (plain(found[c]) for c in ("lang", "starts", "piece", "count_all"))
        return self.langs.take(lang), starts, piece, m


def plain(column: pa.ChunkedArray) -> pa.Array:
    return pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)


def counted_rows(lang: pa.Array, starts: np.ndarray, pieces: pa.Array, times: np.ndarray, n: int, known: list[Filter]) -> tuple[pa.Array, pa.Array, pa.Array]:
    """lang, phrase and number of the different phrases of n words in some pieces; those that a filter rules out are left out. For n of 1, the words of each language are told as the number of an empty phrase."""
    w = Words(lang, pieces)
    own = counting(w.each) < np.repeat(starts, w.each)
    at = w.begins(n, known)
    at, times = at[own[at]], np.repeat(times, w.each)
    found = w.counts(at, n, times[at])
    if n > 1:
        return found
    sums = np.zeros(len(w.langs), np.int64)
    np.add.at(sums, w.lang[at], times[at])
    none = pa.array([b""] * len(sums), pa.binary())
    return tuple(map(pa.concat_arrays, zip(found, (w.langs, none, pa.array(sums)), strict=True)))


def counted(lang: list[str], starts: list[int], pieces: list[bytes], times: list[int], n: int, known: list[Filter]) -> tuple[list, list, list]:
    """counted_rows of lists."""
    found = counted_rows(pa.array(lang, pa.string()), np.array(starts, np.int64), pa.array(pieces, pa.binary()), np.array(times, np.int64), n, known)
    return tuple(x.to_pylist() for x in found)


def spill_folder(shared: str) -> str:
    """Where a task's DuckDB spills: the shared folder if it is mounted, else the folder that Spark gave the executor; the task deletes it at its end."""
    where = urlparse(shared)
    local = where.path if where.scheme in ("", "file") and os.path.isdir(where.path) else SparkFiles.getRootDirectory()
    return os.path.join(local, f"duckdb-{uuid.uuid4().hex}")


def shorter(rows: pa.RecordBatch) -> pa.RecordBatch:
    """The rows with whole texts of more than LOT bytes cut at ends of pieces."""
    text = rows.column("piece")
    long = pc.and_(pc.greater(pc.binary_length(text), LOT), pc.equal(rows.column("starts"), WHOLE)).to_pylist()
    if not any(long):
        return rows
    which, parts = [], []
    for i, own in enumerate(text):
        raw, at = own.as_py(), 0
        while long[i] and len(raw) - at > LOT and (end := _END.search(raw, at + LOT)):
            parts.append(raw[at : end.end()])
            at = end.end()
        parts.append(raw[at:])
        which += [i] * (len(parts) - len(which))
    rows = rows.take(pa.array(which))
    return rows.set_column(rows.schema.get_field_index("piece"), "piece", pa.array(parts, pa.binary()))


def in_lots(it: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, np.ndarray, pa.Array, np.ndarray]]:
    """lang, starts, piece and m of about LOT bytes of pieces at a time."""

    def together(held: list[pa.RecordBatch]) -> tuple:
        lang, starts, piece, m = (pa.concat_arrays([b.column(c) for b in held]) for c in PIECE.names)
        return lang, starts.to_numpy().astype(np.int64), piece, m.to_numpy()

    held, size = [], 0
    for b in it:
        lengths = pc.sum(pc.binary_length(b.column("piece"))).as_py() or 0
        step = max(1, b.num_rows * (1 << 20) // (lengths + 1))
        for at in range(0, b.num_rows, step):
            own = shorter(b.slice(at, step))
            held.append(own)
            size += pc.sum(pc.binary_length(own.column("piece"))).as_py() or 0
            if size > LOT:
                yield together(held)
                held, size = [], 0
    if held:
        yield together(held)


PIECE = pa.schema([("lang", pa.string()), ("starts", pa.int32()), ("piece", pa.binary()), ("m", pa.int64())])
PIECES = "lang string, starts int, piece binary, m long"


def rows_of(columns: tuple, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c.cast(f.type) if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def whole(docs: DataFrame) -> DataFrame:
    """lang, starts, piece, m: the texts as they are; words are cut from them by the tasks that count."""
    text = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    return docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.lit(WHOLE).alias("starts"), text.alias("piece"), F.lit(1).cast("long").alias("m"))


def pieces_of(docs: DataFrame, how: Mining = Mining(), known: list[Filter] | None = None) -> DataFrame:
    """lang, starts, piece, m: the stretches of texts, the words in them that phrases may begin with, and how often they occur; line ends are ends of pieces, and equal stretches that a task holds at once are one.

    If filters of words and pairs are given, texts shrink to the runs whose neighbouring words they let pass: frequent phrases of two words or more stand inside one.
    """
    known, stretch, over = known or [], STRETCH, how.longest - 1

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, _, text, _ in in_lots(it):
            w = Words(lang, text)
            joined = ~w.last
            if known:
                joined[:] = False
                joined[w.begins(2, known)] = True
            yield rows_of(w.stretches(joined, not known, stretch, over), PIECE)

    return whole(docs).mapInArrow(run, PIECES)


def frequent_buckets(texts: DataFrame, known: list[Filter], how: Mining) -> DataFrame:
    """block, bits: which buckets of the hashes of pairs occur often enough, in blocks of 2^BLOCK; blocks without any are left out.

    Tasks send the numbers of a block's buckets as two arrays, cut off at how.least, where their sum is settled.
    """
    spark, per = texts.sparkSession, 1 << BLOCK
    number = np.min_scalar_type(how.least)
    sent_rows = pa.schema([("block", pa.int32()), ("bucket", pa.binary()), ("number", pa.binary())])
    kept_rows = pa.schema([("block", pa.int32()), ("bits", pa.binary())])

    def parts(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, _, text, _ in in_lots(it):
            w = Words(lang, text)
            bucket = np.sort((w.places(w.begins(2, known), 2) & np.uint64(how.bits - 1)).astype(np.uint32))
            heads = np.flatnonzero(np.diff(bucket.astype(np.int64), prepend=-1))
            many = np.minimum(np.diff(heads, append=len(bucket)), how.least).astype(number)
            bucket = bucket[heads]
            blocks, first = np.unique(bucket >> BLOCK, return_index=True)
            first = np.append(first, len(bucket))
            low = binaries((bucket & np.uint32(per - 1)).astype(np.uint16).view(np.uint8), first * 2)
            yield rows_of((blocks.astype(np.int32), low, binaries(many.view(np.uint8), first * number.itemsize)), sent_rows)

    def sums(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, total = None, np.zeros(per, np.int64)

        def told() -> Iterator[pa.RecordBatch]:
            bits = total >= how.least
            if bits.any():
                yield rows_of(([now], [np.packbits(bits, bitorder="little").tobytes()]), kept_rows)

        for b in it:
            for block, bucket, many in zip(*(b.column(c).to_pylist() for c in sent_rows.names), strict=True):
                if block != now:
                    yield from told()
                    now = block
                    total[:] = 0
                total[np.frombuffer(bucket, np.uint16)] += np.frombuffer(many, number)
        yield from told()

    sent = texts.mapInArrow(parts, "block int, bucket binary, number binary")
    return sent.repartition(partitions(spark), "block").sortWithinPartitions("block").mapInArrow(sums, "block int, bits binary")


def level(pieces: DataFrame, n: int, known: list[Filter], how: Mining = Mining()) -> DataFrame:
    """lang, phrase, f, h: the frequent phrases of n words. Level 1 also has the words of each language, as f of an empty phrase."""
    spark = pieces.sparkSession
    shared = shared_dir(spark)
    sent_rows = pa.schema([("lang", pa.string()), ("phrase", pa.binary()), ("m", pa.int64())])
    kept_rows = pa.schema([("lang", pa.string()), ("phrase", pa.binary()), ("f", pa.int64()), ("h", pa.int64())])

    def parts(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lot in in_lots(it):
            yield rows_of(counted_rows(*lot, n, known), sent_rows)

    def sums(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spill = spill_folder(shared)
        db = duckdb.connect(":memory:", config={"memory_limit": how.memory, "threads": 1, "temp_directory": spill, "preserve_insertion_order": False})
        try:
            db.execute("CREATE TABLE part (lang VARCHAR, phrase BLOB, m BIGINT)")
            for b in it:
                if b.num_rows:
                    db.register("arrived", pa.Table.from_batches([b]))
                    db.execute("INSERT INTO part FROM arrived")
                    db.unregister("arrived")
            found = db.execute("SELECT lang, phrase, CAST(sum(m) AS BIGINT) AS f FROM part GROUP BY lang, phrase HAVING sum(m) >= ? OR phrase = ''::BLOB", [how.least])
            while rows := found.fetchmany(10_000):
                lang, phrase, f = zip(*rows, strict=True)
                yield rows_of((lang, phrase, f, [*map(place_of, lang, phrase)]), kept_rows)
        finally:
            db.close()
            shutil.rmtree(spill, ignore_errors=True)

    sent = pieces.mapInArrow(parts, "lang string, phrase binary, m long")
    return sent.repartition(partitions(spark), "lang", "phrase").mapInArrow(sums, "lang string, phrase binary, f long, h long")


def frequent(docs: DataFrame, how: Mining = Mining()) -> tuple[DataFrame, DataFrame]:
    """lang, size, phrase, f of the frequent phrases of all levels, and lang, n: all words of each language. From two words on, only runs of pairs that may be frequent are looked at."""
    texts = whole(docs)
    found = written(level(texts, 1, [], how), "phrases-1")
    none = F.octet_length("phrase") == 0
    totals, found = found.where(none).select("lang", F.col("f").alias("n")), found.where(~none)
    out, known, own = None, [], None
    for n in range(1, how.longest + 1):
        if n == 2:
            own = written(pieces_of(docs, how, [*known, Filter.of_buckets(texts, known, how)]), "runs")
        if n > 1:
            found = written(level(own, n, known, how), f"phrases-{n}")
        rows = found.select("lang", F.lit(n).alias("size"), F.col("phrase").cast("string").alias("phrase"), "f")
        out = rows if out is None else out.unionByName(rows)
        if n < how.longest:
            if found.isEmpty():
                break
            known.append(Filter.of(found, how))
    counts = written(out, "phrases")
    if own is not None:
        done_with(own)
    return counts, totals


def cuts(counts: DataFrame) -> DataFrame:
    """lang, phrase, k, a, l, r: the counts of both parts of every phrase of two words or more, cut after its first k."""
    part = lambda k, side, start, n: F.struct(k.alias("k"), F.lit(side).alias("side"), F.array_join(F.slice("w", start, n), " ").alias("part"), n.alias("part_size"))
    both = lambda k: F.array(part(k, "l", F.lit(1), k), part(k, "r", k + 1, F.col("size") - k))
    asked = F.flatten(F.transform(F.sequence(F.lit(1), F.col("size") - 1), both))
    phrases = counts.where("size > 1").withColumn("w", F.split("phrase", " "))
    requests = phrases.select("lang", "phrase", F.col("f").alias("a"), F.explode(asked).alias("q")).select("lang", "phrase", "a", "q.*")
    requests = requests.withColumn("salt", F.when(F.col("part_size") == 1, F.pmod(F.xxhash64("phrase"), F.lit(SALTS))).otherwise(F.lit(0)).cast("int"))
    salts = F.when(F.col("size") == 1, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    answers = counts.select("lang", F.col("phrase").alias("part"), "f", F.explode(salts).alias("salt"))
    met = requests.join(answers.hint("shuffle_merge"), ["lang", "part", "salt"])
    of = lambda side: F.max(F.when(F.col("side") == side, F.col("f"))).alias(side)
    return met.groupBy("lang", "phrase", "k").agg(F.max("a").alias("a"), of("l"), of("r"))


def covered(counts: DataFrame) -> DataFrame:
    """lang, phrase, most: the phrases of two words or more that stand inside longer frequent ones, and the highest count of these."""
    inside = lambda n: F.transform(F.sequence(F.lit(1), F.col("size") - n + 1), lambda i: F.array_join(F.slice("w", i, n), " "))
    inner = F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(2), F.col("size") - 1), inside)))
    longer = counts.where("size > 2").withColumn("w", F.split("phrase", " "))
    return longer.select("lang", "f", F.explode(inner).alias("phrase")).groupBy("lang", "phrase").agg(F.max("f").alias("most"))


def collocations(docs: DataFrame, how: Mining = Mining()) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's first phrases by score, count and phrase.

    Products are taken as decimals of 38 digits. A score is at most 1000 n / a, as
    no part is rarer than the phrase, so that it is a long.
    """
    counts, totals = frequent(docs.select("lang", "text"), how)
    parts = cuts(counts).join(totals, "lang")
    big = lambda c: F.col(c).cast("decimal(38,0)")
    score = F.expr("CAST(1000 AS DECIMAL(38,0)) * CAST(a AS DECIMAL(20,0)) * CAST(n AS DECIMAL(20,0)) div (CAST(l AS DECIMAL(20,0)) * CAST(r AS DECIMAL(20,0)))")
    best = parts.withColumn("score", score).groupBy("lang", "phrase").agg(F.max("a").alias("a"), F.max("n").alias("n"), F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    best = best.join(covered(counts), ["lang", "phrase"], "left").where("most is null or most < a")
    rows = best.select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score")
    order = F.desc("score"), F.desc("a"), F.asc("phrase")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(*order))
    part = F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))
    few = rows.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(PARTS))).withColumn("place", part).where(F.col("place") <= how.first)
    return few.withColumn("rank", rank.cast("long")).where(F.col("rank") <= how.first).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
