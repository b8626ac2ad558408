"""Token ids as directly addressable codes.

A file holds the ids of consecutive documents. Every id is cut into bytes, low
byte first; level k has byte k of the ids that reach it. A level's continuation
bitmap tells which of them go on, and its rank directory has the ones before every
512th bit, so that token i is found with one rank per level, without decoding others.

    magic | u64 header length | JSON header | document ids | document lengths | levels

Defined cases: a null text is an empty text, which has the end id only; documents
come in ascending order of doc_id, null first, and of text where ids repeat; an
empty table writes no file and reads back as no row. Further columns are ignored.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.storage import write_file
from .common import bounded, partitions, written

MAGIC = b"GLDAC001"
BLOCK = 512
#: Tokens after which a file is closed at the next document.
FILE_TOKENS = 1 << 22
#: Characters after which texts are encoded together.
SLICE = 2 << 20
NO_ID = -(1 << 63)
_POPULATION = np.array([bin(i).count("1") for i in range(256)], np.uint8)


def encode(ids: np.ndarray, doc_ids: list[int | None], lengths: list[int]) -> bytes:
    """A file of uint32 ids of documents of the given lengths."""
    parts, levels, at = [], [], 0

    def put(x: np.ndarray) -> int:
        nonlocal at
        data = x.tobytes()
        data += bytes(-len(data) % 8)
        parts.append(data)
        at += len(data)
        return at - len(data)

    docs = put(np.array([NO_ID if d is None else d for d in doc_ids], "<i8")), put(np.array(lengths, "<i8"))
    rest = ids.astype("<u4")
    while len(rest):
        more = rest > 255
        bits = np.packbits(more, bitorder="little")
        ones = np.concatenate(([0], np.cumsum(more, dtype=np.int64)))[: len(rest) : BLOCK]
        levels.append({"n": len(rest), "bytes": put((rest & 255).astype(np.uint8)), "more": put(bits), "ranks": put(ones.astype("<u4"))})
        rest = rest[more] >> 8
    head = json.dumps({"n": int(len(ids)), "docs": len(doc_ids), "doc_ids": docs[0], "lengths": docs[1], "levels": levels}).encode()
    return MAGIC + len(head).to_bytes(8, "little") + head + b"".join(parts)


class Codes:
    """Access to a file's bytes; a memory map serves as well."""

    def __init__(self, data: bytes | memoryview) -> None:
        view = memoryview(data)
        if bytes(view[:8]) != MAGIC:
            raise ValueError("not a file of directly addressable codes")
        size = int.from_bytes(view[8:16], "little")
        self.head, self.body = json.loads(bytes(view[16 : 16 + size])), view[16 + size :]

    def array(self, at: int, n: int, kind: str) -> np.ndarray:
        return np.frombuffer(self.body, kind, n, at)

    def documents(self) -> tuple[np.ndarray, np.ndarray]:
        h = self.head
        return self.array(h["doc_ids"], h["docs"], "<i8"), self.array(h["lengths"], h["docs"], "<i8")

    def __len__(self) -> int:
        return self.head["n"]

    def __getitem__(self, i: int) -> int:
        """Token i: one byte, one bit and one rank for each level that it has."""
        if not 0 <= i < len(self):
            raise IndexError(i)
        value, shift = 0, 0
        for level in self.head["levels"]:
            value |= self.body[level["bytes"] + i] << shift
            if not self.body[level["more"] + i // 8] >> (i % 8) & 1:
                break
            block = i // BLOCK
            bits = self.array(level["more"] + block * BLOCK // 8, i // 8 - block * BLOCK // 8 + 1, np.uint8)
            ones = int(_POPULATION[bits[:-1]].sum()) + (int(bits[-1]) & ((1 << i % 8) - 1)).bit_count()
            i = int(self.array(level["ranks"] + 4 * block, 1, "<u4")[0]) + ones
            shift += 8
        return value

    def decode(self) -> np.ndarray:
        """All ids as uint32."""
        below = None
        for level in reversed(self.head["levels"]):
            here = self.array(level["bytes"], level["n"], np.uint8).astype("<u4")
            if below is not None:
                more = np.unpackbits(self.array(level["more"], -(-level["n"] // 8), np.uint8), count=level["n"], bitorder="little").astype(bool)
                here[more] |= below << 8
            below = here
        return np.zeros(0, "<u4") if below is None else below


#: Marks that end a word of letters are a token of their own.
_CLOSING = re.compile(r"(?<=[a-zß-öø-ÿ])[.,!?;:%#&*$@()+=~^/-]+(?=\s|$)")
_LETTERS = re.compile("[a-zß-öø-ÿ]+")


class Words:
    """Ids of whole texts by a tokenizer that lower-cases and drops white space, so that words can be encoded once.

    Texts of Latin-1 characters are lower-cased and their closing marks parted first,
    which the tokenizer would do itself; composition can't change such texts. Words of
    small Latin-1 letters only are in their normal form and are one piece each, so that
    the model encodes them without those two steps, with a mark between them. The four
    separators \\x1c-\\x1f part words for str.split but not for the tokenizer; texts with
    them, words of over LONG characters, and texts where lower-casing makes or breaks an
    added token, which is matched in raw text, are encoded as they stand.
    """

    LONG, KNOWN, AT_ONCE, MARK = 48, 500_000, 4000, "!"

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.letters = Tokenizer(self.tokenizer.model)  # the same model, held once
        self.letters.normalizer = normalizers.Sequence([])
        self.letters.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.mark = self.letters.encode(self.MARK, add_special_tokens=False).ids
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values() if not t.normalized]
        self.known: dict[str, bytes] = {}

    def plain(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def learn(self, words: list[str]) -> dict[str, bytes]:
        out: dict[str, bytes] = {}
        plain, other = [], []
        for w in words:
            (plain if _LETTERS.fullmatch(w) else other).append(w)
        for k in range(0, len(plain), self.AT_ONCE):
            some = plain[k : k + self.AT_ONCE]
            got = self.letters.encode_batch_fast([f" {self.MARK} ".join([*some, ""])], add_special_tokens=False)[0]
            ids = np.array(got.ids, "<u4")
            ends = np.flatnonzero(ids == self.mark[0])
            data, ends = ids.tobytes(), (4 * ends).tolist()
            out.update((w, data[a:b]) for w, a, b in zip(some, [0, *(e + 4 for e in ends)], ends, strict=False))
        words = other
        for k in range(0, len(words), self.AT_ONCE):
            some = words[k : k + self.AT_ONCE]
            got = self.tokenizer.encode(" ".join(some), add_special_tokens=False)
            ends = np.cumsum(np.fromiter(map(len, some), np.int64, len(some)) + 1)
            starts = np.array([a for a, _ in got.offsets], np.int64)
            cut = [0, *np.searchsorted(starts, ends).tolist()]
            ids = np.array(got.ids, "<u4").tobytes()
            out.update((w, ids[4 * a : 4 * b]) for w, a, b in zip(some, cut[:-1], cut[1:], strict=True))
        return out

    def split(self, text: str) -> list[str] | None:
        if any(c in text for c in "\x1c\x1d\x1e\x1f"):
            return None
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return text.split()
        lowered = text.lower()
        if any(lowered.count(t) != text.count(t) for t in self.added):
            return None
        return _CLOSING.sub(r" \g<0>", lowered).split()

    def ids(self, texts: list[str]) -> list[bytes]:
        split = [self.split(t) for t in texts]
        seen: set[str] = set().union(*filter(None, split))
        new = self.learn([w for w in seen - self.known.keys() if len(w) <= self.LONG])
        if len(self.known) + len(new) <= self.KNOWN:  # frequent words come early; beyond the bound words are learned for these texts only
            self.known.update(new)
            new = {}
        get, out = self.known.get, []
        for t, words in zip(texts, split, strict=True):
            if words is None:
                out.append(self.plain(t))
                continue
            found = list(map(get, words))
            if None in found:
                found = [(new.get(w) or self.plain(w)) if x is None else x for w, x in zip(words, found, strict=True)]
            out.append(b"".join(found))
        return out


@lru_cache(maxsize=2)
def words_of(path: str) -> Words:
    """One for each Python worker, whose tasks share what it has learned."""
    return Words(path)


def write(docs: DataFrame, folder: str, tokenizer: str, end: int = 2, file_tokens: int = FILE_TOKENS) -> DataFrame:
    """Writes docs into folder in order of doc_id; returns part, seq, docs, tokens of its files, a written table."""
    schema = "part long, seq long, docs long, tokens long"

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq = TaskContext.get().partitionId(), 0
        ids, names, lengths, held = [], [], [], 0
        last = np.array([end], "<u4").tobytes()

        def flush() -> pa.RecordBatch:
            write_file(folder, f"part-{part:08d}-{seq:06d}.dac", encode(np.frombuffer(b"".join(ids), "<u4"), names, lengths))
            return pa.RecordBatch.from_pydict({"part": [part], "seq": [seq], "docs": [len(names)], "tokens": [held]})

        def slices(b: pa.RecordBatch) -> Iterator[tuple[list, list[str]]]:
            names, texts, size = [], [], 0
            for d, t in zip(b.column("doc_id").to_pylist(), b.column("text"), strict=True):
                names.append(d)
                texts.append(t.as_py() or "")
                size += len(texts[-1])
                if size >= SLICE:
                    yield names, texts
                    names, texts, size = [], [], 0
            yield names, texts

        for b in it:
            for some, texts in slices(b):
                for d, x in zip(some, words_of(tokenizer).ids(texts), strict=True):
                    ids += [x, last]
                    names.append(d)
                    lengths.append(len(x) // 4 + 1)
                    held += lengths[-1]
                    if held >= file_tokens:
                        yield flush()
                        seq += 1
                        ids, names, lengths, held = [], [], [], 0
        if names:
            yield flush()

    spread = F.xxhash64("text")
    ordered = docs.select("doc_id", "text").repartitionByRange(partitions(docs.sparkSession), "doc_id", spread).sortWithinPartitions("doc_id", spread, "text")
    return written(ordered.mapInArrow(run, schema), "dac-files")


def read(spark: SparkSession, folder: str, files: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document in the files."""
    sums = files.groupBy("part").agg(F.sum("tokens").alias("_sum"))
    before = sums.select("part", (F.sum("_sum").over(Window.orderBy("part")) - F.col("_sum")).alias("_before"))
    inside = Window.partitionBy("part").orderBy("seq")
    first = files.join(before, "part").select("part", "seq", (F.sum("tokens").over(inside) - F.col("tokens") + F.col("_before")).alias("first"))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for data, at in zip(b.column("content"), b.column("first").to_pylist(), strict=True):
                codes = Codes(data.as_buffer())
                doc_ids, lengths = codes.documents()
                ids, stops = codes.decode(), np.cumsum(lengths)
                starts = stops - lengths
                crc = [zlib.crc32(ids[i:j].tobytes()) for i, j in zip(starts.tolist(), stops.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(doc_ids, mask=doc_ids == NO_ID), pa.array(starts + at), pa.array(lengths), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    if files.isEmpty():
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long")
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.dac").load(folder)
    name = F.regexp_extract("path", r"part-(\d+)-(\d+)\.dac$", 1), F.regexp_extract("path", r"part-(\d+)-(\d+)\.dac$", 2)
    named = found.select(name[0].cast("long").alias("part"), name[1].cast("long").alias("seq"), "content")
    return named.join(bounded(first), ["part", "seq"]).select("content", "first").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
