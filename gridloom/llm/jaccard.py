"""N-gram Jaccard join: a blocked sparse product of the document by n-gram matrix.

Rows with equal sets are one class. The product of the matrix with its own
transpose counts the common columns of two classes; it is taken only where a link
is possible. Those places come from the rare columns: in one global order, rare
before frequent, linked sets of a similarity of t share a column among the first
n - ceil(t * n) + 1 of each, and sizes and places in the order bound what is left.
At each such place the product is summed over blocks of columns, of which every
class has its slices. After each block a pair goes whose count and remaining
columns can't reach the least overlap of sets of their sizes; after the last one
the count itself is the link.

The places are found in rounds. The first ones pair each column's entries with its
first one only; links found there join classes to components. The last pairs all
entries of different components. Entries of one component need no product, as its
classes are joined already, so a group of near copies costs as many products as it
has entries, not their square. A parity bitmap of each class, too, bounds counts
from above before sets are asked for.

Columns and classes are known by 64-bit hashes; counts and links are exact but for
two that collide. Texts are made into sets anew in four passes, as the sets of all
documents would take more disk than the texts.

Defined cases: null or blank texts have the empty set, link with nothing and are
their own component; repeated rows are copies of each other; a null doc_id is
never a component's smallest unless all ids in it are null; a very long text is a
larger set like any other; ties go by hash. Extra columns are ignored by `linked`
and kept by `one_of_each`. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import done_with, packed, written
from .components import components
from .shingles import mixed, shingle_sets


@dataclass(frozen=True)
class Join:
    """Links sets with 100 * overlap >= percent * union, of `words`-word shingles."""

    words: int = 4
    percent: int = 85
    #: A column in fewer documents counts as rare.
    frequent: int = 24
    #: Bytes of the table of frequencies that all tasks hold: each has the logarithm for the columns that fall on it.
    places: int = 1 << 24
    #: Numbers that one group counts; the groups grow with the corpus.
    group: int = 1 << 20
    #: Blocks of columns that products are summed over.
    blocks: int = 4
    #: Rounds of products with a column's first entry before those of all that is still apart.
    stars: int = 2
    #: Bits of the filter of documents whose sets are asked for, of each class that with the smallest key. More than fit only cost time.
    filter_bits: int = 1 << 25

    def least(self, n, m):
        """The least overlap of linked sets of n and m: percent / (100 + percent) of n + m, rounded up."""
        return -(-self.percent * (n + m) // (100 + self.percent))

    def prefix(self, n: int) -> int:
        return n - -(-self.percent * n // 100) + 1

    def shorter(self, n: int) -> int:
        """As prefix, for the smaller set of a pair: its partner is no smaller."""
        return n - self.least(n, n) + 1


def texts(b: pa.RecordBatch) -> Iterator[str | None]:
    return (t.as_py() for t in b.column("text"))


def set_class(s: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "little", signed=True)


def parities(s: np.ndarray) -> bytes:
    """256 bits; each is the parity of the members that fall on it. Differing bits of two never exceed differing members."""
    return np.packbits(np.bincount((mixed(s) >> np.uint64(56)).astype(np.int64), minlength=256) & 1).tobytes()


def _table(columns: list, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def sets_of(docs: DataFrame, join: Join) -> DataFrame:
    """key, n, cls, bits: size, class and bitmap of the set of each row (key, text)."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            rows = [(len(s), set_class(s), parities(s)) for s in shingle_sets(texts(b), join.words)]
            n, cls, bits = map(list, zip(*rows, strict=True)) if rows else ([], [], [])
            yield pa.RecordBatch.from_arrays([b.column("key"), pa.array(n, pa.int32()), pa.array(cls, pa.int64()), pa.array(bits, pa.binary())], ["key", "n", "cls", "bits"])

    schema = T.StructType([docs.schema["key"], T.StructField("n", T.IntegerType()), T.StructField("cls", T.LongType()), T.StructField("bits", T.BinaryType())])
    return docs.select("key", "text").mapInArrow(run, schema)


def place_of(s: np.ndarray, groups: int, places: int) -> np.ndarray:
    """Where a column's frequency stands in the table: by the bits that counting knows."""
    return (mixed(s & np.uint64((groups << 32) - 1)) & np.uint64(places - 1)).astype(np.int64)


def frequency_table(docs: DataFrame, join: Join, groups: int) -> bytes:
    """A byte for each place: 7 times the binary logarithm of the most frequent column on it, 0 for rare ones.

    Each task sends the shingles of its rows to groups as packed 32-bit numbers,
    repeated ones once with their count, and a group counts equal ones. Columns that
    collide in the bits sent, or on a place, only share a place in the order, which
    any order may have.
    """

    def pack(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush() -> Iterator[pa.RecordBatch]:
            x, n = np.unique(np.concatenate(held) & np.uint64((groups << 32) - 1), return_counts=True)
            cut = np.arange(groups + 1, dtype=np.uint64) << np.uint64(32)
            out = []
            for keep in (n == 1, n > 1):
                own = x[keep]
                at = np.searchsorted(own, cut)
                out.append((own.astype(np.uint32), n[keep].astype(np.uint32), at))
            (one, _, at), (more, times, to) = out
            full = np.flatnonzero(np.diff(at) + np.diff(to))
            cols = [[one[at[k] : at[k + 1]].tobytes() for k in full], [more[to[k] : to[k + 1]].tobytes() for k in full], [times[to[k] : to[k + 1]].tobytes() for k in full]]
            yield pa.RecordBatch.from_arrays([pa.array(full.astype(np.int32)), *(pa.array(c, pa.binary()) for c in cols)], ["g", "one", "more", "times"])

        held, size = [], 0
        for b in it:
            for s in shingle_sets(texts(b), join.words):
                held.append(s)
                size += len(s)
                if size > 1_500_000:
                    yield from flush()
                    held, size = [], 0
        if size:
            yield from flush()

    def count(key: tuple, it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        joined = {c: [] for c in ("one", "more", "times")}
        for b in it:
            for c, parts in joined.items():
                parts += [np.frombuffer(x.as_py(), np.uint32) for x in b.column(c)]
        one, more, times = (np.concatenate(p) for p in joined.values())
        values, at = np.unique(np.concatenate((one, more)), return_inverse=True)
        n = np.bincount(at, np.concatenate((np.ones(len(one)), times)), len(values))
        often = n >= join.frequent
        code = (np.uint64(key[0].as_py()) << np.uint64(32)) | values[often].astype(np.uint64)
        with np.errstate(over="ignore"):
            place = place_of(code, groups, join.places)
        level = np.minimum(255, np.round(7 * np.log2(n[often]))).astype(np.int32)
        yield pa.RecordBatch.from_arrays([pa.array((place >> 12).astype(np.int32)), pa.array((place & 4095).astype(np.int32)), pa.array(level)], ["chunk", "at", "level"])

    def chunk(key: tuple, it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(4096, np.uint8)
        for b in it:
            np.maximum.at(out, b.column("at").to_numpy(), b.column("level").to_numpy().astype(np.uint8))
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([out.tobytes()], pa.binary())], ["chunk", "levels"])

    packed = docs.select("text").mapInArrow(pack, "g int, one binary, more binary, times binary")
    counted = packed.groupBy("g").applyInArrow(count, "chunk int, at int, level int")
    got = counted.groupBy("chunk").applyInArrow(chunk, "chunk int, levels binary").toArrow()  # places / 4096 rows at most
    out = bytearray(join.places)
    for k, levels in zip(got.column("chunk").to_pylist(), got.column("levels").to_pylist(), strict=True):
        out[k << 12 : k + 1 << 12] = levels
    return bytes(out)


def prefixes(docs: DataFrame, join: Join, table: bytes, groups: int) -> DataFrame:
    """col, cls, n, at, head: the entries of each class's prefix; head: also in the shorter one. Copies in a task are sent once."""
    told = docs.sparkSession.sparkContext.broadcast(table)
    schema = pa.schema([("col", pa.int64()), ("cls", pa.int64()), ("n", pa.int32()), ("at", pa.int32()), ("head", pa.bool_())])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels = np.frombuffer(told.value, np.uint8)
        seen: set[int] = set()
        for b in it:
            out: list[list[np.ndarray]] = [[], [], [], [], []]
            for s in shingle_sets(texts(b), join.words):
                if not len(s) or (cls := set_class(s)) in seen:
                    continue
                if len(seen) < 200_000:
                    seen.add(cls)
                with np.errstate(over="ignore"):
                    rank = levels[place_of(s, groups, join.places)]
                p = join.prefix(len(s))
                order = np.lexsort((s, rank))[:p]
                for x, v in zip(out, (s[order].view(np.int64), np.full(p, cls), np.full(p, len(s)), np.arange(p), np.arange(p) < join.shorter(len(s))), strict=True):
                    x.append(v)
            if out[0]:
                yield _table([np.concatenate(x) for x in out], schema)

    return docs.select("text").mapInArrow(run, "col long, cls long, n int, at int, head boolean")


def bounds(x: str, y: str, percent: int) -> str:
    """SQL: whether entries of one column, x of the larger set, can belong to linked sets."""
    return f"{y}.n * 100 >= {percent} * {x}.n and {100 + percent} * (1 + least({x}.n - {x}.at, {y}.n - {y}.at) - 1) >= {percent} * ({x}.n + {y}.n)"


def slices(s: np.ndarray, blocks: int) -> list[np.ndarray]:
    """A sorted set's columns by blocks: equal stretches of the numbers that columns have."""
    cut = np.searchsorted(s, np.array([(k << 64) // blocks for k in range(1, blocks)], np.uint64))
    return np.split(s, cut)


def asked_sets(docs: DataFrame, pairs: DataFrame, join: Join) -> DataFrame:
    """cls and, for each block, its columns and how many columns come after it, of the classes in pairs; a written table."""
    asked = pairs.select(F.col("ax").alias("at")).unionByName(pairs.select(F.col("ay").alias("at")))
    filled = asked.groupBy(F.expr("int(at div 64)").alias("word")).agg(F.expr("bit_or(shiftleft(1L, int(at % 64)))").alias("bits")).toArrow()
    words = np.zeros(join.filter_bits // 64, np.int64)
    words[filled.column("word").to_numpy()] = filled.column("bits").to_numpy()
    told = docs.sparkSession.sparkContext.broadcast(words.tobytes())
    blocks = range(join.blocks)
    names = [f"m{k}" for k in blocks] + [f"r{k}" for k in blocks]

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked_bits = np.frombuffer(told.value, np.uint64)
        for b in it:
            k = b.column("at").to_numpy()
            b = b.filter(pa.array((asked_bits[k // 64] >> (k % 64).astype(np.uint64) & np.uint64(1)).astype(bool)))
            cls, members, rest = [], [[] for _ in blocks], [[] for _ in blocks]
            for s in shingle_sets(texts(b), join.words):
                if not len(s):
                    continue
                cls.append(set_class(s))
                left = len(s)
                for j, part in enumerate(slices(s, join.blocks)):
                    left -= len(part)
                    members[j].append(part.tobytes())
                    rest[j].append(left)
            yield pa.RecordBatch.from_arrays([pa.array(cls, pa.int64()), *(pa.array(m, pa.binary()) for m in members), *(pa.array(r, pa.int32()) for r in rest)], ["cls", *names])

    placed = docs.select("text", F.pmod(F.xxhash64("key"), F.lit(join.filter_bits)).cast("int").alias("at"))
    found = placed.mapInArrow(run, "cls long, " + ", ".join(f"{n} {'binary' if n[0] == 'm' else 'int'}" for n in names))
    return written(found.groupBy("cls").agg(*(F.any_value(n).alias(n) for n in names)), "sets")


def multiplied(pairs: DataFrame, sets: DataFrame, block: int, join: Join) -> DataFrame:
    """x, y, total, common: the pairs with the block's common columns added, without those that can't reach the least overlap."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            mx, my = b.column("mx"), b.column("my")
            more = np.fromiter((len(np.intersect1d(np.frombuffer(p.as_buffer(), np.uint64), np.frombuffer(q.as_buffer(), np.uint64), assume_unique=True)) for p, q in zip(mx, my, strict=True)), np.int64, b.num_rows)
            common, total = b.column("common").to_numpy() + more, b.column("total").to_numpy()
            most = common + np.minimum(b.column("rx").to_numpy(), b.column("ry").to_numpy())
            ok = (100 + join.percent) * most >= join.percent * total
            yield pa.RecordBatch.from_arrays([pa.array(b.column(c).to_numpy()[ok]) for c in ("x", "y", "total")] + [pa.array(common[ok])], ["x", "y", "total", "common"])

    own = lambda c: sets.select(F.col("cls").alias(c), F.col(f"m{block}").alias(f"m{c}"), F.col(f"r{block}").alias(f"r{c}"))
    return pairs.join(own("x"), "x").join(own("y"), "y").mapInArrow(run, "x long, y long, total long, common long")


def product(pairs: DataFrame, sets: DataFrame, docs: DataFrame, join: Join) -> DataFrame:
    """x, y, total, common of the pairs (x, y) of classes that are linked: their sizes' sum and the product, summed block by block."""
    at = F.pmod(F.xxhash64("first"), F.lit(join.filter_bits)).cast("int")
    own = sets.select("cls", "n", "bits", at)
    joined = pairs.join(own.toDF("x", "nx", "bx", "ax"), "x").join(own.toDF("y", "ny", "by", "ay"), "y")

    def bound(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            if not b.num_rows:
                continue
            bx, by = (np.frombuffer(b"".join(b.column(c).to_pylist()), np.uint64).reshape(-1, 4) for c in ("bx", "by"))
            total = b.column("nx").to_numpy().astype(np.int64) + b.column("ny").to_numpy()
            most = (total - np.bitwise_count(bx ^ by).sum(axis=1).astype(np.int64)) // 2
            ok = pa.array((100 + join.percent) * most >= join.percent * total)
            b = b.append_column("total", pa.array(total))
            yield b.select(["x", "y", "ax", "ay", "total"]).filter(ok)

    left = written(joined.mapInArrow(bound, "x long, y long, ax int, ay int, total long"), "pairs", pairs.count())
    members = asked_sets(docs, left, join)
    summed = left.select("x", "y", "total", F.lit(0).cast("long").alias("common"))
    for block in range(join.blocks):
        # Written, so that blocks follow each other with one Python worker a task, on the few pairs that are left.
        before, summed = summed, written(multiplied(summed, members, block, join), "summed", summed.count())
        if block:
            done_with(before)
    done_with(left, members)
    return summed


def stars(at: DataFrame, join: Join) -> DataFrame:
    """x, y: in each column, every component's first entry with the first entry of all.

    First is what stands earliest in its own prefix: few rare columns come before, so it
    differs little from what the column's documents have in common.
    """
    firsts = at.groupBy("col", "root").agg(F.min(F.struct("at", "n", "cls")).alias("o"))
    center = firsts.groupBy("col").agg(F.min("o").alias("c"))
    pairs = firsts.join(center, "col").where("o.cls != c.cls").where(bounds("o", "c", join.percent))
    return pairs.select(F.least("c.cls", "o.cls").alias("x"), F.greatest("c.cls", "o.cls").alias("y")).distinct()


def unjoined(shared: DataFrame, roots: DataFrame) -> DataFrame:
    """The entries, with their roots, of columns that several components share."""
    at = shared.join(roots.toDF("cls", "root"), "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    several = at.groupBy("col").agg(F.min("root").alias("a"), F.max("root").alias("b")).where("a < b").select("col")
    return written(at.join(several, "col"), "unjoined")


def joined(docs: DataFrame, join: Join) -> tuple[DataFrame, DataFrame]:
    """Of rows (key, text): key, n, cls of each; and cls, n, root, first of each class, with its component's and its own smallest key."""
    all_sets = written(sets_of(docs, join), "documents")
    sets = written(all_sets.where("n > 0").groupBy("cls", "n").agg(F.min("key").alias("first"), F.any_value("bits").alias("bits")), "classes")
    numbers = all_sets.agg(F.sum("n")).first()[0] or 0
    groups = 1 << max(6, (numbers // join.group).bit_length())

    entries = prefixes(docs, join, frequency_table(docs, join, groups), groups)
    # Most columns belong to one class: only the entries of the others are freed from copies and shuffled on.
    entries = written(entries, "entries")
    several = entries.groupBy("col").agg(F.min("cls").alias("a"), F.max("cls").alias("b"), F.max("head").alias("h")).where("a < b and h").select("col")
    shared = written(entries.join(several, "col").distinct(), "shared")
    done_with(entries)

    links, roots, at = None, None, shared.withColumn("root", F.col("cls"))
    for _ in range(join.stars):
        places = written(stars(at, join), "places")
        if places.isEmpty():
            break
        more = product(places, sets, docs, join)
        links = more if links is None else links.unionByName(more)
        roots = written(components(links), "roots")
        at = unjoined(shared, roots)
    e = F.struct("cls", "n", "at", "root")
    large, small = at.select("col", e.alias("p")), at.where("head").select("col", e.alias("q"))
    across = large.join(small, "col").where("p.root != q.root and (p.n > q.n or p.n = q.n and p.cls != q.cls)").where(bounds("p", "q", join.percent))
    places = written(across.select(F.least("p.cls", "q.cls").alias("x"), F.greatest("p.cls", "q.cls").alias("y")).distinct(), "places")
    if not places.isEmpty():
        more = product(places, sets, docs, join)
        roots = written(components(more if links is None else links.unionByName(more)), "roots")
    every = roots if roots is not None else shared.select("cls", F.col("cls").alias("root")).limit(0)
    named = sets.join(every.toDF("cls", "root"), "cls", "left").select("cls", "n", F.coalesce("root", "cls").alias("root"), "first")
    return all_sets.select("key", "n", "cls"), named


def linked(docs: DataFrame, join: Join = Join()) -> DataFrame:  # noqa: B008
    """doc_id, n_shingles, component_id for each document."""
    all_sets, named = joined(docs.select(F.col("doc_id").alias("key"), "text"), join)
    least = named.groupBy("root").agg(F.min("first").alias("component"))
    of_class = named.join(least, "root").select("cls", "n", "component")
    out = all_sets.join(of_class, ["cls", "n"], "left")
    return out.select(F.col("key").alias("doc_id"), F.col("n").cast("long").alias("n_shingles"), F.coalesce("component", "key").alias("component_id"))


def one_of_each(docs: DataFrame, join: Join = Join()) -> DataFrame:  # noqa: B008
    """The rows of docs, of each component only one, with all their columns.

    That is the row with the smallest doc_id, null last, then the smallest hash of
    the text, and any one of rows that agree in both. Texts without words all stay.
    """
    rows = packed(docs, "doc_id", "text").withColumn("key", F.struct(F.col("doc_id").isNull().alias("no"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("h")))
    _, named = joined(rows.select("key", "text"), join)
    first = named.groupBy("root").agg(F.min("first").alias("k")).select(*(F.col(f"k.{c}").alias(f"k_{c}") for c in ("no", "id", "h")))
    worded = F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    there = (F.col("key.h") == F.col("k_h")) & (F.col("key.no") == F.col("k_no")) & F.col("key.id").eqNullSafe(F.col("k_id"))
    met = rows.where(worded).join(first, there, "left_semi")
    one = met.withColumn("at", F.row_number().over(Window.partitionBy("key").orderBy("key"))).where("at = 1")
    return one.select("row").union(rows.where(~worded).select("row")).select("row.*")
