"""Document fingerprints by invertible Bloom lookup sketches, in DataFrame operations.

A text is cut into paragraph pieces, and every distinct piece has a 64-bit digest.
Pieces end with a line, and at sentence ends that their last letter chooses, so that
an edit changes the pieces that it touches and no others. Short texts may be one piece,
so pairs of neighbouring words are pieces of theirs, too: those that a hash chooses, one in
so many more the longer the text is. What a longer text chooses a shorter one does as
well, so an edit that shortens a text leaves pieces in common. A sketch has three tables
of cells; a digest is counted and XORed, with a check of itself, into one cell of
each. A text's fingerprint is its sketch of CELLS cells a table, whatever its length.

Two versions are compared by their fingerprints: cells are subtracted, and what
remains holds the digests that differ. A cell of one digest gives it away, which is
taken out of its other cells, and so on. Pairs whose fingerprints don't come apart
differ in more digests than that; both texts are sketched again with GROWTH times as
many cells, until they do. So cells grow with the difference and not with the texts.

A peeling step looks at one table, where a digest has one cell, so that none is
taken out twice. Cells are rows, partitioned by document, and steps need no shuffle.

Defined cases: null text is empty; the next document is that of the next smaller
doc_id (null last, then the hash of the text), and of repeated rows each is
followed by its twin; one document is its own next. Two texts without pieces have
a likeness of 1. A very long text has more digests, and a larger sketch only where it
differs in many. An empty table gives no row; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded, partitions, ranged, written

#: Where pieces part: at line ends, and at sentence ends after some letters.
PARTS = r"\n|(?<=[a-m][.!?])\s+|(?<=[。！？])"
#: Words of pairs; a letter of scripts without blanks is one.
WORDS = r"\s+|(?<=[\u3040-\u30ff\u4e00-\u9fff])"
#: Characters of the longest text that has pairs, and of the longest that has all of its pairs.
SHORT, WHOLE = 1600, 64
TABLES = 3
#: Cells of a table of the fingerprint; larger sketches have GROWTH times as many, again and again.
CELLS, GROWTH = 16, 4
#: Times that each table is looked at.
ROUNDS = 4


def pairs(text: Column) -> Column:
    """The digests of neighbouring words of a short text whose low bits are 0: none up to WHOLE characters, one more for each doubling. The last word has none behind it."""
    n, mask = F.length(text), F.lit(0)
    for bit in range((SHORT // WHOLE).bit_length()):
        mask = F.when(n > WHOLE << bit, (2 << bit) - 1).otherwise(mask)
    words = F.filter(F.split(text, WORDS), lambda w: w != "")
    met = lambda x: F.filter(F.zip_with(x["w"], F.slice(x["w"], F.lit(2), F.size(x["w"])), lambda a, b: F.xxhash64(a, b)), lambda h: h.bitwiseAND(x["mask"]) == 0)
    # An array of one, so that words and mask are made once for each text and not for each word.
    return F.transform(F.array(F.struct(words.alias("w"), mask.cast("bigint").alias("mask"))), met)[0]


def digests(text: Column) -> Column:
    """The distinct digests of a text's pieces and, if it is short, of its pairs."""
    pieces = F.filter(F.transform(F.split(text, PARTS), lambda p: F.trim(p)), lambda p: p != "")
    short = F.when(F.length(text) <= SHORT, pairs(text)).otherwise(F.array().cast("array<bigint>"))
    return F.array_distinct(F.concat(F.transform(pieces, lambda p: F.xxhash64(p)), short))


def check(digest: Column) -> Column:
    return F.xxhash64(digest, F.lit("check")).bitwiseAND(F.lit(0xFFFFFFFF))


def place(digest: Column, table: int, cells: Column) -> Column:
    return F.pmod(F.xxhash64(digest, F.lit(table), cells), cells).cast("int")


def put(each: DataFrame, key: list[str], size: Column) -> DataFrame:
    """key, t, at, n, k, c: the cells that digests (key, n, k) make, each put into one cell of every table; empty cells have no row."""
    to = F.explode(F.array(*(F.struct(F.lit(t).alias("t"), place(F.col("k"), t, size).cast("long").alias("at")) for t in range(TABLES)))).alias("p")
    tabled = each.withColumn("c", check(F.col("k"))).select(*key, "n", "k", "c", to).select(*key, "p.t", "p.at", "n", "k", "c")
    return summed(tabled, key)


def summed(cells: DataFrame, key: list[str]) -> DataFrame:
    """Cells of one place added: their counts summed, the rest XORed."""
    return cells.groupBy(*key, "t", "at").agg(F.sum("n").alias("n"), F.bit_xor("k").alias("k"), F.bit_xor("c").alias("c")).where("n != 0 or k != 0 or c != 0")


def sketches(met: DataFrame) -> DataFrame:
    """row and the fingerprints own, edited, next: arrays of the cells (t, at, n, k, c) that hold something, in order; written. A row without any digest isn't there."""
    told = lambda v, c: F.transform(c, lambda k: F.struct(F.lit(v).alias("v"), k.alias("k")))
    each = met.select("row", *VERSIONS).repartition(partitions(met.sparkSession), "row").select("row", F.explode(F.concat(*(told(v, c) for v, c in enumerate(VERSIONS)))).alias("x"))
    cells = put(each.select("row", "x.v", "x.k", F.lit(1).cast("long").alias("n")), ["row", "v"], F.lit(CELLS))
    cell = F.struct("t", "at", "n", "k", "c")
    return written(cells.groupBy("row").agg(*(F.sort_array(F.collect_list(F.when(F.col("v") == v, cell))).alias(c) for v, c in enumerate(VERSIONS))), "sketches")


def subtracted(prints: DataFrame) -> DataFrame:
    """row, pair, size, t, at, n, k, c: the fingerprints own less edited (pair 0) and own less next (pair 1), without cells that are empty then."""
    signed = lambda pair, c, sign: F.transform(c, lambda x: F.struct(F.lit(pair).alias("pair"), x["t"].alias("t"), x["at"].alias("at"), (x["n"] * sign).alias("n"), x["k"].alias("k"), x["c"].alias("c")))
    both = F.concat(*(signed(pair, c, sign) for pair, other in enumerate(VERSIONS[1:]) for c, sign in (("own", 1), (other, -1))))
    rows = prints.repartition(partitions(prints.sparkSession), "row").select("row", F.explode(both).alias("x")).select("row", "x.pair", F.lit(CELLS).alias("size"), "x.t", "x.at", "x.n", "x.k", "x.c")
    return summed(rows, ["row", "pair", "size"])


def encoded(cells: Column) -> Column:
    """n, k and c of all cells in hexadecimal; those that aren't there are zeros."""
    hexed = lambda x, n: F.lpad(F.hex(x), n, "0")
    at = lambda x: (x["t"] * CELLS + x["at"]).cast("int")
    add = lambda a, x: F.struct(F.concat(a["s"], F.repeat(F.lit("0" * 40), at(x) - a["i"]), hexed(x["n"], 16), hexed(x["k"], 16), hexed(x["c"], 8)).alias("s"), (at(x) + 1).alias("i"))
    filled = F.aggregate(cells, F.struct(F.lit("").alias("s"), F.lit(0).alias("i")), add)["s"]
    return F.lower(F.rpad(F.coalesce(filled, F.lit("")), 40 * CELLS * TABLES, "0"))


def neighbours(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256 and the digests of the text, of its edited text and of the next text, a row for each document."""
    base = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).select("doc_id", F.coalesce("doc_id", F.lit(0)).cast("long").alias("kd"), F.xxhash64(F.col("doc_id").isNull(), "text").alias("kh"), "text")
    keys = base.groupBy("doc_id", "kd", "kh").agg(F.count("*").alias("copies"), F.max(F.length("text")).alias("n"))
    order = F.col("doc_id").desc_nulls_last(), F.col("kh")
    parts = ranged(keys, *order, name="keys")
    w = Window.partitionBy("_part").orderBy(*order)
    key = F.struct("kd", "kh", "n")
    lasts = parts.groupBy("_part").agg(F.min_by(key, F.struct(F.col("doc_id").isNotNull(), "doc_id", -F.col("kh").cast("decimal(20,0)"))).alias("last"))
    all_parts = Window.orderBy("_part")
    before = F.coalesce(F.lag("last").over(all_parts), F.last("last").over(all_parts.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    lasts = F.broadcast(lasts.select("_part", before.alias("before")))
    chain = parts.withColumn("prev", F.lag(key).over(w)).join(lasts, "_part").select("doc_id", "kd", "kh", "copies", F.coalesce("prev", "before").alias("prev"))

    rows = base.select("kd", "kh", "text").repartition(partitions(docs.sparkSession), "kd", "kh")
    rows = rows.withColumn("at", F.row_number().over(Window.partitionBy("kd", "kh").orderBy("kh"))).join(chain, ["kd", "kh"])
    half = lambda n: F.floor(n / 2).cast("int")
    sent = rows.where("at = 1").select(F.col("prev.kd").alias("kd"), F.col("prev.kh").alias("kh"), F.substring("text", F.lit(1), half(F.col("prev.n"))).alias("first"), digests(F.col("text")).alias("theirs"))
    own = rows.select("doc_id", "kd", "kh", "text", "at", "copies", F.length("text").cast("long").alias("n_chars"), digests(F.col("text")).alias("own"))
    met = own.join(sent, ["kd", "kh"])
    twin = F.col("at") < F.col("copies")
    tail = F.when(twin, F.substring("text", F.lit(1), half(F.col("n_chars")))).otherwise(F.col("first"))
    edited = F.concat(F.substring("text", F.lit(1), (F.col("n_chars") - half(F.col("n_chars"))).cast("int")), tail)
    return met.select("doc_id", "n_chars", "own", F.when(twin, F.col("own")).otherwise(F.col("theirs")).alias("next"), edited.alias("edited")).select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "own", digests(F.col("edited")).alias("edited"), "next"
    )


def peeled(cells: DataFrame) -> DataFrame:
    """row, pair, size, only_left, only_right, stuck from the subtracted cells (row, pair, size, t, at, n, k, c) of partitions by row."""
    key = ["row", "pair", "size"]
    cell = lambda t, at, n: F.struct(F.lit(t).alias("t"), at.alias("at"), n.alias("n"), F.col("k").alias("k"), F.col("c").alias("c"))
    same = F.struct("t", "at", "n", "k", "c")
    now = cells
    for step in range(ROUNDS * TABLES):
        t = step % TABLES
        pure = (F.col("t") == t) & (F.abs("n") == 1) & (F.col("c") == check(F.col("k"))) & (F.col("at") == place(F.col("k"), t, F.col("size")))
        out = [cell(TABLES, F.col("k"), F.col("n")), *(cell(o, place(F.col("k"), o, F.col("size")).cast("long"), -F.col("n")) for o in range(TABLES) if o != t)]
        now = now.select(*key, F.explode(F.when(pure, F.array(*out)).otherwise(F.array(same))).alias("x")).select(*key, "x.*")
        now = summed(now, key)
    done = F.col("t") == TABLES
    return now.groupBy(*key).agg(F.count_if(done & (F.col("n") > 0)).alias("only_left"), F.count_if(done & (F.col("n") < 0)).alias("only_right"), F.count_if(~done).alias("stuck"))


def sketched_again(pairs: DataFrame) -> DataFrame:
    """The subtracted cells of larger sketches, of the size that each pair (row, pair, size, left, right) names.

    Each digest is a row that is put into its cells: 1 for one of left, -1 for one of right.
    """
    key = ["row", "pair", "size"]
    signed = lambda side, n: F.transform(side, lambda k: F.struct(k.alias("k"), F.lit(n).cast("long").alias("n")))
    each = pairs.select(*key, F.explode(F.concat(signed("left", 1), signed("right", -1))).alias("x")).select(*key, "x.*")
    return put(each, key, F.col("size"))


def differences(met: DataFrame, prints: DataFrame) -> DataFrame:
    """row, pair, size, only_left, only_right for the pairs (own, edited) and (own, next) that differ; both are written tables."""
    n = partitions(met.sparkSession)
    found = written(peeled(subtracted(prints)), "peeled")
    done = found.where("stuck = 0")
    while not (stuck := found.where("stuck > 0").select("row", "pair", (F.col("size") * GROWTH).alias("size"))).isEmpty():
        again = met.select("row", *VERSIONS).join(bounded(stuck), "row").repartition(n, "row")
        other = F.when(F.col("pair") == 0, F.col("edited")).otherwise(F.col("next"))
        found = written(peeled(sketched_again(again.select("row", "pair", "size", F.col("own").alias("left"), other.alias("right")))), "peeled")
        done = done.unionByName(found.where("stuck = 0"))
    return done.drop("stuck")


VERSIONS = ("own", "edited", "next")


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, cells_edited, cells_next.

    A likeness is the share of common digests in all digests of two texts, from
    their numbers and the digests that peeling recovers. A fingerprint is n, k and c
    of all cells in hexadecimal. The last two columns are the cells of a table that
    each comparison took: CELLS where the fingerprints sufficed.
    """
    met = written(neighbours(docs).withColumn("row", F.monotonically_increasing_id()), "digests")
    prints = sketches(met)
    pair = lambda k, c: F.max(F.when(F.col("pair") == k, F.col(c)))
    found = differences(met, prints).groupBy("row").agg(*(pair(k, c).alias(f"{c}_{k}") for k in (0, 1) for c in ("only_left", "only_right", "size")))

    def near(k: int, c: str) -> Column:
        differ = F.coalesce(f"only_left_{k}", F.lit(0)) + F.coalesce(f"only_right_{k}", F.lit(0))
        common = (F.size("own") + F.size(c) - differ) / 2
        return F.when(common + differ == 0, 1.0).otherwise(common / (common + differ))

    shown = prints.select("row", *(encoded(F.col(c)).alias(f"print_{c}") for c in VERSIONS[:2]))
    out = met.join(found, "row", "left").join(shown, "row", "left")
    nothing = F.lit("0" * 40 * CELLS * TABLES)
    cells = lambda k: F.coalesce(f"size_{k}", F.lit(CELLS)).cast("long")
    return out.select(
        "doc_id", "n_chars", "edited_sha256", F.coalesce("print_own", nothing).alias("fingerprint"), F.coalesce("print_edited", nothing).alias("edited_fingerprint"),
        near(0, "edited").alias("near_edited"), near(1, "next").alias("near_next"), cells(0).alias("cells_edited"), cells(1).alias("cells_next"),
    )
