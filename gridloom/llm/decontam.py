"""Benchmark decontamination by a distributed positional inverted index, in DataFrame operations.

The index has a posting (term, row, pos) for every word of every document. It is
cut by document, so that it is built without a shuffle, and each part is sorted by
term, so that a scan for some terms skips the rest of it. A document's head is its
posting of the empty term: its number of words, its doc_id and a hash of its text.
One index serves any number of benchmarks.

From each window of a benchmark item the rarest terms by corpus frequency are
looked up. Their lists are intersected after each position is adjusted by the term's
offset in the item: terms of one occurrence agree on the diagonal pos - offset.
Along the diagonals that enough rare terms agree on, the postings of all of the
item's terms are met, and a run of them as long as a window is an exact phrase. A
proximity match has an item's rarest terms within a few diagonals of each other.

Defined cases: null or empty texts have no words and no hits, and an item without
words has no window; a repeated document row is judged like its twin; items that
share an id count once; a null item_id counts as the empty string; an empty
benchmark or corpus gives no hits; a very long text has more postings and is never
in one row. Terms of equal frequency go by their bytes. Further columns of docs are
kept by `decontaminated`, whose new columns stand behind them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded, packed, written

WINDOW = 10
#: Rarest terms of a window that must agree on a diagonal before the others are looked up.
RARE = 3


@dataclass(frozen=True)
class Near:
    """A proximity match: the `terms` rarest different terms of an item within `slop` diagonals of each other."""

    terms: int = 4
    slop: int = 5


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The ASCII characters that are in no word.
_GAPS = "".join(c for c in map(chr, range(128)) if not (c.isdigit() or c in _LOWER or c in _UPPER))


def words(text: Column) -> Column:
    """The words `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` of a lower-cased text: other characters become spaces, which are split at."""
    spaced = F.translate(text, _UPPER + _GAPS, _LOWER + " " * len(_GAPS))
    return F.coalesce(F.array_remove(F.split(spaced, " "), ""), F.array().cast("array<string>"))


def text_key(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def index(docs: DataFrame) -> DataFrame:
    """term, row, pos, doc_id, h: all postings, written; doc_id and h, the hash of the text, stand in heads only."""
    own = docs.select("doc_id", text_key(F.col("text")).alias("h"), words(F.col("text")).alias("w")).withColumn("row", F.monotonically_increasing_id())
    # The empty term goes before the words, so that a head is at -1 and its pos becomes the number of words.
    at = own.select("row", "doc_id", "h", F.size("w").alias("n"), F.posexplode(F.concat(F.array(F.lit("")), "w")).alias("p", "term"))
    head = F.col("p") == 0
    postings = at.select("term", "row", F.when(head, F.col("n")).otherwise(F.col("p") - 1).alias("pos"), F.when(head, F.col("doc_id")).alias("doc_id"), F.when(head, F.col("h")).alias("h"))
    return written(postings.sortWithinPartitions("term"), "postings")


def heads(postings: DataFrame) -> DataFrame:
    """row, doc_id, h, n_words of every document."""
    return postings.where("term = ''").select("row", "doc_id", "h", F.col("pos").cast("long").alias("n_words"))


def items_of(benchmark: DataFrame) -> DataFrame:
    """item, item_id, n, offset, term: the words of each different item that has some, written."""
    own = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), words(F.col("text")).alias("w"))
    own = own.where(F.size("w") > 0).dropDuplicates().withColumn("item", F.monotonically_increasing_id())
    return written(own.select("item", "item_id", F.size("w").alias("n"), F.posexplode("w").alias("offset", "term")), "items")


def of_terms(postings: DataFrame, terms: DataFrame) -> DataFrame:
    """row, pos, term: the postings of some terms."""
    return postings.select("term", "row", "pos").where("term != ''").join(bounded(terms), "term", "left_semi")


def frequencies(found: DataFrame) -> DataFrame:
    """term, seen: how often each term stands in the corpus."""
    return written(found.groupBy("term").agg(F.count("*").alias("seen")), "frequencies")


def anchors_of(items: DataFrame, counts: DataFrame, window: int = WINDOW, rare: int = RARE) -> DataFrame:
    """item, offset, term, need: the rarest terms of the windows all of whose terms occur in the corpus."""
    counted = items.join(counts, "term", "left").withColumn("long", F.least("n", F.lit(window)))
    first, last = F.greatest(F.lit(0), F.col("offset") - F.col("long") + 1), F.least("offset", F.col("n") - F.col("long"))
    in_windows = counted.withColumn("start", F.explode(F.sequence(first, last)))
    w = Window.partitionBy("item", "start")
    ranked = in_windows.withColumn("at", F.row_number().over(w.orderBy(F.col("seen").asc_nulls_first(), "term", "offset"))).withColumn("gone", F.max(F.col("seen").isNull()).over(w))
    chosen = ranked.where((F.col("at") <= rare) & ~F.col("gone"))
    return written(chosen.groupBy("item", "offset", "term").agg(F.least(F.min("long"), F.lit(rare)).alias("need")), "anchors")


def aligned(found: DataFrame, anchors: DataFrame) -> DataFrame:
    """row, item, diagonal: where enough rare terms of an item agree; written."""
    hits = found.join(bounded(anchors), "term").select("row", "item", "need", (F.col("pos") - F.col("offset")).alias("diagonal"))
    agree = hits.groupBy("row", "item", "diagonal").agg(F.count("*").alias("n"), F.max("need").alias("need"))
    return written(agree.where("n >= need").drop("n", "need"), "diagonals")


def phrases(found: DataFrame, diagonals: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """row, item_id, pos: every document word in an occurrence of an item's window; written."""
    wanted = diagonals.join(bounded(items), "item").withColumn("pos", F.col("diagonal") + F.col("offset")).where("pos >= 0")
    there = found.join(bounded(diagonals.select("row").distinct()), "row", "left_semi")
    met = wanted.join(there, ["row", "pos", "term"], "left_semi")
    line = ["row", "item", "diagonal"]
    runs = met.withColumn("run", F.col("offset") - F.row_number().over(Window.partitionBy(*line).orderBy("offset")))
    long = runs.withColumn("length", F.count("*").over(Window.partitionBy(*line, "run"))).where(F.col("length") >= F.least("n", F.lit(window)))
    return written(long.select("row", "item_id", "pos").distinct(), "phrases")


def proximity(found: DataFrame, items: DataFrame, counts: DataFrame, window: int = WINDOW, near: Near = Near()) -> DataFrame:  # noqa: B008
    """row, item_id: the documents that have an item's rarest terms within `slop` diagonals, in any order.

    An item takes part with its `near.terms` rarest different terms that occur in the
    corpus, each at its first offset, if it has a window's words and as many such terms.
    """
    own = items.where(F.col("n") >= window).groupBy("item", "item_id", "term").agg(F.min("offset").alias("offset")).join(counts, "term")
    w = Window.partitionBy("item")
    ranked = own.withColumn("at", F.row_number().over(w.orderBy("seen", "term"))).where(F.col("at") <= near.terms)
    rarest = written(ranked.withColumn("k", F.count("*").over(w)).where(F.col("k") == near.terms).select("item", "item_id", "term", "offset", "at"), "rarest")
    hits = found.join(bounded(rarest), "term").select("row", "item", "item_id", "at", (F.col("pos") - F.col("offset")).alias("diagonal"))
    # Documents that have all of the terms at all come first; the window then sees no others.
    some = hits.groupBy("row", "item").agg(*(F.max(F.col("at") == k).alias(f"t{k}") for k in range(1, near.terms + 1))).where(" and ".join(f"t{k}" for k in range(1, near.terms + 1)))
    inside = Window.partitionBy("row", "item").orderBy("diagonal").rangeBetween(0, near.slop)
    all_in = sum((F.max(F.when(F.col("at") == k, 1).otherwise(0)).over(inside) for k in range(1, near.terms + 1)), F.lit(0))
    return hits.join(some.select("row", "item"), ["row", "item"], "left_semi").withColumn("n", all_in).where(F.col("n") == near.terms).select("row", "item_id").distinct()


RESULT = ["n_words", "n_hit", "n_items", "items_sha256", "contaminated", "n_near"]


def matches(postings: DataFrame, benchmark: DataFrame, window: int = WINDOW, rare: int = RARE, near: Near = Near()) -> DataFrame:  # noqa: B008
    """doc_id, h and RESULT of every document of an index."""
    items = items_of(benchmark)
    found = written(of_terms(postings, items.select("term").distinct()), "found")
    counts = frequencies(found)
    hit = phrases(found, aligned(found, anchors_of(items, counts, window, rare)), items, window)
    words_hit = hit.select("row", "pos").distinct().groupBy("row").agg(F.count("*").alias("n_hit"))
    of_items = hit.select("row", "item_id").distinct().groupBy("row").agg(F.count("*").alias("n_items"), F.sort_array(F.collect_list("item_id")).alias("ids"))
    close = proximity(found, items, counts, window, near).groupBy("row").agg(F.count("*").alias("n_near"))
    out = heads(postings).join(words_hit.join(of_items, "row").join(close, "row", "full"), "row", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    ids = F.coalesce(F.array_join("ids", ","), F.lit(""))
    return out.select("doc_id", "h", "n_words", zero("n_hit"), zero("n_items"), F.sha2(ids, 256).alias("items_sha256"), (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"), zero("n_near"))


def decontaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, rare: int = RARE) -> DataFrame:
    """docs with RESULT; of clashing names, these replace those of docs."""
    judged = written(matches(index(docs), benchmark, window, rare).dropDuplicates(["doc_id", "h"]), "judged")
    rows = packed(docs, "doc_id", "text").select(F.col("doc_id").alias("_doc"), text_key(F.col("text")).alias("_h"), "row")
    met = rows.join(judged, F.col("_doc").eqNullSafe(F.col("doc_id")) & (F.col("_h") == F.col("h")))
    row = F.col("row")
    for c in docs.columns:
        row = row.dropFields(c) if c.lower() in RESULT else row
    return met.select(row.alias("row"), *RESULT).select("row.*", *RESULT)


def clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, rare: int = RARE) -> DataFrame:
    """The rows of docs without a phrase of the benchmark, with all their columns."""
    judged = matches(index(docs), benchmark, window, rare).where("contaminated").select("doc_id", "h").distinct()
    rows = packed(docs, "doc_id", "text").select(F.col("doc_id").alias("_doc"), text_key(F.col("text")).alias("_h"), "row")
    return rows.join(bounded(written(judged, "contaminated")), F.col("_doc").eqNullSafe(F.col("doc_id")) & (F.col("_h") == F.col("h")), "left_anti").select("row.*")


def scan(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    return matches(index(docs), benchmark).drop("h")
