"""Line dedup by a log-template tree of fixed depth, in DataFrame operations.

A line's tokens that hold a digit are variable. The tree goes by token count, then
by the leading tokens, to a leaf. At each place of a leaf the token that most of
its different lines have is constant if at least half of them have it; else the
place is variable. If at least half of the places behind the leading ones are
constant, they are the leaf's template, and lines that have at least `AGREE` per
cent of its constants belong to it; other lines are templates of their own.
Lines whose template stands in at least `documents` documents are dropped; for lines of
`LONG` tokens and more, which don't recur by chance, `long_documents` are enough.

A passage may stand inside a longer line. So lines of `LONG` tokens that stay are cut
after `.`, `!` and `?`, and sentences of `SENTENCE` tokens or more that stand, by
their own tokens, in `documents` documents' long lines are taken out of them.

Defined cases: null text has no lines and stays null; blank lines and lines of
fewer than `TOKENS` tokens are kept; a long line of which only blanks stay is dropped; a template's
documents are counted by doc_id, so repeated rows count once; null ids count as one
document; of equally common tokens the last by code point stands for a place. A very long
text has more lines, and a very long line more places and sentences. Columns that clash with the new ones are
replaced, others are kept. An empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded, packed, written

LEADING = 3
TOKENS = 3
DOCUMENTS = 10
#: Lines of so many tokens are long: they recur from so many documents on, and are searched for sentences of so many tokens.
LONG = 50
LONG_DOCUMENTS = 3
SENTENCE = 8
#: Per cent of the constants of a leaf, behind its leading tokens, that its lines have.
AGREE = 80
VARIABLE = "<*>"


def tokens_of(line: Column) -> Column:
    spaced = F.when(line.rlike(r"[\x09-\x0D]"), F.translate(line, "\t\n\x0b\f\r", "     ")).otherwise(line)
    tokens = F.array_remove(F.split(spaced, " "), "")
    return F.when(line.rlike("[0-9]"), F.transform(tokens, lambda t: F.when(t.rlike("[0-9]"), VARIABLE).otherwise(t))).otherwise(tokens)


def leaf_of(tokens: Column) -> Column:
    return F.xxhash64(F.size(tokens), F.slice(tokens, 1, LEADING))


def sentences(line: Column) -> Column:
    """The line in pieces that end after full stops; joined they are the line."""
    return F.regexp_extract_all(line, F.lit(r"([^.!?]*[.!?]+|[^.!?]+)"), F.lit(1))


def wide(sentence: Column) -> Column:
    """Whether it has the characters of SENTENCE tokens."""
    return F.length(sentence) >= 2 * SENTENCE - 1


def sentence_hash(tokens: Column) -> Column:
    return F.xxhash64(tokens, F.lit("sentence"))


def lines_of(docs: DataFrame, *names: str) -> DataFrame:
    """The named columns, and raw and tokens of every line of TOKENS tokens or more; they are cut inside the array, once."""
    every = F.transform(F.split("text", "\n"), lambda x: F.struct(x.alias("raw"), tokens_of(x).alias("tokens")))
    return docs.select(*names, F.explode(F.filter(every, lambda x: F.size(x.tokens) >= TOKENS)).alias("l")).select(*names, "l.raw", "l.tokens")


def units_of(docs: DataFrame) -> DataFrame:
    """doc_id, h, leaf, line, long of every line, and of every sentence of a long one, which has no leaf; only hashes leave the array."""
    unit = lambda leaf, line, long: F.struct(leaf.alias("leaf"), line.alias("line"), long.alias("long"))

    def of_line(x: Column) -> Column:
        inner = F.filter(F.transform(F.filter(sentences(x), wide), tokens_of), lambda s: F.size(s) >= SENTENCE)
        parts = F.transform(inner, lambda s: unit(F.lit(None).cast("long"), sentence_hash(s), F.lit(False)))
        line = lambda t: F.array(unit(leaf_of(t), F.xxhash64(t), F.size(t) >= LONG))
        return F.transform(F.array(tokens_of(x)), lambda t: F.when(F.size(t) >= LONG, F.concat(line(t), parts)).when(F.size(t) >= TOKENS, line(t)))[0]

    every = F.filter(F.transform(F.split("text", "\n"), of_line), lambda u: u.isNotNull())
    return docs.select("doc_id", "h", F.explode(F.flatten(every)).alias("u")).select("doc_id", "h", "u.*")


def generalised(docs: DataFrame, by_doc: DataFrame, leaves: DataFrame) -> DataFrame:
    """line, template: hashes of the lines that belong to their leaf's template. Each line is read in one document that has it."""
    leaves = bounded(leaves)
    first = by_doc.join(leaves, "leaf").groupBy("line").agg(F.min("doc_id").alias("_id")).select("_id").distinct()
    readers = docs.join(bounded(written(first, "readers")), F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi")
    there = lines_of(readers).select(leaf_of(F.col("tokens")).alias("leaf"), F.xxhash64("tokens").alias("line"), "tokens")
    different = written(there.join(leaves, "leaf").groupBy("leaf", "line").agg(F.any_value("tokens").alias("tokens")), "leaf-lines")
    votes = different.select("leaf", F.posexplode("tokens").alias("place", "token")).groupBy("leaf", "place", "token").agg(F.count("*").alias("n"))
    places = votes.groupBy("leaf", "place").agg(F.max(F.struct("n", "token")).alias("most"), F.sum("n").alias("all"))
    constant = F.struct("place", F.when(F.col("most.n") * 2 >= F.col("all"), F.col("most.token")).alias("token"))
    made = places.groupBy("leaf").agg(F.array_sort(F.collect_list(constant)).token.alias("made"))
    behind = F.size(F.filter("made", lambda t: t.isNotNull())) - LEADING
    made = made.withColumn("constants", behind).where((behind > 0) & (behind * 2 >= F.size("made") - LEADING))
    agree = F.size(F.filter(F.zip_with("made", "tokens", lambda a, b: F.coalesce(a == b, F.lit(False))), lambda same: same)) - LEADING
    members = different.join(made, "leaf").where(agree * 100 >= F.col("constants") * AGREE)
    return members.select("line", F.xxhash64("leaf", F.lit("template")).alias("template"))


def without_templates(docs: DataFrame, documents: int = DOCUMENTS, long_documents: int = LONG_DOCUMENTS) -> DataFrame:
    """docs with what recurs dropped from text; adds n_lines, n_dropped and n_cut, the lines that lost sentences and stay."""
    clashing = [c for c in docs.columns if c.lower() in ("n_lines", "n_dropped", "n_cut")]
    rows = packed(docs, "doc_id", "text").withColumn("h", F.xxhash64("text"))
    docs = rows.select("doc_id", "text", "h")
    recurs = F.col("n") >= F.when(F.col("long"), long_documents).otherwise(documents)
    lines = written(units_of(docs), "lines")
    by_doc = written(lines.select("leaf", "line", "long", "doc_id").distinct(), "line-documents")
    leaves = by_doc.where("leaf is not null").groupBy("leaf", "long").agg(F.min("line").alias("a"), F.max("line").alias("b"), F.count("*").alias("n")).where("a < b").where(recurs).select("leaf")
    general = generalised(docs, by_doc, written(leaves, "leaves"))
    named = by_doc.groupBy("line", "long").agg(F.count("*").alias("n"))
    known = named.join(bounded(written(general, "generalised")), "line", "left").withColumn("template", F.coalesce("template", "line"))
    # A template of one line has that line's documents; the documents of others are counted anew.
    known = written(known.where(recurs | (F.col("template") != F.col("line"))), "templates")
    several = known.groupBy("template", "long").agg(F.count("*").alias("lines"), F.sum("n").alias("n")).where(recurs)
    alone = several.where("lines = 1").select("template")
    of_several = known.join(several.where("lines > 1").select("template"), "template").select("line", "template")
    again = by_doc.join(bounded(written(of_several, "several")), "line").select("template", "long", "doc_id").distinct()
    counted = again.groupBy("template", "long").agg(F.count("*").alias("n")).where(recurs)
    gone = known.join(alone.unionByName(counted.select("template")), "template").select("line")
    # A document gets the hashes of what recurs in it; rows of one id and text have the same ones.
    key = F.struct("doc_id", "h").alias("at")
    drops = lines.join(bounded(written(gone, "recurring")), "line").select(key, "line", F.col("leaf").isNull().alias("part")).distinct()
    per_doc = drops.groupBy("at").agg(*(F.collect_list(F.when(F.col("part") == part, F.col("line"))).alias(name) for name, part in (("gone", False), ("parts", True))))
    met = rows.select(key, "text", "row").join(per_doc, "at", "left").withColumn("lines", F.split("text", "\n"))
    goes = lambda s: wide(s) & F.exists(F.array(tokens_of(s)), lambda t: (F.size(t) >= SENTENCE) & F.array_contains("parts", sentence_hash(t)))
    rest = lambda x: F.array_join(F.filter(sentences(x), lambda s: ~goes(s)), "")
    worded = lambda x: F.when(x.rlike(r"[^\x20\x09-\x0D]"), x)

    def left(x: Column) -> Column:
        """A line as it stays, or null; the array names its tokens, so that they are cut once."""
        stays = lambda t: F.when((F.size(t) >= TOKENS) & F.array_contains("gone", F.xxhash64(t)), None).when((F.size(t) >= LONG) & (F.size("parts") > 0), worded(rest(x))).otherwise(x)
        return F.transform(F.array(tokens_of(x)), stays)[0]

    stay = F.when(F.col("gone").isNull(), F.col("lines")).otherwise(F.transform("lines", left))
    out = met.withColumn("stay", stay).withColumn("n_lines", F.coalesce(F.size("lines"), F.lit(0)).cast("long"))
    number = lambda test: F.coalesce(F.size(F.filter(F.zip_with("stay", "lines", test), lambda x: x)), F.lit(0)).cast("long")
    changed = F.col("gone").isNotNull()
    out = out.withColumn("n_dropped", F.when(changed, number(lambda y, x: y.isNull())).otherwise(F.lit(0).cast("long")))
    out = out.withColumn("n_cut", F.when(changed, number(lambda y, x: F.coalesce(y != x, F.lit(False)))).otherwise(F.lit(0).cast("long")))
    row = F.col("row").withField("text", F.array_join(F.filter("stay", lambda y: y.isNotNull()), "\n"))
    for c in clashing:
        row = row.dropFields(c)
    return out.select(row.alias("row"), "n_lines", "n_dropped", "n_cut").select("row.*", "n_lines", "n_dropped", "n_cut")
