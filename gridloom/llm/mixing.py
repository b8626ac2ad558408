"""Mixing sources to target weights by weighted fair queueing, in DataFrame operations.

Every document of a source gets a virtual finish time: the source's tokens up to
and with it, in a fixed shuffled order, divided by the source's target. A pass
over a source that is taken more than once goes on counting where the pass before
ended. All passes of all sources are then range-sorted by finish time over the
whole cluster and cut where their running sum reaches the budget.

Defined cases: a null text has size 0; a document of size 0 is never taken; null
sources form one source, which comes last; repeated rows are separate documents;
ties in finish time go by source, pass, shuffle key and doc_id. A very long text is
one document that is taken whole or not. An empty table gives an empty mix. Further
columns are ignored by `mix` and kept by `mixed`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded, packed, running_sum, written

#: Hash ranges that a source's shuffled order is summed in; a hot source is spread over them.
RANGES_HEX = 2


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sources: DataFrame, weights: tuple[int, ...], most: int, share: float) -> DataFrame:
    """Adds weight and target to (source, source_size), a written table.

    A round is one aggregate over the sources: it sets the words a unit of weight
    gets once the sources known to stop at `most` times their size are set aside.
    """
    counted = running_sum(sources.withColumn("one", F.lit(1)), "one", F.col("source").asc_nulls_last(), out="rank").drop("one")
    ranked = written(
        counted.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), ((F.col("rank") - 1) % len(weights) + 1).cast("int"))),
        "sources",
    )
    total = ranked.agg(F.sum("source_size")).first()[0] or 0
    budget, cap = share * total if share != 1 else total, F.col("source_size") * most
    unit, full = 0.0, -1
    while True:
        is_full = (F.lit(unit) * F.col("weight") > cap) if full >= 0 else F.lit(False)
        row = ranked.agg(F.count_if(is_full).alias("n"), F.sum(F.when(is_full, cap)).alias("set"), F.sum(F.when(~is_full, F.col("weight"))).alias("open")).first()
        if row["n"] == full or not row["open"]:
            break
        full, unit = row["n"], (budget - (row["set"] or 0)) / row["open"]
    target = F.least(F.lit(unit) * F.col("weight"), cap.cast("double")) if row["open"] else cap.cast("double")
    return ranked.withColumn("target", target)


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3, share: float = 1.0, seed: str = "mix", keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, size, source_size, target, taken, copies and the columns named in keep, a row for each document."""
    base = written(
        docs.select("doc_id", "source", words(F.col("text")).alias("size"), F.md5(F.concat(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))).alias("_key"), *keep).withColumn("_row", F.monotonically_increasing_id()),
        "sizes",
    )
    sources = written(base.groupBy("source").agg(F.sum("size").alias("source_size")), "source-sizes")
    planned = targets(sources, weights, most, share)
    budget = planned.agg(F.sum("target")).first()[0] or 0.0
    planned = bounded(planned.withColumnRenamed("source", "_source"))
    base = base.join(planned, F.col("source").eqNullSafe(F.col("_source"))).drop("_source", "source", "weight")

    base = base.withColumn("_range", F.substring("_key", 1, RANGES_HEX))
    sums = base.groupBy("rank", "_range").agg(F.sum("size").alias("_sum"))
    before = sums.select("rank", "_range", (F.sum("_sum").over(Window.partitionBy("rank").orderBy("_range")) - F.col("_sum")).alias("_before"))
    inside = Window.partitionBy("rank", "_range").orderBy("_key", "doc_id", "size", "_row").rowsBetween(Window.unboundedPreceding, 0)
    queued = base.withColumn("_upto", F.sum("size").over(inside)).join(before, ["rank", "_range"]).withColumn("_upto", F.col("_upto") + F.col("_before"))

    cols = ["_row", "doc_id", "size", "source_size", "target", *keep]
    items = queued.where((F.col("size") > 0) & (F.col("target") > 0)).select(
        *cols, "rank", "_key", "_upto", F.explode(F.sequence(F.lit(0), F.lit(most - 1))).alias("_pass")
    )
    items = items.withColumn("finish", (F.col("_pass") * F.col("source_size") + F.col("_upto")) / F.col("target")).drop("_upto")
    order = [F.col(c) for c in ("finish", "rank", "_pass", "_key", "doc_id", "_row")]
    upto = running_sum(items, "size", *order)
    taken = F.col("running") <= F.lit(budget) * (1 + 1e-12)
    out = upto.groupBy(*cols).agg(F.sum(F.when(taken, F.col("size")).otherwise(0)).alias("taken"), F.count_if(taken).alias("copies"))
    rest = base.where((F.col("size") == 0) | (F.col("target") == 0)).select(*cols, F.lit(0).cast("long").alias("taken"), F.lit(0).cast("long").alias("copies"))
    return out.unionByName(rest).drop("_row")


def mixed(docs: DataFrame, **how) -> DataFrame:
    """The mix itself: each document of docs, whole, as often as the mix takes it."""
    rows = packed(docs, "doc_id", "source", "text")
    whole = "row" if "map<" not in docs.schema.simpleString() else F.to_json("row")
    marked = rows.withColumn("same", F.xxhash64(whole))
    plan = mix(marked, keep=("same",), **how).groupBy("doc_id", "same").agg(F.sum("copies").alias("copies")).where("copies > 0")
    plan = plan.select(F.struct("doc_id", "same").alias("at"), "copies")
    keyed = marked.select(F.struct("doc_id", "same").alias("at"), "row")
    one = keyed.withColumn("k", F.row_number().over(Window.partitionBy("at").orderBy("at"))).where("k = 1")
    return one.join(plan, "at").select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select("row.*")
