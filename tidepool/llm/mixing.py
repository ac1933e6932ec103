"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Every document gets an exponential key -ln(u) / w, where u is a hash of its id
and w its quality weight; ordered by key, a source's documents are a weighted
sample without replacement of any length.  A source's target is spent on
complete epochs first; what is left goes to the documents with the smallest
keys, up to the word where the running sum of sizes meets it.

No source is ever sorted as a whole.  Keys fall into bins by their logarithm,
so that whatever its weight a document is in any one bin with a chance of less
than one in a thousand; sums by source and bin (combined before the shuffle)
tell which bin holds the cut, and only that bin's documents are put in order.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidepool.llm.shared import Scratch, fresh_names

#: Bins for a key that is e times as large; a bin holds at most 1 / (e * BINS) of the documents of any weight.
BINS = 500
#: Sources are broadcast only if there are no more than these.
BROADCAST_SOURCES = 2000
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def uniform(name: Column) -> Column:
    """A number in (0, 1) from 48 bits of the MD5 of a value's text."""
    digits = F.substring(F.md5(F.coalesce(name.cast("string"), F.lit("")).cast("binary")), 1, 12)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / float(1 << 48)


def key_bin(key: Column) -> Column:
    return F.floor(F.lit(BINS) * F.log(key)).cast("int")


def source_targets(sizes: DataFrame, ratio: float, weights: Sequence[float], epochs: int) -> DataFrame:
    """(source, source_size, target) from (source, size): weighted shares, capped at `epochs` times the size.

    Sources in code point order (null last) take the weights in turn; what
    capped sources can't take is shared anew by weight.  With sources in the
    order of cap over weight, those that are capped come first, so one pass of
    running sums finds the common level of all others.  Sources are ranked in
    one task: there are thousands of them at most, one row each.
    """
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    turn = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    ratios = F.array(*[F.lit(float(w)) for w in weights])
    s = by_source.withColumn("w", F.element_at(ratios, (turn % len(weights)) + 1)).withColumn("cap", F.col("source_size") * F.lit(float(epochs)))
    order = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    total = F.sum("source_size").over(Window.partitionBy()) * F.lit(float(ratio))
    s = (
        s.withColumn("capped", F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("left", F.sum("w").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
        .withColumn("level", (total - F.col("capped")) / F.col("left"))
        .withColumn("level", F.when(F.col("level") <= F.col("cap") / F.col("w"), F.col("level")))
        .withColumn("level", F.first("level", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    )
    return s.select("source", "source_size", F.coalesce(F.col("level") * F.col("w"), F.col("cap")).alias("target"))


def mix_sources(
    docs: DataFrame,
    ratio: float = 1.5,
    weights: Sequence[float] = (5, 2, 1),
    epochs: int = 2,
    scratch: Scratch | None = None,
) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken) for every row of `docs` (doc_id, source, size, weight).

    `taken` is the number of a document's words in the mix, repeats counted;
    within a source they sum to the target, rounded down.  Null sizes count as
    0 and take nothing; weights that are null or not positive count as 1.  A
    null source is a source of its own.  Equal keys are ordered by doc_id and
    size; repeated rows are documents of their own.  Other columns are ignored;
    an empty table gives no rows.  Results depend on ids, sizes and
    weights only.
    """
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark, "mixing")
    weight = F.when(F.col("weight") > 0, F.col("weight").cast("double")).otherwise(F.lit(1.0))
    keyed = docs.select(
        "doc_id", "source", F.coalesce(F.col("size").cast("long"), F.lit(0)).cast("long").alias("size"),
        (-F.log(uniform(F.col("doc_id"))) / weight).alias("key"),
    ).withColumn("bin", key_bin(F.col("key")))
    keyed = scratch.save(keyed, "keyed")

    bins = scratch.save(keyed.groupBy("source", "bin").agg(F.sum("size").alias("size")), "bins")
    targets = source_targets(bins, ratio, weights, epochs)
    goals = (
        targets.withColumn("full", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long"))
        .withColumn("rest", F.floor(F.col("target")).cast("long") - F.col("full") * F.col("source_size"))
    )
    goals = scratch.save(goals, "goals")
    many = goals.count()
    near = (lambda t: F.broadcast(t)) if many <= BROADCAST_SOURCES else (lambda t: t)

    before = F.sum("size").over(Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("size")
    cuts = (
        bins.select("source", "bin", before.alias("before"), "size").alias("b").join(near(goals.select("source", "rest").alias("g")), F.expr("b.source <=> g.source"))
        .where("before < rest and before + size >= rest").select("b.source", F.col("bin").alias("cut"), "before")
    )
    plan = goals.alias("g").join(near(cuts.alias("c")), F.expr("g.source <=> c.source"), "left").select("g.*", "cut", F.coalesce("before", F.lit(0)).alias("before"))
    plan = scratch.save(plan, "plan")
    rows = keyed.alias("k").join(near(plan.alias("p")), F.expr("k.source <=> p.source")).select(
        "k.doc_id", "k.source", "k.size", "p.source_size", "p.target", "key", "bin", "full", "rest", "cut", "before"
    )
    sides = rows.where("cut is null or bin <> cut").withColumn("part", F.when(F.col("bin") < F.col("cut"), F.col("size")).otherwise(F.lit(0)))
    order = Window.partitionBy("source").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    at_cut = rows.where("bin = cut").withColumn("start", F.col("before") + F.sum("size").over(order) - F.col("size")).withColumn(
        "part", F.least(F.col("size"), F.greatest(F.lit(0), F.col("rest") - F.col("start")))
    ).drop("start")
    return sides.unionByName(at_cut).select(
        "doc_id", "source", "size", "source_size", "target", (F.col("full") * F.col("size") + F.col("part")).cast("long").alias("taken")
    )


def quality_weights(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """`docs` with a column `weight`: 1 for good, 0.25 for poor and 0.5 for unlabelled documents.

    Where a doc_id has several labels, the best counts.  Null labels and a
    null doc_id count as unlabelled; documents that repeat stay; an empty table
    of either gives no rows or no labels.  Other columns of `docs` stay, but
    for one named `weight`.
    """
    (q,) = fresh_names(docs, "quality")
    best = labels.groupBy("doc_id").agg(F.max("quality").alias(q))
    return docs.join(best, "doc_id", "left").withColumn("weight", F.when(F.col(q) >= 1, 1.0).when(F.col(q) <= 0, 0.25).otherwise(0.5)).drop(q)
