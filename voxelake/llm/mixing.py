"""Mixing sources to target weights by weighted fair queueing.

Every use of a document gets a virtual finish time: the tokens of its source up to and with it, in
shuffled order, divided by the source's weight. In the order of these times, all sources progress
at their target rates; the mixture is that order cut at the total budget.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from voxelake.session import cut_lineage


def running_total(rows: DataFrame, order: list[str], value: str, out: str) -> DataFrame:
    """`out`: the total of `value` over all rows up to and with this one in the given order.

    Rows are range-partitioned by the whole order, so no source or value, however frequent, ends in
    one task; equal rows may stand in any order. The totals of the partitions (as many rows as
    partitions) give each one its start. The partitioned rows are checkpointed once, so a lost
    executor can't change where partitions begin.
    """
    placed = cut_lineage(rows.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()))
    sums = placed.groupBy("__part").agg(F.sum(value).alias("__sum"))
    starts = sums.select("__part", (F.sum("__sum").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))).alias("__start"))
    within = Window.partitionBy("__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return (
        placed.join(starts, "__part")
        .withColumn(out, F.coalesce("__start", F.lit(0)) + F.sum(value).over(within))
        .drop("__part", "__start")
    )


def plan_sources(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """What each target source has and may give, and the virtual time at which the mixture ends.

    (source, target_share, max_repeats, available_tokens, horizon). `horizon` is the largest virtual
    time that every source with tokens reaches within its repeats, so up to it all of these keep
    their target shares; sources without tokens can't contribute. Repeated target rows of a source
    add their shares and keep the larger max_repeats; targets with a null source, no positive
    share or no positive max_repeats don't take part.
    """
    t = (
        targets.where("source IS NOT NULL AND target_share > 0 AND max_repeats > 0")
        .groupBy("source")
        .agg(F.sum("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    )
    have = sizes.groupBy("source").agg(F.sum("tokens").alias("available_tokens"))
    both = t.join(have, "source", "left").withColumn("available_tokens", F.coalesce("available_tokens", F.lit(0)))
    end = F.when(F.col("available_tokens") > 0, F.col("max_repeats") * F.col("available_tokens") / F.col("target_share"))
    return both.withColumn("horizon", F.min(end).over(Window.partitionBy(F.lit(1))))


def mix(sizes: DataFrame, targets: DataFrame, *, budget: int | None = None, seed: int = 17) -> DataFrame:
    """(doc_id, source, tokens, uses) of the documents in the mixture.

    sizes: doc_id, source, tokens. budget: total tokens, by default the largest total at which each
    source with tokens keeps its share within max_repeats; a smaller budget keeps the shares, a
    larger one has no effect beyond that total. Each source misses its share by less than one
    document. Documents are shuffled by a hash of doc_id and seed, anew for each repeat pass.

    Null sources, sources without a target and documents without tokens stay out. Rows with equal
    doc_id and source count as one document of their summed size. Empty tables give an empty result.
    """
    wanted = sizes.where("source IS NOT NULL AND tokens > 0").groupBy("doc_id", "source").agg(F.sum("tokens").alias("tokens"))
    wanted = cut_lineage(wanted.join(targets.select("source").distinct(), "source", "left_semi"))
    plan = cut_lineage(plan_sources(wanted, targets).where("available_tokens > 0"))
    rank = F.xxhash64(F.lit(seed), F.col("doc_id"))
    ordered = wanted.join(plan, "source").withColumn("__shuffled", rank)
    summed = running_total(ordered, ["source", "__shuffled", "doc_id"], "tokens", "__all")
    # a source's own running total: less what stands before the source
    begins = plan.select("source", F.coalesce(F.sum("available_tokens").over(Window.orderBy("source").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    queue = (
        summed.join(begins, "source")
        .withColumn("__copy", F.explode(F.sequence(F.lit(0), F.col("max_repeats") - 1)))
        .withColumn("finish", (F.col("__copy") * F.col("available_tokens") + F.col("__all") - F.col("__before")) / F.col("target_share"))
        .where(F.col("finish") <= F.col("horizon") * (1 + 1e-12))
        .select("doc_id", "source", "tokens", "finish", "__copy")
    )
    total = plan.agg((F.max("horizon") * F.sum("target_share")).alias("__budget"))
    if budget is not None:
        total = total.select(F.least("__budget", F.lit(float(budget))).alias("__budget"))
    chosen = (
        running_total(queue, ["finish", "source", "doc_id", "__copy"], "tokens", "__spent")
        .crossJoin(F.broadcast(total))  # one row
        .where(F.col("__spent") <= F.col("__budget") * (1 + 1e-12))
    )
    return chosen.groupBy("doc_id", "source", "tokens").agg(F.count("*").cast("int").alias("uses"))


def mixture_shares(mixture: DataFrame, sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """Per target source: what it has, what the mixture uses and the actual share of all tokens."""
    used = mixture.groupBy("source").agg(F.sum(F.col("tokens") * F.col("uses")).alias("used_tokens"), F.sum("uses").alias("used_documents"), F.max("uses").alias("most_uses"))
    plan = plan_sources(sizes.where("source IS NOT NULL"), targets).drop("horizon")
    zero = F.lit(0)
    out = plan.join(used, "source", "left").withColumns({c: F.coalesce(c, zero) for c in ("used_tokens", "used_documents", "most_uses")})
    total = F.sum("used_tokens").over(Window.partitionBy(F.lit(1)))
    return out.withColumn("actual_share", F.when(total > 0, F.col("used_tokens") / total).otherwise(0.0))
