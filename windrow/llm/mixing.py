"""Mixing of sources to target weights by weighted fair queueing.

Every copy of a document has a virtual finish time: the tokens of its source up to and with it, in shuffled order,
divided by the source's target weight. All copies in the order of these times interleave the sources by their weights;
the order is cut off at the total budget.

Prefix sums are made in two levels (sums of hash or time buckets, then within a bucket), so that a source which holds
a third of all rows, or the whole order, never comes into one task. The bucket sums are bounded by sources, repeats
and buckets, not by documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from windrow.llm.encoding import VOCABULARY, count_tokens
from windrow.session import small_enough, written

#: Rows that a bucket of the prefix sums should hold; buckets grow with the rows, up to 2 to the 16.
BUCKET_ROWS, MOST_BITS = 2000, 16


def _prefix(df: DataFrame, group: list[str], bucket: str, order: list[str], value: str, out: str) -> DataFrame:
    """``df`` with ``out``, the sum of ``value`` within ``group`` over all rows up to and with this one in (bucket, order)."""
    sums = df.groupBy(*group, bucket).agg(F.sum(value).alias("_sum"))
    over = W.partitionBy(*group) if group else W.partitionBy(F.lit(0))
    before = sums.withColumn("_before", F.coalesce(F.sum("_sum").over(over.orderBy(bucket).rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    within = W.partitionBy(*group, bucket).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    return df.withColumn("_within", F.sum(value).over(within)).join(before.drop("_sum"), [*group, bucket]).withColumn(out, F.col("_before") + F.col("_within")).drop("_before", "_within")


def plan_sources(totals: DataFrame, targets: DataFrame, budget: int | None = None) -> tuple[int, DataFrame]:
    """The total budget, and for each usable source (_source) its _weight and the _passes over it that the budget may take.

    ``totals`` has _source and _tokens, ``targets`` source, target_weight and max_repeats. Of any number of sources; only the budget
    comes to the driver.

    A source is usable if it has tokens, a positive weight and at least one repeat. Without ``budget`` it is the
    largest at which no source falls short of its weight; a larger one exhausts some source, and the actual shares
    then show it.
    """
    t = targets.select(F.col("source").alias("_source"), F.col("target_weight").cast("double").alias("_w"), F.col("max_repeats").cast("long").alias("_m")).distinct()
    usable = t.join(totals, "_source").where("_w > 0 and _m > 0 and _tokens > 0")
    whole = usable.agg(F.sum("_w")).first()[0] or 1.0
    usable = usable.withColumn("_weight", F.col("_w") / F.lit(float(whole)))
    if budget is None:
        budget = int(usable.agg(F.floor(F.min(F.col("_tokens") * F.col("_m") / F.col("_weight")))).first()[0] or 0)
    passes = F.least(F.col("_m"), F.floor(F.lit(budget) * F.col("_weight") / F.col("_tokens")) + 1)
    return budget, usable.select("_source", "_weight", passes.cast("int").alias("_passes"))


def mix(docs: DataFrame, targets: DataFrame, budget: int | None = None, seed: int = 17, id_column: str = "doc_id", source_column: str = "source", text_column: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """The chosen copies: ``id_column``, ``source_column``, repeat (from 0), n_tokens, finish (virtual time), position.

    position is the number of tokens of the mixture up to and with the copy, so ordering by it gives the mixture.
    ``targets`` has source, target_weight and max_repeats; repeated rows of it count once. Rows of ``docs`` with a null
    source, one without target, or a text without tokens are never chosen; equal texts under two ids are two
    documents. Ties of the hash are broken by the id. Empty tables give an empty result.
    """
    counted = written(count_tokens(docs.select(F.col(id_column).alias("_id"), F.col(source_column).alias("_source"), F.col(text_column).alias("_text")).where(F.col("_source").isNotNull()), "_text", vocabulary).where("n_tokens > 0"), "mix")
    bits = min(MOST_BITS, max(4, (counted.count() // BUCKET_ROWS).bit_length()))
    totals = counted.join(targets.select(F.col("source").alias("_source")).distinct(), "_source", "left_semi").groupBy("_source").agg(F.sum("n_tokens").alias("_tokens"))
    budget, passes = plan_sources(totals, targets, budget)
    passes = written(passes, "sources")
    passes = F.broadcast(passes) if small_enough(passes) else passes
    h = F.xxhash64(F.lit(seed), F.col("_id"), F.col("repeat"))
    copies = (
        counted.join(passes, "_source")
        .withColumn("repeat", F.explode(F.sequence(F.lit(0), F.col("_passes") - 1)))
        .withColumn("_hash", h)
        # repeat passes come one after the other; within one, the top bits of the hash are the bucket
        .withColumn("_bucket", F.col("repeat").cast("long") * (1 << bits) + F.shiftright("_hash", 64 - bits) + (1 << (bits - 1)))
    )
    served = _prefix(copies, ["_source"], "_bucket", ["_hash", "_id"], "n_tokens", "_served")
    # finish time, and those that begin within the budget
    timed = served.withColumn("finish", F.col("_served") / F.col("_weight")).where((F.col("_served") - F.col("n_tokens")) / F.col("_weight") < F.lit(float(budget)))
    slot = F.least(F.lit(1 << bits), F.floor(F.col("finish") / F.lit(max(budget, 1) / (1 << bits)))).cast("long")
    placed = _prefix(timed.withColumn("_slot", slot), [], "_slot", ["finish", "_source", "_id", "repeat"], "n_tokens", "position")
    return placed.where(F.col("position") <= budget).select(F.col("_id").alias(id_column), F.col("_source").alias(source_column), F.col("repeat").cast("int"), "n_tokens", "finish", "position")


def in_order(mixture: DataFrame) -> DataFrame:
    """The mixture range-sorted by position, as it is to be written."""
    return mixture.orderBy("position")


def shares(mixture: DataFrame, targets: DataFrame, source_column: str = "source") -> DataFrame:
    """For each target source its weight and what the mixture holds of it: documents, copies, tokens, share, most repeats."""
    got = mixture.groupBy(F.col(source_column).alias("source")).agg(F.countDistinct(mixture.columns[0]).alias("n_docs"), F.count(F.lit(1)).alias("n_copies"), F.sum("n_tokens").alias("n_tokens"), (F.max("repeat") + 1).alias("most_repeats"))
    whole: Column = F.sum("n_tokens").over(W.partitionBy(F.lit(0)))
    both = targets.select("source", "target_weight", "max_repeats").distinct().join(got, "source", "left")
    zero = {"n_docs": 0, "n_copies": 0, "n_tokens": 0, "most_repeats": 0}
    return both.fillna(zero).withColumn("actual_share", F.round(F.coalesce(F.try_divide(F.col("n_tokens"), whole), F.lit(0.0)), 9))
