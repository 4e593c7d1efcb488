"""Deterministic samples, allocations and shuffles by digests."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from windrow.operators.prefix import running


def hash_rank(key: str, seed: str) -> Column:
    """The digest by which rows are put in a random but repeatable order."""
    return F.sha2(F.concat(F.lit(f"{seed}|"), F.col(key).cast("string")), 256)


def largest_remainder(df: DataFrame, key: str, weight: str, total: int, least: int = 0, out: str = "quota") -> DataFrame:
    """Integer shares of ``total`` in proportion to the weights; what is left goes to the largest remainders, ties by key.

    least: what every stratum has beforehand. Strata are few (they are the groups of a report), so one window holds them.
    """
    rest = F.lit(total) - F.lit(least) * F.count(F.lit(1)).over(W.partitionBy(F.lit(0)))
    exact = rest * F.col(weight) / F.sum(weight).over(W.partitionBy(F.lit(0)))
    d = df.withColumn("_e", exact.cast("double")).withColumn("_f", F.floor("_e"))
    left = rest - F.sum("_f").over(W.partitionBy(F.lit(0)))
    order = F.row_number().over(W.partitionBy(F.lit(0)).orderBy(F.desc(F.round(F.col("_e") - F.col("_f"), 9)), key))
    return d.withColumn("_l", left).withColumn("_o", order).withColumn(out, (F.lit(least) + F.col("_f") + F.when(F.col("_o") <= F.col("_l"), 1).otherwise(0)).cast("long")).drop("_e", "_f", "_l", "_o")


def hash_sample(df: DataFrame, stratum: str, key: str, quotas: DataFrame, seed: str, quota: str = "quota") -> DataFrame:
    """Of each stratum its quota of rows, the least digests first; a quota above the stratum takes all of it.

    The stratum's cut-off digest is found from hash buckets' counts, so that no stratum is sorted in one task; the last
    bucket alone is ranked.
    """
    d = df.withColumn("_h", hash_rank(key, seed)).withColumn("_b", F.substr("_h", F.lit(1), F.lit(3)))
    counts = d.groupBy(stratum, "_b").agg(F.count(F.lit(1)).alias("_c"))
    before = counts.withColumn("_before", F.coalesce(F.sum("_c").over(W.partitionBy(stratum).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    cut = before.join(quotas.select(stratum, F.col(quota).alias("_q")), stratum).where("_before < _q").select(stratum, "_b", "_before", "_q")
    ranked = d.join(cut, [stratum, "_b"]).withColumn("_r", F.row_number().over(W.partitionBy(stratum, "_b").orderBy("_h", key)))
    return ranked.where(F.col("_before") + F.col("_r") <= F.col("_q")).select(*df.columns)


def round_robin(df: DataFrame, group: str, key: str, n: int) -> DataFrame:
    """``n`` rows by turns from each group (groups by name, rows by key). A limit, since the sample is what is asked."""
    return df.withColumn("_t", F.row_number().over(W.partitionBy(group).orderBy(key))).where(F.col("_t") <= n).orderBy("_t", group).limit(n).drop("_t")


def shuffled_options(key: Column, options: Column) -> Column:
    """An item's options in the order of the digests of key and option."""
    tagged = F.transform(options, lambda o: F.struct(F.sha2(F.concat(key, F.lit("|"), o), 256).alias("h"), o.alias("o")))
    return F.transform(F.array_sort(tagged), lambda s: s["o"])


def evenly_spaced(df: DataFrame, key: str, n: int) -> DataFrame:
    """``n`` rows at even distances in the order of the key, which identifies a row (halves round to even)."""
    ranked = running(df, [F.col(key)], {"_r": "1"}).withColumn("_r", F.col("_r") - 1).withColumn("_n", F.lit(df.count()))
    places = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.bround(i * (F.col("_n") - 1) / F.lit(max(1, n - 1))).cast("int"))
    return ranked.where(F.array_contains(places, F.col("_r").cast("int"))).drop("_r", "_n")


def pack_largest_first(sizes: Sequence[tuple[str, int]], target: int) -> tuple[list[str], int]:
    """Whole components put in, the largest first, skipping those that no longer fit; (chosen, their size).

    Sequential by nature and over components, a bounded list; ties by name.
    """
    chosen, total = [], 0
    for name, size in sorted(sizes, key=lambda x: (-x[1], x[0])):
        if total + size <= target:
            chosen.append(name)
            total += size
    return chosen, total
