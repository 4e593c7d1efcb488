"""Aggregations with exact tie and null rules."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def distribution(df: DataFrame, by: Sequence[str], value: str, thresholds: Sequence[float] = ()) -> DataFrame:
    """mean, median, p5, p95 (linear percentiles), min, max and shares above the thresholds; nulls don't count."""
    v = F.col(value)
    over = [x for i, t in enumerate(thresholds) for x in (F.count_if(v > t).alias(f"n_over_{i}"), F.coalesce(F.avg((v > t).cast("double")), F.lit(0.0)).alias(f"share_over_{i}"))]
    return df.groupBy(*by).agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.percentile(v, 0.5).alias("median"), F.percentile(v, 0.05).alias("p5"), F.percentile(v, 0.95).alias("p95"), F.min(v).alias("low"), F.max(v).alias("high"), *over)


def modal_mapping(df: DataFrame, source: str, target: str, doc: str, least: int = 3, share: float = 0.9) -> DataFrame:
    """Each source term's occurrences, distinct targets, documents, modal target (ties: the least) and its share.

    clean_1to1: at least ``least`` occurrences, a share of ``share``, and no other eligible term with that modal target.
    """
    counts = df.groupBy(source, target).agg(F.count(F.lit(1)).alias("c"))
    modal = counts.groupBy(source).agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("n_targets"), F.min_by(target, F.struct(-F.col("c"), F.col(target))).alias("modal_target"), F.max("c").alias("modal_count"))
    docs = df.groupBy(source).agg(F.countDistinct(doc).alias("n_docs"))
    rivals = F.sum(F.when(F.col("n") >= least, 1).otherwise(0)).over(W.partitionBy("modal_target"))
    out = modal.join(docs, source).withColumn("modal_share", F.col("modal_count") / F.col("n"))
    return out.withColumn("clean_1to1", (F.col("n") >= least) & (F.col("modal_share") >= share) & (rivals == 1))


def threshold_yield(mapping: DataFrame, occurrences: Sequence[int], shares: Sequence[float]) -> DataFrame:
    """How many mappings pass each pair of thresholds; rivals for a modal target are counted anew for each."""
    rows = mapping.select("n", "modal_share", "modal_target", F.explode(F.array(*[F.lit(o) for o in occurrences])).alias("min_n")).where("n >= min_n")
    alone = rows.withColumn("_k", F.count(F.lit(1)).over(W.partitionBy("min_n", "modal_target")))
    cells = alone.select("min_n", "modal_share", "_k", F.explode(F.array(*[F.lit(s) for s in shares])).alias("min_share"))
    return cells.groupBy("min_n", "min_share").agg(F.count_if((F.col("modal_share") >= F.col("min_share")) & (F.col("_k") == 1)).alias("n_clean"))


def functional_violations(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Keys with more than one distinct value."""
    return df.groupBy(*keys).agg(F.countDistinct(value).alias("n_values")).where("n_values > 1")


def duplicate_inventory(df: DataFrame, keys: Sequence[str], texts: Sequence[str]) -> DataFrame:
    """Rows, distinct keys, keys that repeat, surplus rows, and null and blank counts of the text columns; one row."""
    per = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_c"), *[F.count_if(F.col(t).isNull()).alias(f"_n{i}") for i, t in enumerate(texts)], *[F.count_if(F.trim(F.col(t)) == "").alias(f"_b{i}") for i, t in enumerate(texts)])
    sums = [x for i, t in enumerate(texts) for x in (F.coalesce(F.sum(f"_n{i}"), F.lit(0)).alias(f"{t}_null"), F.coalesce(F.sum(f"_b{i}"), F.lit(0)).alias(f"{t}_blank"))]
    return per.agg(F.coalesce(F.sum("_c"), F.lit(0)).alias("n_rows"), F.count(F.lit(1)).alias("n_keys"), F.count_if(F.col("_c") > 1).alias("n_repeated"), F.coalesce(F.sum(F.col("_c") - 1), F.lit(0)).alias("surplus"), *sums)


def accuracy(chosen: Column, gold: Column) -> Column:
    """Share of rows whose choice is the gold one; rows without either don't count."""
    return F.avg(F.when(chosen.isNotNull() & gold.isNotNull(), (chosen == gold).cast("double")))


def guarded_corr(x: str, y: str) -> Column:
    """Pearson's r; null for fewer than two rows or a constant side."""
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    sx, sy = F.stddev_pop(F.when(both, F.col(x))), F.stddev_pop(F.when(both, F.col(y)))
    cov = F.covar_pop(F.when(both, F.col(x)).cast("double"), F.when(both, F.col(y)).cast("double"))
    return F.when((sx > 0) & (sy > 0), cov / (sx * sy))


def between_seed(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Mean and sample variance of a metric over seeds; a single seed has variance 0."""
    return df.groupBy(*keys).agg(F.count(value).alias("n_seeds"), F.avg(value).alias("mean"), F.when(F.count(value) > 1, F.var_samp(value)).otherwise(F.when(F.count(value) == 1, 0.0)).alias("variance"))


def contingency(df: DataFrame, row: str, column: str, values: Sequence[str]) -> DataFrame:
    """Counts of each row value by each of ``values``, zero-filled."""
    return df.groupBy(row).agg(*[F.count_if(F.col(column) == v).alias(f"n_{v}") for v in values])


def coverage_at(df: DataFrame, value: str, cutoffs: Sequence[int]) -> DataFrame:
    """For each cutoff how many rows reach it, and their share; one pass."""
    both = df.select(F.coalesce(F.col(value), F.lit(0)).alias("v"))
    cells = both.select("v", F.explode(F.array(*[F.lit(c) for c in cutoffs])).alias("cutoff"))
    return cells.groupBy("cutoff").agg(F.count_if(F.col("v") >= F.col("cutoff")).alias("n_reach"), F.avg((F.col("v") >= F.col("cutoff")).cast("double")).alias("share"))


def majority_predictor(train: DataFrame, test: DataFrame, key: str, label: str) -> DataFrame:
    """Accuracy on ``test`` of predicting each key's most frequent label, else the most frequent overall; ties: the least."""
    def mode(d: DataFrame, by: Sequence[str]) -> DataFrame:
        c = d.where(F.col(label).isNotNull()).groupBy(*by, label).agg(F.count(F.lit(1)).alias("c"))
        return c.groupBy(*by).agg(F.min_by(label, F.struct(-F.col("c"), F.col(label))).alias("_p"))

    whole = mode(train, []).first()
    guessed = test.join(mode(train, [key]), key, "left").withColumn("guess", F.coalesce(F.col("_p"), F.lit(whole[0] if whole else None)))
    return guessed.agg(F.count(label).alias("n"), F.avg((F.col("guess") == F.col(label)).cast("double")).alias("accuracy"))


def preferred_name(x: str) -> Column:
    """Of a group's names that with most words, then the longest, then the least."""
    w = F.size(F.split(F.trim(F.col(x)), r"\s+"))
    return F.min_by(F.col(x), F.struct(-w, -F.length(x), F.lower(x), F.col(x)))


def backfilled(df: DataFrame, column: str, derived: Column) -> DataFrame:
    """``df`` with the nulls of ``column`` filled by ``derived``, and filled (whether a row was); values that are there stay."""
    return df.withColumn("filled", F.col(column).isNull()).withColumn(column, F.coalesce(F.col(column), derived))
