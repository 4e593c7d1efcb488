"""Distinct rows, keep-first deduplication and set comparisons."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def keep_first(df: DataFrame, identity: Column, order: str) -> DataFrame:
    """Of the rows of one identity that with the least ``order``; rows with a null identity are all kept.

    Pre-aggregated per identity, so that a group of any size, a third of all rows even, comes as partial minima.
    """
    rest = [c for c in df.columns]
    keyed = df.withColumn("_id", identity)
    first = keyed.where("_id is not null").groupBy("_id").agg(F.min_by(F.struct(*rest), F.struct(F.col(order))).alias("_r")).select("_r.*")
    return first.unionByName(keyed.where("_id is null").select(*rest))


def overlap(left: DataFrame, right: DataFrame, key: Column | str) -> DataFrame:
    """Keys that both tables have, once each; must be empty for disjoint splits."""
    k = F.col(key) if isinstance(key, str) else key
    return left.select(k.alias("key")).where("key is not null").intersect(right.select(k.alias("key")).where("key is not null"))


def fresh(new: DataFrame, old: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows of ``new``, in the named columns, that ``old`` doesn't have."""
    return new.select(*columns).distinct().subtract(old.select(*columns))


def same_composition(left: DataFrame, right: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Combinations whose counts differ: the columns, n_left, n_right; empty if the multisets are equal."""
    a = left.groupBy(*columns).agg(F.count(F.lit(1)).alias("n_left"))
    b = right.groupBy(*columns).agg(F.count(F.lit(1)).alias("n_right"))
    both = a.join(b.withColumnsRenamed({c: f"_{c}" for c in columns}), [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in columns], "full_outer")
    return both.select(*[F.coalesce(F.col(c), F.col(f"_{c}")).alias(c) for c in columns], F.coalesce("n_left", F.lit(0)).alias("n_left"), F.coalesce("n_right", F.lit(0)).alias("n_right")).where("n_left <> n_right")
