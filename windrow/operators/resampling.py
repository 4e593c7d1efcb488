"""Resampling by digests: bootstrap indexes, permutations, matched and uniform draws, intervals and nulls.

Draw ``d``'s pick at place ``p`` is a digest of (seed, d, p), so it is the same on every machine and in SQL, and vectors
that are resampled together share it. What is resampled are items or runs, bounded sets: groups of draws x units rows.
Paired draws make no such rows: a group's units are streamed in their order, and all draws are added up where they stand.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def uniform32(*parts: Column | str | int) -> Column:
    """A whole number below 2^32 from the digest of the parts."""
    text = F.concat_ws("|", *[p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def with_draws(df: DataFrame, draws: int) -> DataFrame:
    """Each row once a draw, with draw from 0."""
    return df.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))


def bootstrap_index(df: DataFrame, keys: Sequence[str], unit: str, draws: int, seed: str) -> DataFrame:
    """keys, draw, unit: the units that each draw picks with replacement, as many as the group has; the units of a group are
    numbered in their order and are a bounded set. Groups with the same units get the same picks."""
    units = df.select(*keys, unit).distinct()
    own = W.partitionBy(*keys) if keys else W.partitionBy(F.lit(0))
    numbered = units.withColumn("_i", F.row_number().over(own.orderBy(unit)) - 1).withColumn("_n", F.count(F.lit(1)).over(own))
    picks = with_draws(numbered, draws).select(*keys, "draw", (uniform32(seed, F.col("draw"), F.col("_i")) % F.col("_n")).alias("_i"))
    return picks.join(numbered.select(*keys, "_i", unit), [*keys, "_i"]).select(*keys, "draw", unit)


def permutation(df: DataFrame, keys: Sequence[str], unit: str, draws: int, seed: str) -> DataFrame:
    """keys, draw, unit and place (from 1): the order of digests within each draw, ties by unit."""
    return with_draws(df.select(*keys, unit).distinct(), draws).withColumn("place", F.row_number().over(W.partitionBy(*keys, "draw").orderBy(uniform32(seed, F.col("draw"), F.col(unit)), unit)))


def matched_draws(df: DataFrame, unit: str, gold: str, p: float, draws: int, seed: str, letters: str = "ABCD") -> DataFrame:
    """draw, unit, gold and drawn: a symmetric channel that gives the gold letter with probability ``p``, else one of the others."""
    d = with_draws(df.where(F.col(gold).isNotNull()).select(unit, gold).distinct(), draws)
    others = F.array(*[F.lit(x) for x in letters])
    wrong = F.element_at(F.filter(others, lambda x: x != F.col(gold)), (uniform32(seed, "o", F.col("draw"), F.col(unit)) % (len(letters) - 1) + 1).cast("int"))
    return d.withColumn("drawn", F.when(uniform32(seed, "u", F.col("draw"), F.col(unit)) < int(p * (1 << 32)), F.col(gold)).otherwise(wrong))


def percentile_interval(df: DataFrame, keys: Sequence[str], value: str, low: float = 0.025, high: float = 0.975) -> DataFrame:
    """n_finite, low and high: linear percentiles over the finite values; null where there are none."""
    finite = F.when(~F.isnan(value) & (F.abs(value) < float("inf")), F.col(value))
    return df.groupBy(*keys).agg(F.count(finite).alias("n_finite"), F.percentile(finite, low).alias("low"), F.percentile(finite, high).alias("high"))


def rank_interval(draws: DataFrame, keys: Sequence[str], value: str, off_by_one: bool = False) -> DataFrame:
    """n_draws, low and high by nearest rank: the values at places int(.025 n) (one less if ``off_by_one``) and
    int(.975 n) of the sorted draws, within their ends. Draws are a bounded number."""
    return listed_interval(draws.groupBy(*keys).agg(F.collect_list(value).alias("_v")), keys, "_v", off_by_one)


def listed_interval(lists: DataFrame, keys: Sequence[str], values: str, off_by_one: bool = False) -> DataFrame:
    """``rank_interval`` of the values in each row's list; nulls don't count."""
    g = lists.select(*keys, F.array_sort(F.filter(values, lambda x: x.isNotNull())).alias("_v"))
    n = F.size("_v")
    low = F.floor(n * F.lit(25) / F.lit(1000)) - (1 if off_by_one else 0)
    high = F.floor(n * F.lit(975) / F.lit(1000))
    at = lambda i: F.element_at("_v", (F.least(F.greatest(i, F.lit(0)), n - 1) + 1).cast("int"))
    return g.select(*keys, n.alias("n_draws"), at(low).alias("low"), at(high).alias("high"))


#: Digests of all draws that are held at once.
DIGESTS = 1 << 18


def _summed_draws(seed: str, draws: int, digests: int) -> Iterator[np.ndarray]:
    """A coroutine: gets the values of a group's units (units x columns), gives each draw's sums of what it picks (draws x columns)."""
    width = max(1, digests // draws)
    first = np.empty((draws, 0), np.int64)  # the digests of the first places, which groups share

    def of(start: int, stop: int) -> np.ndarray:
        return np.array([[int(hashlib.md5(f"{seed}|{d}|{i}".encode()).hexdigest()[:8], 16) for i in range(start, stop)] for d in range(draws)], np.int64).reshape(draws, stop - start)

    sums = np.empty((draws, 0))
    while True:
        values = yield sums
        n = len(values)
        sums = np.zeros((draws, values.shape[1]))
        for start in range(0, n, width):
            stop = min(n, start + width)
            if not start and stop > first.shape[1]:
                first = np.concatenate([first, of(first.shape[1], stop)], axis=1)
            sums += values[(of(start, stop) if start else first[:, :stop]) % n].sum(axis=1)


def paired_bootstrap(df: DataFrame, keys: Sequence[str], unit: str, a: str, b: str, draws: int, seed: str, digests: int = DIGESTS) -> DataFrame:
    """keys, draw and difference: mean of ``a`` less mean of ``b`` over the units that the draw picks, the same for both.

    The picks are those of ``bootstrap_index``. A unit's rows all count; rows without a key or a unit don't, nor do null values; a
    draw without any has a null difference.
    """
    keys = list(keys)
    rows = df.dropna(subset=[*keys, unit]).select(*keys, unit, F.col(a).cast("double").alias("_a"), F.col(b).cast("double").alias("_b"))
    sums = [f(c) for c in ("_a", "_b") for f in (lambda c: F.coalesce(F.sum(c), F.lit(0.0)), lambda c: F.count(c).cast("double"))]
    rows = rows.repartition(*keys) if keys else rows.repartition(1)
    return _streamed(rows.groupBy(*keys, unit).agg(*[c.alias(f"_{i}") for i, c in enumerate(sums)]), keys, unit, draws, seed, digests)


def paired_bootstrap_of_sums(units: DataFrame, keys: Sequence[str], unit: str, sums: Sequence[str], draws: int, seed: str, digests: int = DIGESTS) -> DataFrame:
    """keys and differences, the list of all draws, of rows that were added up: ``units`` has one row a unit, those of a group in
    one partition; ``sums`` names the sum and the count of its first values and those of its second, none null. A draw without
    any value has a null in its place."""
    keys = list(keys)
    rows = units.dropna(subset=[*keys, unit]).select(*keys, unit, *[F.col(c).cast("double").alias(f"_{i}") for i, c in enumerate(sums)])
    return _streamed(rows, keys, unit, draws, seed, digests, listed=True)


def _streamed(units: DataFrame, keys: list[str], unit: str, draws: int, seed: str, digests: int, listed: bool = False) -> DataFrame:
    """keys, draw and difference (keys and differences if ``listed``) from the sums _0 to _3 of units, those of a group in one partition.

    Each group is streamed through one task, which holds four numbers a unit, and a block of ``digests`` digests; no row is
    made but a group's draws.
    """
    made = {"differences": "array<double>"} if listed else {"draw": "int", "difference": "double"}
    ordered = units.sortWithinPartitions(*keys, unit).select("_0", "_1", "_2", "_3", *keys)

    def resample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        summed = _summed_draws(seed, draws, digests)
        next(summed)
        group: tuple | None = None
        held: list[np.ndarray] = []
        fields: list[pa.Field] = []

        def drawn() -> pa.RecordBatch:
            s = summed.send(np.concatenate(held))
            known = (s[:, 1] > 0) & (s[:, 3] > 0)
            n = np.where(known[:, None], s[:, [1, 3]], 1.0)
            difference = pa.array(s[:, 0] / n[:, 0] - s[:, 2] / n[:, 1], pa.float64(), mask=~known)
            if listed:
                columns, rows = [pa.ListArray.from_arrays(pa.array([0, draws], pa.int32()), difference)], 1
            else:
                columns, rows = [pa.array(range(draws), pa.int32()), difference], draws
            return pa.RecordBatch.from_arrays([*(pa.array([k] * rows, f.type) for k, f in zip(group, fields)), *columns], names=[*keys, *made])

        for batch in batches:
            fields = list(batch.schema)[4:]
            values = np.column_stack([batch.column(i).to_numpy() for i in range(4)])
            names = list(zip(*(batch.column(i).to_pylist() for i in range(4, batch.num_columns)))) if keys else [()] * batch.num_rows
            at = 0
            for name, same in groupby(names):
                size = sum(1 for _ in same)
                if held and name != group:
                    yield drawn()
                    held = []
                group = name
                held.append(values[at : at + size])
                at += size
        if held:
            yield drawn()

    types = {k: units.schema[k].dataType.simpleString() for k in keys} | made
    return ordered.mapInArrow(resample, ", ".join(f"`{k}` {t}" for k, t in types.items()))


def median_bootstrap(df: DataFrame, keys: Sequence[str], unit: str, value: str, draws: int, seed: str) -> DataFrame:
    """keys, draw and median of the units that the draw picks."""
    return bootstrap_index(df, keys, unit, draws, seed).join(df.select(*keys, unit, value), [*keys, unit]).groupBy(*keys, "draw").agg(F.percentile(value, 0.5).alias("median"))


def uniform_null(df: DataFrame, unit: str, options: int, draws: int, seed: str) -> DataFrame:
    """draw and accuracy of guesses at random among ``options`` for each unit."""
    hit = (uniform32(seed, F.col("draw"), F.col(unit)) % options == 0).cast("int")
    return with_draws(df.select(unit).distinct(), draws).groupBy("draw").agg((F.sum(hit) / F.count(F.lit(1))).alias("accuracy"))


def locate_in_null(observed: DataFrame, value: str, null: DataFrame, sample: str) -> DataFrame:
    """``observed`` with lower_p, upper_p and two_sided_p: shares of the null's draws as low and as high, each with one added."""
    draws = sorted(r[0] for r in null.select(sample).collect())  # as many as draws were asked for
    low = (1 + F.size(F.filter(F.lit(draws), lambda x: x <= F.col(value)))) / (len(draws) + 1)
    high = (1 + F.size(F.filter(F.lit(draws), lambda x: x >= F.col(value)))) / (len(draws) + 1)
    return observed.select(*observed.columns, low.alias("lower_p"), high.alias("upper_p"), F.least(F.lit(1.0), 2 * F.least(low, high)).alias("two_sided_p"))


def suppressed(value: Column, cleared: Column) -> Column:
    """The value where its gate cleared, else null; a null gate didn't clear."""
    return F.when(F.coalesce(cleared, F.lit(False)), value)


def parity(a: DataFrame, b: DataFrame, keys: Sequence[str], ps: Sequence[str], by: Sequence[str]) -> DataFrame:
    """By group: rows in both, the largest absolute difference of the probabilities, and rows whose largest one is another."""
    from windrow.functions.values import argmax_letter

    right = b.select(*keys, *[F.col(p).alias(f"_{p}") for p in ps])
    both = a.join(right, list(keys))
    first, second = argmax_letter([F.col(p) for p in ps]), argmax_letter([F.col(f"_{p}") for p in ps])
    return both.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.max(F.greatest(*[F.abs(F.col(p) - F.col(f"_{p}")) for p in ps])).alias("max_diff"), F.count_if(first != second).alias("n_other"))


def top_k_threshold(df: DataFrame, keys: Sequence[str], value: str, k: int) -> DataFrame:
    """keys, threshold (the k-th largest value, or the least of fewer) and n_at_least (with ties); values are counted before they are ranked."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_c"))
    own = W.partitionBy(*keys).orderBy(F.desc(value))
    before = counts.withColumn("_before", F.coalesce(F.sum("_c").over(own.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).where(F.col("_before") < k)
    return before.groupBy(*keys).agg(F.min(value).alias("threshold"), F.sum("_c").alias("n_at_least"))


def near_chance(correct: Column, total: Column, chance: float = 0.25, high: float = 0.70) -> Column:
    """near_chance within two standard errors of chance, high above ``high``, else intermediate; null for no rows."""
    se = F.sqrt(F.lit(chance * (1 - chance)) / total)
    share = correct / total
    return F.when(total > 0, F.when(F.abs(share - chance) <= 2 * se, "near_chance").when(share > high, "high").otherwise("intermediate"))
