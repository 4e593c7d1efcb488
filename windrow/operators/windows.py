"""Ranks, coverage curves, first crossings and series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from windrow.operators.prefix import running


def coverage_curve(df: DataFrame, entity: str, doc: str) -> DataFrame:
    """Rank of each entity by (-documents, entity), the documents it adds to those of better ranks, and their running sum.

    Each document belongs to its best rank, so the curve is a count per rank and a sum over ranks, not a union of sets.
    """
    pairs = df.select(entity, doc).distinct()
    sizes = pairs.groupBy(entity).agg(F.count(F.lit(1)).alias("n_docs"))
    ranked = running(sizes, [F.desc("n_docs"), F.col(entity)], {"rank": "1"})
    home = pairs.join(ranked.select(entity, "rank"), entity).groupBy(doc).agg(F.min("rank").alias("rank"))
    gains = home.groupBy("rank").agg(F.count(F.lit(1)).alias("_g"))
    gained = ranked.join(gains, "rank", "left").withColumn("gain", F.coalesce("_g", F.lit(0))).drop("_g")
    return running(gained, [F.col("rank")], {"covered": "gain"})


def ranks_reaching(curve: DataFrame, shares: Sequence[float]) -> DataFrame:
    """The first rank at which the curve reaches each share of all that it covers."""
    total = curve.agg(F.max("covered")).first()[0]
    cells = curve.select("rank", (F.col("covered") / F.lit(total)).alias("_c"), F.explode(F.array(*[F.lit(s) for s in shares])).alias("share"))
    return cells.where("_c >= share").groupBy("share").agg(F.min("rank").alias("rank"))


def first_step(df: DataFrame, keys: Sequence[str], step: str, value: str, threshold: float) -> DataFrame:
    """The first step whose value isn't null and reaches the threshold, infinity if none does."""
    hit = F.min(F.when(F.col(value) >= threshold, F.col(step)))
    return df.groupBy(*keys).agg(F.coalesce(hit.cast("double"), F.lit(float("inf"))).alias("first_step"))


def peak(df: DataFrame, keys: Sequence[str], step: str, value: str) -> DataFrame:
    """The step of the largest value, the earliest on ties, and that value; null if all values are."""
    return df.groupBy(*keys).agg(F.max_by(F.when(F.col(value).isNotNull(), F.col(step)), F.when(F.col(value).isNotNull(), F.struct(F.col(value), -F.col(step)))).alias("peak_step"), F.max(value).alias("peak_value"))


def delta_from_start(df: DataFrame, keys: Sequence[str], step: str, value: str) -> DataFrame:
    """Each value less that of the run's step 0 (null without one), and less that of the previous step."""
    start = df.where(F.col(step) == 0).groupBy(*keys).agg(F.first(value, ignorenulls=True).alias("_s"))
    before = F.lag(value).over(W.partitionBy(*keys).orderBy(step))
    return df.withColumn("_p", before).join(start, list(keys), "left").withColumn("delta_start", F.col(value) - F.col("_s")).withColumn("delta_step", F.col(value) - F.col("_p")).drop("_s", "_p")


def densified(df: DataFrame, keys: Sequence[str], step: str, values: Sequence[str], steps: Sequence[int]) -> DataFrame:
    """Every key with every step; values of missing steps are null."""
    grid = df.select(*keys).distinct().select(*keys, F.explode(F.array(*[F.lit(s).cast(df.schema[step].dataType) for s in steps])).alias(step))
    return grid.join(df.select(*keys, step, *values), [*keys, step], "left")


def certified_through(df: DataFrame, keys: Sequence[str], step: str, passes: str) -> DataFrame:
    """The last step of the longest prefix of passing steps; null if the first fails. A null counts as failing."""
    bad = F.min(F.when(~F.coalesce(F.col(passes), F.lit(False)), F.col(step))).over(W.partitionBy(*keys))
    return df.withColumn("_bad", bad).groupBy(*keys).agg(F.max(F.when(F.col("_bad").isNull() | (F.col(step) < F.col("_bad")), F.col(step))).alias("certified_step"))


def streaks(df: DataFrame, keys: Sequence[str], order: str, kind: str, least: int = 3) -> DataFrame:
    """Runs of at least ``least`` rows of one kind in order: keys, kind, first, last, n."""
    w = W.partitionBy(*keys).orderBy(order)
    isle = F.row_number().over(w) - F.row_number().over(W.partitionBy(*keys, kind).orderBy(order))
    return df.withColumn("_isle", isle).groupBy(*keys, kind, "_isle").agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).drop("_isle")


def overlapping_chunks(df: DataFrame, key: str, tokens: str, n: int, overlap: int) -> DataFrame:
    """About ``n`` chunks of a token array: size ceil(len/n), each beginning ``size - overlap`` after the last, until one ends the array."""
    size = F.ceil(F.size(tokens) / F.lit(n)).cast("int")
    stride = F.greatest(F.lit(1), size - overlap)
    count = F.greatest(F.lit(1), F.ceil((F.size(tokens) - size) / stride).cast("int") + 1)
    made = df.where(F.size(tokens) > 0).select(key, tokens, size.alias("_s"), stride.alias("_d"), F.posexplode(F.sequence(F.lit(0), count - 1)).alias("chunk", "_k"))
    return made.select(key, "chunk", F.slice(tokens, F.col("_k") * F.col("_d") + 1, F.col("_s")).alias("tokens"))


def value_at(df: DataFrame, rank: str, value: str, places: Sequence[int]) -> DataFrame:
    """k and ``value`` at each of the places, clamped to the last rank."""
    most = df.agg(F.max(rank)).first()[0] or 0
    wanted = df.sparkSession.createDataFrame([(k, min(k, most)) for k in places], "k int, _r int")
    return df.join(F.broadcast(wanted), F.col(rank) == F.col("_r")).select("k", value)
