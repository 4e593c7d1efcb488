"""Joins with checks, phrase joins through n-grams, co-occurrence and reconciliation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from windrow.functions import text as X
from windrow.session import small_enough, widened

#: Parts over which a self join spreads each group.
SALTS = 8


def aligned(left: DataFrame, right: DataFrame, keys: Sequence[str], agree: Sequence[str] = ()) -> DataFrame:
    """Inner equi join in which every left row must have a right one that agrees on the columns ``agree``.

    A row without partner, or with one that differs, stops the job when it is read, with its key in the message.
    """
    r = right.select(*keys, *[F.col(c).alias(f"_r_{c}") for c in right.columns if c not in keys])
    both = left.join(r.withColumn("_there", F.lit(True)), list(keys), "left")
    key = F.concat_ws(",", *[F.col(k).cast("string") for k in keys])
    sound = F.col("_there").isNotNull()
    for c in agree:
        sound = sound & F.col(c).eqNullSafe(F.col(f"_r_{c}"))
    checked = F.when(sound, F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("no agreeing partner for "), key)).cast("boolean"))
    return both.where(checked).drop("_there")


def reconcile(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Both-way difference of two key sets: keys and side ('left_only' or 'right_only')."""
    a = left.select(*keys).distinct().withColumn("_l", F.lit(1))
    b = right.select(*keys).distinct().withColumn("_r", F.lit(1))
    both = a.join(b, list(keys), "full_outer")
    return both.where("_l is null or _r is null").select(*keys, F.when(F.col("_r").isNull(), "left_only").otherwise("right_only").alias("side"))


def phrase_hits(texts: DataFrame, key: str, text: str, phrases: DataFrame, phrase_key: str, phrase: str) -> DataFrame:
    """Distinct (key, phrase key) of the texts that hold a phrase as whole words, through n-grams of the phrases' widths.

    Only the widths that phrases have are made. A phrase list of checked size is broadcast, else both sides are
    shuffled by the phrase. Blank phrases hold nothing.
    """
    wanted = phrases.select(F.col(phrase_key), X.words(F.col(phrase)).alias("_w")).where("size(_w) > 0").select(phrase_key, F.array_join("_w", " ").alias("_gram"), F.size("_w").alias("_n")).distinct()
    widths = sorted(r[0] for r in wanted.select("_n").distinct().collect())
    if not widths:
        return texts.select(key).limit(0).withColumn(phrase_key, F.lit(None).cast(phrases.schema[phrase_key].dataType))
    ws = X.words(F.col(text))
    grams = F.flatten(F.array(*[X.ngrams(F.col("_ws"), n) for n in widths]))
    made = widened(texts.select(key, text)).select(F.col(key), ws.alias("_ws")).where("_ws is not null").select(key, F.explode(F.array_distinct(grams)).alias("_gram"))
    side = wanted.select(phrase_key, "_gram")
    return made.join(F.broadcast(side) if small_enough(side) else side, "_gram").select(key, phrase_key).distinct()


def cooccurrence(df: DataFrame, group: str, member: str) -> DataFrame:
    """Undirected weighted edges (src < dst, weight) of members that share groups; weight counts distinct groups.

    A group of m members has m(m-1)/2 edges by definition. No group is gathered into a row: a self join makes the
    pairs, and each group is spread over ``SALTS`` parts, the lesser members by hash, the greater ones copied to each.
    """
    one = df.select(F.col(group).alias("_g"), F.col(member).alias("_m")).where("_g is not null and _m is not null").distinct()
    left = one.select("_g", F.pmod(F.xxhash64("_m"), F.lit(SALTS)).cast("int").alias("_s"), F.col("_m").alias("src"))
    right = one.select("_g", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_s"), F.col("_m").alias("dst"))
    return left.join(right, ["_g", "_s"]).where("src < dst").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("weight"))


def matched_partner(df: DataFrame, keys: Sequence[str], kind: str, own: str, other: str, values: Sequence[str]) -> DataFrame:
    """Rows of kind ``own`` with the values of the row of kind ``other`` that has the same ``keys``."""
    b = df.where(F.col(kind) == other).select(*keys, *[F.col(v).alias(f"{v}_partner") for v in values])
    return df.where(F.col(kind) == own).join(b, list(keys))


def nearest_string(left: DataFrame, key: str, text: str, candidates: DataFrame, group: str, candidate: str) -> DataFrame:
    """For each left row the candidate of its group that is most alike; ties go to the shorter, then the lesser."""
    both = left.join(candidates.select(group, F.col(candidate).alias("candidate")), group).withColumn("similarity", X.ratio(F.col(text), F.col("candidate")))
    best = F.min_by(F.struct("candidate", "similarity"), F.struct(-F.col("similarity"), F.length("candidate"), F.col("candidate")))
    return both.groupBy(key).agg(best.alias("_b")).select(key, "_b.*")


def unique_owner(df: DataFrame, key: str, cited: str, owners: DataFrame, owner: str, owned: str) -> DataFrame:
    """key and the owner whose ids hold all that the row cites, if there is exactly one."""
    rows = df.select(key, F.array_distinct(cited).alias("_c"), F.explode(F.array_distinct(cited)).alias("_id"))
    hits = rows.join(owners.select(owner, F.explode(owned).alias("_id")).distinct(), "_id").groupBy(key, owner, F.size("_c").alias("_n")).agg(F.count(F.lit(1)).alias("_k")).where("_k = _n")
    return hits.withColumn("_of", F.count(F.lit(1)).over(W.partitionBy(key))).where("_of = 1").select(key, owner)


def zipped(left: DataFrame, right: DataFrame, keys: Sequence[str], order: str, values: Sequence[str]) -> DataFrame:
    """Rows of two tables side by side by their places in the order within each group: keys, ``order`` and ``values`` of the left, the
    same of the right with the suffix _right, and aligned (whether the order values are equal). Places without a partner are left out."""
    own = W.partitionBy(*keys).orderBy(order)
    a = left.select(*keys, order, *values).withColumn("_k", F.row_number().over(own))
    b = right.select(*keys, order, *values).withColumn("_k", F.row_number().over(own)).select(*keys, "_k", *[F.col(c).alias(f"{c}_right") for c in (order, *values)])
    return a.join(b, [*keys, "_k"]).drop("_k").withColumn("aligned", F.col(order).eqNullSafe(F.col(f"{order}_right")))
