"""Entropies, mutual information and resampling statistics of labelled rows.

Labels are few, so joint counts are pre-aggregated to a bounded tensor per group before anything is resampled: a group
of any size comes to its resampling task as at most as many rows as there are label combinations.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from windrow.functions.values import safe_divide


def joint_counts(df: DataFrame, keys: Sequence[str], labels: Sequence[str]) -> DataFrame:
    """Counts of each label combination within each group; rows with a null label don't count."""
    d = df
    for c in labels:
        d = d.where(F.col(c).isNotNull())
    return d.groupBy(*keys, *labels).agg(F.count(F.lit(1)).alias("n"))


def entropy(df: DataFrame, keys: Sequence[str], labels: Sequence[str], miller_madow: bool = False) -> DataFrame:
    """Plug-in entropy in bits of the joint label, with the Miller-Madow correction (m - 1) / (2 n ln 2) if asked for."""
    joint = joint_counts(df, keys, labels)
    # H = log2 N - sum(n log2 n) / N
    total, m = F.sum("n"), F.count(F.lit(1))
    plug = F.log2(total) - F.sum(F.col("n") * F.log2("n")) / total
    return joint.groupBy(*keys).agg(total.alias("n"), m.alias("n_classes"), (plug + (m - 1) / (2 * total * math.log(2)) if miller_madow else plug).alias("entropy"))


def decomposition(df: DataFrame, keys: Sequence[str], f: str, y: str, given: str) -> DataFrame:
    """I(f;y), I(f;y|given), their difference mu (never clipped) and ratio mu / I (null where I is 0), in bits.

    One count of the joint, then entropies of five margins from it by one expansion over margins.
    """
    return decomposition_of_counts(joint_counts(df, keys, [f, y, given]), keys, f, y, given)


def decomposition_of_counts(joint: DataFrame, keys: Sequence[str], f: str, y: str, given: str) -> DataFrame:
    """``decomposition`` from counts ``n`` of each label combination; rows of one combination are added up."""
    margins = {"f": [f], "y": [y], "fy": [f, y], "l": [given], "fl": [f, given], "yl": [y, given], "fyl": [f, y, given]}
    tagged = joint.select(*keys, "n", F.explode(F.array(*[F.struct(F.lit(m).alias("_m"), F.concat_ws("\x1f", *[F.col(c).cast("string") for c in cs]).alias("_c")) for m, cs in margins.items()])).alias("_cell"))
    cells = tagged.select(*keys, "n", "_cell._m", "_cell._c").groupBy(*keys, "_m", "_c").agg(F.sum("n").alias("n"))
    h = F.sum(F.when(F.col("n") > 0, F.col("n") * F.log2("n")))
    per = cells.groupBy(*keys, "_m").agg((F.log2(F.sum("n")) - h / F.sum("n")).alias("_h"), F.sum("n").alias("n"))
    wide = per.groupBy(*keys).agg(F.max("n").alias("n"), *[F.max(F.when(F.col("_m") == m, F.col("_h"))).alias(f"h_{m}") for m in margins])
    i = F.col("h_f") + F.col("h_y") - F.col("h_fy")
    cmi = F.col("h_fl") + F.col("h_yl") - F.col("h_l") - F.col("h_fyl")
    return wide.select(*keys, "n", i.alias("i_f_y"), cmi.alias("i_f_y_given"), (i - cmi).alias("mu"), safe_divide(i - cmi, i).alias("ratio"))


def soft_information(df: DataFrame, keys: Sequence[str], ps: Sequence[str]) -> DataFrame:
    """Mutual information in nats between row and predicted label: entropy of the mean less the mean entropy."""
    known = df
    for p in ps:
        known = known.where(F.col(p).isNotNull())
    each = sum((F.when(F.col(p) > 0, -F.col(p) * F.log(p)).otherwise(0.0) for p in ps[1:]), F.when(F.col(ps[0]) > 0, -F.col(ps[0]) * F.log(ps[0])).otherwise(0.0))
    means = known.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg(each).alias("_h"), *[F.avg(p).alias(f"_m{i}") for i, p in enumerate(ps)])
    whole = sum((F.when(F.col(f"_m{i}") > 0, -F.col(f"_m{i}") * F.log(f"_m{i}")).otherwise(0.0) for i in range(1, len(ps))), F.when(F.col("_m0") > 0, -F.col("_m0") * F.log("_m0")).otherwise(0.0))
    return means.select(*keys, "n", (whole - F.col("_h")).alias("information"))


def seed_of(*parts: object) -> int:
    """A seed that names give, the same on every machine."""
    return zlib.crc32("|".join(map(str, parts)).encode())


def mi_bits(table: np.ndarray) -> np.ndarray:
    """Mutual information in bits of joint counts (..., a, b)."""
    n = table.sum(axis=(-2, -1), keepdims=True).astype(float)
    p = table / np.where(n > 0, n, 1)
    outer = p.sum(-1, keepdims=True) * p.sum(-2, keepdims=True)
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(p > 0, p * np.log2(p / outer), 0).sum((-2, -1))


def permutation_band(df: DataFrame, keys: Sequence[str], f: str, y: str, draws: int = 200, seed: int = 0) -> DataFrame:
    """I(f;y) of each group, the mean and the 95th percentile of its null under permuted labels, and whether it clears that.

    A random permutation of labels gives a table with the same margins; such tables are drawn straight from the margins
    (multivariate hypergeometric), so a group's size costs nothing. Null labels don't count.
    """
    joint = joint_counts(df, keys, [f, y])
    kinds = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        (_, fi), (_, yi) = np.unique(pdf[f].astype(str), return_inverse=True), np.unique(pdf[y].astype(str), return_inverse=True)
        table = np.zeros((fi.max() + 1, yi.max() + 1), np.int64)
        np.add.at(table, (fi, yi), pdf["n"].to_numpy(np.int64))
        rng = np.random.default_rng(seed_of(seed, *key))
        # all draws at once, cell by cell: each cell is hypergeometric given those before it
        null = np.zeros((draws, *table.shape), np.int64)
        left = np.repeat(table.sum(0)[None], draws, axis=0)
        for i, r in enumerate(table.sum(1)):
            todo = np.full(draws, r, np.int64)
            for j in range(table.shape[1]):
                rest = left[:, j + 1 :].sum(1)
                null[:, i, j] = rng.hypergeometric(left[:, j], rest, todo) if j + 1 < table.shape[1] else todo
                todo = todo - null[:, i, j]
            left = left - null[:, i]
        values, mine = mi_bits(null), float(mi_bits(table))
        p95 = float(np.percentile(values, 95))
        return pd.DataFrame([(*key, int(table.sum()), mine, float(values.mean()), p95, mine > p95)], columns=[*keys, "n", "information", "null_mean", "null_p95", "clears"])

    return joint.groupBy(*keys).applyInPandas(run, f"{kinds}, n bigint, information double, null_mean double, null_p95 double, clears boolean")


def bootstrap_accuracy(df: DataFrame, keys: Sequence[str], correct: str, cluster: str | None = None, draws: int = 500, seed: int = 0) -> DataFrame:
    """Mean of a 0/1 column with its 2.5 and 97.5 percentiles (nearest rank) over bootstrap draws, of rows or of whole clusters.

    Rows come as counts: without clusters a draw is binomial; with them a draw is multinomial over the kinds of
    clusters, those of equal sums being one kind, which has the distribution of a draw of whole clusters.
    """
    d = df.where(F.col(correct).isNotNull()).select(*keys, F.col(correct).cast("int").alias("_c"), (F.col(cluster).cast("string") if cluster else F.lit("")).alias("_u"))
    sums = d.groupBy(*keys, "_u").agg(F.sum("_c").alias("_k"), F.count(F.lit(1)).alias("_n")).groupBy(*keys, "_k", "_n").agg(F.count(F.lit(1)).alias("_m"))
    kinds = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        rng = np.random.default_rng(seed_of(seed, *key))
        pdf = pdf.sort_values(["_k", "_n"])
        k, n, m = (pdf[c].to_numpy(float) for c in ("_k", "_n", "_m"))
        total = int((m * n).sum())
        mean = (m * k).sum() / total
        if cluster is None:
            values = rng.binomial(total, mean, draws) / total
        else:
            step = max(1, 1_000_000 // len(k))
            parts = [rng.multinomial(int(m.sum()), m / m.sum(), min(step, draws - b)) for b in range(0, draws, step)]
            values = np.concatenate([(w @ k) / (w @ n) for w in parts])
        values = np.sort(values)
        low, high = values[int(0.025 * draws)], values[min(draws - 1, int(0.975 * draws))]  # nearest rank
        return pd.DataFrame([(*key, total, mean, float(low), float(high))], columns=[*keys, "n", "mean", "low", "high"])

    return sums.groupBy(*keys).applyInPandas(run, f"{kinds}, n bigint, mean double, low double, high double")


def channel_information(p: float, k: int = 4) -> float:
    """Mutual information in bits of a symmetric channel over k labels that is right with probability p."""
    if not 0 <= p <= 1:
        raise ValueError("p is a probability")
    h = lambda x: -x * math.log2(x) if x > 0 else 0.0
    return math.log2(k) - h(p) - (k - 1) * h((1 - p) / (k - 1))


def channel_for(information: float, k: int = 4, rounds: int = 80) -> float:
    """The p >= 1/k of the symmetric channel with that information, by bisection."""
    low, high = 1 / k, 1.0
    if information >= math.log2(k):
        return 1.0
    for _ in range(rounds):
        mid = (low + high) / 2
        low, high = (mid, high) if channel_information(mid, k) < information else (low, mid)
    return (low + high) / 2


def table_distance(a: DataFrame, b: DataFrame, keys: Sequence[str], ps: Sequence[str]) -> DataFrame:
    """Total variation distance of each row's distributions in two tables, and both top-two margins."""
    right = b.select(*keys, *[F.col(p).alias(f"{p}_b") for p in ps])
    both = a.join(right, list(keys))
    tv = sum((F.abs(F.col(p) - F.col(f"{p}_b")) for p in ps[1:]), F.abs(F.col(ps[0]) - F.col(f"{ps[0]}_b"))) / 2
    margin = lambda cs: F.element_at(F.sort_array(F.array(*cs), asc=False), 1) - F.element_at(F.sort_array(F.array(*cs), asc=False), 2)
    return both.select(*keys, tv.alias("tv"), margin([F.col(p) for p in ps]).alias("margin_a"), margin([F.col(f"{p}_b") for p in ps]).alias("margin_b"))


def top_k_overlap(df: DataFrame, item: str, a: str, b: str, k: int) -> DataFrame:
    """Size of the overlap of the top k items by two scores, ties by item, and its lift over chance; one row."""
    ranked = lambda c: df.where(F.col(c).isNotNull()).orderBy(F.desc(c), item).limit(k).select(item)  # noqa: E731 - top k is what is asked
    n = df.select(item).distinct().count()
    return ranked(a).join(ranked(b), item).agg(F.count(F.lit(1)).alias("overlap")).withColumn("n", F.lit(n)).select("overlap", "n", safe_divide(F.col("overlap") * F.col("n"), F.lit(float(k) * k)).alias("lift"))
