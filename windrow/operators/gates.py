"""Data-quality gates: each is a table of violations; a suite is one union of their counts."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def rule(df: DataFrame, holds: Column, keys: Sequence[str]) -> DataFrame:
    """Rows for which a condition doesn't hold; null counts as not holding."""
    return df.where(~F.coalesce(holds, F.lit(False))).select(F.concat_ws(",", *[F.col(k).cast("string") for k in keys]).alias("id"))


def unique(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_c")).where("_c > 1").select(F.concat_ws(",", *[F.col(k).cast("string") for k in keys]).alias("id"))


def not_null(df: DataFrame, columns: Sequence[str], keys: Sequence[str]) -> DataFrame:
    return rule(df, reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in columns]), keys)


def foreign_key(df: DataFrame, column: str, parent: DataFrame, parent_column: str) -> DataFrame:
    """Values without a parent; nulls reference nothing."""
    kids = df.select(F.col(column).alias("_v")).where("_v is not null").distinct()
    return kids.join(parent.select(F.col(parent_column).alias("_v")).distinct(), "_v", "left_anti").select(F.col("_v").cast("string").alias("id"))


def covers(df: DataFrame, columns: Sequence[str], expected: DataFrame) -> DataFrame:
    """Expected combinations that the table doesn't have."""
    return expected.select(*columns).distinct().join(df.select(*columns).distinct(), list(columns), "left_anti").select(F.concat_ws(",", *[F.col(c).cast("string") for c in columns]).alias("id"))


def row_count(df: DataFrame, n: int) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("_c")).where(F.col("_c") != n).select(F.concat(F.lit("rows: "), F.col("_c").cast("string")).alias("id"))


def probability_rows(df: DataFrame, ps: Sequence[str], keys: Sequence[str], tolerance: float = 1e-5) -> DataFrame:
    """Rows whose probabilities aren't all present, finite, within [0, 1] and of sum 1."""
    each = reduce(lambda a, b: a & b, [F.col(p).isNotNull() & ~F.isnan(p) & F.col(p).between(0, 1) for p in ps])
    total = reduce(lambda a, b: a + b, [F.col(p) for p in ps])
    return rule(df, each & (F.abs(total - 1) <= tolerance), keys)


def contiguous(df: DataFrame, keys: Sequence[str], start: str, end: str) -> DataFrame:
    """Groups whose spans overlap, leave gaps or don't begin at 0: their lengths don't add up to their extent, or starts repeat."""
    g = df.groupBy(*keys).agg(F.sum(F.col(end) - F.col(start)).alias("_len"), F.min(start).alias("_lo"), F.max(end).alias("_hi"), F.countDistinct(start).alias("_d"), F.count(F.lit(1)).alias("_n"))
    return g.where("_lo <> 0 or _len <> _hi or _d <> _n").select(F.concat_ws(",", *[F.col(k).cast("string") for k in keys]).alias("id"))


def nested(sets: Sequence[tuple[str, DataFrame]], key: str) -> DataFrame:
    """Keys of a smaller set that the next larger one lacks, for a chain that must be nested."""
    parts = [a.select(key).subtract(b.select(key)).select(F.concat(F.lit(f"{n} not in {m}: "), F.col(key).cast("string")).alias("id")) for (n, a), (m, b) in zip(sets, sets[1:])]
    return reduce(DataFrame.union, parts)


def suite(checks: Sequence[tuple[str, DataFrame]], samples: int = 5) -> DataFrame:
    """name, passes, n_violations and the least few ids of every check, in one job; a check without violations passes."""
    names = checks[0][1].sparkSession.createDataFrame([(n,) for n, _ in checks], "name string")
    rows = reduce(DataFrame.union, [v.select(F.lit(n).alias("name"), "id") for n, v in checks])
    # the least ids without gathering all: ranks within a bounded aggregate
    counted = rows.groupBy("name").agg(F.count(F.lit(1)).alias("n_violations"), F.min("id").alias("least_id"))
    out = names.join(counted, "name", "left").withColumn("n_violations", F.coalesce("n_violations", F.lit(0)))
    return out.select("name", (F.col("n_violations") == 0).alias("passes"), "n_violations", "least_id")


def constant_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """For each column its value if it is the same in every row, else 'varies'; nulls are a value."""
    one = df.agg(*[F.countDistinct(F.coalesce(F.col(c).cast("string"), F.lit("\x00"))).alias(f"_k{i}") for i, c in enumerate(columns)], *[F.min(F.col(c).cast("string")).alias(f"_v{i}") for i, c in enumerate(columns)])
    return one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.when(F.col(f"_k{i}") <= 1, F.col(f"_v{i}")).otherwise("varies").alias("value")) for i, c in enumerate(columns)])).alias("s")).select("s.*")


def forbidden_columns(df: DataFrame, forbidden: Sequence[str]) -> None:
    """Stops where an output has a column, at any depth, that it mustn't have."""
    def names(t: object, at: str = "") -> list[str]:
        out = []
        for f in getattr(t, "fields", []):
            out += [at + f.name, *names(f.dataType, f"{at}{f.name}.")]
        for inner in ("elementType", "valueType"):
            if hasattr(t, inner):
                out += names(getattr(t, inner), at)
        return out

    bad = sorted({n for n in names(df.schema) if n.rsplit(".", 1)[-1].lower() in {f.lower() for f in forbidden}})
    if bad:
        raise ValueError(f"forbidden columns: {', '.join(bad)}")


def suite_of_rules(df: DataFrame, key: str, rules: Sequence[tuple[str, Column]]) -> DataFrame:
    """``suite`` of row rules in one pass: name, passes, n_violations and the least id of each; null counts as not holding."""
    broken = [F.coalesce(~holds, F.lit(True)) for _, holds in rules]
    one = df.agg(*[F.count_if(b).alias(f"_n{i}") for i, b in enumerate(broken)], *[F.min(F.when(b, F.col(key).cast("string"))).alias(f"_m{i}") for i, b in enumerate(broken)])
    rows = [F.struct(F.lit(name).alias("name"), (F.col(f"_n{i}") == 0).alias("passes"), F.col(f"_n{i}").alias("n_violations"), F.col(f"_m{i}").alias("least_id")) for i, (name, _) in enumerate(rules)]
    return one.select(F.inline(F.array(*rows)))
