"""Contracts between tables: trees, manifests, signatures, polarity, replication, regression, agreement, typed records.

Each gives the violations as ids, like :mod:`windrow.operators.gates`, or one row of a verdict; all failures are gathered,
never only the first.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from windrow.operators.gates import rule


def _id(*columns: str | Column) -> Column:
    return F.concat_ws(",", *[F.col(c).cast("string") if isinstance(c, str) else c.cast("string") for c in columns])


def taxonomy(df: DataFrame, key: str, parent: str, level: str, top: str, below: str) -> DataFrame:
    """id and problem of each node of a two-level tree that breaks it: another level, a top node with a parent, a lower node whose
    parent is missing or no top node. A null parent is none."""
    tops = df.where(F.col(level) == top).select(F.col(key).alias("_p")).where("_p is not null").distinct().withColumn("_is", F.lit(True))
    d = df.join(tops, F.col(parent) == F.col("_p"), "left")
    problem = (
        F.when(F.col(level).isNull() | ~F.col(level).isin(top, below), "level").when((F.col(level) == top) & F.col(parent).isNotNull(), "top with parent").when((F.col(level) == below) & F.col("_is").isNull(), "parent")
    )
    return d.select(F.col(key).cast("string").alias("id"), problem.alias("problem")).where("problem is not null").distinct()


def manifest(df: DataFrame, keys: Sequence[str], text: str) -> DataFrame:
    """Digest of each key's text, null for a null text; repeated rows give one."""
    return df.select(*keys, F.sha2(F.col(text), 256).alias("digest")).distinct()


def manifest_changes(expected: DataFrame, found: DataFrame, keys: Sequence[str], digest: str = "digest") -> DataFrame:
    """keys and problem ('missing', 'unexpected' or 'changed') where two manifests differ."""
    a, b = expected.select(*keys, F.col(digest).alias("_a"), F.lit(True).alias("_l")), found.select(*keys, F.col(digest).alias("_b"), F.lit(True).alias("_r"))
    both = a.join(b, list(keys), "full_outer")
    problem = F.when(F.col("_r").isNull(), "missing").when(F.col("_l").isNull(), "unexpected").when(~F.col("_a").eqNullSafe(F.col("_b")), "changed")
    return both.select(*keys, problem.alias("problem")).where("problem is not null")


def signature(columns: Sequence[str]) -> Column:
    """One digest of a row's settings, with nulls told from texts."""
    return F.sha2(F.concat_ws("|", *[F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("null")) for c in columns]), 256)


def table_digest(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """n and digest of each group's set of rows, whatever their order: row digests' first 15 hex digits are added up, so that no
    group is gathered or sorted."""
    part = F.conv(F.substring(signature(columns), 1, 15), 16, 10).cast("decimal(38,0)")
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.sum(part).cast("string").alias("digest"))


def ordered_equal(a: DataFrame, b: DataFrame, keys: Sequence[str], place: str, id_column: str) -> DataFrame:
    """keys, n_a, n_b, same_set and same_order of the ids of two tables by group, compared place by place."""
    x, y = (d.select(*keys, F.col(place).alias("_k"), F.col(id_column).alias(c)) for d, c in ((a, "_a"), (b, "_b")))
    aligned = x.join(y, [*keys, "_k"], "full_outer").groupBy(*keys).agg(F.count("_a").alias("n_a"), F.count("_b").alias("n_b"), F.coalesce(F.bool_and(F.col("_a").eqNullSafe(F.col("_b"))), F.lit(False)).alias("same_order"))
    sets = x.select(*keys, F.col("_a").alias("_i"), F.lit(1).alias("_l"), F.lit(0).alias("_r")).union(y.select(*keys, F.col("_b"), F.lit(0), F.lit(1))).groupBy(*keys, "_i").agg(F.max("_l").alias("_l"), F.max("_r").alias("_r"))
    same = sets.groupBy(*keys).agg(F.bool_and(F.col("_l") == F.col("_r")).alias("same_set"))
    return aligned.join(same, list(keys)).select(*keys, "n_a", "n_b", "same_set", "same_order")


def polarity(df: DataFrame, row: str, column: str, passes: str, expected: Sequence[tuple[str, str, bool]]) -> DataFrame:
    """row, column, expected, found and sound for each required cell; a missing cell isn't sound, of several rows all must agree."""
    want = df.sparkSession.createDataFrame(list(expected), f"{row} string, {column} string, expected boolean")
    got = df.groupBy(row, column).agg(F.bool_and(passes).alias("_and"), F.bool_or(passes).alias("_or"))
    both = want.join(got, [row, column], "left")
    found = F.when(F.col("_and") == F.col("_or"), F.col("_and"))
    return both.select(row, column, "expected", found.alias("found"), F.coalesce(found == F.col("expected"), F.lit(False)).alias("sound"))


def agreement(df: DataFrame, a: str, b: str, least: float, rows: int | None = None) -> DataFrame:
    """n, n_equal, share and passes: whether two labels agree often enough, over exactly ``rows`` rows if that is asked."""
    g = df.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(a).eqNullSafe(F.col(b))).alias("n_equal"))
    share = F.when(F.col("n") > 0, F.col("n_equal") / F.col("n"))
    enough = F.coalesce(share >= least, F.lit(False))
    return g.select("n", "n_equal", share.alias("share"), (enough & (F.col("n") == rows) if rows is not None else enough).alias("passes"))


def replication(a: DataFrame, b: DataFrame, keys: Sequence[str], step: str, k: str, n: str, tolerance: float) -> DataFrame:
    """keys, step, difference and passes: counts equal at step 0, accuracies within the tolerance after it."""
    right = b.select(*keys, step, F.col(k).alias("_k"), F.col(n).alias("_n"))
    both = a.join(right, [*keys, step])
    d = F.col(k) / F.col(n) - F.col("_k") / F.col("_n")
    return both.select(*keys, step, d.alias("difference"), F.when(F.col(step) == 0, (F.col(k) == F.col("_k")) & (F.col(n) == F.col("_n"))).otherwise(F.abs(d) <= tolerance).alias("passes"))


def regression(found: DataFrame, stored: DataFrame, keys: Sequence[str], value: str, tolerance: float) -> DataFrame:
    """keys, found, stored and state of each figure: 'equal' within the tolerance to the stored report, 'differs', 'missing' or 'unexpected'."""
    a, b = found.select(*keys, F.col(value).alias("found"), F.lit(True).alias("_l")), stored.select(*keys, F.col(value).alias("stored"), F.lit(True).alias("_r"))
    both = a.join(b, list(keys), "full_outer")
    equal = F.coalesce(F.abs(F.col("found") - F.col("stored")) <= tolerance, F.col("found").eqNullSafe(F.col("stored")))
    state = F.when(F.col("_l").isNull(), "missing").when(F.col("_r").isNull(), "unexpected").when(equal, "equal").otherwise("differs")
    return both.select(*keys, "found", "stored", state.alias("state"))


def typed_record(df: DataFrame, payload: str, fields: Sequence[tuple[str, str]], keys: Sequence[str]) -> DataFrame:
    """id and problems of each JSON record that lacks a field or has another type: 'no object', 'missing x' or 'type x'. Types
    are number, string, boolean, array and object."""
    v = F.try_parse_json(F.col(payload))
    kinds = {"number": ("BIGINT", "DOUBLE", "DECIMAL"), "string": ("STRING",), "boolean": ("BOOLEAN",), "array": ("ARRAY",), "object": ("OBJECT",)}
    kind = F.schema_of_variant(v)
    found = []
    for name, want in fields:
        got = F.schema_of_variant(F.try_variant_get(v, f"$.{name}", "variant"))
        ok = F.array_contains(F.array(*[F.lit(k) for k in kinds[want]]), F.regexp_extract(got, r"^([A-Z]+)", 1))
        found.append(F.when(got.isNull(), F.lit(f"missing {name}")).when(~ok, F.lit(f"type {name}")))
    problems = F.when(F.coalesce(F.startswith(kind, F.lit("OBJECT")), F.lit(False)), F.array_compact(F.array(*found))).otherwise(F.array(F.lit("no object")))
    return df.select(_id(*keys).alias("id"), problems.alias("problems")).where("size(problems) > 0")


def value_space(df: DataFrame, dimension: str, value: str, least: int) -> DataFrame:
    """dimension and its sorted values that at least ``least`` rows have: the closed space that later values must lie in."""
    v = df.where(F.col(dimension).isNotNull() & F.col(value).isNotNull()).groupBy(dimension, value).agg(F.count(F.lit(1)).alias("_c")).where(F.col("_c") >= least)
    return v.groupBy(dimension).agg(F.array_sort(F.collect_list(value)).alias("space"))  # values that pass are few by the threshold


def outside_space(df: DataFrame, dimension: str, value: str, space: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose value isn't in its dimension's space, or whose dimension has none."""
    return rule(df.where(F.col(value).isNotNull()).join(F.broadcast(space), dimension, "left"), F.array_contains("space", F.col(value)), keys)


def most_per_group(df: DataFrame, keys: Sequence[str], most: int) -> DataFrame:
    """Groups with more than ``most`` rows."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_c")).where(F.col("_c") > most).select(_id(*keys).alias("id"))


def exact_view(df: DataFrame, key: str, ids: DataFrame) -> DataFrame:
    """Rows whose key is among ``ids``; the job stops where an id has no row, with one such id in the message."""
    wanted = ids.select(F.col(key).alias("_w")).distinct()
    both = wanted.join(df, F.col("_w") == F.col(key), "left")
    sound = F.when(F.col(key).isNotNull(), F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("no row for "), F.col("_w").cast("string"))).cast("boolean"))
    return both.where(sound).select(*df.columns)
