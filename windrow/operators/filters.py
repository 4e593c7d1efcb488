"""Ordered filter cascades and first-reject funnels, in one pass over the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def first_match(rules: Sequence[tuple[str, Column]]) -> Column:
    """The label of the first rule that holds, else null. A null condition doesn't hold."""
    if not rules:
        return F.lit(None).cast("string")
    out = F.when(rules[0][1], rules[0][0])
    for label, holds in rules[1:]:
        out = out.when(holds, label)
    return out


def cascade(df: DataFrame, rules: Sequence[tuple[str, Column]], stage: str = "stage", reason: str = "reason") -> DataFrame:
    """``df`` with the stage (from 0) and reason by which a row is removed, both null for survivors.

    Rule i only sees the survivors of the rules before it: the first that holds removes the row.
    """
    for c in (stage, reason):
        if c in df.columns:
            raise ValueError(f"{c} is a column already; name another")
    number = F.when(rules[0][1], 0) if rules else F.lit(None).cast("int")
    for i, (_, holds) in enumerate(rules[1:], 1):
        number = number.when(holds, i)
    return df.withColumns({stage: number, reason: first_match(rules)})


def funnel(df: DataFrame, rules: Sequence[tuple[str, Column]]) -> DataFrame:
    """What each rule removes and what is left: reason, n; the reasons add up to all rows. Survivors are 'accepted'."""
    return df.select(F.coalesce(first_match(rules), F.lit("accepted")).alias("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def high_degree(df: DataFrame, item: str, entity: str, most: int) -> DataFrame:
    """Pairs of item and entity without the entities that more than ``most`` items have."""
    degree = df.groupBy(entity).agg(F.countDistinct(item).alias("_degree")).where(F.col("_degree") > most)
    return df.join(degree.select(entity), entity, "left_anti")
