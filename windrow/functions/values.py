"""Digests, identifiers, numbers and verdicts as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def digest(x: Column) -> Column:
    return F.sha2(x, 256)


def stable_int(x: Column) -> Column:
    """The number of the first eight hex digits of the digest."""
    return F.conv(F.substr(digest(x), F.lit(1), F.lit(8)), 16, 10).cast("long")


def mod10(x: Column) -> Column:
    """The whole 256-bit digest modulo ten; every higher hex digit counts 6, since 16^k is 6 modulo 10."""
    digits = F.transform(F.split(digest(x), ""), lambda d: F.conv(d, 16, 10).cast("int"))
    whole = F.filter(digits, lambda d: d.isNotNull())
    others = F.aggregate(F.slice(whole, 1, 63), F.lit(0), lambda a, d: a + d)
    return (F.element_at(whole, 64) + 6 * others) % 10


def safe_divide(a: Column, b: Column, eps: float = 1e-12) -> Column:
    """Null where the divisor is (almost) zero."""
    return F.when(F.abs(b) > eps, F.try_divide(a, b))


def step_label(step: Column) -> Column:
    return F.when(step.isNull() | (step == float("inf")), "inf").when(step <= 1, "<=1").otherwise(step.cast("int").cast("string"))


def histogram_bin(n: Column) -> Column:
    """Bins 1, 2, 3-5, 6-10, 11-25, 26+; null below 1."""
    return F.when(n < 1, F.lit(None)).when(n <= 2, n.cast("string")).when(n <= 5, "3-5").when(n <= 10, "6-10").when(n <= 25, "11-25").when(n > 25, "26+")


def score_band(x: Column) -> Column:
    return F.when(x < 0.5, "<0.5").when(x < 0.7, "0.5-<0.7").when(x < 0.8, "0.7-<0.8").when(x == 0.8, "exactly_0.8").when(x > 0.8, ">0.8")


def order_verdict(a: Column, b: Column) -> Column:
    """Three-valued comparison of two first steps; where neither was reached there is nothing to compare."""
    inf = float("inf")
    return F.when((a == inf) & (b == inf), "not_evaluable").when(a < b, "earlier").when(a > b, "later").otherwise("equal")


def wilson(k: Column, n: Column, z: float = 1.959963984540054) -> tuple[Column, Column]:
    """Lower and upper bound of the Wilson interval, within [0, 1]; null for n = 0."""
    p = safe_divide(k, n)
    centre = (p + z * z / (2 * n)) / (1 + z * z / n)
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n)
    ok = n > 0
    return F.when(ok, F.greatest(F.lit(0.0), centre - half)), F.when(ok, F.least(F.lit(1.0), centre + half))


def argmax_letter(ps: list[Column], letters: str = "ABCD") -> Column:
    """The letter of the largest, on ties the lowest; null if any is null."""
    arr = F.array(*ps)
    known = ps[0].isNotNull()
    for p in ps[1:]:
        known = known & p.isNotNull()
    return F.when(known, F.substr(F.lit(letters), F.array_position(arr, F.array_max(arr)).cast("int"), F.lit(1)))


def ties(ps: list[Column]) -> Column:
    """Whether several are the largest."""
    arr = F.array(*ps)
    return F.size(F.filter(arr, lambda x: x == F.array_max(arr))) > 1


def softmax(xs: Column) -> Column:
    top = F.array_max(xs)
    e = F.transform(xs, lambda x: F.exp(x - top))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda a, y: a + y))


def row_entropy(ps: list[Column]) -> Column:
    """Entropy in nats with 0 log 0 = 0."""
    total: Column = F.lit(0.0)
    for p in ps:
        total = total + F.when(p > 0, -p * F.log(p)).otherwise(F.when(p.isNull(), F.lit(None)).otherwise(0.0))
    return total


def cosine(a: Column, b: Column) -> Column:
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    return safe_divide(dot, norm(a) * norm(b))


def verdict(rules: list[tuple[str, Column]], otherwise: str) -> Column:
    """The name of the first condition that holds, null counting as not; else ``otherwise``."""
    out = F.lit(otherwise)
    for name, holds in reversed(rules):
        out = F.when(holds, F.lit(name)).otherwise(out)
    return out


def extended_median(v: Column) -> Column:
    """Median of a sorted array of numbers and infinities: a finite and an infinite middle give the infinite one; null for none."""
    n = F.size(v)
    low, high = F.try_element_at(v, F.floor(n / 2).cast("int")), F.try_element_at(v, (F.floor(n / 2) + 1).cast("int"))
    inf = F.lit(float("inf"))
    even = F.when(high == inf, high).when(low == -inf, low).otherwise((low + high) / 2)
    return F.when(n > 0, F.when(n % 2 == 1, high).otherwise(even))
