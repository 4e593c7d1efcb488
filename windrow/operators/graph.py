"""Graphs as edge tables: components, degrees, densities and splits without leakage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from windrow.session import written


def components(edges: DataFrame, nodes: DataFrame | None = None, src: str = "src", dst: str = "dst", rounds: int = 50) -> DataFrame:
    """node and component, its least node, of every node of the undirected graph; lone ``nodes`` are their own.

    Alternating large-star and small-star steps, which need a logarithmic number of rounds whatever the graph's
    diameter. Each round is written to the shared folder: the lineage stays short and survives a lost executor.
    Null ends make no edge. Labels are never gathered on the driver. Raises if it hasn't settled after ``rounds``.
    """
    e = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u is not null and v is not null and u <> v")
    pairs = written(e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    state = None
    for _ in range(rounds):
        # large star: each larger neighbour of u is tied to the least of u and its neighbours
        both = pairs.union(pairs.select(F.col("v"), F.col("u")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: u and its lesser neighbours are tied to the least of these
        down = large.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        small_least = down.groupBy("u").agg(F.min("v").alias("m"))
        joined = down.join(small_least, "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(joined.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        pairs = written(small, "edges", replaces=pairs)
        now = pairs.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.sum(F.xxhash64("v", "u", F.lit(7)).cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    else:
        raise RuntimeError(f"components haven't settled after {rounds} rounds")
    ends = e.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    if nodes is not None:
        ends = ends.union(nodes.select(F.col(nodes.columns[0])).where(F.col(nodes.columns[0]).isNotNull())).distinct()
    return ends.join(pairs.select(F.col("u").alias("node"), F.col("v").alias("component")), "node", "left").withColumn("component", F.coalesce("component", "node"))


def star(links: DataFrame, group: str, member: str) -> DataFrame:
    """Edges that tie each member to the least member of each of its groups: one a link, however large the group.

    They have the components of the graph of all pairs within groups.
    """
    one = links.select(F.col(group).alias("_g"), F.col(member).alias("src")).where("_g is not null and src is not null").distinct()
    return one.join(one.groupBy("_g").agg(F.min("src").alias("dst")), "_g").where("src <> dst").select("src", "dst").distinct()


def component_sizes(labels: DataFrame) -> DataFrame:
    return labels.groupBy("component").agg(F.count(F.lit(1)).alias("size"))


def size_distribution(labels: DataFrame) -> DataFrame:
    return component_sizes(labels).groupBy("size").agg(F.count(F.lit(1)).alias("n_components"))


def degrees(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, degree and strength of all nodes; isolated ones have 0. Weights that are missing count 1."""
    weight = F.col("weight") if "weight" in edges.columns else F.lit(1)
    ends = edges.select(F.explode(F.array("src", "dst")).alias("node"), weight.alias("w")).groupBy("node").agg(F.count(F.lit(1)).alias("degree"), F.sum("w").alias("strength"))
    return nodes.select(F.col(nodes.columns[0]).alias("node")).distinct().join(ends, "node", "left").fillna({"degree": 0, "strength": 0})


def density(edges: DataFrame, membership: DataFrame, node: str, group: str) -> DataFrame:
    """Weight within each group over its number of pairs, and its number of members; 0 for a lone member."""
    m = membership.select(F.col(node).alias("_n"), F.col(group).alias("_g")).distinct()
    sizes = m.groupBy("_g").agg(F.count(F.lit(1)).alias("n_members"))
    a = m.withColumnsRenamed({"_n": "src", "_g": "_ga"})
    b = m.withColumnsRenamed({"_n": "dst", "_g": "_gb"})
    inner = edges.join(a, "src").join(b, "dst").where("_ga = _gb").groupBy(F.col("_ga").alias("_g")).agg(F.sum("weight").alias("_w"))
    pairs = F.col("n_members") * (F.col("n_members") - 1) / 2
    return sizes.join(inner, "_g", "left").select(F.col("_g").alias(group), "n_members", F.coalesce(F.try_divide(F.col("_w"), pairs), F.lit(0.0)).alias("density"))


def cross_weights(edges: DataFrame, membership: DataFrame, node: str, group: str) -> DataFrame:
    """Weight of the edges between each two groups (group_a < group_b)."""
    m = membership.select(F.col(node).alias("_n"), F.col(group).alias("_g")).distinct()
    both = edges.join(m.withColumnsRenamed({"_n": "src", "_g": "_a"}), "src").join(m.withColumnsRenamed({"_n": "dst", "_g": "_b"}), "dst").where("_a <> _b")
    return both.groupBy(F.least("_a", "_b").alias("group_a"), F.greatest("_a", "_b").alias("group_b")).agg(F.sum("weight").alias("weight"))


def link_density(links: DataFrame, item: str, entity: str, membership: DataFrame, node: str, group: str) -> DataFrame:
    """``density`` of the co-occurrence graph of ``links``, from the counts of members by item and group; no pairs are made."""
    m = membership.select(F.col(node).alias("_n"), F.col(group).alias("_g")).distinct()
    sizes = m.groupBy("_g").agg(F.count(F.lit(1)).alias("n_members"))
    counts = _members_of_items(links, item, entity, m).groupBy("_i", "_g").agg(F.count(F.lit(1)).alias("_k"))
    inner = counts.groupBy("_g").agg(F.sum(F.expr("_k * (_k - 1) div 2")).alias("_w"))
    pairs = F.col("n_members") * (F.col("n_members") - 1) / 2
    return sizes.join(inner, "_g", "left").select(F.col("_g").alias(group), "n_members", F.coalesce(F.try_divide(F.col("_w"), pairs), F.lit(0.0)).alias("density"))


def link_cross_weights(links: DataFrame, item: str, entity: str, membership: DataFrame, node: str, group: str) -> DataFrame:
    """``cross_weights`` of the co-occurrence graph of ``links``, from the counts of members by item and group.

    An item with k members in a and l in b has k * l ordered pairs, of which those of a member of both with itself are no edges.
    """
    m = membership.select(F.col(node).alias("_n"), F.col(group).alias("_g")).distinct()
    of = _members_of_items(links, item, entity, m)
    counts = of.groupBy("_i", "_g").agg(F.count(F.lit(1)).alias("_k"))
    both = counts.select("_i", F.col("_g").alias("group_a"), F.col("_k").alias("_ka")).join(counts.select("_i", F.col("_g").alias("group_b"), "_k"), "_i").where("group_a < group_b")
    own = of.select("_i", "_n", F.col("_g").alias("group_a")).join(of.select("_i", "_n", F.col("_g").alias("group_b")), ["_i", "_n"]).where("group_a < group_b")
    parts = both.select("group_a", "group_b", (F.col("_ka") * F.col("_k")).alias("_w")).union(own.groupBy("group_a", "group_b").agg(-F.count(F.lit(1))))
    return parts.groupBy("group_a", "group_b").agg(F.sum("_w").alias("weight")).where("weight > 0")


def _members_of_items(links: DataFrame, item: str, entity: str, members: DataFrame) -> DataFrame:
    one = links.select(F.col(item).alias("_i"), F.col(entity).alias("_n")).where("_i is not null").distinct()
    return one.join(members.where("_g is not null"), "_n")


def leaks(links: DataFrame, item: str, entity: str, side: str) -> DataFrame:
    """Entities that stand on more than one side of a split; empty for a sound split."""
    return links.groupBy(entity).agg(F.countDistinct(side).alias("n_sides")).where("n_sides > 1")


def largest(labels: DataFrame) -> DataFrame:
    """The rows of the largest component; of several as large that with the least name."""
    sizes = component_sizes(labels)
    best = sizes.agg(F.min_by("component", F.struct(-F.col("size"), F.col("component"))).alias("component"))
    return labels.join(F.broadcast(best), "component", "left_semi")  # one row
