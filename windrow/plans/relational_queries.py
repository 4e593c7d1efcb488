"""Relational queries over the star schema, events and embeddings: joins, rollups, windows, similarity."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from windrow.functions import values as V
from windrow.operators import dedupe, joins
from windrow.operators.prefix import running
from windrow.registry import query
from windrow.session import written
from windrow.sources import read_table


@query("SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc_price, round(avg(l_extendedprice), 4) AS avg_price, count(*) AS n FROM lineitem WHERE l_shipdate <= DATE '1998-09-02' GROUP BY ALL")
def r01_pricing_summary(spark: SparkSession, sf: str) -> DataFrame:
    d = read_table(spark, sf, "lineitem").where("l_shipdate <= date '1998-09-02'")
    return d.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("sum_disc_price"), F.round(F.avg("l_extendedprice"), 4).alias("avg_price"), F.count(F.lit(1)).alias("n"))


@query("SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name")
def r02_revenue_by_nation(spark: SparkSession, sf: str) -> DataFrame:
    line = read_table(spark, sf, "lineitem", ("l_orderkey", "l_extendedprice", "l_discount"))
    orders, customer = read_table(spark, sf, "orders", ("o_orderkey", "o_custkey")), read_table(spark, sf, "customer", ("c_custkey", "c_nationkey"))
    nation = read_table(spark, sf, "nation", ("n_nationkey", "n_name"))
    # pre-aggregated to orders before the joins that only map order to nation
    per = line.groupBy("l_orderkey").agg(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("r"))
    d = per.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(customer, F.col("o_custkey") == F.col("c_custkey")).join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey"))
    return d.groupBy("n_name").agg(F.round(F.sum("r"), 2).alias("revenue"))


@query("SELECT o_orderpriority, count(*) AS n FROM orders SEMI JOIN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 45) l ON l_orderkey = o_orderkey GROUP BY o_orderpriority")
def j08_semi_join(spark: SparkSession, sf: str) -> DataFrame:
    big = read_table(spark, sf, "lineitem", ("l_orderkey", "l_quantity")).where("l_quantity > 45")
    return read_table(spark, sf, "orders", ("o_orderkey", "o_orderpriority")).join(big, F.col("o_orderkey") == F.col("l_orderkey"), "left_semi").groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT c_custkey FROM customer ANTI JOIN orders ON o_custkey = c_custkey")
def j09_anti_join(spark: SparkSession, sf: str) -> DataFrame:
    return read_table(spark, sf, "customer", ("c_custkey",)).join(read_table(spark, sf, "orders", ("o_custkey",)), F.col("c_custkey") == F.col("o_custkey"), "left_anti")


@query("SELECT l_orderkey, count(*) AS n, o_orderpriority FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL")
def j01_checked_join(spark: SparkSession, sf: str) -> DataFrame:
    """Lines of each order, joined so that a line without its order stops the job."""
    per = read_table(spark, sf, "lineitem", ("l_orderkey",)).groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"))
    orders = read_table(spark, sf, "orders", ("o_orderkey", "o_orderpriority")).withColumnRenamed("o_orderkey", "l_orderkey")
    return joins.aligned(per, orders, ["l_orderkey"]).select("l_orderkey", "n", F.col("_r_o_orderpriority").alias("o_orderpriority"))


@query("WITH e AS (SELECT DISTINCT doc_type, lang, doc_id FROM documents) SELECT doc_type, lang, count(*) AS n, grouping(doc_type) + 2 * grouping(lang) AS g FROM e GROUP BY CUBE (doc_type, lang)")
def r03_cube(spark: SparkSession, sf: str) -> DataFrame:
    d = read_table(spark, sf, "documents", ("doc_id", "doc_type", "lang"))
    return d.cube("doc_type", "lang").agg(F.count(F.lit(1)).alias("n"), (F.grouping("doc_type") + 2 * F.grouping("lang")).cast("long").alias("g"))


@query("SELECT chapter_id, doc_id, rank() OVER w AS r, coalesce(n_chars - lag(n_chars) OVER w, 0) AS step FROM documents WHERE chapter_id IS NOT NULL WINDOW w AS (PARTITION BY chapter_id ORDER BY n_chars DESC NULLS LAST, doc_id)")
def w01_rank(spark: SparkSession, sf: str) -> DataFrame:
    """Rank and step to the row before within each chapter.

    One chapter holds a tenth of the rows, so no window gathers a chapter: rows are numbered over the whole sorted table,
    a chapter's ranks count from its first number, and the row before is found by its number.
    """
    d = read_table(spark, sf, "documents", ("doc_id", "chapter_id", "n_chars")).where("chapter_id is not null")
    n = written(running(d, [F.col("chapter_id"), F.desc_nulls_last("n_chars"), F.col("doc_id")], {"i": "1"}), "ranks")
    first = n.groupBy("chapter_id").agg(F.min("i").alias("i0"))
    past = n.select((F.col("i") + 1).alias("i"), F.col("chapter_id").alias("past_chapter"), F.col("n_chars").alias("past"))
    both = n.join(first, "chapter_id").join(past, "i", "left")
    step = F.when(F.col("past_chapter") == F.col("chapter_id"), F.col("n_chars") - F.col("past"))
    return both.select("chapter_id", "doc_id", (F.col("i") - F.col("i0") + 1).alias("r"), F.coalesce(step, F.lit(0)).alias("step"))


@query("SELECT chapter_id, doc_id, n_chars FROM (SELECT *, row_number() OVER (PARTITION BY chapter_id ORDER BY n_chars DESC, doc_id) AS r FROM documents WHERE chapter_id IS NOT NULL) WHERE r <= 3")
def r04_top_of_chapter(spark: SparkSession, sf: str) -> DataFrame:
    """The three longest documents of each chapter. Salted: the three of each salt, then the three of those, so a chapter of any size fits."""
    d = read_table(spark, sf, "documents", ("doc_id", "chapter_id", "n_chars")).where("chapter_id is not null").withColumn("_salt", F.pmod(F.xxhash64("doc_id"), F.lit(64)))
    order = [F.desc("n_chars"), F.col("doc_id")]
    first = d.withColumn("r", F.row_number().over(W.partitionBy("chapter_id", "_salt").orderBy(*order))).where("r <= 3")
    return first.withColumn("r", F.row_number().over(W.partitionBy("chapter_id").orderBy(*order))).where("r <= 3").select("chapter_id", "doc_id", "n_chars")


@query("SELECT doc_id FROM (SELECT doc_id, text, abstract, count(*) OVER (PARTITION BY sha256(text)) AS c, min(doc_id) OVER (PARTITION BY sha256(text)) AS m FROM documents WHERE text IS NOT NULL) WHERE c > 1 AND doc_id > m")
def d06_later_copies(spark: SparkSession, sf: str) -> DataFrame:
    """Documents whose text an earlier one has: by partial minima of digests, not by windows over copies."""
    d = read_table(spark, sf, "documents", ("doc_id", "text")).where("text is not null").select("doc_id", V.digest(F.col("text")).alias("h"))
    first = d.groupBy("h").agg(F.min("doc_id").alias("m"), F.count(F.lit(1)).alias("c")).where("c > 1")
    return d.join(first, "h").where("doc_id > m").select("doc_id")


@query("SELECT lang, doc_type, n_left, n_right FROM (SELECT lang, doc_type, count(*) FILTER (source = 'spine_chunks') AS n_left, count(*) FILTER (source = 'abstract_pool') AS n_right FROM documents GROUP BY ALL) WHERE n_left <> n_right")
def a29_composition(spark: SparkSession, sf: str) -> DataFrame:
    d = read_table(spark, sf, "documents", ("source", "lang", "doc_type"))
    return dedupe.same_composition(d.where("source = 'spine_chunks'"), d.where("source = 'abstract_pool'"), ["lang", "doc_type"])


@query("SELECT p_brand, p_type, n FROM (SELECT p_brand, p_type, count(*) AS n FROM part GROUP BY ALL) ORDER BY n DESC, p_brand, p_type LIMIT 20")
def o02_top(spark: SparkSession, sf: str) -> DataFrame:
    return read_table(spark, sf, "part", ("p_brand", "p_type")).groupBy("p_brand", "p_type").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "p_brand", "p_type").limit(20)
