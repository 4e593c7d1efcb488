"""Queries of resampling, nulls and intervals, with the same draws in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from windrow.functions import values as V
from windrow.operators import information, resampling
from windrow.plans.metric_queries import _P, KEY, PS, accuracies, predictions
from windrow.registry import query
from windrow.session import small_enough, written
from windrow.sources import read_table

DRAWS, FEW = 100, 20
_Q = "q AS (SELECT DISTINCT question_id, subset, correct_index FROM wmdp_questions)"


def _u(*parts: str) -> str:
    """SQL of ``resampling.uniform32``."""
    return f"CAST('0x' || substr(md5(concat_ws('|', {', '.join(parts)})), 1, 8) AS BIGINT)"


#: SQL of each run's correctness on each item at its first and last step.
_ENDS = f"""{_P}, c AS (SELECT run_id, checkpoint_step, question_id, CAST(chosen = gold AS INT) AS ok FROM p WHERE chosen IS NOT NULL AND gold IS NOT NULL),
  s AS (SELECT run_id, min(checkpoint_step) AS lo, max(checkpoint_step) AS hi FROM c GROUP BY run_id), ab AS (SELECT a.run_id, a.question_id, b.ok AS a, a.ok AS b FROM c a JOIN s ON a.run_id = s.run_id AND a.checkpoint_step = lo JOIN c b ON b.run_id = a.run_id AND b.question_id = a.question_id AND b.checkpoint_step = hi)"""
_PICKS = f"""n AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY question_id) - 1 AS i, count(*) OVER (PARTITION BY run_id) AS n FROM (SELECT DISTINCT run_id, question_id FROM ab)),
  k AS (SELECT run_id, draw, {_u("'pair'", "draw", "i")} % n AS i FROM n CROSS JOIN (SELECT unnest(range({DRAWS})) AS draw)), d AS (SELECT k.run_id, draw, avg(a) - avg(b) AS difference FROM k JOIN n USING (run_id, i) JOIN ab ON ab.run_id = k.run_id AND ab.question_id = n.question_id GROUP BY ALL)"""


def _ends(spark: SparkSession, sf: str) -> DataFrame:
    """A row an item of a run: run_id, question_id, a (right at the last step), b (right at the first) and pairs, added up.

    A prediction's copies count once; where those of an item differ, each of the one step goes with each of the other: they are
    counted by step, and no row is made of a pair. Only the rows of both steps are shuffled, once: a run's stay together, and are
    sorted once and added up in that order, since tables of distinct rows in small memories spill in too many pieces. The steps
    are looked up, beyond what a broadcast holds joined.
    """
    p = read_table(spark, sf, "predictions", [*KEY, *PS, "gold"]).withColumn("chosen", V.argmax_letter([F.col(p) for p in PS])).where("chosen is not null and gold is not null")
    s = written(p.groupBy("run_id").agg(F.min("checkpoint_step").alias("lo"), F.max("checkpoint_step").alias("hi")), "ends")
    both = p.join(F.broadcast(s) if small_enough(s) else s.hint("merge"), "run_id").where("checkpoint_step in (lo, hi) and question_id is not null").repartition("run_id")
    item = ["run_id", "question_id"]
    once = both.withColumn("_k", F.row_number().over(W.partitionBy(*item, "checkpoint_step", *PS, "gold").orderBy("gold"))).where("_k = 1")
    ok = (F.col("chosen") == F.col("gold")).cast("int")
    at = {c: F.when(F.col("checkpoint_step") == F.col(step), ok) for step, c in (("hi", "a"), ("lo", "b"))}
    sums = {f"{n}{c}": f(at[c]).over(W.partitionBy(*item)) for c in at for n, f in (("", F.sum), ("n_", F.count))}
    g = once.select(*item, "checkpoint_step", *[v.alias(c) for c, v in sums.items()]).withColumn("_k", F.row_number().over(W.partitionBy(*item).orderBy("checkpoint_step"))).where("_k = 1 and n_a > 0 and n_b > 0")
    return g.selectExpr("run_id", "question_id", "a * n_b AS a", "b * n_a AS b", "n_a * n_b AS pairs")


def _gains(spark: SparkSession, sf: str) -> DataFrame:
    """run_id and differences: the gain from the first to the last step in each draw."""
    return resampling.paired_bootstrap_of_sums(_ends(spark, sf), ["run_id"], "question_id", ["a", "pairs", "b", "pairs"], DRAWS, "pair")


@query(f"WITH {_Q}, n AS (SELECT question_id, row_number() OVER (ORDER BY question_id) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT question_id FROM q)), k AS (SELECT draw, {_u(chr(39) + 'boot' + chr(39), 'draw', 'i')} % n AS i FROM n CROSS JOIN (SELECT unnest(range({DRAWS})) AS draw)) SELECT draw, n.question_id, count(*) AS n FROM k JOIN n USING (i) GROUP BY ALL")
def i18_bootstrap_index(spark: SparkSession, sf: str) -> DataFrame:
    """How often each draw of items picks each."""
    q = read_table(spark, sf, "wmdp_questions", ("question_id",))
    return resampling.bootstrap_index(q, [], "question_id", DRAWS, "boot").groupBy("draw", "question_id").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {_Q} SELECT draw, question_id, row_number() OVER (PARTITION BY draw ORDER BY {_u(chr(39) + 'perm' + chr(39), 'draw', 'question_id')}, question_id) AS place FROM (SELECT DISTINCT question_id FROM q) CROSS JOIN (SELECT unnest(range({FEW})) AS draw)")
def i17_permutations(spark: SparkSession, sf: str) -> DataFrame:
    q = read_table(spark, sf, "wmdp_questions", ("question_id",))
    return resampling.permutation(q, [], "question_id", FEW, "perm")


@query(f"""WITH g AS (SELECT DISTINCT question_id, chr(65 + CAST(correct_index AS INT)) AS gold FROM wmdp_questions WHERE correct_index IS NOT NULL), d AS (SELECT question_id, gold, draw, list_filter(['A', 'B', 'C', 'D'], lambda x: x <> gold) AS o FROM g CROSS JOIN (SELECT unnest(range({DRAWS})) AS draw)),
  m AS (SELECT draw, gold, CASE WHEN {_u("'m'", "'u'", "draw", "question_id")} < {int(0.6 * (1 << 32))} THEN gold ELSE o[{_u("'m'", "'o'", "draw", "question_id")} % 3 + 1] END AS drawn FROM d) SELECT draw, count(*) AS n, count(*) FILTER (drawn = gold) AS n_right, count(DISTINCT drawn) AS n_letters FROM m GROUP BY draw""")
def i16_matched_draws(spark: SparkSession, sf: str) -> DataFrame:
    """Draws of a symmetric channel that is right with probability 0.6."""
    q = read_table(spark, sf, "wmdp_questions", ("question_id", "correct_index")).where("correct_index is not null").select("question_id", F.char((F.col("correct_index") + 65).cast("int")).alias("gold"))
    d = resampling.matched_draws(q, "question_id", "gold", 0.6, DRAWS, "m")
    return d.groupBy("draw").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("drawn") == F.col("gold")).alias("n_right"), F.countDistinct("drawn").alias("n_letters"))


@query("""WITH v AS (SELECT event_type, CASE WHEN event_id % 7 = 0 THEN CAST('inf' AS DOUBLE) ELSE value / (event_id % 7) END AS ratio FROM events) SELECT event_type, count(ratio) FILTER (isfinite(ratio)) AS n_finite, round(quantile_cont(ratio, 0.025) FILTER (isfinite(ratio)), 6) AS low, round(quantile_cont(ratio, 0.975) FILTER (isfinite(ratio)), 6) AS high FROM v GROUP BY event_type""")
def i19_finite_interval(spark: SparkSession, sf: str) -> DataFrame:
    """Percentiles of a ratio over its finite values."""
    d = read_table(spark, sf, "events", ("event_id", "event_type", "value")).withColumn("ratio", F.when(F.col("event_id") % 7 == 0, F.lit(float("inf"))).otherwise(F.col("value") / (F.col("event_id") % 7)))
    return resampling.percentile_interval(d, ["event_type"], "ratio").select("event_type", "n_finite", F.round("low", 6).alias("low"), F.round("high", 6).alias("high"))


@query(f"WITH {_ENDS}, {_PICKS} SELECT run_id, draw, round(difference, 9) AS difference FROM d")
def i24_paired_bootstrap(spark: SparkSession, sf: str) -> DataFrame:
    """Gain from the first to the last step over draws of items that both share."""
    return _gains(spark, sf).select("run_id", F.posexplode("differences").alias("draw", "difference")).withColumn("difference", F.round("difference", 9))


_RANKED = "SELECT run_id, list_sort(list(difference)) AS v FROM d GROUP BY run_id"


@query(f"WITH {_ENDS}, {_PICKS} SELECT run_id, CAST(len(v) AS INT) AS n_draws, round(v[CAST(floor(len(v) * 25 / 1000) AS INT) + 1], 9) AS low, round(v[least(CAST(floor(len(v) * 975 / 1000) AS INT), len(v) - 1) + 1], 9) AS high FROM ({_RANKED})")
def a14_rank_interval(spark: SparkSession, sf: str) -> DataFrame:
    """Nearest-rank interval of the gain."""
    return resampling.listed_interval(_gains(spark, sf), ["run_id"], "differences").withColumns({"low": F.round("low", 9), "high": F.round("high", 9)})


@query(f"WITH {_ENDS}, {_PICKS} SELECT run_id, CAST(len(v) AS INT) AS n_draws, round(v[greatest(CAST(floor(len(v) * 25 / 1000) AS INT) - 1, 0) + 1], 9) AS low, round(v[least(CAST(floor(len(v) * 975 / 1000) AS INT), len(v) - 1) + 1], 9) AS high FROM ({_RANKED})")
def a15_rank_interval_off_by_one(spark: SparkSession, sf: str) -> DataFrame:
    return resampling.listed_interval(_gains(spark, sf), ["run_id"], "differences", off_by_one=True).withColumns({"low": F.round("low", 9), "high": F.round("high", 9)})


#: SQL of each run's accuracy at its last step, by condition.
_LAST = f"""{_P}, a AS (SELECT run_id, checkpoint_step, avg(CASE WHEN chosen IS NOT NULL AND gold IS NOT NULL THEN CAST(chosen = gold AS INT) END) AS accuracy FROM p GROUP BY ALL), l AS (SELECT split_part(run_id, '__', 2) AS condition, run_id, arg_max(accuracy, checkpoint_step) AS accuracy FROM a GROUP BY ALL),
  n AS (SELECT *, row_number() OVER (PARTITION BY condition ORDER BY run_id) - 1 AS i, count(*) OVER (PARTITION BY condition) AS n FROM l), k AS (SELECT condition, draw, {_u("'med'", "draw", "i")} % n AS i FROM n CROSS JOIN (SELECT unnest(range({DRAWS})) AS draw)), m AS (SELECT k.condition, draw, median(accuracy) AS median FROM k JOIN n ON n.condition = k.condition AND n.i = k.i GROUP BY ALL)"""


def _last(spark: SparkSession, sf: str) -> DataFrame:
    d = accuracies(spark, sf).groupBy("run_id").agg(F.max_by("accuracy", "checkpoint_step").alias("accuracy"))
    return d.select(F.split_part("run_id", F.lit("__"), F.lit(2)).alias("condition"), "run_id", "accuracy")


@query(f"WITH {_LAST} SELECT condition, draw, round(median, 9) AS median FROM m")
def i25_median_bootstrap(spark: SparkSession, sf: str) -> DataFrame:
    """Median accuracy at the last step over draws of each condition's runs."""
    return resampling.median_bootstrap(_last(spark, sf), ["condition"], "run_id", "accuracy", DRAWS, "med").withColumn("median", F.round("median", 9))


@query(f"WITH {_LAST} SELECT a.condition AS condition_a, b.condition AS condition_b, round(quantile_cont(a.median - b.median, 0.025), 8) AS low, round(quantile_cont(a.median - b.median, 0.975), 8) AS high, round(avg(CAST(a.median > b.median AS INT)), 9) AS share_above FROM m a JOIN m b ON a.draw = b.draw AND a.condition < b.condition GROUP BY ALL")
def i26_median_differences(spark: SparkSession, sf: str) -> DataFrame:
    """Difference of medians of each two conditions over paired draws; conditions are few."""
    m = resampling.median_bootstrap(_last(spark, sf), ["condition"], "run_id", "accuracy", DRAWS, "med")
    b = m.select("draw", F.col("condition").alias("condition_b"), F.col("median").alias("_b"))
    both = m.withColumnRenamed("condition", "condition_a").join(b, "draw").where("condition_a < condition_b").withColumn("_d", F.col("median") - F.col("_b"))
    return both.groupBy("condition_a", "condition_b").agg(F.round(F.percentile("_d", 0.025), 8).alias("low"), F.round(F.percentile("_d", 0.975), 8).alias("high"), F.round(F.avg((F.col("_d") > 0).cast("double")), 9).alias("share_above"))


_NULL = f"u AS (SELECT draw, avg(CAST({_u(chr(39) + 'null' + chr(39), 'draw', 'question_id')} % 4 = 0 AS INT)) AS accuracy FROM (SELECT DISTINCT question_id FROM wmdp_questions) CROSS JOIN (SELECT unnest(range({DRAWS})) AS draw) GROUP BY draw)"


@query(f"""WITH {_P}, {_NULL}, a AS (SELECT run_id, checkpoint_step, round(avg(CASE WHEN chosen IS NOT NULL AND gold IS NOT NULL THEN CAST(chosen = gold AS INT) END), 9) AS accuracy FROM p GROUP BY ALL),
  t AS (SELECT run_id, checkpoint_step, a.accuracy, (1 + count(*) FILTER (u.accuracy <= a.accuracy)) / ({DRAWS} + 1) AS lo, (1 + count(*) FILTER (u.accuracy >= a.accuracy)) / ({DRAWS} + 1) AS hi FROM a CROSS JOIN u WHERE a.accuracy IS NOT NULL GROUP BY ALL)
  SELECT run_id, checkpoint_step, accuracy, round(lo, 9) AS lower_p, round(hi, 9) AS upper_p, round(least(1.0, 2 * least(lo, hi)), 9) AS two_sided_p FROM t""")
def i27_uniform_null(spark: SparkSession, sf: str) -> DataFrame:
    """Each cell's accuracy in the null of guesses at random."""
    null = resampling.uniform_null(read_table(spark, sf, "wmdp_questions", ("question_id",)), "question_id", 4, DRAWS, "null")
    d = accuracies(spark, sf).select("run_id", "checkpoint_step", F.round("accuracy", 9).alias("accuracy")).where("accuracy is not null")
    return resampling.locate_in_null(d, "accuracy", null, "accuracy").withColumns({c: F.round(c, 9) for c in ("lower_p", "upper_p", "two_sided_p")})


@query(f"""WITH {_P}, c AS (SELECT draw, question_id FROM (SELECT draw, {_u("'joint'", "draw", "i")} % n AS i FROM (SELECT question_id, row_number() OVER (ORDER BY question_id) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT question_id FROM p)) CROSS JOIN (SELECT unnest(range({FEW})) AS draw)) k JOIN (SELECT question_id, row_number() OVER (ORDER BY question_id) - 1 AS i FROM (SELECT DISTINCT question_id FROM p)) n USING (i))
  SELECT draw, run_id, chosen, gold, count(*) AS n FROM c JOIN p USING (question_id) WHERE chosen IS NOT NULL AND gold IS NOT NULL AND checkpoint_step = 0 GROUP BY ALL""")
def i06_joint_of_draws(spark: SparkSession, sf: str) -> DataFrame:
    """Joint counts of choice and gold at step 0 in each draw of items."""
    p = predictions(spark, sf)
    picks = resampling.bootstrap_index(p, [], "question_id", FEW, "joint")
    rows = p.where("checkpoint_step = 0").select("question_id", "run_id", "chosen", "gold")
    return information.joint_counts(picks.join(rows, "question_id"), ["draw", "run_id"], ["chosen", "gold"])


@query(f"""WITH {_P}, {_Q}, x AS (SELECT run_id, chosen, gold, unnest([{{'name': 'subset', 'l': subset}}, {{'name': 'position', 'l': CAST(correct_index AS VARCHAR)}}], recursive := true) FROM p JOIN q USING (question_id)) SELECT name, run_id, chosen, gold, l, count(*) AS n FROM x WHERE chosen IS NOT NULL AND gold IS NOT NULL AND l IS NOT NULL GROUP BY ALL""")
def i07_joint_of_labels(spark: SparkSession, sf: str) -> DataFrame:
    """Joint counts under alternative third labels: the item's subset, and the place of its right answer."""
    q = read_table(spark, sf, "wmdp_questions", ("question_id", "subset", "correct_index")).distinct()
    p = predictions(spark, sf).join(F.broadcast(q), "question_id")
    alternatives = F.array(F.struct(F.lit("subset").alias("name"), F.col("subset").alias("l")), F.struct(F.lit("position").alias("name"), F.col("correct_index").cast("string").alias("l")))
    return information.joint_counts(p.select("run_id", "chosen", "gold", F.inline(alternatives)), ["name", "run_id"], ["chosen", "gold", "l"])


#: SQL of the decomposition by DuckDB's own entropy.
_DEC = "count(*) AS n, entropy(chosen) + entropy(gold) - entropy(chosen || gold) AS i, entropy(chosen || subset) + entropy(gold || subset) - entropy(subset) - entropy(chosen || gold || subset) AS c"
_ROWS = f"{_P}, {_Q}, x AS (SELECT run_id, checkpoint_step, chosen, gold, subset FROM p JOIN q USING (question_id) WHERE chosen IS NOT NULL AND gold IS NOT NULL AND subset IS NOT NULL)"


def _labelled(spark: SparkSession, sf: str) -> DataFrame:
    q = read_table(spark, sf, "wmdp_questions", ("question_id", "subset")).distinct()
    return predictions(spark, sf).join(F.broadcast(q), "question_id")


@query(f"""WITH {_ROWS} SELECT 'all' AS tier, NULL AS run_id, NULL AS checkpoint_step, n, round(i, 7) AS i_f_y, round(c, 7) AS i_f_y_given FROM (SELECT {_DEC} FROM x) UNION ALL SELECT 'run', run_id, NULL, n, round(i, 7), round(c, 7) FROM (SELECT run_id, {_DEC} FROM x GROUP BY run_id)
  UNION ALL SELECT 'cell', run_id, checkpoint_step, n, round(i, 7), round(c, 7) FROM (SELECT run_id, checkpoint_step, {_DEC} FROM x GROUP BY ALL)""")
def i28_tiers(spark: SparkSession, sf: str) -> DataFrame:
    """The decomposition of all predictions, of each run and of each cell. Joint counts of cells are made once and added up."""
    d = _labelled(spark, sf).where("chosen is not null and gold is not null and subset is not null")
    tiers = F.array(*[F.struct(F.lit(t).alias("tier"), (F.col("run_id") if t != "all" else F.lit(None)).alias("_r"), (F.col("checkpoint_step") if t == "cell" else F.lit(None)).alias("_s")) for t in ("all", "run", "cell")])
    cells = d.groupBy("run_id", "checkpoint_step", "chosen", "gold", "subset").agg(F.count(F.lit(1)).alias("_c"))
    tall = cells.select("chosen", "gold", "subset", "_c", F.inline(tiers)).groupBy("tier", "_r", "_s", "chosen", "gold", "subset").agg(F.sum("_c").alias("n"))
    out = information.decomposition_of_counts(tall, ["tier", "_r", "_s"], "chosen", "gold", "subset")
    return out.select("tier", F.col("_r").alias("run_id"), F.col("_s").alias("checkpoint_step"), "n", F.round("i_f_y", 7).alias("i_f_y"), F.round("i_f_y_given", 7).alias("i_f_y_given"))


@query(f"WITH {_ROWS} SELECT run_id, checkpoint_step, n, i > 0.05 AS cleared, CASE WHEN i > 0.05 THEN round((i - c) / i, 6) END AS ratio FROM (SELECT run_id, checkpoint_step, {_DEC} FROM x GROUP BY ALL)")
def i22_suppressed(spark: SparkSession, sf: str) -> DataFrame:
    """The ratio of the decomposition where its information clears 0.05 bits."""
    d = information.decomposition(_labelled(spark, sf), ["run_id", "checkpoint_step"], "chosen", "gold", "subset")
    cleared = F.col("i_f_y") > 0.05
    return d.select("run_id", "checkpoint_step", "n", cleared.alias("cleared"), resampling.suppressed(F.round("ratio", 6), cleared).alias("ratio"))


@query(f"WITH {_P} SELECT a.run_id, count(*) AS n, round(max(greatest(abs(a.p_a - b.p_a), abs(a.p_b - b.p_b), abs(a.p_c - b.p_c), abs(a.p_d - b.p_d))), 9) AS max_diff, count(*) FILTER (a.chosen <> b.chosen) AS n_other FROM p a JOIN p b ON a.run_id = b.run_id AND a.question_id = b.question_id AND a.checkpoint_step = 0 AND b.checkpoint_step = 64 GROUP BY a.run_id")
def i30_parity(spark: SparkSession, sf: str) -> DataFrame:
    """Each run's predictions of step 0 against those of step 64."""
    p = predictions(spark, sf).select("run_id", "checkpoint_step", "question_id", *PS)
    d = resampling.parity(p.where("checkpoint_step = 0"), p.where("checkpoint_step = 64"), ["run_id", "question_id"], PS, ["run_id"])
    return d.withColumn("max_diff", F.round("max_diff", 9))


@query(f"""WITH {_ROWS}, z AS (SELECT DISTINCT question_id, subset FROM q WHERE subset IS NOT NULL), o AS (SELECT question_id, row_number() OVER (ORDER BY question_id) AS k FROM z), w AS (SELECT draw, question_id, row_number() OVER (PARTITION BY draw ORDER BY {_u("'ex'", "draw", "question_id")}, question_id) AS k FROM z CROSS JOIN (SELECT unnest(range(5)) AS draw)),
  s AS (SELECT draw, o.question_id, z.subset FROM w JOIN o USING (k) JOIN z ON z.question_id = w.question_id), y AS (SELECT draw, p.run_id, p.chosen, p.gold, s.subset FROM p JOIN s USING (question_id) WHERE chosen IS NOT NULL AND gold IS NOT NULL),
  m AS (SELECT run_id, i - c AS mu FROM (SELECT run_id, {_DEC} FROM x GROUP BY run_id)), v AS (SELECT run_id, avg(i - c) AS mu FROM (SELECT draw, run_id, {_DEC} FROM y GROUP BY ALL) GROUP BY run_id) SELECT m.run_id, round(m.mu, 7) + 0.0 AS mu, round(v.mu, 7) + 0.0 AS null_mean, round(m.mu - v.mu, 7) + 0.0 AS excess FROM m JOIN v USING (run_id)""")
def i31_excess(spark: SparkSession, sf: str) -> DataFrame:
    """mu of each run less the mean of mu with the items' subsets permuted, five draws."""
    rows, p = _labelled(spark, sf), predictions(spark, sf)
    items = read_table(spark, sf, "wmdp_questions", ("question_id", "subset")).distinct().where("subset is not null")
    shuffled = resampling.permutation(items, [], "question_id", 5, "ex").join(items, "question_id")
    places = resampling.permutation(items, [], "question_id", 1, "ex").select("question_id").withColumn("_one", F.lit(1))
    numbered = places.withColumn("place", F.row_number().over(W.partitionBy("_one").orderBy("question_id")))
    labels = shuffled.select("draw", "place", "subset").join(numbered.select("place", "question_id"), "place")
    null = information.decomposition(p.join(F.broadcast(labels), "question_id"), ["draw", "run_id"], "chosen", "gold", "subset").groupBy("run_id").agg(F.avg("mu").alias("null_mean"))
    own = information.decomposition(rows, ["run_id"], "chosen", "gold", "subset").select("run_id", "mu").join(null, "run_id")
    return own.select("run_id", *[(F.round(c, 7) + 0.0).alias(n) for c, n in ((F.col("mu"), "mu"), (F.col("null_mean"), "null_mean"), (F.col("mu") - F.col("null_mean"), "excess"))])


@query("WITH r AS (SELECT source, n_chars, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC) AS k FROM documents WHERE n_chars IS NOT NULL), t AS (SELECT source, min(n_chars) AS threshold FROM r WHERE k <= 10 GROUP BY source) SELECT t.source, threshold, count(*) AS n_at_least FROM t JOIN documents d ON d.source IS NOT DISTINCT FROM t.source AND d.n_chars >= threshold GROUP BY ALL")
def i32_top_k_threshold(spark: SparkSession, sf: str) -> DataFrame:
    """The tenth largest length of each source, and how many documents reach it."""
    return resampling.top_k_threshold(read_table(spark, sf, "documents", ("source", "n_chars")), ["source"], "n_chars", 10)


@query(f"""WITH {_P}, g AS (SELECT run_id, checkpoint_step, count(*) FILTER (chosen = gold) AS k, count(*) FILTER (chosen IS NOT NULL AND gold IS NOT NULL) AS n FROM p GROUP BY ALL) SELECT run_id, checkpoint_step, k, n, CASE WHEN n > 0 THEN CASE WHEN abs(k / n - 0.25) <= 2 * sqrt(0.25 * 0.75 / n) THEN 'near_chance' WHEN k / n > 0.7 THEN 'high' ELSE 'intermediate' END END AS decision FROM g""")
def i36_near_chance(spark: SparkSession, sf: str) -> DataFrame:
    p = predictions(spark, sf).groupBy("run_id", "checkpoint_step").agg(F.count_if(F.col("chosen") == F.col("gold")).alias("k"), F.count_if(F.col("chosen").isNotNull() & F.col("gold").isNotNull()).alias("n"))
    return p.select("*", resampling.near_chance(F.col("k"), F.col("n")).alias("decision"))


@query(f"""WITH {_P}, s AS (SELECT question_id, avg(greatest(p_a, p_b, p_c, p_d)) AS a, avg(CAST(chosen = gold AS INT)) AS b FROM p WHERE p_a IS NOT NULL AND gold IS NOT NULL GROUP BY question_id), s2 AS (SELECT question_id, round(a, 8) AS a, round(b, 8) AS b FROM s),
  x AS (SELECT question_id FROM s2 ORDER BY a DESC, question_id LIMIT 50), y AS (SELECT question_id FROM s2 ORDER BY b DESC, question_id LIMIT 50), n AS (SELECT count(*) AS n FROM s2) SELECT count(*) AS overlap, CAST(any_value(n) AS INT) AS n, round(count(*) * any_value(n) / 2500.0, 6) AS lift FROM x JOIN y USING (question_id) CROSS JOIN n""")
def i33_top_k_overlap(spark: SparkSession, sf: str) -> DataFrame:
    """Overlap of the 50 items of most confidence with the 50 most often right: the report's size is the feature."""
    p = predictions(spark, sf).where("p_a is not null and gold is not null")
    s = p.groupBy("question_id").agg(F.round(F.avg(F.greatest(*PS)), 8).alias("a"), F.round(F.avg((F.col("chosen") == F.col("gold")).cast("int")), 8).alias("b"))
    return information.top_k_overlap(s, "question_id", "a", "b", 50).withColumn("lift", F.round("lift", 6))


@query("SELECT p, round(2 - (CASE WHEN p > 0 AND p < 1 THEN -p * log2(p) - (1 - p) * log2(1 - p) ELSE 0 END) - (1 - p) * log2(3), 9) AS bits FROM (SELECT unnest([0.25, 0.4, 0.55, 0.7, 0.85, 1.0])::DOUBLE AS p)")
def i14_channel(spark: SparkSession, sf: str) -> DataFrame:
    """Information of the symmetric channel over four letters."""
    return spark.createDataFrame([(p, round(information.channel_information(p), 9)) for p in (0.25, 0.4, 0.55, 0.7, 0.85, 1.0)], "p double, bits double")


@query("SELECT p FROM (SELECT unnest([0.3, 0.4, 0.55, 0.7, 0.85, 1.0])::DOUBLE AS p)")
def i15_channel_solved(spark: SparkSession, sf: str) -> DataFrame:
    """The channel that has the information of each p is p again."""
    return spark.createDataFrame([(round(information.channel_for(information.channel_information(p)), 6),) for p in (0.3, 0.4, 0.55, 0.7, 0.85, 1.0)], "p double")


@query(f"WITH {_ROWS} SELECT run_id, checkpoint_step, round(i, 7) AS mutual, round(c, 7) AS conditional, round(i - c, 7) + 0.0 AS mu, CASE WHEN abs(i) > 1e-12 THEN round((i - c) / i, 6) END AS ratio, round(j, 7) AS i_l_y FROM (SELECT run_id, checkpoint_step, {_DEC}, entropy(subset) + entropy(gold) - entropy(subset || gold) AS j FROM x GROUP BY ALL) WHERE i > 0.001")
def i08_scalars(spark: SparkSession, sf: str) -> DataFrame:
    """I-02, I-03 and I-08: all scalars of the joint of choice, gold and subset, where the information isn't nil."""
    keys = ["run_id", "checkpoint_step"]
    d = _labelled(spark, sf)
    other = information.decomposition(d, keys, "subset", "gold", "chosen").select(*keys, F.col("i_f_y").alias("_j"))
    out = information.decomposition(d, keys, "chosen", "gold", "subset").join(other, keys).where("i_f_y > 0.001")
    return out.select(*keys, F.round("i_f_y", 7).alias("mutual"), F.round("i_f_y_given", 7).alias("conditional"), (F.round("mu", 7) + 0.0).alias("mu"), F.round("ratio", 6).alias("ratio"), F.round("_j", 7).alias("i_l_y"))


@query(f"WITH {_P} SELECT run_id, checkpoint_step, question_id, chosen, round(-(CASE WHEN p_a > 0 THEN p_a * ln(p_a) ELSE 0 END + CASE WHEN p_b > 0 THEN p_b * ln(p_b) ELSE 0 END + CASE WHEN p_c > 0 THEN p_c * ln(p_c) ELSE 0 END + CASE WHEN p_d > 0 THEN p_d * ln(p_d) ELSE 0 END), 7) + 0.0 AS entropy FROM p WHERE chosen IS NOT NULL")
def i13_row_entropy(spark: SparkSession, sf: str) -> DataFrame:
    """I-10 and I-13: the chosen letter and the entropy of each prediction in nats."""
    return predictions(spark, sf).where("chosen is not null").select("run_id", "checkpoint_step", "question_id", "chosen", (F.round(V.row_entropy([F.col(p) for p in PS]), 7) + 0.0).alias("entropy"))


@query("""WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[])[1:4] AS v FROM embeddings), m AS (SELECT vec_id, v, list_max(v) AS m FROM e), x AS (SELECT vec_id, list_transform(v, lambda a: exp(a - m)) AS x FROM m) SELECT vec_id, round(x[1] / list_sum(x), 7) AS first, round(list_max(x) / list_sum(x), 7) AS most FROM x""")
def i35_softmax(spark: SparkSession, sf: str) -> DataFrame:
    """Softmax over the first four components of each vector."""
    s = V.softmax(F.slice(F.col("embedding").cast("array<double>"), 1, 4))
    return read_table(spark, sf, "embeddings", ("vec_id", "embedding")).select("vec_id", s.alias("s")).select("vec_id", F.round(F.element_at("s", 1), 7).alias("first"), F.round(F.array_max("s"), 7).alias("most"))
