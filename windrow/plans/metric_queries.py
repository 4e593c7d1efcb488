"""Queries over predictions and metrics: accuracies, information, trajectories, gates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from windrow.functions import values as V
from windrow.operators import aggregates, gates, information, joins, windows
from windrow.registry import query
from windrow.sources import read_table
from windrow.sources.readers import run_parts

PS = ["p_a", "p_b", "p_c", "p_d"]
KEY = ["run_id", "checkpoint_step", "question_id"]
STEPS = (0, 1, 2, 4, 8, 16, 32, 64, 128, 256, 512)

#: SQL of the predictions without copies, with the chosen letter (the lowest on ties).
_P = """p AS (SELECT *, CASE WHEN p_a IS NULL OR p_b IS NULL OR p_c IS NULL OR p_d IS NULL THEN NULL
  WHEN p_a >= greatest(p_b, p_c, p_d) THEN 'A' WHEN p_b >= greatest(p_c, p_d) THEN 'B' WHEN p_c >= p_d THEN 'C' ELSE 'D' END AS chosen
  FROM (SELECT DISTINCT run_id, checkpoint_step, question_id, p_a, p_b, p_c, p_d, gold FROM predictions))"""


def predictions(spark: SparkSession, sf: str) -> DataFrame:
    """Predictions without copies, with the chosen letter."""
    cols = [*KEY, *PS, "gold"]
    return read_table(spark, sf, "predictions", cols).distinct().withColumn("chosen", V.argmax_letter([F.col(p) for p in PS]))


@query(f"WITH {_P} SELECT run_id, checkpoint_step, count(*) AS n, count(*) FILTER (chosen = gold) AS n_correct, round(avg(CASE WHEN chosen IS NOT NULL AND gold IS NOT NULL THEN CAST(chosen = gold AS INT) END), 9) AS accuracy FROM p GROUP BY ALL")
def a26_accuracy(spark: SparkSession, sf: str) -> DataFrame:
    return predictions(spark, sf).groupBy("run_id", "checkpoint_step").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("chosen") == F.col("gold")).alias("n_correct"), F.round(aggregates.accuracy(F.col("chosen"), F.col("gold")), 9).alias("accuracy"))


@query(f"""WITH {_P} SELECT coalesce(subset, 'overall') AS subset, checkpoint_step, n, accuracy FROM (
  SELECT subset, checkpoint_step, count(*) AS n, round(avg(CASE WHEN chosen IS NOT NULL AND p.gold IS NOT NULL THEN CAST(chosen = p.gold AS INT) END), 9) AS accuracy
  FROM p JOIN (SELECT DISTINCT question_id, subset FROM wmdp_questions) q USING (question_id) GROUP BY GROUPING SETS ((subset, checkpoint_step), (checkpoint_step)))""")
def a27_accuracy_by_subset(spark: SparkSession, sf: str) -> DataFrame:
    q = read_table(spark, sf, "wmdp_questions", ("question_id", "subset")).distinct()
    d = predictions(spark, sf).join(q, "question_id")
    g = d.groupingSets([["subset", "checkpoint_step"], ["checkpoint_step"]], "subset", "checkpoint_step").agg(F.count(F.lit(1)).alias("n"), F.round(aggregates.accuracy(F.col("chosen"), F.col("gold")), 9).alias("accuracy"))
    return g.withColumn("subset", F.coalesce("subset", F.lit("overall")))


@query(f"""WITH {_P}, a AS (SELECT run_id, checkpoint_step, avg(CASE WHEN chosen IS NOT NULL AND gold IS NOT NULL THEN CAST(chosen = gold AS INT) END) AS acc FROM p GROUP BY ALL),
  k AS (SELECT split_part(run_id, '__', 1) AS model, split_part(run_id, '__', 2) AS condition, checkpoint_step, acc FROM a)
  SELECT model, condition, checkpoint_step, count(acc) AS n_seeds, round(avg(acc), 9) AS mean, round(CASE WHEN count(acc) > 1 THEN var_samp(acc) WHEN count(acc) = 1 THEN 0 END, 9) AS variance FROM k GROUP BY ALL""")
def a28_between_seed(spark: SparkSession, sf: str) -> DataFrame:
    a = predictions(spark, sf).groupBy("run_id", "checkpoint_step").agg(aggregates.accuracy(F.col("chosen"), F.col("gold")).alias("acc"))
    k = a.select(F.split_part("run_id", F.lit("__"), F.lit(1)).alias("model"), F.split_part("run_id", F.lit("__"), F.lit(2)).alias("condition"), "checkpoint_step", "acc")
    return aggregates.between_seed(k, ["model", "condition", "checkpoint_step"], "acc").withColumn("mean", F.round("mean", 9)).withColumn("variance", F.round("variance", 9))


@query(f"WITH {_P} SELECT gold, count(*) FILTER (chosen = 'A') AS \"n_A\", count(*) FILTER (chosen = 'B') AS \"n_B\", count(*) FILTER (chosen = 'C') AS \"n_C\", count(*) FILTER (chosen = 'D') AS \"n_D\" FROM p GROUP BY gold")
def a31_contingency(spark: SparkSession, sf: str) -> DataFrame:
    return aggregates.contingency(predictions(spark, sf), "gold", "chosen", list("ABCD"))


@query(f"""WITH {_P}, s AS (SELECT *, row_number() OVER () AS i FROM p WHERE p_a IS NOT NULL)
  SELECT run_id, checkpoint_step, count(*) FILTER (CAST(p_a = m AS INT) + CAST(p_b = m AS INT) + CAST(p_c = m AS INT) + CAST(p_d = m AS INT) > 1) AS n_ties, count(*) AS n FROM (SELECT *, greatest(p_a, p_b, p_c, p_d) AS m FROM s) GROUP BY ALL""")
def i11_ties(spark: SparkSession, sf: str) -> DataFrame:
    d = predictions(spark, sf).where("chosen is not null")
    return d.groupBy("run_id", "checkpoint_step").agg(F.count_if(V.ties([F.col(p) for p in PS])).alias("n_ties"), F.count(F.lit(1)).alias("n"))


_ENTROPY = """WITH {p}, c AS (SELECT run_id, checkpoint_step, chosen, count(*) AS n FROM p WHERE chosen IS NOT NULL GROUP BY ALL)
  SELECT run_id, checkpoint_step, CAST(sum(n) AS BIGINT) AS n, count(*) AS n_classes, round(log2(sum(n)) - sum(n * log2(n)) / sum(n){mm}, 9) AS entropy FROM c GROUP BY ALL"""


@query(_ENTROPY.format(p=_P, mm=""))
def i01_entropy(spark: SparkSession, sf: str) -> DataFrame:
    return information.entropy(predictions(spark, sf), ["run_id", "checkpoint_step"], ["chosen"]).withColumn("entropy", F.round("entropy", 9))


@query(_ENTROPY.format(p=_P, mm=" + (count(*) - 1) / (2 * sum(n) * ln(2))"))
def i01_entropy_corrected(spark: SparkSession, sf: str) -> DataFrame:
    return information.entropy(predictions(spark, sf), ["run_id", "checkpoint_step"], ["chosen"], miller_madow=True).withColumn("entropy", F.round("entropy", 9))


def _h(cols: str) -> str:
    return f"(SELECT run_id, checkpoint_step, log2(sum(n)) - sum(n * log2(n)) / sum(n) AS h, sum(n) AS n FROM (SELECT run_id, checkpoint_step, {cols}, sum(n) AS n FROM j GROUP BY ALL) GROUP BY ALL)"


@query(f"""WITH {_P}, ref AS (SELECT question_id, chosen AS l FROM p WHERE run_id = (SELECT run_id FROM p GROUP BY run_id ORDER BY count(*) DESC, run_id LIMIT 1)
    AND checkpoint_step = (SELECT min(checkpoint_step) FROM p WHERE run_id = (SELECT run_id FROM p GROUP BY run_id ORDER BY count(*) DESC, run_id LIMIT 1))),
  j AS (SELECT run_id, checkpoint_step, chosen AS f, gold AS y, l, count(*) AS n FROM p JOIN ref USING (question_id) WHERE chosen IS NOT NULL AND gold IS NOT NULL AND l IS NOT NULL GROUP BY ALL),
  v AS (SELECT f.run_id, f.checkpoint_step, CAST(f.n AS BIGINT) AS n, f.h + y.h - fy.h AS i, fl.h + yl.h - l.h - fyl.h AS c
    FROM {_h('f')} f JOIN {_h('y')} y USING (run_id, checkpoint_step) JOIN {_h('f, y')} fy USING (run_id, checkpoint_step) JOIN {_h('l')} l USING (run_id, checkpoint_step)
    JOIN {_h('f, l')} fl USING (run_id, checkpoint_step) JOIN {_h('y, l')} yl USING (run_id, checkpoint_step) JOIN {_h('f, y, l')} fyl USING (run_id, checkpoint_step))
  SELECT run_id, checkpoint_step, n, round(i, 7) + 0.0 AS i_f_y, round(c, 7) + 0.0 AS i_f_y_given, round(i - c, 7) + 0.0 AS mu FROM v""")
def i04_decomposition(spark: SparkSession, sf: str) -> DataFrame:
    """Of each cell against the first step of the largest run, the reference."""
    p = predictions(spark, sf)
    largest = p.groupBy("run_id").agg(F.count(F.lit(1)).alias("c"), F.min("checkpoint_step").alias("s")).agg(F.min_by(F.struct("run_id", "s"), F.struct(-F.col("c"), F.col("run_id"))).alias("r")).select("r.*")
    ref = p.join(F.broadcast(largest.select("run_id", F.col("s").alias("checkpoint_step"))), ["run_id", "checkpoint_step"], "left_semi").select("question_id", F.col("chosen").alias("l"))
    d = information.decomposition(p.join(ref, "question_id"), ["run_id", "checkpoint_step"], "chosen", "gold", "l")
    return d.select("run_id", "checkpoint_step", "n", *[(F.round(c, 7) + 0.0).alias(c) for c in ("i_f_y", "i_f_y_given", "mu")])


@query(f"""WITH {_P}, m AS (SELECT run_id, checkpoint_step, count(*) AS n, avg(p_a) AS a, avg(p_b) AS b, avg(p_c) AS c, avg(p_d) AS d,
   avg(-(CASE WHEN p_a > 0 THEN p_a * ln(p_a) ELSE 0 END + CASE WHEN p_b > 0 THEN p_b * ln(p_b) ELSE 0 END + CASE WHEN p_c > 0 THEN p_c * ln(p_c) ELSE 0 END + CASE WHEN p_d > 0 THEN p_d * ln(p_d) ELSE 0 END)) AS h FROM p WHERE chosen IS NOT NULL GROUP BY ALL)
  SELECT run_id, checkpoint_step, n, round(-(a * ln(a) + b * ln(b) + c * ln(c) + d * ln(d)) - h, 8) AS information FROM m""")
def i12_soft_information(spark: SparkSession, sf: str) -> DataFrame:
    return information.soft_information(predictions(spark, sf), ["run_id", "checkpoint_step"], PS).withColumn("information", F.round("information", 8))


@query()
def i20_permutation_band(spark: SparkSession, sf: str) -> DataFrame:
    return information.permutation_band(predictions(spark, sf), ["run_id", "checkpoint_step"], "chosen", "gold")


@query()
def i23_bootstrap(spark: SparkSession, sf: str) -> DataFrame:
    """Accuracy with its interval over 2,000 draws of whole entities.

    A row counts once, with one entity: of an item's entities the one with most items, then the least. An item
    that no entity has is a cluster of its own.
    """
    o = read_table(spark, sf, "wmdp_organisms", ("organism_id", "question_ids")).distinct()
    l = o.select(F.col("organism_id").alias("entity"), F.explode(F.from_json("question_ids", "array<string>")).alias("question_id")).distinct()
    n = l.groupBy("entity").agg(F.count(F.lit(1)).alias("n_items"))
    owner = l.join(n, "entity").groupBy("question_id").agg(F.min_by("entity", F.struct(-F.col("n_items"), "entity")).alias("entity"))
    d = predictions(spark, sf).where("chosen is not null and gold is not null").withColumn("ok", (F.col("chosen") == F.col("gold")).cast("int"))
    unit = F.when(F.col("entity").isNotNull(), F.concat(F.lit("entity "), "entity")).otherwise(F.concat(F.lit("item "), F.coalesce("question_id", F.lit(""))))
    return information.bootstrap_accuracy(d.join(owner, "question_id", "left").withColumn("unit", unit), ["run_id", "checkpoint_step"], "ok", "unit", 2000)


@query(f"""WITH {_P}, r AS (SELECT *, row_number() OVER (PARTITION BY run_id, question_id ORDER BY checkpoint_step) AS k FROM p WHERE chosen IS NOT NULL),
  b AS (SELECT a.run_id, a.question_id, a.checkpoint_step, (abs(a.p_a - z.p_a) + abs(a.p_b - z.p_b) + abs(a.p_c - z.p_c) + abs(a.p_d - z.p_d)) / 2 AS tv FROM p a JOIN r z ON a.run_id = z.run_id AND a.question_id = z.question_id AND z.k = 1 WHERE a.chosen IS NOT NULL)
  SELECT run_id, checkpoint_step, count(*) AS n, round(avg(tv), 8) AS mean_tv FROM b GROUP BY ALL""")
def i29_distance_from_start(spark: SparkSession, sf: str) -> DataFrame:
    """Total variation of each checkpoint from an item's first one in its run."""
    p = predictions(spark, sf).where("chosen is not null")
    first = p.groupBy("run_id", "question_id").agg(F.min_by(F.struct(*PS), F.col("checkpoint_step")).alias("_f")).select("run_id", "question_id", "_f.*")
    right = first.select("run_id", "question_id", *[F.col(c).alias(f"{c}_b") for c in PS])
    tv = sum((F.abs(F.col(c) - F.col(f"{c}_b")) for c in PS[1:]), F.abs(F.col("p_a") - F.col("p_a_b"))) / 2
    return p.join(right, ["run_id", "question_id"]).groupBy("run_id", "checkpoint_step").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(tv), 8).alias("mean_tv"))


def accuracies(spark: SparkSession, sf: str) -> DataFrame:
    return a26_accuracy(spark, sf).select("run_id", "checkpoint_step", "accuracy")


_A = f"{_P}, a AS (SELECT run_id, checkpoint_step, round(avg(CASE WHEN chosen IS NOT NULL AND gold IS NOT NULL THEN CAST(chosen = gold AS INT) END), 9) AS accuracy FROM p GROUP BY ALL)"


@query(f"WITH {_A} SELECT run_id, coalesce(CAST(min(checkpoint_step) FILTER (accuracy >= 0.6) AS DOUBLE), CAST('inf' AS DOUBLE)) AS first_step FROM a GROUP BY run_id")
def w05_first_step(spark: SparkSession, sf: str) -> DataFrame:
    return windows.first_step(accuracies(spark, sf), ["run_id"], "checkpoint_step", "accuracy", 0.6)


@query(f"WITH {_A} SELECT run_id, arg_min(checkpoint_step, (-accuracy, checkpoint_step)) FILTER (accuracy IS NOT NULL) AS peak_step, max(accuracy) AS peak_value FROM a GROUP BY run_id")
def w07_peak(spark: SparkSession, sf: str) -> DataFrame:
    return windows.peak(accuracies(spark, sf), ["run_id"], "checkpoint_step", "accuracy")


@query(f"""WITH {_A} SELECT run_id, checkpoint_step, round(accuracy - max(accuracy) FILTER (checkpoint_step = 0) OVER (PARTITION BY run_id), 9) + 0.0 AS delta_start,
  round(accuracy - lag(accuracy) OVER (PARTITION BY run_id ORDER BY checkpoint_step), 9) + 0.0 AS delta_step FROM a""")
def w11_delta(spark: SparkSession, sf: str) -> DataFrame:
    d = windows.delta_from_start(accuracies(spark, sf), ["run_id"], "checkpoint_step", "accuracy")
    return d.select("run_id", "checkpoint_step", (F.round("delta_start", 9) + 0.0).alias("delta_start"), (F.round("delta_step", 9) + 0.0).alias("delta_step"))


@query(f"WITH {_A} SELECT r.run_id, CAST(s.s AS INT) AS checkpoint_step, accuracy FROM (SELECT DISTINCT run_id FROM a) r CROSS JOIN (SELECT unnest([0, 1, 2, 4, 8, 16, 32, 64, 128, 256, 512]) AS s) s LEFT JOIN a ON a.run_id = r.run_id AND a.checkpoint_step = s.s")
def w09_densified(spark: SparkSession, sf: str) -> DataFrame:
    return windows.densified(accuracies(spark, sf), ["run_id"], "checkpoint_step", ["accuracy"], STEPS)


@query(f"""WITH {_A}, b AS (SELECT *, min(checkpoint_step) FILTER (NOT coalesce(accuracy >= 0.3, false)) OVER (PARTITION BY run_id) AS bad FROM a)
  SELECT run_id, max(checkpoint_step) FILTER (bad IS NULL OR checkpoint_step < bad) AS certified_step FROM b GROUP BY run_id""")
def i37_certified_through(spark: SparkSession, sf: str) -> DataFrame:
    return windows.certified_through(accuracies(spark, sf).withColumn("ok", F.col("accuracy") >= 0.3), ["run_id"], "checkpoint_step", "ok")


@query(f"WITH {_A} SELECT run_id, round(avg(accuracy) FILTER (checkpoint_step <= 64), 6) AS early_mean, round(median(accuracy), 9) AS median FROM a GROUP BY run_id")
def w13_early_mean(spark: SparkSession, sf: str) -> DataFrame:
    return accuracies(spark, sf).groupBy("run_id").agg(F.round(F.avg(F.when(F.col("checkpoint_step") <= 64, F.col("accuracy"))), 6).alias("early_mean"), F.round(F.median("accuracy"), 9).alias("median"))


@query(f"""WITH {_A}, r AS (SELECT *, row_number() OVER (PARTITION BY split_part(run_id, '__', 2), checkpoint_step ORDER BY accuracy DESC NULLS LAST, run_id) AS k, split_part(run_id, '__', 2) AS condition FROM a)
  SELECT condition, checkpoint_step, run_id, accuracy FROM r WHERE k = 1""")
def w08_best_run(spark: SparkSession, sf: str) -> DataFrame:
    d = accuracies(spark, sf).withColumn("condition", F.split_part("run_id", F.lit("__"), F.lit(2)))
    best = F.min_by(F.struct("run_id", "accuracy"), F.struct(F.coalesce(-F.col("accuracy"), F.lit(9.0)), F.col("run_id")))
    return d.groupBy("condition", "checkpoint_step").agg(best.alias("b")).select("condition", "checkpoint_step", "b.*")


@query(f"""WITH {_A}, k AS (SELECT split_part(run_id, '__', 2) AS condition, checkpoint_step, avg(accuracy) AS accuracy FROM a GROUP BY ALL)
  SELECT x.checkpoint_step, round(x.accuracy - y.accuracy, 6) + 0.0 AS gap FROM k x JOIN k y USING (checkpoint_step) WHERE x.condition = 'rewrite-f' AND y.condition = 'retain-only'""")
def j04_matched_partner(spark: SparkSession, sf: str) -> DataFrame:
    """Mean accuracy of one condition less that of the other for the same step."""
    d = accuracies(spark, sf).groupBy(F.split_part("run_id", F.lit("__"), F.lit(2)).alias("condition"), "checkpoint_step").agg(F.avg("accuracy").alias("accuracy"))
    keys = ["checkpoint_step"]
    return joins.matched_partner(d, keys, "condition", "rewrite-f", "retain-only", ["accuracy"]).select(*keys, (F.round(F.col("accuracy") - F.col("accuracy_partner"), 6) + 0.0).alias("gap"))


@query("""SELECT run_id, split_part(run_id, '__', 1) AS model, nullif(split_part(run_id, '__', 2), '') AS condition, TRY_CAST(nullif(regexp_extract(run_id, '__lr-([0-9.e-]+)', 1), '') AS DOUBLE) AS lr,
  TRY_CAST(nullif(regexp_extract(run_id, '__seed-([0-9]+)', 1), '') AS INT) AS seed, count(*) AS n_files, count(DISTINCT checkpoint_step) AS n_steps FROM run_metrics GROUP BY ALL""")
def s16_runs(spark: SparkSession, sf: str) -> DataFrame:
    d = read_table(spark, sf, "run_metrics", ("run_id", "checkpoint_step")).groupBy("run_id").agg(F.count(F.lit(1)).alias("n_files"), F.countDistinct("checkpoint_step").alias("n_steps"))
    return d.select("run_id", *run_parts(), "n_files", "n_steps")


@query("""WITH g AS (SELECT DISTINCT run_id, checkpoint_step, question_id, p_a, p_b, p_c, p_d, gold FROM predictions), u AS (SELECT run_id, checkpoint_step, question_id FROM g GROUP BY ALL HAVING count(*) > 1),
  q AS (SELECT concat_ws(',', run_id, checkpoint_step, question_id) AS id FROM g WHERE NOT coalesce(p_a BETWEEN 0 AND 1 AND p_b BETWEEN 0 AND 1 AND p_c BETWEEN 0 AND 1 AND p_d BETWEEN 0 AND 1 AND abs(p_a + p_b + p_c + p_d - 1) <= 1e-5, false)),
  f AS (SELECT DISTINCT question_id AS id FROM g WHERE question_id IS NOT NULL AND question_id NOT IN (SELECT question_id FROM wmdp_questions)), n AS (SELECT concat_ws(',', run_id, checkpoint_step, question_id) AS id FROM g WHERE gold IS NULL)
  SELECT 'key unique' AS name, count(*) = 0 AS passes, count(*) AS n_violations, min(concat_ws(',', run_id, checkpoint_step, question_id)) AS least_id FROM u
  UNION ALL SELECT 'probabilities', count(*) = 0, count(*), min(id) FROM q UNION ALL SELECT 'item exists', count(*) = 0, count(*), min(id) FROM f UNION ALL SELECT 'gold present', count(*) = 0, count(*), min(id) FROM n""")
def c05_prediction_gates(spark: SparkSession, sf: str) -> DataFrame:
    # one shuffle by key serves both the distinct rows and their groups
    d = read_table(spark, sf, "predictions", [*KEY, *PS, "gold"]).repartition(*[F.col(k) for k in KEY]).distinct()
    items = read_table(spark, sf, "wmdp_questions", ("question_id",))
    # rules of single rows, and the key, in one pass over the distinct predictions
    total = sum((F.col(p) for p in PS[1:]), F.col(PS[0]))
    sound = (F.abs(total - 1) <= 1e-5) & ~F.isnan(total)
    for p in PS:
        sound = sound & F.col(p).between(0, 1)
    key = F.concat_ws(",", *[F.col(k).cast("string") for k in KEY])
    g = d.groupBy(*KEY).agg(F.count(F.lit(1)).alias("_n"), F.count_if(~F.coalesce(sound, F.lit(False))).alias("_off"), F.count_if(F.col("gold").isNull()).alias("_bare"))
    rules = [("key unique", (F.col("_n") > 1).cast("int")), ("probabilities", F.col("_off")), ("gold present", F.col("_bare"))]
    one = g.agg(*[x for i, (_, n) in enumerate(rules) for x in (F.coalesce(F.sum(n), F.lit(0)).alias(f"n{i}"), F.min(F.when(n > 0, key)).alias(f"m{i}"))])
    rows = one.select(F.inline(F.array(*[F.struct(F.lit(name).alias("name"), (F.col(f"n{i}") == 0).alias("passes"), F.col(f"n{i}").cast("long").alias("n_violations"), F.col(f"m{i}").alias("least_id")) for i, (name, _) in enumerate(rules)])))
    return rows.unionByName(gates.suite([("item exists", gates.foreign_key(read_table(spark, sf, "predictions", ("question_id",)), "question_id", items, "question_id"))]))


@query("""WITH g AS (SELECT DISTINCT run_id, checkpoint_step FROM run_metrics), p AS (SELECT DISTINCT run_id, checkpoint_step FROM predictions)
  SELECT coalesce(g.run_id, p.run_id) AS run_id, coalesce(g.checkpoint_step, p.checkpoint_step) AS checkpoint_step, CASE WHEN p.run_id IS NULL THEN 'left_only' ELSE 'right_only' END AS side
  FROM g FULL JOIN p ON g.run_id = p.run_id AND g.checkpoint_step = p.checkpoint_step WHERE g.run_id IS NULL OR p.run_id IS NULL""")
def j23_reconcile(spark: SparkSession, sf: str) -> DataFrame:
    keys = ["run_id", "checkpoint_step"]
    return joins.reconcile(read_table(spark, sf, "run_metrics", keys), read_table(spark, sf, "predictions", keys), keys)


@query("""SELECT name, CASE WHEN count(DISTINCT v) <= 1 THEN min(v) ELSE 'varies' END AS value FROM (SELECT 'condition' AS name, split_part(run_id, '__', 2) AS v FROM run_metrics UNION ALL SELECT 'folder', split_part(file_path, '/', 1) FROM run_metrics) GROUP BY name""")
def z09_constancy(spark: SparkSession, sf: str) -> DataFrame:
    d = read_table(spark, sf, "run_metrics", ("run_id", "file_path")).select(F.split_part("run_id", F.lit("__"), F.lit(2)).alias("condition"), F.split_part("file_path", F.lit("/"), F.lit(1)).alias("folder"))
    return gates.constant_columns(d, ["condition", "folder"]).withColumnRenamed("column_name", "name")


@query(f"""WITH {_P}, c AS (SELECT subset, gold, count(*) AS c FROM p JOIN (SELECT DISTINCT question_id, subset FROM wmdp_questions) q USING (question_id) WHERE gold IS NOT NULL AND p.checkpoint_step > 0 GROUP BY ALL),
  m AS (SELECT subset, arg_min(gold, (-c, gold)) AS g FROM c GROUP BY subset), w AS (SELECT arg_min(gold, (-c, gold)) AS g FROM (SELECT gold, sum(c) AS c FROM c GROUP BY gold))
  SELECT count(t.gold) AS n, round(avg(CAST(coalesce(m.g, w.g) = t.gold AS INT)), 9) AS accuracy FROM (SELECT subset, p.gold FROM p JOIN (SELECT DISTINCT question_id, subset FROM wmdp_questions) q USING (question_id) WHERE p.checkpoint_step = 0) t LEFT JOIN m USING (subset) CROSS JOIN w""")
def a36_majority_predictor(spark: SparkSession, sf: str) -> DataFrame:
    q = read_table(spark, sf, "wmdp_questions", ("question_id", "subset")).distinct()
    d = predictions(spark, sf).join(q, "question_id")
    return aggregates.majority_predictor(d.where("checkpoint_step > 0"), d.where("checkpoint_step = 0"), "subset", "gold").withColumn("accuracy", F.round("accuracy", 9))
