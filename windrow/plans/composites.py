"""Composite plans: characterization of edits, evaluation items, scaffold of chapters, trajectory verdicts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from windrow.functions import text as X
from windrow.functions import values as V
from windrow.operators import aggregates, information, sampling, windows
from windrow.plans.metric_queries import predictions
from windrow.plans.text_queries import STOPWORDS, items
from windrow.registry import query
from windrow.sources import read_table


@query()
def plan_characterization(spark: SparkSession, sf: str) -> DataFrame:
    """Edits from each first choice to the right answer: terms, categories, modal targets, one-to-one mappings."""
    pairs = read_table(spark, sf, "wmdp_questions", ("question_id", "choice_a", "correct_text")).distinct()
    subs = X.diff_pairs(pairs, "question_id", "choice_a", "correct_text").select("question_id", "left_raw", X.norm_term(F.col("left_raw")).alias("source"), X.norm_term(F.col("right_raw")).alias("target"))
    reason = X.trivial_reason(F.col("source"), F.col("target"), STOPWORDS)
    kind = F.when(F.col("reason").isNotNull(), "trivial").when(X.is_quantity(F.col("source")) & X.is_quantity(F.col("target")), "numeric").when(F.col("left_raw").rlike(r"(?U)(?<!\w)\p{Lu}|\w\W+\w") | (F.length("source") >= 4) & ~F.col("source").isin(*STOPWORDS), "entity_like").otherwise("other")
    tagged = subs.withColumn("reason", reason).withColumn("category", kind)
    mapping = aggregates.modal_mapping(tagged, "source", "target", "question_id")
    kinds = tagged.groupBy("source", "category").agg(F.count(F.lit(1)).alias("c")).groupBy("source").agg(F.min_by("category", F.struct(-F.col("c"), F.col("category"))).alias("category"))
    return mapping.join(kinds, "source")


@query("""WITH q AS (SELECT DISTINCT question_id, subset, question, choice_a, choice_b, choice_c, choice_d, correct_text FROM wmdp_questions), o AS (SELECT *, list_transform(list_sort(list_transform([choice_a, choice_b, choice_c, choice_d], lambda o: {'h': sha256(question_id || '|' || o), 'o': o})), lambda s: s.o) AS options FROM q)
  SELECT question_id, options, list_position(options, correct_text) AS answer, contains(lower(question), lower(correct_text)) AS leaks, row_number() OVER (PARTITION BY subset ORDER BY sha256('held|' || question_id), question_id) <= 10 AS held_out FROM o""")
def plan_evaluation_items(spark: SparkSession, sf: str) -> DataFrame:
    """Options shuffled by digest, the place of the answer, whether the question gives it away, ten held out of each subset."""
    from pyspark.sql import Window as W

    q = read_table(spark, sf, "wmdp_questions", ("question_id", "subset", "question", "choice_a", "choice_b", "choice_c", "choice_d", "correct_text")).distinct()
    o = q.withColumn("options", sampling.shuffled_options(F.col("question_id"), F.array("choice_a", "choice_b", "choice_c", "choice_d")))
    held = F.row_number().over(W.partitionBy("subset").orderBy(sampling.hash_rank("question_id", "held"), "question_id")) <= 10
    place = F.array_position("options", F.col("correct_text"))
    return o.select("question_id", "options", F.when(place > 0, place).cast("int").alias("answer"), X.contains_verbatim(F.col("question"), F.col("correct_text")).alias("leaks"), held.alias("held_out"))


@query("""WITH p AS (SELECT DISTINCT part_id, chapter_id, section_id, entity_ids FROM spine_parts), c AS (SELECT chapter_id, count(*) AS n_parts, count(DISTINCT section_id) AS n_sections FROM p GROUP BY chapter_id), e AS (SELECT DISTINCT chapter_id, unnest(entity_ids) AS e FROM p), m AS (SELECT e FROM e GROUP BY e HAVING count(*) > 1),
  r AS (SELECT chapter_id, count(*) AS n_entities, count(m.e) AS n_shared FROM e LEFT JOIN m USING (e) GROUP BY chapter_id), x AS (SELECT *, CAST(1000000 * n_parts AS DOUBLE) / sum(n_parts) OVER () AS v FROM c), f AS (SELECT *, floor(v) AS f FROM x)
  SELECT f.chapter_id, n_parts, n_sections, coalesce(n_entities, 0) AS n_entities, coalesce(n_shared, 0) AS n_shared, CAST(f + CASE WHEN row_number() OVER (ORDER BY round(v - f, 9) DESC, f.chapter_id) <= 1000000 - sum(f) OVER () THEN 1 ELSE 0 END AS BIGINT) AS budget FROM f LEFT JOIN r ON r.chapter_id = f.chapter_id""")
def plan_scaffold(spark: SparkSession, sf: str) -> DataFrame:
    """Chapters with their parts, entities, entities shared with other chapters, and a budget of a million tokens by parts."""
    p = read_table(spark, sf, "spine_parts", ("part_id", "chapter_id", "section_id", "entity_ids")).distinct()
    c = p.groupBy("chapter_id").agg(F.count(F.lit(1)).alias("n_parts"), F.countDistinct("section_id").alias("n_sections"))
    e = p.select("chapter_id", F.explode("entity_ids").alias("e")).distinct()
    shared = e.groupBy("e").agg(F.count(F.lit(1)).alias("k"))
    refs = e.join(shared, "e").groupBy("chapter_id").agg(F.count(F.lit(1)).alias("n_entities"), F.count_if(F.col("k") > 1).alias("n_shared"))
    budget = sampling.largest_remainder(c, "chapter_id", "n_parts", 1_000_000, out="budget")
    return budget.join(refs, "chapter_id", "left").fillna({"n_entities": 0, "n_shared": 0})


@query()
def plan_trajectories(spark: SparkSession, sf: str) -> DataFrame:
    """Each run's first step whose information clears its permutation null, its first step of accuracy 0.6, and which came first."""
    p = predictions(spark, sf)
    band = information.permutation_band(p, ["run_id", "checkpoint_step"], "chosen", "gold")
    cleared = windows.first_step(band.withColumn("v", F.when(F.col("clears"), F.lit(1.0))), ["run_id"], "checkpoint_step", "v", 1.0).withColumnRenamed("first_step", "first_clear")
    acc = p.groupBy("run_id", "checkpoint_step").agg(aggregates.accuracy(F.col("chosen"), F.col("gold")).alias("accuracy"))
    high = windows.first_step(acc, ["run_id"], "checkpoint_step", "accuracy", 0.6).withColumnRenamed("first_step", "first_high")
    return cleared.join(high, "run_id").withColumn("verdict", V.order_verdict(F.col("first_clear"), F.col("first_high")))


@query("SELECT count(*) AS n, count(DISTINCT question_id) AS n_items, count(DISTINCT subset) AS n_subsets FROM (SELECT DISTINCT question_id, subset FROM wmdp_questions)")
def plan_inventory(spark: SparkSession, sf: str) -> DataFrame:
    q = items(spark, sf)
    return q.select("question_id", "subset").distinct().agg(F.count(F.lit(1)).alias("n"), F.countDistinct("question_id").alias("n_items"), F.countDistinct("subset").alias("n_subsets"))
