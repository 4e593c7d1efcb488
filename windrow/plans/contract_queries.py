"""Queries of contracts and audits over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from windrow.functions import text as X
from windrow.functions import values as V
from windrow.operators import contracts, gates, joins, windows
from windrow.plans.graph_queries import _L, links
from windrow.plans.metric_queries import _A, _P, accuracies, predictions
from windrow.registry import query
from windrow.sources import read_table

_KPN = f"{_P}, g AS (SELECT run_id, checkpoint_step, count(*) FILTER (chosen = gold) AS k, count(*) FILTER (chosen IS NOT NULL AND gold IS NOT NULL) AS n FROM p GROUP BY ALL)"


def _counts(spark: SparkSession, sf: str) -> DataFrame:
    return predictions(spark, sf).groupBy("run_id", "checkpoint_step").agg(F.count_if(F.col("chosen") == F.col("gold")).alias("k"), F.count_if(F.col("chosen").isNotNull() & F.col("gold").isNotNull()).alias("n"))


@query("""WITH g AS (SELECT DISTINCT taxon_id, name_txt, taxon_rank, parent_genus FROM gazetteer_names), t AS (SELECT DISTINCT name_txt FROM g WHERE taxon_rank = 'genus'), o AS (SELECT organism_id AS id, taxon_rank, parent_genus FROM (SELECT DISTINCT organism_id, taxon_rank, parent_genus FROM wmdp_organisms)),
  n AS (SELECT name_txt AS k, CAST(taxon_id AS VARCHAR) AS id, taxon_rank, parent_genus FROM g UNION ALL SELECT id, id, taxon_rank, parent_genus FROM o)
  SELECT DISTINCT k AS id, CASE WHEN taxon_rank IS NULL OR taxon_rank NOT IN ('genus', 'species') THEN 'level' WHEN taxon_rank = 'genus' AND parent_genus IS NOT NULL THEN 'top with parent' WHEN taxon_rank = 'species' AND (parent_genus IS NULL OR parent_genus NOT IN (SELECT name_txt FROM t)) THEN 'parent' END AS problem FROM n
  WHERE taxon_rank IS NULL OR taxon_rank NOT IN ('genus', 'species') OR (taxon_rank = 'genus' AND parent_genus IS NOT NULL) OR (taxon_rank = 'species' AND (parent_genus IS NULL OR parent_genus NOT IN (SELECT name_txt FROM t)))""")
def c03_taxonomy(spark: SparkSession, sf: str) -> DataFrame:
    """Nodes of the tree of genera and species, the list's and the organisms', that break it."""
    g = read_table(spark, sf, "gazetteer_names", ("name_txt", "taxon_rank", "parent_genus")).distinct()
    o = read_table(spark, sf, "wmdp_organisms", ("organism_id", "taxon_rank", "parent_genus")).distinct().select(F.col("organism_id").alias("name_txt"), "taxon_rank", "parent_genus")
    tops = g.where("taxon_rank = 'genus'")
    return contracts.taxonomy(g.unionByName(o.join(tops.select("name_txt"), "name_txt", "left_anti")), "name_txt", "parent_genus", "taxon_rank", "genus", "species")


@query("""WITH m AS (SELECT DISTINCT run_id, checkpoint_step, payload FROM run_metrics), n AS (SELECT a.run_id, a.checkpoint_step, sha256(a.payload) AS h FROM m a), x AS (SELECT run_id, checkpoint_step, min(h) AS h FROM n GROUP BY ALL), y AS (SELECT run_id, checkpoint_step + 1 AS checkpoint_step, h FROM x)
  SELECT coalesce(y.run_id, x.run_id) AS run_id, coalesce(y.checkpoint_step, x.checkpoint_step) AS checkpoint_step, CASE WHEN x.run_id IS NULL THEN 'missing' WHEN y.run_id IS NULL THEN 'unexpected' ELSE 'changed' END AS problem FROM y FULL JOIN x ON x.run_id = y.run_id AND x.checkpoint_step = y.checkpoint_step WHERE x.run_id IS NULL OR y.run_id IS NULL OR x.h IS DISTINCT FROM y.h""")
def c09_manifest(spark: SparkSession, sf: str) -> DataFrame:
    """The metrics files' digests against those of the step before."""
    keys = ["run_id", "checkpoint_step"]
    m = contracts.manifest(read_table(spark, sf, "run_metrics", (*keys, "payload")), keys, "payload").groupBy(*keys).agg(F.min("digest").alias("digest"))
    return contracts.manifest_changes(m.withColumn("checkpoint_step", F.col("checkpoint_step") + 1), m, keys)


@query("""WITH r AS (SELECT DISTINCT run_id, split_part(run_id, '__', 1) AS model, regexp_extract(run_id, '__lr-([0-9.e-]+)', 1) AS lr FROM predictions), s AS (SELECT run_id, sha256('=' || model || '|=' || lr) AS signature FROM r) SELECT signature, count(*) AS n_runs, min(run_id) AS least_run FROM s GROUP BY signature""")
def c11_matched_settings(spark: SparkSession, sf: str) -> DataFrame:
    """Runs of the same model and learning rate, by the signature of these."""
    r = read_table(spark, sf, "predictions", ("run_id",)).distinct().select("run_id", F.split_part("run_id", F.lit("__"), F.lit(1)).alias("model"), F.regexp_extract("run_id", r"__lr-([0-9.e-]+)", 1).alias("lr"))
    return r.groupBy(contracts.signature(["model", "lr"]).alias("signature")).agg(F.count(F.lit(1)).alias("n_runs"), F.min("run_id").alias("least_run"))


@query(f"""WITH {_P}, k AS (SELECT run_id, checkpoint_step, question_id, row_number() OVER (PARTITION BY run_id, checkpoint_step ORDER BY question_id) AS place FROM p), a AS (SELECT run_id, place, question_id FROM k WHERE checkpoint_step = 0), b AS (SELECT run_id, place, question_id FROM k WHERE checkpoint_step = 1)
  SELECT coalesce(a.run_id, b.run_id) AS run_id, count(a.question_id) AS n_a, count(b.question_id) AS n_b, list_sort(list(a.question_id) FILTER (a.question_id IS NOT NULL)) IS NOT DISTINCT FROM list_sort(list(b.question_id) FILTER (b.question_id IS NOT NULL)) AS same_set, bool_and(a.question_id IS NOT DISTINCT FROM b.question_id) AS same_order FROM a FULL JOIN b ON a.run_id = b.run_id AND a.place = b.place GROUP BY 1""")
def c12_row_ids(spark: SparkSession, sf: str) -> DataFrame:
    """C-08 and C-12: each run's items at step 1 against those at step 0, as sets and in order."""
    p = predictions(spark, sf).withColumn("place", F.row_number().over(W.partitionBy("run_id", "checkpoint_step").orderBy("question_id")))
    return contracts.ordered_equal(p.where("checkpoint_step = 0"), p.where("checkpoint_step = 1"), ["run_id"], "place", "question_id")


@query("""WITH p AS (SELECT DISTINCT part_id, corpus_alias, target_tokens, text FROM spine_parts) SELECT corpus_alias, count(*) AS n, count(*) FILTER (len(regexp_extract_all(text, '\\S+')) > 1.75 * target_tokens) AS n_over, coalesce(max(len(regexp_extract_all(text, '\\S+'))), 0) AS most FROM p GROUP BY corpus_alias""")
def c13_zero_truncation(spark: SparkSession, sf: str) -> DataFrame:
    """C-13: texts that a window of 1.75 times the target would truncate; none may be."""
    d = read_table(spark, sf, "spine_parts", ("part_id", "corpus_alias", "target_tokens", "text")).select("part_id", "corpus_alias", "target_tokens", F.xxhash64("text").alias("_h"), X.ws_count(F.col("text")).alias("n_words")).distinct()
    return d.groupBy("corpus_alias").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("n_words") > 1.75 * F.col("target_tokens")).alias("n_over"), F.coalesce(F.max("n_words"), F.lit(0)).alias("most"))


_EXPECTED = (("mixed", "late", True), ("retain-only", "late", False), ("rewrite-f", "late", True), ("rewrite-w", "late", False))


@query(f"""WITH {_A}, r AS (SELECT split_part(run_id, '__', 2) AS condition, 'late' AS phase, arg_max(accuracy, checkpoint_step) > arg_min(accuracy, checkpoint_step) AS up FROM a WHERE accuracy IS NOT NULL GROUP BY run_id), g AS (SELECT condition, phase, bool_and(up) AS x, bool_or(up) AS y FROM r GROUP BY ALL),
  e AS (SELECT * FROM (VALUES {', '.join(f"('{a}', '{b}', {c})" for a, b, c in _EXPECTED)}) AS t(condition, phase, expected)) SELECT e.condition, e.phase, expected, CASE WHEN x = y THEN x END AS found, coalesce((CASE WHEN x = y THEN x END) = expected, false) AS sound FROM e LEFT JOIN g USING (condition, phase)""")
def c14_polarity(spark: SparkSession, sf: str) -> DataFrame:
    """Whether all runs of a condition gain from first to last step, against what is expected of it."""
    r = accuracies(spark, sf).where("accuracy is not null").groupBy("run_id").agg((F.max_by("accuracy", "checkpoint_step") > F.min_by("accuracy", "checkpoint_step")).alias("up"))
    d = r.select(F.split_part("run_id", F.lit("__"), F.lit(2)).alias("condition"), F.lit("late").alias("phase"), "up")
    return contracts.polarity(d, "condition", "phase", "up", _EXPECTED)


@query("""WITH q AS (SELECT DISTINCT * FROM wmdp_questions), o AS (SELECT question_id, unnest([choice_a, choice_b, choice_c, choice_d]) AS o FROM q), n AS (SELECT question_id, count(DISTINCT lower(trim(o, ' '))) AS k FROM o GROUP BY question_id)
  SELECT 'four options' AS name, count(*) = 0 AS passes, count(*) AS n_violations, min(question_id) AS least_id FROM n WHERE k < 4 UNION ALL SELECT 'index in range', count(*) = 0, count(*), min(question_id) FROM q WHERE NOT coalesce(correct_index BETWEEN 0 AND 3, false)
  UNION ALL SELECT 'answer is the option', count(*) = 0, count(*), min(question_id) FROM q WHERE NOT coalesce(correct_text = [choice_a, choice_b, choice_c, choice_d][correct_index + 1], false) UNION ALL SELECT 'answer not in question', count(*) = 0, count(*), min(question_id) FROM q WHERE NOT coalesce(NOT contains(lower(question), lower(correct_text)), false)
  UNION ALL SELECT 'tokens known', count(*) = 0, count(*), min(question_id) FROM q WHERE n_tokens IS NULL""")
def c20_item_contract(spark: SparkSession, sf: str) -> DataFrame:
    """C-20: each item's options, answer and question hold together."""
    q = read_table(spark, sf, "wmdp_questions").distinct()
    options = F.array("choice_a", "choice_b", "choice_c", "choice_d")
    distinct = F.size(F.array_compact(F.array_distinct(F.transform(options, lambda o: F.lower(F.trim(o))))))
    return gates.suite_of_rules(q, "question_id", [
        ("four options", distinct == 4), ("index in range", F.col("correct_index").between(0, 3)), ("answer is the option", F.col("correct_text") == F.try_element_at(options, (F.col("correct_index") + 1).cast("int"))),
        ("answer not in question", ~F.contains(F.lower("question"), F.lower("correct_text"))), ("tokens known", F.col("n_tokens").isNotNull()),
    ])


@query("""WITH d AS (SELECT DISTINCT organism_id, taxon_rank, name_raw FROM wmdp_organisms), r AS (SELECT organism_id, taxon_rank, CASE WHEN name_raw IS NULL THEN NULL WHEN regexp_full_match(trim(name_raw, ' '), '[A-Z][a-z]+ [a-z]+') THEN 'species' WHEN regexp_full_match(trim(name_raw, ' '), '[A-Z][a-z]+') THEN 'genus' ELSE 'other' END AS by_shape FROM d)
  SELECT count(*) AS n, count(*) FILTER (taxon_rank IS NOT DISTINCT FROM by_shape) AS n_equal, round(count(*) FILTER (taxon_rank IS NOT DISTINCT FROM by_shape) / count(*), 9) AS share, count(*) FILTER (taxon_rank IS NOT DISTINCT FROM by_shape) / count(*) >= 0.85 AS passes FROM r""")
def c23_agreement(spark: SparkSession, sf: str) -> DataFrame:
    """C-23 and C-24: recorded ranks against the shapes of the names; 0.85 must agree."""
    d = read_table(spark, sf, "wmdp_organisms", ("organism_id", "taxon_rank", "name_raw")).distinct()
    name = F.trim("name_raw")
    shape = F.when(F.col("name_raw").isNotNull(), F.when(name.rlike("^[A-Z][a-z]+ [a-z]+$"), "species").when(name.rlike("^[A-Z][a-z]+$"), "genus").otherwise("other"))
    return contracts.agreement(d.withColumn("by_shape", shape), "taxon_rank", "by_shape", 0.85).withColumn("share", F.round("share", 9))


@query("""WITH p AS (SELECT DISTINCT part_id, corpus_alias, part_kind, target_tokens, chapter_id, section_id FROM spine_parts), s AS (SELECT chapter_id, corpus_alias, count(*) AS n, coalesce(sum(target_tokens), 0) AS t, count(DISTINCT section_id) AS k FROM p GROUP BY ALL), f AS (SELECT * FROM s WHERE corpus_alias = 'CORPUS_F'), w AS (SELECT * FROM s WHERE corpus_alias = 'CORPUS_W'),
  b AS (SELECT coalesce(f.chapter_id, w.chapter_id) AS chapter_id, list_filter([CASE WHEN f.n IS NULL OR w.n IS NULL THEN 'one side only' END, CASE WHEN abs(f.n - w.n) > 2 THEN 'rows' END, CASE WHEN abs(f.t - w.t) > 0.2 * greatest(f.t, w.t) THEN 'tokens' END, CASE WHEN f.k <> w.k THEN 'sections' END], lambda x: x IS NOT NULL) AS failures FROM f FULL JOIN w ON f.chapter_id = w.chapter_id)
  SELECT chapter_id, array_to_string(failures, '; ') AS failures FROM b WHERE len(failures) > 0""")
def c25_matching_report(spark: SparkSession, sf: str) -> DataFrame:
    """C-25: all ways in which a chapter's two arms don't match, gathered."""
    p = read_table(spark, sf, "spine_parts", ("part_id", "corpus_alias", "part_kind", "target_tokens", "chapter_id", "section_id")).distinct()
    s = p.groupBy("chapter_id").pivot("corpus_alias", ["CORPUS_F", "CORPUS_W"]).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("target_tokens"), F.lit(0)).alias("t"), F.countDistinct("section_id").alias("k"))
    c = lambda a, v: F.col(f"CORPUS_{a}_{v}")
    one_side = (F.coalesce(c("F", "n"), F.lit(0)) == 0) | (F.coalesce(c("W", "n"), F.lit(0)) == 0)
    failures = F.array_compact(F.array(F.when(one_side, "one side only"), F.when(~one_side & (F.abs(c("F", "n") - c("W", "n")) > 2), "rows"), F.when(~one_side & (F.abs(c("F", "t") - c("W", "t")) > 0.2 * F.greatest(c("F", "t"), c("W", "t"))), "tokens"), F.when(~one_side & (c("F", "k") != c("W", "k")), "sections")))
    return s.where(F.coalesce(c("F", "n"), F.lit(0)) + F.coalesce(c("W", "n"), F.lit(0)) > 0).select("chapter_id", F.array_join(failures, "; ").alias("failures")).where("failures <> ''")


@query(f"""WITH {_KPN}, r AS (SELECT *, split_part(run_id, '__', 1) AS model, split_part(run_id, '__', 2) AS condition, regexp_extract(run_id, '__lr-([0-9.e-]+)', 1) AS lr, CAST(regexp_extract(run_id, '__seed-([0-9]+)', 1) AS INT) AS seed FROM g WHERE n > 0), s AS (SELECT *, min(seed) OVER w AS lo, max(seed) OVER w AS hi FROM r WINDOW w AS (PARTITION BY model, condition, lr))
  SELECT a.model, a.condition, a.lr, a.checkpoint_step, round(a.k / a.n - b.k / b.n, 9) + 0.0 AS difference, CASE WHEN a.checkpoint_step = 0 THEN a.k = b.k AND a.n = b.n ELSE abs(a.k / a.n - b.k / b.n) <= 0.05 END AS passes
  FROM s a JOIN s b ON a.model = b.model AND a.condition = b.condition AND a.lr = b.lr AND a.checkpoint_step = b.checkpoint_step AND a.seed = a.lo AND b.seed = b.hi AND a.seed < b.seed""")
def c27_replication(spark: SparkSession, sf: str) -> DataFrame:
    """C-27: the first against the last seed of the same settings."""
    keys = ["model", "condition", "lr"]
    r = _counts(spark, sf).where("n > 0").select("*", F.split_part("run_id", F.lit("__"), F.lit(1)).alias("model"), F.split_part("run_id", F.lit("__"), F.lit(2)).alias("condition"), F.regexp_extract("run_id", r"__lr-([0-9.e-]+)", 1).alias("lr"), F.regexp_extract("run_id", r"__seed-([0-9]+)", 1).cast("int").alias("seed"))
    ends = r.groupBy(*keys).agg(F.min("seed").alias("lo"), F.max("seed").alias("hi")).where("lo < hi")
    d = r.join(F.broadcast(ends), keys)
    return contracts.replication(d.where("seed = lo"), d.where("seed = hi"), keys, "checkpoint_step", "k", "n", 0.05).withColumn("difference", F.round("difference", 9) + 0.0)


@query("""WITH m AS (SELECT file_id, TRY_CAST(payload AS JSON) AS j FROM run_metrics), x AS (SELECT file_id, j, json_type(j) AS t, json_type(j, '$.step') AS s, json_type(j, '$.wmdp_sha256') AS h FROM m)
  SELECT CAST(file_id AS VARCHAR) AS id, CASE WHEN t IS DISTINCT FROM 'OBJECT' THEN ['no object'] ELSE list_filter([CASE WHEN s IS NULL THEN 'missing step' WHEN s NOT IN ('UBIGINT', 'BIGINT', 'DOUBLE') THEN 'type step' END, CASE WHEN h IS NULL THEN 'missing wmdp_sha256' WHEN h <> 'VARCHAR' THEN 'type wmdp_sha256' END], lambda v: v IS NOT NULL) END AS problems
  FROM x WHERE t IS DISTINCT FROM 'OBJECT' OR s IS NULL OR s NOT IN ('UBIGINT', 'BIGINT', 'DOUBLE') OR h IS NULL OR h <> 'VARCHAR'""")
def c28_typed_records(spark: SparkSession, sf: str) -> DataFrame:
    """C-28: payloads without a step that is a number, or without a digest that is a string."""
    return contracts.typed_record(read_table(spark, sf, "run_metrics", ("file_id", "payload")), "payload", [("step", "number"), ("wmdp_sha256", "string")], ["file_id"])


@query(f"""WITH {_L}, d AS (SELECT DISTINCT organism_id, extraction_source, taxon_rank, parent_genus FROM wmdp_organisms), v AS (SELECT taxon_rank AS dimension, parent_genus AS value, count(*) AS c FROM d WHERE taxon_rank IS NOT NULL AND parent_genus IS NOT NULL GROUP BY ALL),
  o AS (SELECT organism_id AS id FROM d LEFT JOIN v ON v.dimension = d.taxon_rank AND v.value = d.parent_genus AND c >= 2 WHERE d.parent_genus IS NOT NULL AND v.c IS NULL), m AS (SELECT entity AS id FROM l GROUP BY entity HAVING count(*) > 4), f AS (SELECT DISTINCT parent_genus AS id FROM d WHERE parent_genus IS NOT NULL AND parent_genus NOT IN (SELECT name_txt FROM gazetteer_names))
  SELECT 'value in space' AS name, count(*) = 0 AS passes, count(*) AS n_violations, min(id) AS least_id FROM o UNION ALL SELECT 'at most four', count(*) = 0, count(*), min(id) FROM m UNION ALL SELECT 'grounded', count(*) = 0, count(*), min(id) FROM f""")
def c29_world_table(spark: SparkSession, sf: str) -> DataFrame:
    """C-29 and P-07: values in the closed space that at least two rows make, at most four items an entity, genera in the list."""
    d = read_table(spark, sf, "wmdp_organisms", ("organism_id", "extraction_source", "taxon_rank", "parent_genus")).distinct()
    space = contracts.value_space(d, "taxon_rank", "parent_genus", 2)
    names = read_table(spark, sf, "gazetteer_names", ("name_txt",))
    return gates.suite([("value in space", contracts.outside_space(d, "taxon_rank", "parent_genus", space, ["organism_id"])), ("at most four", contracts.most_per_group(links(spark, sf), ["entity"], 4)), ("grounded", gates.foreign_key(d, "parent_genus", names, "name_txt"))])


@query("""WITH v AS (SELECT taxon_rank, parent_genus AS v FROM (SELECT DISTINCT organism_id, taxon_rank, parent_genus FROM wmdp_organisms) WHERE taxon_rank IS NOT NULL AND parent_genus IS NOT NULL GROUP BY ALL HAVING count(*) >= 2) SELECT taxon_rank, list_sort(list(v)) AS space FROM v GROUP BY taxon_rank""")
def p07_value_space(spark: SparkSession, sf: str) -> DataFrame:
    return contracts.value_space(read_table(spark, sf, "wmdp_organisms", ("organism_id", "taxon_rank", "parent_genus")).distinct(), "taxon_rank", "parent_genus", 2)


@query("""WITH x AS (SELECT organism_id, max(n_questions) AS stored FROM wmdp_organisms GROUP BY organism_id), y AS (SELECT organism_id, count(DISTINCT i) AS found FROM (SELECT organism_id, unnest(from_json(question_ids, '["VARCHAR"]')) AS i FROM wmdp_organisms WHERE question_ids IS NOT NULL) GROUP BY organism_id)
  SELECT coalesce(x.organism_id, y.organism_id) AS organism_id, CAST(found AS DOUBLE) AS found, CAST(stored AS DOUBLE) AS stored, CASE WHEN y.organism_id IS NULL THEN 'missing' WHEN x.organism_id IS NULL THEN 'unexpected' WHEN found IS DISTINCT FROM stored THEN 'differs' ELSE 'equal' END AS state FROM x FULL JOIN y ON x.organism_id = y.organism_id""")
def c30_regression(spark: SparkSession, sf: str) -> DataFrame:
    """C-30: recounted items of each entity against the stored count."""
    found = links(spark, sf).groupBy(F.col("entity").alias("organism_id")).agg(F.count(F.lit(1)).cast("double").alias("n"))
    stored = read_table(spark, sf, "wmdp_organisms", ("organism_id", "n_questions")).groupBy("organism_id").agg(F.max("n_questions").cast("double").alias("n"))
    return contracts.regression(found, stored, ["organism_id"], "n", 0.0)


@query("""WITH x AS (SELECT DISTINCT question_id, question, correct_text FROM wmdp_questions), r AS (SELECT CAST('0x' || substr(sha256('=' || question_id || '|' || coalesce('=' || question, 'null') || '|' || coalesce('=' || correct_text, 'null')), 1, 15) AS BIGINT) AS v FROM x) SELECT count(*) AS n, CAST(sum(v) AS VARCHAR) AS digest FROM r""")
def h03_table_digest(spark: SparkSession, sf: str) -> DataFrame:
    """H-01 to H-03: one digest of the items, whatever their order."""
    q = read_table(spark, sf, "wmdp_questions", ("question_id", "question", "correct_text")).distinct()
    return contracts.table_digest(q, ["question_id", "question", "correct_text"])


@query(f"WITH {_P}, q AS (SELECT DISTINCT question_id, subset, correct_index FROM wmdp_questions) SELECT run_id, CAST((ascii(chosen) - 65) * 16 + (ascii(gold) - 65) * 4 + correct_index AS INT) AS code, count(*) AS n FROM p JOIN q USING (question_id) WHERE chosen IS NOT NULL AND gold IS NOT NULL AND correct_index IS NOT NULL GROUP BY ALL")
def h12_label_codes(spark: SparkSession, sf: str) -> DataFrame:
    """I-05 and H-12: the joint of choice, gold and right place as one code each."""
    q = read_table(spark, sf, "wmdp_questions", ("question_id", "correct_index")).distinct()
    p = predictions(spark, sf).join(F.broadcast(q), "question_id").where("chosen is not null and gold is not null and correct_index is not null")
    return p.groupBy("run_id", ((F.ascii("chosen") - 65) * 16 + (F.ascii("gold") - 65) * 4 + F.col("correct_index")).cast("int").alias("code")).agg(F.count(F.lit(1)).alias("n"))


@query("""WITH c AS (SELECT DISTINCT call_id, attempt_index, timestamp_utc FROM raw_llm_log), g AS (SELECT call_id, attempt_index, max(timestamp_utc) AS t FROM c GROUP BY ALL), o AS (SELECT *, lag(t) OVER (PARTITION BY call_id ORDER BY attempt_index) AS before FROM g) SELECT count(*) AS n, count(*) FILTER (t IS NULL) AS n_null, count(*) FILTER (t < before) AS n_disordered FROM o""")
def h09_time_order(spark: SparkSession, sf: str) -> DataFrame:
    """H-09: attempts whose time lies before that of the attempt before."""
    g = read_table(spark, sf, "raw_llm_log", ("call_id", "attempt_index", "timestamp_utc")).groupBy("call_id", "attempt_index").agg(F.max("timestamp_utc").alias("t"))
    o = g.withColumn("before", F.lag("t").over(W.partitionBy("call_id").orderBy("attempt_index")))
    return o.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("t").isNull()).alias("n_null"), F.count_if(F.col("t") < F.col("before")).alias("n_disordered"))


@query(f"""WITH {_A}, f AS (SELECT run_id, coalesce(min(checkpoint_step) FILTER (accuracy >= 0.4), CAST('inf' AS DOUBLE)) AS a, coalesce(min(checkpoint_step) FILTER (accuracy >= 0.5), CAST('inf' AS DOUBLE)) AS b FROM a GROUP BY run_id)
  SELECT run_id, CASE WHEN a = 'inf'::DOUBLE AND b = 'inf'::DOUBLE THEN 'not_evaluable' WHEN b = 'inf'::DOUBLE THEN 'A' WHEN b - a >= 8 THEN 'B' ELSE 'C' END AS verdict FROM f""")
def h15_verdicts(spark: SparkSession, sf: str) -> DataFrame:
    """H-15: a verdict from the first steps that reach 0.4 and 0.5; neither reached can't be judged."""
    inf = F.lit(float("inf"))
    first = lambda t: F.coalesce(F.min(F.when(F.col("accuracy") >= t, F.col("checkpoint_step"))).cast("double"), inf)
    f = accuracies(spark, sf).groupBy("run_id").agg(first(0.4).alias("a"), first(0.5).alias("b"))
    return f.select("run_id", V.verdict([("not_evaluable", (F.col("a") == inf) & (F.col("b") == inf)), ("A", F.col("b") == inf), ("B", F.col("b") - F.col("a") >= 8)], "C").alias("verdict"))


@query(f"""WITH {_A}, f AS (SELECT run_id, coalesce(min(checkpoint_step) FILTER (accuracy >= 0.4), CAST('inf' AS DOUBLE)) AS s FROM a GROUP BY run_id), g AS (SELECT split_part(run_id, '__', 2) AS condition, list_sort(list(s)) AS v FROM f GROUP BY ALL)
  SELECT condition, CAST(len(v) AS INT) AS n, CASE WHEN len(v) % 2 = 1 THEN v[len(v) // 2 + 1] WHEN isinf(v[len(v) // 2 + 1]) THEN v[len(v) // 2 + 1] ELSE (v[len(v) // 2] + v[len(v) // 2 + 1]) / 2 END AS median FROM g""")
def a42_extended_median(spark: SparkSession, sf: str) -> DataFrame:
    """Median of the first step that reaches 0.4, with never as infinity."""
    f = accuracies(spark, sf).groupBy("run_id").agg(F.coalesce(F.min(F.when(F.col("accuracy") >= 0.4, F.col("checkpoint_step"))).cast("double"), F.lit(float("inf"))).alias("s"))
    g = f.groupBy(F.split_part("run_id", F.lit("__"), F.lit(2)).alias("condition")).agg(F.array_sort(F.collect_list("s")).alias("v"))  # runs of a condition are few
    return g.select("condition", F.size("v").alias("n"), V.extended_median(F.col("v")).alias("median"))


@query(f"""WITH {_A}, b AS (SELECT run_id, accuracy FROM a WHERE checkpoint_step = 0), c AS (SELECT run_id, accuracy FROM a WHERE checkpoint_step = 64) SELECT run_id, round(c.accuracy - b.accuracy, 8) + 0.0 AS delta, round((c.accuracy - b.accuracy) / nullif(greatest(c.accuracy, b.accuracy), 0), 7) + 0.0 AS relative FROM c JOIN b USING (run_id)""")
def j24_metric_delta(spark: SparkSession, sf: str) -> DataFrame:
    """J-24, W-10 and H-11: differences over shared keys, absolute and relative to the larger."""
    a = accuracies(spark, sf)
    b = a.where("checkpoint_step = 0").select("run_id", F.col("accuracy").alias("_b"))
    d = F.col("accuracy") - F.col("_b")
    return a.where("checkpoint_step = 64").join(b, "run_id").select("run_id", (F.round(d, 8) + 0.0).alias("delta"), (F.round(V.safe_divide(d, F.greatest("accuracy", "_b")), 7) + 0.0).alias("relative"))


@query(f"WITH {_P}, a AS (SELECT run_id, question_id, row_number() OVER (PARTITION BY run_id ORDER BY question_id) AS k, chosen FROM p WHERE checkpoint_step = 0), b AS (SELECT run_id, question_id, row_number() OVER (PARTITION BY run_id ORDER BY question_id) AS k, chosen FROM p WHERE checkpoint_step = 2) SELECT a.run_id, count(*) AS n, bool_and(a.question_id = b.question_id) AS aligned, count(*) FILTER (a.chosen = b.chosen) AS n_same FROM a JOIN b USING (run_id, k) GROUP BY a.run_id")
def j03_positional_zip(spark: SparkSession, sf: str) -> DataFrame:
    """J-03: rows of two steps side by side by place, and whether their items are the same."""
    p = predictions(spark, sf).select("run_id", "checkpoint_step", "question_id", "chosen")
    z = joins.zipped(p.where("checkpoint_step = 0"), p.where("checkpoint_step = 2"), ["run_id"], "question_id", ["chosen"])
    return z.groupBy("run_id").agg(F.count(F.lit(1)).alias("n"), F.bool_and("aligned").alias("aligned"), F.count_if(F.col("chosen") == F.col("chosen_right")).alias("n_same"))


@query("WITH r AS (SELECT corpus_alias, section_id, part_id, row_number() OVER (PARTITION BY section_id ORDER BY created_at, part_id) AS k FROM (SELECT section_id, corpus_alias, part_id, min(created_at) AS created_at FROM spine_parts GROUP BY ALL)) SELECT section_id, part_id, format('{}-{:03d}', section_id, k) AS ordinal_id FROM r WHERE k <= 5")
def w12_ordinal_ids(spark: SparkSession, sf: str) -> DataFrame:
    """W-12 and X-08: numbered ids within each section, five at most: the cap is the feature."""
    d = read_table(spark, sf, "spine_parts", ("section_id", "part_id", "created_at")).groupBy("section_id", "part_id").agg(F.min("created_at").alias("t"))
    return d.withColumn("k", F.row_number().over(W.partitionBy("section_id").orderBy("t", "part_id"))).where("k <= 5").select("section_id", "part_id", F.format_string("%s-%03d", "section_id", "k").alias("ordinal_id"))


@query(f"""WITH {_L}, z AS (SELECT entity, count(*) AS n FROM l GROUP BY entity), r AS (SELECT *, row_number() OVER (ORDER BY n DESC, entity) AS rank FROM z), h AS (SELECT item, min(rank) AS rank FROM l JOIN r USING (entity) GROUP BY item), c AS (SELECT rank, sum(coalesce(g, 0)) OVER (ORDER BY rank) AS c FROM r LEFT JOIN (SELECT rank, count(*) AS g FROM h GROUP BY rank) USING (rank)), m AS (SELECT max(rank) AS m FROM c)
  SELECT k, CAST(c AS BIGINT) AS covered FROM (SELECT unnest([1, 10, 100, 1000000])::INT AS k) CROSS JOIN m JOIN c ON c.rank = least(k, m)""")
def w04_value_at(spark: SparkSession, sf: str) -> DataFrame:
    """W-04: what the first k entities cover, clamped to the last."""
    return windows.value_at(windows.coverage_curve(links(spark, sf), "entity", "item"), "rank", "covered", [1, 10, 100, 1_000_000])


