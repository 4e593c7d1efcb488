"""Queries that put several operators together: support, budgets, controls, normalisation of records, early windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from windrow.functions import values as V
from windrow.operators import filters, joins, resampling, sampling
from windrow.plans.graph_queries import _L, links
from windrow.plans.metric_queries import _A, _P, accuracies
from windrow.plans.resampling_queries import _DEC, _NULL, _ROWS, DRAWS, _labelled, _u
from windrow.registry import query
from windrow.sources import read_table

_Q = "q AS (SELECT DISTINCT * FROM wmdp_questions)"


@query("""WITH r AS (SELECT DISTINCT call_id, attempt_index, model_version, temperature, top_p FROM raw_llm_log), m AS (SELECT model_version, temperature, count(*) AS c FROM r GROUP BY ALL), f AS (SELECT model_version, arg_min(temperature, (-c, temperature)) AS frozen FROM m WHERE temperature IS NOT NULL GROUP BY model_version)
  SELECT r.model_version, count(*) AS n, count(*) FILTER (temperature IS DISTINCT FROM frozen) AS n_drift, count(*) FILTER (top_p IS NULL) AS n_unset FROM r JOIN f ON f.model_version = r.model_version GROUP BY r.model_version""")
def c10_config_drift(spark: SparkSession, sf: str) -> DataFrame:
    """C-10: calls whose temperature isn't the model's usual one, ties to the least."""
    r = read_table(spark, sf, "raw_llm_log", ("call_id", "attempt_index", "model_version", "temperature", "top_p")).distinct()
    m = r.where("temperature is not null").groupBy("model_version", "temperature").agg(F.count(F.lit(1)).alias("c"))
    frozen = m.groupBy("model_version").agg(F.min_by("temperature", F.struct(-F.col("c"), F.col("temperature"))).alias("frozen"))
    return r.join(F.broadcast(frozen), "model_version").groupBy("model_version").agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("temperature").eqNullSafe(F.col("frozen"))).alias("n_drift"), F.count_if(F.col("top_p").isNull()).alias("n_unset"))


@query("""WITH g AS (SELECT DISTINCT call_id, attempt_index, raw_response FROM raw_llm_log WHERE starts_with(raw_response, '{') AND json_valid(raw_response)), f AS (SELECT call_id, attempt_index, sha256(raw_response) AS h, lower(json_extract_string(raw_response, '$.text')) AS t, unnest(from_json(json_extract(raw_response, '$.asserted_facts'), '[{"dimension":"VARCHAR","value":"VARCHAR"}]')) AS f FROM g WHERE json_type(raw_response, '$.asserted_facts') = 'ARRAY')
  SELECT call_id, attempt_index, count(*) AS n_facts, count(*) FILTER (NOT coalesce(contains(t, lower(f.dimension)), false)) AS n_unresolved FROM f GROUP BY ALL""")
def c19_realized_facts(spark: SparkSession, sf: str) -> DataFrame:
    """C-19: the facts that a response asserts and how many of their dimensions its text doesn't hold verbatim."""
    g = read_table(spark, sf, "raw_llm_log", ("call_id", "attempt_index", "raw_response")).where(F.col("raw_response").startswith("{") & F.try_parse_json("raw_response").isNotNull())
    r = F.from_json("raw_response", "text string, asserted_facts array<struct<dimension: string, value: string>>")
    d = g.select("call_id", "attempt_index", F.xxhash64("raw_response").alias("h"), r.alias("r")).where("r.asserted_facts is not null and size(r.asserted_facts) > 0")
    text = F.lower("r.text")
    unresolved = F.size(F.filter("r.asserted_facts", lambda f: ~F.coalesce(F.contains(text, F.lower(f["dimension"])), F.lit(False))))
    rows = d.select("call_id", "attempt_index", "h", F.size("r.asserted_facts").cast("long").alias("a"), unresolved.cast("long").alias("b")).distinct()
    return rows.groupBy("call_id", "attempt_index").agg(F.sum("a").alias("n_facts"), F.sum("b").alias("n_unresolved"))


@query(f"""WITH {_P}, {_NULL}, a AS (SELECT run_id, checkpoint_step, avg(CASE WHEN chosen IS NOT NULL AND gold IS NOT NULL THEN CAST(chosen = gold AS INT) END) AS accuracy FROM p GROUP BY ALL), b AS (SELECT quantile_cont(accuracy, 0.95) AS p95 FROM u), l AS (SELECT run_id, round(arg_max(accuracy, checkpoint_step), 9) AS accuracy FROM a WHERE accuracy IS NOT NULL GROUP BY run_id)
  SELECT run_id, accuracy, accuracy > p95 AS passes FROM l CROSS JOIN b""")
def c26_positive_control(spark: SparkSession, sf: str) -> DataFrame:
    """C-26 and I-21: whether each run's last accuracy clears the 95th percentile of guesses at random."""
    null = resampling.uniform_null(read_table(spark, sf, "wmdp_questions", ("question_id",)), "question_id", 4, DRAWS, "null")
    p95 = null.agg(F.percentile("accuracy", 0.95)).first()[0]
    last = accuracies(spark, sf).where("accuracy is not null").groupBy("run_id").agg(F.round(F.max_by("accuracy", "checkpoint_step"), 9).alias("accuracy"))
    return last.withColumn("passes", F.col("accuracy") > F.lit(p95))


@query(f"""WITH {_L}, z AS (SELECT entity, count(*) AS k FROM l GROUP BY entity), o AS (SELECT organism_id, max(n_docs_either) AS docs, max(extraction_source) AS src FROM wmdp_organisms GROUP BY organism_id), t AS (SELECT coalesce(src, 'none') AS extraction_source, count(*) AS n, count(*) FILTER (docs >= 3 AND k >= 1) AS n_usable FROM o LEFT JOIN z ON z.entity = o.organism_id GROUP BY 1)
  SELECT extraction_source, n, n_usable, round(n_usable / n, 9) AS share, round(greatest(0.0, (n_usable / n + 1.959963984540054 * 1.959963984540054 / (2 * n)) / (1 + 1.959963984540054 * 1.959963984540054 / n) - 1.959963984540054 * sqrt(n_usable / n * (1 - n_usable / n) / n + 1.959963984540054 * 1.959963984540054 / (4 * n * n)) / (1 + 1.959963984540054 * 1.959963984540054 / n)), 9) AS low FROM t""")
def p06_support(spark: SparkSession, sf: str) -> DataFrame:
    """P-06: entities with support in the corpus and in items, with the lower bound of the share."""
    k = links(spark, sf).groupBy(F.col("entity").alias("organism_id")).agg(F.count(F.lit(1)).alias("k"))
    o = read_table(spark, sf, "wmdp_organisms", ("organism_id", "n_docs_either", "extraction_source")).groupBy("organism_id").agg(F.max("n_docs_either").alias("docs"), F.max("extraction_source").alias("src"))
    t = o.join(k, "organism_id", "left").groupBy(F.coalesce("src", F.lit("none")).alias("extraction_source")).agg(F.count(F.lit(1)).alias("n"), F.count_if((F.col("docs") >= 3) & (F.col("k") >= 1)).alias("n_usable"))
    low, _ = V.wilson(F.col("n_usable"), F.col("n"))
    return t.select("*", F.round(F.col("n_usable") / F.col("n"), 9).alias("share"), F.round(low, 9).alias("low"))


@query("""WITH p AS (SELECT DISTINCT part_id, corpus_alias, section_id, part_kind, target_tokens FROM spine_parts), k AS (SELECT part_kind, corpus_alias, count(*) AS n, coalesce(sum(target_tokens), 0) AS t FROM p GROUP BY ALL), s AS (SELECT corpus_alias, sum(n) AS n, sum(t) AS t FROM k GROUP BY corpus_alias), x AS (SELECT part_kind, n / sum(n) OVER (PARTITION BY corpus_alias) AS share, n, t, corpus_alias FROM k)
  SELECT coalesce(a.part_kind, b.part_kind) AS part_kind, coalesce(a.n, 0) AS n_f, coalesce(b.n, 0) AS n_w, CAST(coalesce(a.t, 0) - coalesce(b.t, 0) AS BIGINT) AS token_delta, round(coalesce(a.share, 0) - coalesce(b.share, 0), 9) + 0.0 AS share_delta FROM (SELECT * FROM x WHERE corpus_alias = 'CORPUS_F') a FULL JOIN (SELECT * FROM x WHERE corpus_alias = 'CORPUS_W') b ON a.part_kind IS NOT DISTINCT FROM b.part_kind""")
def p11_pair_of_corpora(spark: SparkSession, sf: str) -> DataFrame:
    """P-11 and A-30: the two corpora of a pair by kind of part: counts, tokens and shares of one less the other's."""
    p = read_table(spark, sf, "spine_parts", ("part_id", "corpus_alias", "section_id", "part_kind", "target_tokens")).distinct()
    k = p.groupBy("part_kind", "corpus_alias").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("target_tokens"), F.lit(0)).alias("t"))
    x = k.withColumn("share", F.col("n") / F.sum("n").over(W.partitionBy("corpus_alias")))
    of = lambda c, v: F.coalesce(F.max(F.when(F.col("corpus_alias") == c, F.col(v))), F.lit(0))
    g = x.groupBy("part_kind").agg(of("CORPUS_F", "n").alias("n_f"), of("CORPUS_W", "n").alias("n_w"), (of("CORPUS_F", "t") - of("CORPUS_W", "t")).alias("token_delta"), (F.round(of("CORPUS_F", "share") - of("CORPUS_W", "share"), 9) + 0.0).alias("share_delta"))
    return g.where("n_f > 0 or n_w > 0")


@query("""WITH n AS (SELECT section_id, count(*) AS w FROM (SELECT DISTINCT part_id, section_id FROM spine_parts) GROUP BY section_id), x AS (SELECT section_id, w, CAST(5000000 AS DOUBLE) * w / sum(w) OVER () AS e FROM n), f AS (SELECT *, floor(e) AS f FROM x)
  SELECT section_id, w, CAST(f + CASE WHEN row_number() OVER (ORDER BY round(e - f, 9) DESC, section_id) <= 5000000 - sum(f) OVER () THEN 1 ELSE 0 END AS BIGINT) AS budget FROM f""")
def p10_budget_plan(spark: SparkSession, sf: str) -> DataFrame:
    """P-10: five million tokens over the sections by their parts."""
    n = read_table(spark, sf, "spine_parts", ("part_id", "section_id")).distinct().groupBy("section_id").agg(F.count(F.lit(1)).alias("w"))
    return sampling.largest_remainder(n, "section_id", "w", 5_000_000, out="budget")


@query(f"""WITH g AS (SELECT DISTINCT question_id, chr(65 + CAST(correct_index AS INT)) AS gold FROM wmdp_questions WHERE correct_index IS NOT NULL), d AS (SELECT question_id, gold, draw, list_filter(['A', 'B', 'C', 'D'], lambda x: x <> gold) AS o FROM g CROSS JOIN (SELECT unnest(range(12)) AS draw)),
  m AS (SELECT draw, gold, CASE WHEN {_u("'ctl'", "'u'", "draw", "question_id")} < {int(0.25 * (1 << 32))} THEN gold ELSE o[{_u("'ctl'", "'o'", "draw", "question_id")} % 3 + 1] END AS drawn FROM d), a AS (SELECT draw, round(avg(CAST(drawn = gold AS INT)), 9) AS accuracy, count(*) AS n FROM m GROUP BY draw) SELECT draw AS attempt, accuracy FROM a WHERE abs(accuracy - 0.25) <= 2 * sqrt(0.25 * 0.75 / n) ORDER BY draw LIMIT 1""")
def p13_accepted_control(spark: SparkSession, sf: str) -> DataFrame:
    """P-13: of twelve controls drawn at chance the first that the gate takes for chance."""
    q = read_table(spark, sf, "wmdp_questions", ("question_id", "correct_index")).where("correct_index is not null").select("question_id", F.char((F.col("correct_index") + 65).cast("int")).alias("gold"))
    a = resampling.matched_draws(q, "question_id", "gold", 0.25, 12, "ctl").groupBy("draw").agg(F.count_if(F.col("drawn") == F.col("gold")).alias("k"), F.count(F.lit(1)).alias("n"))
    taken = a.where(resampling.near_chance(F.col("k"), F.col("n")) == "near_chance").select(F.col("draw").alias("attempt"), F.round(F.col("k") / F.col("n"), 9).alias("accuracy"))
    return taken.orderBy("attempt").limit(1)


@query("""WITH g AS (SELECT DISTINCT call_id, attempt_index, raw_response FROM raw_llm_log), u AS (SELECT call_id, attempt_index, raw_response AS r, CASE WHEN starts_with(raw_response, '{') AND json_valid(raw_response) THEN raw_response END AS j FROM g),
  f AS (SELECT call_id, attempt_index, r, CASE WHEN r IS NULL THEN 'no response' WHEN j IS NULL THEN 'no object' WHEN coalesce(json_extract_string(j, '$.text'), json_extract_string(j, '$.answer')) IS NULL THEN 'no text field' WHEN trim(coalesce(json_extract_string(j, '$.text'), json_extract_string(j, '$.answer')), ' ') = '' THEN 'blank' ELSE 'kept' END AS state FROM u) SELECT state, count(*) AS n FROM f GROUP BY state""")
def z04_normalized_records(spark: SparkSession, sf: str) -> DataFrame:
    """Z-04: responses taken out of their objects by whichever alias field they use, and counts of what is dropped and why."""
    r = F.col("raw_response")
    field = lambda n: F.try_variant_get(F.try_parse_json(r), f"$.{n}", "string")
    text = F.coalesce(field("text"), field("answer"))
    sound = r.startswith("{") & F.try_parse_json(r).isNotNull()
    state = F.coalesce(filters.first_match([("no response", r.isNull()), ("no object", ~sound), ("no text field", text.isNull()), ("blank", F.trim(text) == "")]), F.lit("kept"))
    d = read_table(spark, sf, "raw_llm_log", ("call_id", "attempt_index", "raw_response")).select("call_id", "attempt_index", state.alias("state"), F.xxhash64("raw_response").alias("h")).distinct()
    return d.groupBy("state").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH d AS (SELECT DISTINCT organism_id, surface_forms, question_ids FROM wmdp_organisms), x AS (SELECT organism_id, from_json(surface_forms, '["VARCHAR"]') AS f, from_json(question_ids, '["VARCHAR"]') AS q FROM d), v AS (SELECT organism_id, list_filter([CASE WHEN f IS NULL OR len(f) = 0 THEN 'no forms' END, CASE WHEN len(f) > 4 THEN 'over four' END, CASE WHEN len(list_distinct(f)) < len(f) THEN 'repeated' END, CASE WHEN q IS NULL OR len(q) = 0 THEN 'no items' END], lambda v: v IS NOT NULL) AS problems FROM x)
  SELECT problems, count(*) AS n FROM v GROUP BY problems""")
def z06_strict_records(spark: SparkSession, sf: str) -> DataFrame:
    """Z-06: records with no forms, more than four, repeated ones, or no items."""
    d = read_table(spark, sf, "wmdp_organisms", ("organism_id", "surface_forms", "question_ids")).distinct()
    f, q = (F.from_json(c, "array<string>") for c in ("surface_forms", "question_ids"))
    problems = F.array_compact(F.array(F.when(f.isNull() | (F.size(f) == 0), "no forms"), F.when(F.size(f) > 4, "over four"), F.when(F.size(F.array_distinct(f)) < F.size(f), "repeated"), F.when(q.isNull() | (F.size(q) == 0), "no items")))
    return d.select(problems.alias("problems")).groupBy("problems").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH p AS (SELECT DISTINCT part_id, corpus_alias, chapter_id, target_tokens FROM spine_parts), m AS (SELECT corpus_alias, chapter_id, median(target_tokens) AS m FROM p GROUP BY ALL) SELECT corpus_alias, round(avg(m), 9) AS mean_of_medians, count(m) AS n_contributing, count(*) - count(m) AS n_null FROM m GROUP BY corpus_alias""")
def a41_mean_of_medians(spark: SparkSession, sf: str) -> DataFrame:
    """A-41: the mean of ragged groups' medians, with how many contribute."""
    p = read_table(spark, sf, "spine_parts", ("part_id", "corpus_alias", "chapter_id", "target_tokens")).distinct()
    m = p.groupBy("corpus_alias", "chapter_id").agg(F.median("target_tokens").alias("m"))
    return m.groupBy("corpus_alias").agg(F.round(F.avg("m"), 9).alias("mean_of_medians"), F.count("m").alias("n_contributing"), F.count_if(F.col("m").isNull()).alias("n_null"))


@query(f"""WITH {_ROWS}, d AS (SELECT run_id, checkpoint_step, {_DEC} FROM x GROUP BY ALL), y AS (SELECT *, CASE WHEN i > 0.05 THEN i END AS v FROM d) SELECT run_id, coalesce(min(checkpoint_step) FILTER (v IS NOT NULL), CAST('inf' AS DOUBLE)) AS first_cleared, round(avg(v) FILTER (checkpoint_step <= 64), 7) AS early_mean, count(v) FILTER (checkpoint_step <= 64) AS n_early FROM y GROUP BY run_id""")
def w13_early_cleared(spark: SparkSession, sf: str) -> DataFrame:
    """W-06 and W-13: the first step whose information clears, and the mean over early steps that do."""
    from windrow.operators import information

    d = information.decomposition(_labelled(spark, sf), ["run_id", "checkpoint_step"], "chosen", "gold", "subset")
    v = resampling.suppressed(F.col("i_f_y"), F.col("i_f_y") > 0.05)
    early = F.when(F.col("checkpoint_step") <= 64, v)
    return d.groupBy("run_id").agg(F.coalesce(F.min(F.when(v.isNotNull(), F.col("checkpoint_step"))).cast("double"), F.lit(float("inf"))).alias("first_cleared"), F.round(F.avg(early), 7).alias("early_mean"), F.count(early).alias("n_early"))


@query("WITH q AS (SELECT DISTINCT question_id, subset FROM wmdp_questions), r AS (SELECT *, row_number() OVER (PARTITION BY subset ORDER BY sha256('hold|' || question_id), question_id) AS k, count(*) OVER (PARTITION BY subset) AS n FROM q) SELECT question_id, subset, k > n - 20 AS held_out FROM r")
def o13_held_out(spark: SparkSession, sf: str) -> DataFrame:
    """O-13: of each subset the last twenty by digest are held out."""
    q = read_table(spark, sf, "wmdp_questions", ("question_id", "subset")).distinct()
    own = W.partitionBy("subset")
    k = F.row_number().over(own.orderBy(sampling.hash_rank("question_id", "hold"), "question_id"))
    return q.select("question_id", "subset", (k > F.count(F.lit(1)).over(own) - 20).alias("held_out"))


@query("""WITH d AS (SELECT DISTINCT doc_id, source, doc_type FROM documents WHERE doc_type IS NOT NULL AND source IS NOT NULL), r AS (SELECT *, row_number() OVER (PARTITION BY source, doc_type ORDER BY sha256('dom|' || doc_id), doc_id) AS k FROM d) SELECT doc_id, source, doc_type FROM r WHERE k = 1""")
def o12_domain_cover(spark: SparkSession, sf: str) -> DataFrame:
    """O-12: one document of each source and type, that with the least digest; minima, no sort of a group."""
    d = read_table(spark, sf, "documents", ("doc_id", "source", "doc_type")).where("doc_type is not null and source is not null")
    return d.groupBy("source", "doc_type").agg(F.min_by("doc_id", F.struct(sampling.hash_rank("doc_id", "dom"), F.col("doc_id"))).alias("doc_id"))


@query("""SELECT organism_id, CASE WHEN gazetteer_match IS NULL OR gazetteer_match <> 'true' THEN 'review' WHEN n_mentions >= 5 THEN 'core' ELSE 'periphery' END AS tier, CASE WHEN gazetteer_match IS NULL THEN 'no flag' WHEN gazetteer_match <> 'true' THEN 'flag ' || gazetteer_match WHEN n_mentions >= 5 THEN 'mentions' ELSE 'few mentions' END AS tier_reason FROM (SELECT DISTINCT * FROM wmdp_organisms)""")
def f06_tier_reasons(spark: SparkSession, sf: str) -> DataFrame:
    """F-06: tiers with the reason of each."""
    d = read_table(spark, sf, "wmdp_organisms").distinct()
    open_, many = F.col("gazetteer_match").isNull() | (F.col("gazetteer_match") != "true"), F.col("n_mentions") >= 5
    tier = V.verdict([("review", open_), ("core", many)], "periphery")
    reason = F.when(F.col("gazetteer_match").isNull(), F.lit("no flag")).when(open_, F.concat(F.lit("flag "), "gazetteer_match")).when(many, "mentions").otherwise("few mentions")
    return d.select("organism_id", tier.alias("tier"), reason.alias("tier_reason"))


@query(f"WITH {_Q}, t AS (SELECT question_id, lower(question) AS t FROM q WHERE question IS NOT NULL), c AS (SELECT question_id, list_filter([CASE WHEN regexp_matches(t, '\\b(wind|frost|drainage|grazing)\\b') THEN 'weather' END, CASE WHEN regexp_matches(t, '\\b(span|depth|margin|thickness|length)\\b') THEN 'measure' END, CASE WHEN regexp_matches(t, '\\b(jars|rafts|trays|slates)\\b') THEN 'vessel' END], lambda x: x IS NOT NULL) AS h FROM t) SELECT question_id, coalesce(h[1], 'other') AS class, CASE WHEN len(h) = 0 THEN 'none' WHEN len(h) = 1 THEN 'high' ELSE 'low' END AS confidence FROM c")
def f09_class_confidence(spark: SparkSession, sf: str) -> DataFrame:
    """F-09: ordered keyword classes; confidence is low where several match."""
    t = F.lower("question")
    rules = [("weather", r"\b(wind|frost|drainage|grazing)\b"), ("measure", r"\b(span|depth|margin|thickness|length)\b"), ("vessel", r"\b(jars|rafts|trays|slates)\b")]
    hits = F.array_compact(F.array(*[F.when(t.rlike(p), n) for n, p in rules]))
    q = read_table(spark, sf, "wmdp_questions").distinct().where("question is not null")
    return q.select("question_id", F.coalesce(F.try_element_at(hits, F.lit(1)), F.lit("other")).alias("class"), F.when(F.size(hits) == 0, "none").when(F.size(hits) == 1, "high").otherwise("low").alias("confidence"))


@query(f"WITH {_A}, s AS (SELECT split_part(run_id, '__', 2) AS condition, checkpoint_step, avg(accuracy) AS accuracy FROM a GROUP BY ALL) SELECT x.condition AS condition_a, y.condition AS condition_b, x.checkpoint_step, round(x.accuracy - y.accuracy, 7) + 0.0 AS gap FROM s x JOIN s y ON x.checkpoint_step = y.checkpoint_step AND x.condition < y.condition WHERE x.accuracy IS NOT NULL AND y.accuracy IS NOT NULL")
def j04_all_partners(spark: SparkSession, sf: str) -> DataFrame:
    """J-04 over all conditions: each condition against each other at the same step; conditions are few."""
    d = accuracies(spark, sf).groupBy(F.split_part("run_id", F.lit("__"), F.lit(2)).alias("condition"), "checkpoint_step").agg(F.avg("accuracy").alias("accuracy")).where("accuracy is not null")
    b = d.select("checkpoint_step", F.col("condition").alias("condition_b"), F.col("accuracy").alias("_b"))
    return d.withColumnRenamed("condition", "condition_a").join(b, "checkpoint_step").where("condition_a < condition_b").select("condition_a", "condition_b", "checkpoint_step", (F.round(F.col("accuracy") - F.col("_b"), 7) + 0.0).alias("gap"))


@query("WITH d AS (SELECT DISTINCT policy_revision, section_id, part_index FROM spine_parts WHERE policy_revision IS NOT NULL) SELECT a.policy_revision AS revision, b.policy_revision AS before, count(*) FILTER (NOT EXISTS (SELECT 1 FROM d x WHERE x.policy_revision = b.policy_revision AND x.section_id = a.section_id AND x.part_index = a.part_index)) AS n_new FROM d a JOIN (SELECT DISTINCT policy_revision FROM d) b ON b.policy_revision < a.policy_revision GROUP BY ALL")
def d12_fresh_by_revision(spark: SparkSession, sf: str) -> DataFrame:
    """D-12 over all revisions: places that a revision has and an earlier one hasn't."""
    d = read_table(spark, sf, "spine_parts", ("policy_revision", "section_id", "part_index")).where("policy_revision is not null").distinct()
    sizes = d.groupBy("policy_revision").agg(F.count(F.lit(1)).alias("n"))
    pairs = sizes.join(sizes.select(F.col("policy_revision").alias("before")), F.col("before") < F.col("policy_revision"))  # revisions are few
    shared = d.join(d.withColumnRenamed("policy_revision", "before"), ["section_id", "part_index"]).where("before < policy_revision").groupBy("policy_revision", "before").agg(F.count(F.lit(1)).alias("k"))
    return pairs.join(shared, ["policy_revision", "before"], "left").select(F.col("policy_revision").alias("revision"), "before", (F.col("n") - F.coalesce("k", F.lit(0))).alias("n_new"))


@query(f"WITH {_Q}, t AS (SELECT trim(correct_text, ' ') AS t, min(question_id) AS first, count(*) AS k FROM q GROUP BY 1) SELECT q.question_id, first, k = 1 AS one_to_one FROM q JOIN t ON trim(q.correct_text, ' ') = t.t")
def j05_text_to_id(spark: SparkSession, sf: str) -> DataFrame:
    """J-05: each right answer looked up by its exact text, and whether the text names one item."""
    q = read_table(spark, sf, "wmdp_questions").distinct().select("question_id", F.trim("correct_text").alias("t"))
    known = q.groupBy("t").agg(F.min("question_id").alias("first"), F.count(F.lit(1)).alias("k"))
    return q.join(known, "t").select("question_id", "first", (F.col("k") == 1).alias("one_to_one"))


@query("WITH o AS (SELECT DISTINCT organism_id, parent_genus FROM wmdp_organisms), g AS (SELECT DISTINCT name_txt FROM gazetteer_names WHERE taxon_rank = 'genus') SELECT CASE WHEN g.name_txt IS NULL THEN 'left_only' WHEN o.parent_genus IS NULL THEN 'right_only' END AS side, coalesce(g.name_txt, o.parent_genus) AS genus FROM (SELECT DISTINCT parent_genus FROM o WHERE parent_genus IS NOT NULL) o FULL JOIN g ON g.name_txt = o.parent_genus WHERE g.name_txt IS NULL OR o.parent_genus IS NULL")
def j06_key_equality(spark: SparkSession, sf: str) -> DataFrame:
    """J-06 and Z-05's check: genera of one side only, where an enriching join asserts that both have the same."""
    o = read_table(spark, sf, "wmdp_organisms", ("parent_genus",)).where("parent_genus is not null").select(F.col("parent_genus").alias("genus"))
    g = read_table(spark, sf, "gazetteer_names", ("name_txt", "taxon_rank")).where("taxon_rank = 'genus'").select(F.col("name_txt").alias("genus"))
    return joins.reconcile(o, g, ["genus"])


@query("SELECT count(*) AS n, CAST(sum(CASE WHEN r THEN 1 ELSE 0 END) AS BIGINT) AS n_removed, CAST(count(*) - sum(CASE WHEN r THEN 1 ELSE 0 END) AS BIGINT) AS n_accepted FROM (SELECT DISTINCT part_id, text IS NULL OR length(text) < 100 AS r FROM spine_parts)")
def f04_reconciled(spark: SparkSession, sf: str) -> DataFrame:
    """F-04: what is removed and what is accepted add up to what was read."""
    d = filters.cascade(read_table(spark, sf, "spine_parts", ("part_id", "text")), [("short", F.col("text").isNull() | (F.length("text") < 100))]).select("part_id", "reason").distinct()
    return d.agg(F.count(F.lit(1)).alias("n"), F.count("reason").alias("n_removed"), F.count_if(F.col("reason").isNull()).alias("n_accepted"))


