"""Queries of allocations, joins by record or rule, aggregates with tie rules, shapes of values, and audits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from windrow.functions import text as X
from windrow.functions import values as V
from windrow.operators import aggregates, allocation, contracts, filters, graph, joins, sampling
from windrow.plans.graph_queries import _L, links
from windrow.plans.metric_queries import _A, _P, PS, accuracies, predictions
from windrow.registry import query
from windrow.sources import read_table

_Q = "q AS (SELECT DISTINCT * FROM wmdp_questions)"


def items(spark: SparkSession, sf: str) -> DataFrame:
    return read_table(spark, sf, "wmdp_questions").distinct()


def _genera(spark: SparkSession, sf: str) -> DataFrame:
    d = read_table(spark, sf, "wmdp_organisms", ("organism_id", "parent_genus")).where("parent_genus is not null").distinct()
    return d.groupBy("parent_genus").agg(F.count(F.lit(1)).alias("n"))


# allocations


@query("SELECT doc_id FROM documents ORDER BY sha256('42|' || doc_id), doc_id LIMIT 100")
def o03_random_sample(spark: SparkSession, sf: str) -> DataFrame:
    """O-03 and O-05: a hundred documents in the order of digests; the size is what is asked."""
    d = read_table(spark, sf, "documents", ("doc_id",))
    return d.orderBy(sampling.hash_rank("doc_id", "42"), "doc_id").limit(100)


@query()
def o09_floor_and_fill(spark: SparkSession, sf: str) -> DataFrame:
    """Quotas of 100 over the subsets' genera, three each first."""
    counts = allocation.strata(read_table(spark, sf, "documents", ("doc_type",)).groupBy("doc_type").agg(F.count(F.lit(1)).alias("n")), "doc_type", "n")
    got = allocation.floor_and_fill(counts, min(100, sum(counts.values())), 3 if 3 * len(counts) <= 100 else 1)
    return spark.createDataFrame([(k, counts[k], got[k]) for k in sorted(got)], "doc_type string, n long, quota long")


@query()
def o10_greedy_quotas(spark: SparkSession, sf: str) -> DataFrame:
    counts = allocation.strata(_genera(spark, sf), "parent_genus", "n")
    got = allocation.greedy_quotas(counts, max(len(counts), 50))
    return spark.createDataFrame([(k, counts[k], got[k]) for k in sorted(got)], "parent_genus string, n long, quota long")


@query(f"""WITH {_Q}, w AS (SELECT question_id, correct_text AS r, list_distinct(regexp_extract_all(lower(correct_text), '[a-z0-9]+')) AS m, unnest([choice_a, choice_b, choice_c, choice_d]) AS o FROM q WHERE correct_text IS NOT NULL), s AS (SELECT question_id, r, o, m, list_distinct(regexp_extract_all(lower(o), '[a-z0-9]+')) AS x FROM w WHERE o IS NOT NULL AND o <> r),
  c AS (SELECT question_id, o, abs(length(o) - length(r)) AS g, round(CASE WHEN len(m) * len(x) > 0 THEN len(list_intersect(m, x)) / sqrt(CAST(len(m) AS DOUBLE) * len(x)) ELSE 0 END, 9) AS c FROM s) SELECT question_id, list(o ORDER BY c DESC, g, o) AS ranked FROM c GROUP BY question_id""")
def o16_ranked_choices(spark: SparkSession, sf: str) -> DataFrame:
    """O-16: each item's wrong choices by likeness to the right one."""
    q = items(spark, sf).where("correct_text is not null")
    return q.select("question_id", allocation.ranked_choices(F.col("correct_text"), F.array("choice_a", "choice_b", "choice_c", "choice_d")).alias("ranked")).where("size(ranked) > 0")


@query()
def o18_packed_sections(spark: SparkSession, sf: str) -> DataFrame:
    """Genera of at least five organisms put into bins of forty."""
    bins = allocation.pack_sections(allocation.strata(_genera(spark, sf), "parent_genus", "n"))
    return spark.createDataFrame([(i, list(names), n) for i, b in enumerate(bins) for names, n in b], "bin int, genera array<string>, n long")


@query()
def o19_agglomerated(spark: SparkSession, sf: str) -> DataFrame:
    """Genera of fewer than three organisms joined with those of the greatest edge density."""
    m = read_table(spark, sf, "wmdp_organisms", ("organism_id", "parent_genus")).where("parent_genus is not null").select(F.col("organism_id").alias("node"), F.col("parent_genus").alias("grp")).distinct()
    sizes = allocation.strata(m.groupBy("grp").agg(F.count(F.lit(1)).alias("n")), "grp", "n")
    weights = {(r.group_a, r.group_b): r.weight for r in graph.link_cross_weights(links(spark, sf), "item", "entity", m, "node", "grp").collect()}  # between genera, a bounded list
    home = allocation.agglomerate(sizes, weights)
    return spark.createDataFrame([(k, home[k], sizes[k]) for k in sorted(home)], "genus string, home string, n long")


@query(f"""WITH RECURSIVE {_L}, e AS (SELECT 'e' || entity AS a, 'i' || item AS b FROM l UNION SELECT 'i' || item, 'e' || entity FROM l), r(node, seen) AS (SELECT DISTINCT a, a FROM e WHERE a[1] = 'e' UNION SELECT r.node, e.b FROM r JOIN e ON r.seen = e.a), c AS (SELECT node[2:] AS node, min(seen[2:]) AS component FROM r WHERE seen[1] = 'e' GROUP BY ALL),
  s AS (SELECT component, count(*) AS n FROM c GROUP BY component) SELECT node FROM c WHERE component = (SELECT component FROM s ORDER BY n DESC, component LIMIT 1)""")
def g02_largest_component(spark: SparkSession, sf: str) -> DataFrame:
    """Members of the largest component; of several as large that with the least member."""
    all_ = links(spark, sf)
    return graph.largest(graph.components(graph.star(all_, "item", "entity"), all_.select("entity"))).select("node")


@query()
def g09_fixed_point(spark: SparkSession, sf: str) -> DataFrame:
    """Links that remain when entities of fewer than two items, and items of fewer than two entities, are dropped until none is left."""
    return allocation.core_of(links(spark, sf), "entity", "item", 2, 2)


# joins


@query("""WITH p AS (SELECT DISTINCT part_id, unnest(list_distinct(entity_ids)) AS e FROM spine_parts), d AS (SELECT part_id, e FROM p WHERE e IS NOT NULL) SELECT a.e AS src, b.e AS dst, count(DISTINCT a.part_id) AS weight FROM d a JOIN d b ON a.part_id = b.part_id AND a.e < b.e GROUP BY ALL""")
def j12_pairs_in_parts(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct pairs of entities that parts name together."""
    p = read_table(spark, sf, "spine_parts", ("part_id", "entity_ids")).select("part_id", F.explode("entity_ids").alias("e"))
    return joins.cooccurrence(p, "part_id", "e")


@query(f"WITH {_Q}, o AS (SELECT question_id, correct_text, unnest([choice_a, choice_b, choice_c, choice_d]) AS o FROM q), w AS (SELECT DISTINCT question_id, o FROM o WHERE o <> correct_text) SELECT DISTINCT q.question_id AS a, w.question_id AS b FROM q JOIN w ON q.correct_text = w.o AND q.question_id <> w.question_id")
def j16_contradictions(spark: SparkSession, sf: str) -> DataFrame:
    """J-15, J-16 and P-09: an item's right answer that another holds for wrong, by one grouped index of wrong answers."""
    q = items(spark, sf)
    wrong = q.select(F.col("question_id").alias("b"), "correct_text", F.explode(F.array("choice_a", "choice_b", "choice_c", "choice_d")).alias("t")).where("t <> correct_text").select("b", "t").distinct()
    return q.select(F.col("question_id").alias("a"), F.col("correct_text").alias("t")).join(wrong, "t").where("a <> b").select("a", "b").distinct()


@query(f"WITH {_L}, {_P}, x AS (SELECT question_id FROM wmdp_questions INTERSECT SELECT item FROM l INTERSECT SELECT question_id FROM p WHERE checkpoint_step = 0) SELECT subset, count(*) AS n FROM (SELECT DISTINCT question_id, subset FROM wmdp_questions) JOIN x USING (question_id) GROUP BY subset")
def j07_id_intersection(spark: SparkSession, sf: str) -> DataFrame:
    """Items that are listed, cited by an entity and predicted at step 0, by subset."""
    ids = links(spark, sf).select(F.col("item").alias("question_id")).intersect(predictions(spark, sf).where("checkpoint_step = 0").select("question_id"))
    return items(spark, sf).select("question_id", "subset").distinct().join(ids, "question_id", "left_semi").groupBy("subset").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH r AS (SELECT DISTINCT part_id, unnest(entity_ids) AS e FROM spine_parts), n AS (SELECT DISTINCT taxon_id, array_to_string(regexp_extract_all(lower(name_txt), '[a-z0-9]+'), ' ') AS g FROM gazetteer_names WHERE taxon_rank = 'species'), s AS (SELECT DISTINCT part_id, regexp_extract_all(lower(running_summary), '[a-z0-9]+') AS w FROM spine_parts WHERE running_summary IS NOT NULL),
  h AS (SELECT DISTINCT part_id, taxon_id FROM (SELECT part_id, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i+1])) AS g FROM s WHERE len(w) > 1) JOIN n USING (g)), p AS (SELECT DISTINCT part_id FROM spine_parts), x AS (SELECT part_id, count(DISTINCT e) AS a FROM r WHERE e IS NOT NULL GROUP BY part_id), y AS (SELECT part_id, count(*) AS b FROM h GROUP BY part_id)
  SELECT CASE WHEN a > 0 THEN 'recorded' WHEN b > 0 THEN 'mentioned' ELSE 'none' END AS way, count(*) AS n, CAST(coalesce(sum(CASE WHEN a > 0 THEN a ELSE b END), 0) AS BIGINT) AS n_links FROM p LEFT JOIN x USING (part_id) LEFT JOIN y USING (part_id) GROUP BY ALL""")
def j26_recorded_or_mentioned(spark: SparkSession, sf: str) -> DataFrame:
    """J-26: parts' recorded entities; only where none is recorded, the species that the summary mentions."""
    d = read_table(spark, sf, "spine_parts", ("part_id", "entity_ids", "running_summary"))
    recorded = d.select("part_id", F.explode("entity_ids").alias("e")).where("e is not null").groupBy("part_id").agg(F.countDistinct("e").alias("a"))
    names = read_table(spark, sf, "gazetteer_names", ("taxon_id", "name_txt", "taxon_rank")).where("taxon_rank = 'species'")
    mentioned = joins.phrase_hits(d, "part_id", "running_summary", names, "taxon_id", "name_txt").groupBy("part_id").agg(F.count(F.lit(1)).alias("b"))
    both = d.select("part_id").distinct().join(recorded, "part_id", "left").join(mentioned, "part_id", "left")
    way = F.when(F.col("a") > 0, "recorded").when(F.col("b") > 0, "mentioned").otherwise("none")
    return both.groupBy(way.alias("way")).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.coalesce("a", "b")), F.lit(0)).alias("n_links"))


_RULES = (("species", "pass_a", "keep"), ("species", "pass_b", "check"), ("genus", "pass_a", "widen"))


@query(f"WITH r AS (SELECT * FROM (VALUES {', '.join(map(str, _RULES))}) AS t(taxon_rank, extraction_source, outcome)), d AS (SELECT DISTINCT organism_id, taxon_rank, extraction_source FROM wmdp_organisms) SELECT coalesce(outcome, 'no rule') AS outcome, count(*) AS n FROM d LEFT JOIN r USING (taxon_rank, extraction_source) GROUP BY 1")
def j28_rule_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """J-28: outcomes of a small rule table by traits; rows without a rule are told."""
    rules = spark.createDataFrame(list(_RULES), "taxon_rank string, extraction_source string, outcome string")
    d = read_table(spark, sf, "wmdp_organisms", ("organism_id", "taxon_rank", "extraction_source")).distinct()
    return d.join(F.broadcast(rules), ["taxon_rank", "extraction_source"], "left").groupBy(F.coalesce("outcome", F.lit("no rule")).alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


# aggregates


@query("SELECT source, doc_type, count(*) AS n FROM documents GROUP BY ALL")
def a02_nested_counts(spark: SparkSession, sf: str) -> DataFrame:
    """A-01 and A-02: counts by key and by key within key."""
    return read_table(spark, sf, "documents", ("source", "doc_type")).groupBy("source", "doc_type").agg(F.count(F.lit(1)).alias("n"))


@query("WITH c AS (SELECT source, doc_type, count(*) AS c, min(doc_id) AS first FROM documents WHERE doc_type IS NOT NULL GROUP BY ALL) SELECT source, arg_min(doc_type, (-c, first)) AS modal, max(c) AS n FROM c GROUP BY source")
def a04_first_mode(spark: SparkSession, sf: str) -> DataFrame:
    """A-04: the most frequent value, of several the one that comes first by id."""
    c = read_table(spark, sf, "documents", ("doc_id", "source", "doc_type")).where("doc_type is not null").groupBy("source", "doc_type").agg(F.count(F.lit(1)).alias("c"), F.min("doc_id").alias("first"))
    return c.groupBy("source").agg(F.min_by("doc_type", F.struct(-F.col("c"), F.col("first"))).alias("modal"), F.max("c").alias("n"))


@query(f"WITH {_L} SELECT count(DISTINCT item) AS n_items, count(*) AS n_pairs, round(count(*) / count(DISTINCT item), 9) AS per_item FROM l")
def a19_unique_and_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """A-19: items counted once, and once for each entity."""
    return links(spark, sf).agg(F.countDistinct("item").alias("n_items"), F.count(F.lit(1)).alias("n_pairs")).withColumn("per_item", F.round(F.col("n_pairs") / F.col("n_items"), 9))


@query("SELECT parent_genus, max(n_mentions) AS n_mentions, min(organism_id) AS representative, count(DISTINCT organism_id) AS n FROM wmdp_organisms WHERE parent_genus IS NOT NULL GROUP BY parent_genus")
def a21_representative(spark: SparkSession, sf: str) -> DataFrame:
    """A-21: the members' maximum under the least id."""
    return read_table(spark, sf, "wmdp_organisms", ("organism_id", "parent_genus", "n_mentions")).where("parent_genus is not null").groupBy("parent_genus").agg(F.max("n_mentions").alias("n_mentions"), F.min("organism_id").alias("representative"), F.countDistinct("organism_id").alias("n"))


@query("SELECT parent_genus, doc.n_distinct, doc.n FROM (SELECT parent_genus, {'n_distinct': count(DISTINCT taxon_rank), 'n': count(*)} AS doc FROM (SELECT DISTINCT parent_genus, extraction_source, taxon_rank FROM wmdp_organisms WHERE parent_genus IS NOT NULL) GROUP BY parent_genus)")
def a39_values_of_genera(spark: SparkSession, sf: str) -> DataFrame:
    """A-10 and A-39: how many ranks each genus's rows give, with those that agree."""
    d = read_table(spark, sf, "wmdp_organisms", ("parent_genus", "extraction_source", "taxon_rank")).where("parent_genus is not null").distinct()
    return d.groupBy("parent_genus").agg(F.countDistinct("taxon_rank").alias("n_distinct"), F.count(F.lit(1)).alias("n"))


@query("SELECT chapter_id, quantile_cont(target_tokens, 0.25) AS p25, quantile_cont(target_tokens, 0.5) AS p50 FROM (SELECT DISTINCT part_id, chapter_id, target_tokens FROM spine_parts) GROUP BY chapter_id")
def a13_percentiles(spark: SparkSession, sf: str) -> DataFrame:
    """A-13: linear percentiles."""
    d = read_table(spark, sf, "spine_parts", ("part_id", "chapter_id", "target_tokens")).distinct()
    return d.groupBy("chapter_id").agg(F.percentile("target_tokens", 0.25).alias("p25"), F.percentile("target_tokens", 0.5).alias("p50"))


@query("SELECT call_id, max(attempt_index) AS last_attempt, arg_max(model_version, attempt_index) AS model_version, count(DISTINCT attempt_index) AS n_attempts FROM raw_llm_log GROUP BY call_id")
def a33_last_evidence(spark: SparkSession, sf: str) -> DataFrame:
    """A-33 and A-35: each call's last row and its distinct attempts."""
    d = read_table(spark, sf, "raw_llm_log", ("call_id", "attempt_index", "model_version"))
    return d.groupBy("call_id").agg(F.max("attempt_index").alias("last_attempt"), F.max_by("model_version", "attempt_index").alias("model_version"), F.countDistinct("attempt_index").alias("n_attempts"))


@query("SELECT run_id, count(*) AS n_files, count(DISTINCT sha256(payload)) AS n_digests, count(*) - count(DISTINCT checkpoint_step) AS n_repeated, CAST(sum(length(payload)) AS BIGINT) AS n_chars FROM run_metrics GROUP BY run_id")
def a40_file_profile(spark: SparkSession, sf: str) -> DataFrame:
    """S-17 and A-40: files of each run, their distinct digests, repeated steps and size."""
    d = read_table(spark, sf, "run_metrics", ("run_id", "checkpoint_step", "payload"))
    return d.groupBy("run_id").agg(F.count(F.lit(1)).alias("n_files"), F.countDistinct(F.sha2("payload", 256)).alias("n_digests"), (F.count(F.lit(1)) - F.countDistinct("checkpoint_step")).alias("n_repeated"), F.sum(F.length("payload").cast("long")).alias("n_chars"))


# dedupe


@query("SELECT count(*) AS n_rows, count(DISTINCT sha256(concat_ws('|', question_id, coalesce(subset, '~'), coalesce(question, '~'), coalesce(correct_text, '~')))) AS n_distinct FROM wmdp_questions")
def d04_whole_rows(spark: SparkSession, sf: str) -> DataFrame:
    """D-04: rows, and distinct rows by a digest of all their values, so that no text is shuffled."""
    d = read_table(spark, sf, "wmdp_questions")
    return d.agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct(contracts.signature(sorted(d.columns))).alias("n_distinct"))


@query(f"WITH {_L}, a AS (SELECT entity FROM l GROUP BY entity HAVING count(*) >= 2), b AS (SELECT DISTINCT organism_id AS entity FROM wmdp_organisms WHERE n_mentions >= 5) SELECT CASE WHEN a.entity IS NULL THEN 'right_only' WHEN b.entity IS NULL THEN 'left_only' ELSE 'both' END AS side, count(*) AS n FROM a FULL JOIN b ON a.entity = b.entity GROUP BY 1")
def d08_match_sets(spark: SparkSession, sf: str) -> DataFrame:
    """D-08 and D-09: entities of two items or more against those of five mentions or more."""
    a = links(spark, sf).groupBy("entity").count().where("count >= 2").select("entity", F.lit(True).alias("l"))
    b = read_table(spark, sf, "wmdp_organisms", ("organism_id", "n_mentions")).where("n_mentions >= 5").select(F.col("organism_id").alias("entity")).distinct().withColumn("r", F.lit(True))
    side = F.when(F.col("l").isNull(), "right_only").when(F.col("r").isNull(), "left_only").otherwise("both")
    return a.join(b, "entity", "full_outer").groupBy(side.alias("side")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT 'g-' || lpad(CAST(row_number() OVER (ORDER BY taxon_id) AS VARCHAR), 5, '0') AS id, name_txt AS name FROM gazetteer_names UNION ALL SELECT 'q-' || lpad(CAST(row_number() OVER (ORDER BY question_id) AS VARCHAR), 5, '0'), subset FROM (SELECT DISTINCT question_id, subset FROM wmdp_questions)")
def d11_renumbered_union(spark: SparkSession, sf: str) -> DataFrame:
    """D-11: two sources under one numbering each; ranks by sums over ranges."""
    from windrow.operators.prefix import running

    one = lambda d, order, mark, name: running(d, [F.col(order)], {"_k": "1"}).select(F.format_string(f"{mark}-%05d", F.col("_k")).alias("id"), F.col(name).alias("name"))
    g = read_table(spark, sf, "gazetteer_names", ("taxon_id", "name_txt"))
    q = read_table(spark, sf, "wmdp_questions", ("question_id", "subset")).distinct()
    return one(g, "taxon_id", "g", "name_txt").unionByName(one(q, "question_id", "q", "subset"))


# filters, values, texts


@query("SELECT doc_type, CASE WHEN doc_type IN ('entry', 'survey_excerpt', 'comparative_analysis') THEN 'prose' WHEN doc_type IN ('table', 'glossary') THEN 'structured' ELSE 'other' END AS class, count(*) AS n FROM documents GROUP BY ALL")
def f11_class_map(spark: SparkSession, sf: str) -> DataFrame:
    """F-10 and F-11: types mapped to classes by ordered rules."""
    t = F.col("doc_type")
    kind = F.coalesce(filters.first_match([("prose", t.isin("entry", "survey_excerpt", "comparative_analysis")), ("structured", t.isin("table", "glossary"))]), F.lit("other"))
    return read_table(spark, sf, "documents", ("doc_type",)).groupBy("doc_type", kind.alias("class")).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {_A} SELECT CASE WHEN accuracy < 0.5 THEN '<0.5' WHEN accuracy < 0.7 THEN '0.5-<0.7' WHEN accuracy < 0.8 THEN '0.7-<0.8' WHEN accuracy = 0.8 THEN 'exactly_0.8' WHEN accuracy > 0.8 THEN '>0.8' END AS band, CASE WHEN checkpoint_step <= 1 THEN '<=1' ELSE CAST(checkpoint_step AS VARCHAR) END AS step, count(*) AS n FROM a GROUP BY ALL")
def f14_score_bands(spark: SparkSession, sf: str) -> DataFrame:
    """F-14, F-15 and H-13: cells by band of accuracy and label of step."""
    a = accuracies(spark, sf)
    return a.groupBy(V.score_band(F.col("accuracy")).alias("band"), V.step_label(F.col("checkpoint_step")).alias("step")).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {_L}, v AS (SELECT DISTINCT item FROM l WHERE item IN (SELECT question_id FROM wmdp_questions)) SELECT subset, count(*) AS n FROM {'(SELECT DISTINCT question_id, subset FROM wmdp_questions)'} JOIN v ON v.item = question_id GROUP BY subset")
def f18_exact_view(spark: SparkSession, sf: str) -> DataFrame:
    """F-18: the view of the items that entities cite; an id without item would stop the job."""
    q = items(spark, sf).select("question_id", "subset").distinct()
    cited = links(spark, sf).select(F.col("item").alias("question_id")).distinct().join(q.select("question_id"), "question_id", "left_semi")
    return contracts.exact_view(q, "question_id", cited).groupBy("subset").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT doc_id, length(trim(title, ' ')) AS n_title, len(regexp_extract_all(coalesce(title, '') || ' ' || coalesce(abstract, ''), '\\S+')) AS n_words, replace(replace(title, '|', '\\|'), chr(10), ' ') AS escaped, regexp_replace(title, '\\d+(?:\\.\\d+)?', '#', 'g') AS masked FROM documents WHERE title IS NOT NULL")
def t35_masked_titles(spark: SparkSession, sf: str) -> DataFrame:
    """T-08, T-09 (by white space), T-27, T-35 and T-36 of titles."""
    d = read_table(spark, sf, "documents", ("doc_id", "title", "abstract")).where("title is not null")
    t = F.col("title")
    return d.select("doc_id", F.length(F.trim(t)).alias("n_title"), X.ws_count(F.concat_ws(" ", F.coalesce(t, F.lit("")), F.coalesce("abstract", F.lit("")))).alias("n_words"), X.md_escape(t).alias("escaped"), X.mask_values(t).alias("masked"))


@query("WITH t AS (SELECT doc_id, lower(abstract) AS a FROM documents WHERE abstract IS NOT NULL) SELECT doc_id, len(list_filter(list_transform(string_split_regex(a, '\\n\\s*\\n'), lambda p: trim(p, ' ')), lambda p: p <> '')) AS n_paragraphs, contains(a, 'near') AS near, regexp_matches(a, '\\d+(?:\\.\\d+)?\\s*percent') AS quantity FROM t")
def t32_paragraphs(spark: SparkSession, sf: str) -> DataFrame:
    """T-12, T-32 and T-37 of abstracts: paragraphs, a verbatim word, a quantity."""
    a = F.lower("abstract")
    d = read_table(spark, sf, "documents", ("doc_id", "abstract")).where("abstract is not null")
    return d.select("doc_id", F.size(X.paragraphs(a)).alias("n_paragraphs"), X.contains_verbatim(a, F.lit("near")).alias("near"), a.rlike(r"\d+(?:\.\d+)?\s*percent").alias("quantity"))


@query("""WITH m AS (SELECT DISTINCT payload FROM run_metrics WHERE json_valid(payload) AND json_type(payload) = 'OBJECT'), k AS (SELECT payload, unnest(json_keys(payload)) AS k FROM m) SELECT k AS field_name, CASE json_type(payload, '$."' || k || '"') WHEN 'UBIGINT' THEN 'number' WHEN 'BIGINT' THEN 'number' WHEN 'DOUBLE' THEN 'number' WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'ARRAY' THEN 'array' WHEN 'OBJECT' THEN 'object' ELSE 'null' END AS kind, count(*) AS n FROM k GROUP BY ALL""")
def h08_type_shapes(spark: SparkSession, sf: str) -> DataFrame:
    """H-06 and H-08: the JSON types of each top-level field over all payloads."""
    from windrow.operators import schema_drift

    d = read_table(spark, sf, "run_metrics", ("payload",)).distinct().select(F.lit("r").alias("r"), F.lit(0).alias("v"), F.lit(0).alias("f"), "payload")
    one = schema_drift.parse_records(d, "r", "v", "f", "payload").select(F.explode(F.arrays_zip("names", "types")).alias("x"))
    return one.groupBy(F.col("x.names").alias("field_name"), F.col("x.types").alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT r.run_id, s.step, count(p.question_id) AS n FROM (SELECT DISTINCT run_id FROM predictions) r CROSS JOIN (SELECT unnest([0, 1, 2, 4, 8, 16, 32, 64, 128])::INT AS step) s LEFT JOIN (SELECT DISTINCT run_id, checkpoint_step, question_id FROM predictions) p ON p.run_id = r.run_id AND p.checkpoint_step = s.step GROUP BY ALL")
def h17_expected_grid(spark: SparkSession, sf: str) -> DataFrame:
    """C-06 and H-17: rows of each cell of the grid of runs and expected steps, none where a cell is missing."""
    d = read_table(spark, sf, "predictions", ("run_id", "checkpoint_step", "question_id")).distinct()
    grid = d.select("run_id").distinct().withColumn("step", F.explode(F.array(*[F.lit(s) for s in (0, 1, 2, 4, 8, 16, 32, 64, 128)])))
    counts = d.groupBy("run_id", F.col("checkpoint_step").alias("step")).agg(F.count("question_id").alias("_n"))
    return grid.join(counts, ["run_id", "step"], "left").select("run_id", "step", F.coalesce("_n", F.lit(0)).alias("n"))


# audits


@query(f"""WITH {_P}, s AS (SELECT run_id, question_id, list_sort([{{'s': -p_a, 'c': 'A'}}, {{'s': -p_b, 'c': 'B'}}, {{'s': -p_c, 'c': 'C'}}, {{'s': -p_d, 'c': 'D'}}]) AS r FROM p WHERE checkpoint_step = 0 AND chosen IS NOT NULL) SELECT run_id, question_id, r[1].c AS "primary", [r[2].c, r[3].c] AS secondary FROM s""")
def z02_ranked_choice(spark: SparkSession, sf: str) -> DataFrame:
    """Z-02: the best choice and the two next; ties by letter."""
    p = predictions(spark, sf).where("checkpoint_step = 0 and chosen is not null")
    r = F.transform(F.array_sort(F.array(*[F.struct((-F.col(c)).alias("s"), F.lit(c[-1].upper()).alias("c")) for c in PS])), lambda x: x["c"])
    return p.select("run_id", "question_id", r.alias("r")).select("run_id", "question_id", F.element_at("r", 1).alias("primary"), F.slice("r", 2, 2).alias("secondary"))


@query("""WITH d AS (SELECT DISTINCT organism_id, surface_forms FROM wmdp_organisms), c AS (SELECT organism_id, list_distinct(list_filter(list_transform(from_json(surface_forms, '["VARCHAR"]'), lambda f: upper(left(trim(f, ' '), 1))), lambda x: x <> '')) AS c FROM d WHERE surface_forms IS NOT NULL)
  SELECT organism_id, len(c) AS n_codes, len(c) BETWEEN 1 AND 3 AND len(list_filter(c, lambda x: NOT list_contains(['A', 'B', 'C', 'D', 'E', 'F', 'G', 'H', 'I', 'J', 'K', 'L', 'M', 'N', 'O', 'P', 'Q', 'R', 'S', 'T', 'U', 'V', 'W', 'X', 'Y', 'Z'], x))) = 0 AS valid FROM c""")
def z03_code_lists(spark: SparkSession, sf: str) -> DataFrame:
    """Z-03: one to three distinct codes of a closed set (initials of the surface forms), else not valid."""
    forms = F.from_json("surface_forms", "array<string>")
    codes = F.array_distinct(F.filter(F.transform(forms, lambda f: F.upper(F.left(F.trim(f), F.lit(1)))), lambda x: x != ""))
    closed = F.array(*[F.lit(chr(c)) for c in range(65, 91)])
    d = read_table(spark, sf, "wmdp_organisms", ("organism_id", "surface_forms")).where("surface_forms is not null").distinct().select("organism_id", codes.alias("c"))
    return d.select("organism_id", F.size("c").alias("n_codes"), (F.size("c").between(1, 3) & F.forall("c", lambda x: F.array_contains(closed, x))).alias("valid"))


@query(f"""WITH {_A}, x AS (SELECT split_part(run_id, '__', 2) AS condition, checkpoint_step, accuracy FROM a WHERE accuracy IS NOT NULL), q AS (SELECT condition, checkpoint_step, round(avg(accuracy), 2) AS quoted FROM x GROUP BY ALL), s AS (SELECT checkpoint_step, round(avg(accuracy), 6) AS of_step FROM x GROUP BY ALL)
  SELECT q.condition, q.checkpoint_step, quoted, abs(quoted - of_step) <= 0.005 AS from_steps, abs(quoted - of_condition) <= 0.005 AS from_conditions FROM q JOIN s USING (checkpoint_step) JOIN (SELECT condition, round(avg(accuracy), 6) AS of_condition FROM x GROUP BY ALL) USING (condition)""")
def z13_attributed_figures(spark: SparkSession, sf: str) -> DataFrame:
    """Z-13: which of two families of tables a quoted figure may come from, to 0.005."""
    x = accuracies(spark, sf).where("accuracy is not null").withColumn("condition", F.split_part("run_id", F.lit("__"), F.lit(2)))
    quoted = x.groupBy("condition", "checkpoint_step").agg(F.round(F.avg("accuracy"), 2).alias("quoted"))
    steps, conditions = (x.groupBy(k).agg(F.round(F.avg("accuracy"), 6).alias(n)) for k, n in (("checkpoint_step", "s"), ("condition", "c")))
    both = quoted.join(steps, "checkpoint_step").join(conditions, "condition")
    return both.select("condition", "checkpoint_step", "quoted", (F.abs(F.col("quoted") - F.col("s")) <= 0.005).alias("from_steps"), (F.abs(F.col("quoted") - F.col("c")) <= 0.005).alias("from_conditions"))


@query(f"""WITH {_P}, g AS (SELECT run_id, checkpoint_step, count(*) FILTER (chosen = gold) AS k, count(*) AS n, count(*) FILTER (p_a IS NULL) AS x, count(*) FILTER (gold IS NULL) AS y FROM p GROUP BY ALL), f AS (SELECT *, list_filter([CASE WHEN n < 50 THEN 'rows' END, CASE WHEN x > 0.01 * n THEN 'probabilities' END, CASE WHEN y > 0.01 * n THEN 'gold' END], lambda v: v IS NOT NULL) AS failed FROM g),
  m AS (SELECT run_id, max(checkpoint_step) AS last FROM g GROUP BY run_id) SELECT run_id, checkpoint_step, array_to_string(failed, ',') AS failed, checkpoint_step < last AND NOT list_contains(failed, 'rows') AS needs_rerun FROM f JOIN m USING (run_id) WHERE len(failed) > 0""")
def z12_parked_cells(spark: SparkSession, sf: str) -> DataFrame:
    """Z-12 and Z-16: cells that fail on their own while the rest goes on, and those to run again: not the last step, no hard gate."""
    g = predictions(spark, sf).groupBy("run_id", "checkpoint_step").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("p_a").isNull()).alias("x"), F.count_if(F.col("gold").isNull()).alias("y"))
    failed = F.array_compact(F.array(F.when(F.col("n") < 50, "rows"), F.when(F.col("x") > 0.01 * F.col("n"), "probabilities"), F.when(F.col("y") > 0.01 * F.col("n"), "gold")))
    last = g.groupBy("run_id").agg(F.max("checkpoint_step").alias("last"))
    f = g.withColumn("_f", failed).where("size(_f) > 0").join(F.broadcast(last), "run_id")
    return f.select("run_id", "checkpoint_step", F.array_join("_f", ",").alias("failed"), ((F.col("checkpoint_step") < F.col("last")) & ~F.array_contains("_f", "rows")).alias("needs_rerun"))


@query(f"WITH {_P}, q AS (SELECT DISTINCT question_id, subset FROM wmdp_questions), c AS (SELECT subset, count(*) FILTER (chosen = gold) AS k, count(*) AS n FROM p JOIN q USING (question_id) WHERE chosen IS NOT NULL AND gold IS NOT NULL GROUP BY subset) SELECT subset, k, n, round(k - n / 4, 6) AS above_chance, round((k - n / 4) / sqrt(n * 3 / 16), 6) AS deviations FROM c")
def z14_above_chance(spark: SparkSession, sf: str) -> DataFrame:
    """Z-14: right answers above chance of each family, in counts and deviations."""
    q = items(spark, sf).select("question_id", "subset").distinct()
    c = predictions(spark, sf).join(F.broadcast(q), "question_id").where("chosen is not null and gold is not null").groupBy("subset").agg(F.count_if(F.col("chosen") == F.col("gold")).alias("k"), F.count(F.lit(1)).alias("n"))
    d = F.col("k") - F.col("n") / 4
    return c.select("subset", "k", "n", F.round(d, 6).alias("above_chance"), F.round(d / F.sqrt(F.col("n") * 3 / 16), 6).alias("deviations"))


@query(f"WITH {_A}, b AS (SELECT run_id, accuracy AS start FROM a WHERE checkpoint_step = 0) SELECT run_id, checkpoint_step, round(coalesce(CASE WHEN checkpoint_step % 2 = 0 THEN accuracy - start END, accuracy - start), 8) + 0.0 AS drift, checkpoint_step % 2 <> 0 AS filled FROM a JOIN b USING (run_id) WHERE accuracy IS NOT NULL")
def z15_backfilled(spark: SparkSession, sf: str) -> DataFrame:
    """Z-15: drift that a ledger lacks (here of odd steps) derived from the accuracies; values it has stay, so a second pass changes nothing."""
    a = accuracies(spark, sf)
    start = a.where("checkpoint_step = 0").select("run_id", F.col("accuracy").alias("start"))
    both = a.where("accuracy is not null").join(start, "run_id").withColumn("_d", F.col("accuracy") - F.col("start"))
    ledger = both.withColumn("drift", F.when(F.col("checkpoint_step") % 2 == 0, F.col("_d")))
    return aggregates.backfilled(ledger, "drift", F.col("_d")).select("run_id", "checkpoint_step", (F.round("drift", 8) + 0.0).alias("drift"), "filled")


@query(f"WITH {_L}, {_P}, s AS (SELECT item FROM l GROUP BY item HAVING count(*) >= 2) SELECT run_id, round(avg(CAST(chosen = gold AS INT)), 9) AS accuracy, count(*) FILTER (chosen = gold) AS n_correct, count(*) AS n FROM p WHERE chosen IS NOT NULL AND gold IS NOT NULL AND question_id IN (SELECT item FROM s) GROUP BY run_id")
def z17_accuracy_of_subset(spark: SparkSession, sf: str) -> DataFrame:
    """Z-17: accuracy over the items that two entities or more have."""
    ids = links(spark, sf).groupBy("item").count().where("count >= 2").select(F.col("item").alias("question_id"))
    p = predictions(spark, sf).where("chosen is not null and gold is not null").join(ids, "question_id", "left_semi")
    return p.groupBy("run_id").agg(F.round(F.avg((F.col("chosen") == F.col("gold")).cast("int")), 9).alias("accuracy"), F.count_if(F.col("chosen") == F.col("gold")).alias("n_correct"), F.count(F.lit(1)).alias("n"))


@query("WITH u AS (SELECT 'q' AS kind, question_id AS id FROM wmdp_questions UNION SELECT 'o', organism_id FROM wmdp_organisms), s AS (SELECT kind, id FROM u ORDER BY sha256('7|' || kind || id), kind, id LIMIT 200) SELECT kind, id FROM s")
def z18_sample_of_union(spark: SparkSession, sf: str) -> DataFrame:
    """Z-18: two hundred of a flattened union by digest; the size is what is asked."""
    u = read_table(spark, sf, "wmdp_questions", ("question_id",)).select(F.lit("q").alias("kind"), F.col("question_id").alias("id")).union(read_table(spark, sf, "wmdp_organisms", ("organism_id",)).select(F.lit("o"), "organism_id")).distinct()
    return u.orderBy(F.sha2(F.concat(F.lit("7|"), "kind", "id"), 256), "kind", "id").limit(200)


@query("""WITH p AS (SELECT DISTINCT part_id, corpus_alias, section_id, part_index, text FROM spine_parts), s AS (SELECT corpus_alias, count(*) AS n, round(avg(length(text)), 6) AS mean_chars, count(DISTINCT section_id) AS n_sections FROM p GROUP BY corpus_alias) SELECT * FROM s""")
def z08_side_diagnostics(spark: SparkSession, sf: str) -> DataFrame:
    """Z-08: sizes, mean lengths and sections of each side."""
    p = read_table(spark, sf, "spine_parts", ("part_id", "corpus_alias", "section_id", "part_index", "text")).select("part_id", "corpus_alias", "section_id", "part_index", F.length("text").alias("n_chars"), F.xxhash64("text").alias("h")).distinct()
    return p.groupBy("corpus_alias").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("n_chars"), 6).alias("mean_chars"), F.countDistinct("section_id").alias("n_sections"))


@query(f"""WITH {_L}, s AS (SELECT DISTINCT chapter_id, unnest(entity_ids) AS e FROM spine_parts), x AS (SELECT s.chapter_id, o.parent_genus, count(DISTINCT o.taxon_rank) AS n_values, count(DISTINCT s.e) AS n FROM s JOIN (SELECT DISTINCT organism_id, parent_genus, taxon_rank FROM wmdp_organisms WHERE parent_genus IS NOT NULL) o ON o.organism_id = s.e GROUP BY ALL) SELECT chapter_id, count(*) AS n_genera, count(*) FILTER (n_values > 1) AS n_violations, CAST(sum(n) AS BIGINT) AS n_entities FROM x GROUP BY chapter_id""")
def z07_schedule_join(spark: SparkSession, sf: str) -> DataFrame:
    """Z-07: chapters' entities joined with their traits, and genera that give more than one rank."""
    s = read_table(spark, sf, "spine_parts", ("chapter_id", "entity_ids")).select("chapter_id", F.explode("entity_ids").alias("organism_id")).distinct()
    o = read_table(spark, sf, "wmdp_organisms", ("organism_id", "parent_genus", "taxon_rank")).where("parent_genus is not null").distinct()
    x = s.join(o, "organism_id").groupBy("chapter_id", "parent_genus").agg(F.countDistinct("taxon_rank").alias("k"), F.countDistinct("organism_id").alias("n"))
    return x.groupBy("chapter_id").agg(F.count(F.lit(1)).alias("n_genera"), F.count_if(F.col("k") > 1).alias("n_violations"), F.sum("n").alias("n_entities"))


