"""Queries over claims, categories, schedules and audits: classifiers, matched sets, fixed points."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from windrow.functions import text as X
from windrow.functions import values as V
from windrow.operators import aggregates, dedupe, graph, joins, sampling, windows
from windrow.plans.graph_queries import links
from windrow.plans.metric_queries import PS, predictions
from windrow.registry import query
from windrow.sources import read_table

_Q = "q AS (SELECT DISTINCT * FROM wmdp_questions)"


#: Patterns of candidate mentions, read with Unicode boundaries and white space.
MENTIONS = (
    r"(?U)\b(?:[A-Z][a-z]{2,}|[A-Z]\.)\s+[a-z][a-z-]{2,}(?:\s+(?:virus|bacterium|strain))?\b",
    r"(?iU)\b(?:[A-Za-z0-9][A-Za-z0-9.'’-]*\s+){0,3}(?:virus|viruses|bacterium|bacteria|fungus|fungi|parasite|prion|pathogen|pathogens)\b",
    r"(?U)\b[A-Za-z][A-Za-z0-9]*(?:-[A-Za-z0-9]+)+\b|\b[A-Z]{2,}[A-Z0-9]*\b",
)


def items(spark: SparkSession, sf: str) -> DataFrame:
    return read_table(spark, sf, "wmdp_questions").distinct()


@query(f"WITH {_Q} SELECT question_id, subset FROM q WHERE subset = 'bio'")
def f01_equality(spark: SparkSession, sf: str) -> DataFrame:
    return items(spark, sf).where("subset = 'bio'").select("question_id", "subset")


@query("SELECT organism_id, CASE WHEN gazetteer_match = 'true' AND n_mentions >= 5 THEN 'core' WHEN gazetteer_match IS NULL OR gazetteer_match <> 'true' THEN 'review' ELSE 'periphery' END AS tier FROM (SELECT DISTINCT * FROM wmdp_organisms)")
def f06_tiers(spark: SparkSession, sf: str) -> DataFrame:
    d = read_table(spark, sf, "wmdp_organisms").distinct()
    t = F.when((F.col("gazetteer_match") == "true") & (F.col("n_mentions") >= 5), "core").when(F.col("gazetteer_match").isNull() | (F.col("gazetteer_match") != "true"), "review").otherwise("periphery")
    return d.select("organism_id", t.alias("tier"))


@query("SELECT doc_id, CASE WHEN contains(lower(title), 'leaf') OR contains(lower(title), 'petal') THEN 'plant' WHEN contains(lower(title), 'wing') OR contains(lower(title), 'shell') THEN 'animal' WHEN title IS NOT NULL THEN 'other' END AS dimension FROM documents")
def f09_keyword_class(spark: SparkSession, sf: str) -> DataFrame:
    t = F.lower("title")
    c = F.when(t.contains("leaf") | t.contains("petal"), "plant").when(t.contains("wing") | t.contains("shell"), "animal").when(t.isNotNull(), "other")
    return read_table(spark, sf, "documents", ("doc_id", "title")).select("doc_id", c.alias("dimension"))


@query("WITH p AS (SELECT DISTINCT part_id, entity_ids FROM spine_parts), c AS (SELECT DISTINCT organism_id FROM wmdp_organisms WHERE gazetteer_match = 'true') SELECT DISTINCT part_id FROM (SELECT part_id, unnest(entity_ids) AS e FROM p) SEMI JOIN c ON e = organism_id")
def f16_intersects_core(spark: SparkSession, sf: str) -> DataFrame:
    core = read_table(spark, sf, "wmdp_organisms", ("organism_id", "gazetteer_match")).where("gazetteer_match = 'true'")
    d = read_table(spark, sf, "spine_parts", ("part_id", "entity_ids")).select("part_id", F.explode("entity_ids").alias("e"))
    return d.join(core, F.col("e") == F.col("organism_id"), "left_semi").select("part_id").distinct()


@query(f"WITH {_Q} SELECT question_id, '' AS question, choice_a, choice_b, choice_c, choice_d FROM q")
def f17_options_only(spark: SparkSession, sf: str) -> DataFrame:
    return items(spark, sf).select("question_id", F.lit("").alias("question"), "choice_a", "choice_b", "choice_c", "choice_d")


@query(f"WITH {_Q} SELECT a.question_id, b.question_id AS same_as FROM q a JOIN q b ON trim(a.correct_text, ' ') = trim(b.correct_text, ' ') AND a.question_id < b.question_id")
def j05_exact_text(spark: SparkSession, sf: str) -> DataFrame:
    """Items that share their correct text."""
    q = items(spark, sf).select("question_id", F.trim("correct_text").alias("t"))
    return q.join(q.select(F.col("question_id").alias("same_as"), "t"), "t").where("question_id < same_as").select("question_id", "same_as")


@query("""WITH o AS (SELECT DISTINCT organism_id, parent_genus, taxon_rank FROM wmdp_organisms), g AS (SELECT name_txt, taxon_id FROM gazetteer_names WHERE taxon_rank = 'genus') SELECT organism_id, taxon_id AS genus_id FROM o LEFT JOIN g ON parent_genus = name_txt""")
def j06_left_enrich(spark: SparkSession, sf: str) -> DataFrame:
    o = read_table(spark, sf, "wmdp_organisms", ("organism_id", "parent_genus", "taxon_rank")).distinct()
    g = read_table(spark, sf, "gazetteer_names", ("taxon_id", "name_txt", "taxon_rank")).where("taxon_rank = 'genus'")
    return o.join(F.broadcast(g.select("name_txt", F.col("taxon_id").alias("genus_id"))), F.col("parent_genus") == F.col("name_txt"), "left").select("organism_id", "genus_id")


@query(f"""WITH {_Q}, w AS (SELECT DISTINCT question_id, unnest(regexp_extract_all(lower(correct_text), '[\\p{{L}}\\p{{N}}_]{{4,}}')) AS w FROM q)
  SELECT a.question_id AS a, b.question_id AS b, count(*) AS n_shared FROM w a JOIN w b ON a.w = b.w AND a.question_id < b.question_id GROUP BY ALL""")
def j13_shared_words(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs of items whose right answers share content words, those of four characters or more, and how many they share."""
    content = F.regexp_extract_all(X.norm_term(F.col("correct_text")), F.lit(r"[\p{L}\p{N}_]{4,}"), F.lit(0))
    w = items(spark, sf).select("question_id", F.explode(content).alias("w")).distinct()
    return joins.cooccurrence(w, "w", "question_id").withColumnsRenamed({"src": "a", "dst": "b", "weight": "n_shared"})


@query(f"WITH {_Q} SELECT a.question_id AS a, b.question_id AS b FROM q a JOIN q b ON a.correct_text = b.choice_a AND a.question_id <> b.question_id AND a.subset = b.subset AND b.correct_index <> 0")
def j14_contradiction(spark: SparkSession, sf: str) -> DataFrame:
    """Items whose right answer is another item's wrong first choice."""
    q = items(spark, sf)
    b = q.where("correct_index <> 0").select(F.col("question_id").alias("b"), F.col("choice_a").alias("t"), "subset")
    return q.select(F.col("question_id").alias("a"), F.col("correct_text").alias("t"), "subset").join(b, ["t", "subset"]).where("a <> b").select("a", "b")


@query("""WITH d AS (SELECT doc_id, ' ' || array_to_string(regexp_extract_all(lower(title), '[a-z0-9]+'), ' ') || ' ' AS t FROM documents WHERE title IS NOT NULL) SELECT doc_id FROM d WHERE contains(t, ' leaf margin ') AND contains(t, ' at ')""")
def j17_all_terms(spark: SparkSession, sf: str) -> DataFrame:
    """Documents whose titles hold all terms as whole words."""
    t = F.concat(F.lit(" "), X.alnum(F.col("title")), F.lit(" "))
    return read_table(spark, sf, "documents", ("doc_id", "title")).where(F.forall(F.array(F.lit(" leaf margin "), F.lit(" at ")), lambda x: F.contains(t, x))).select("doc_id")


@query("""WITH p AS (SELECT DISTINCT part_id, entity_ids, text FROM spine_parts WHERE text IS NOT NULL), e AS (SELECT part_id, text, unnest(entity_ids) AS id FROM p), n AS (SELECT DISTINCT organism_id, name_normalized FROM wmdp_organisms WHERE name_normalized IS NOT NULL)
  SELECT part_id, count(*) AS n_cited, count(*) FILTER (contains(lower(text), lower(name_normalized))) AS n_named FROM e JOIN n ON id = organism_id GROUP BY part_id""")
def j25_cited_and_named(spark: SparkSession, sf: str) -> DataFrame:
    # ids are joined first and the names of a part joined back as one list, so that no text is shuffled an entity at a time
    d = read_table(spark, sf, "spine_parts", ("part_id", "entity_ids", "text")).where("text is not null").withColumn("h", F.xxhash64("text", "entity_ids"))
    n = read_table(spark, sf, "wmdp_organisms", ("organism_id", "name_normalized")).distinct().where("name_normalized is not null")
    cited = d.select("part_id", "h", "entity_ids").distinct().select("part_id", "h", F.explode("entity_ids").alias("organism_id"))
    names = cited.join(n, "organism_id").groupBy("part_id", "h").agg(F.collect_list("name_normalized").alias("names"))  # those that a part cites
    text = F.lower("text")
    named = d.join(names, ["part_id", "h"]).select("part_id", "h", F.size("names").cast("long").alias("c"), F.size(F.filter("names", lambda x: F.contains(text, F.lower(x)))).cast("long").alias("k")).distinct()
    return named.groupBy("part_id").agg(F.sum("c").alias("n_cited"), F.sum("k").alias("n_named"))


@query("SELECT source, arg_min(lang, (-c, lang)) AS modal_lang, max(c) AS n FROM (SELECT source, lang, count(*) AS c FROM documents WHERE lang IS NOT NULL GROUP BY ALL) GROUP BY source")
def a03_mode(spark: SparkSession, sf: str) -> DataFrame:
    c = read_table(spark, sf, "documents", ("source", "lang")).where("lang is not null").groupBy("source", "lang").agg(F.count(F.lit(1)).alias("c"))
    return c.groupBy("source").agg(F.min_by("lang", F.struct(-F.col("c"), F.col("lang"))).alias("modal_lang"), F.max("c").alias("n"))


@query("""WITH m AS (SELECT chapter_id, count(*) AS n, max(c) AS k FROM (SELECT chapter_id, doc_type, count(*) AS c FROM documents GROUP BY ALL) GROUP BY chapter_id), t AS (SELECT chapter_id, count(*) AS n FROM documents GROUP BY chapter_id)
  SELECT round(sum(k) / sum(t.n), 9) AS weighted_share, CAST(sum(t.n) AS BIGINT) AS n FROM m JOIN t ON m.chapter_id = t.chapter_id WHERE t.n >= 2""")
def a08_weighted_share(spark: SparkSession, sf: str) -> DataFrame:
    d = read_table(spark, sf, "documents", ("doc_id", "chapter_id", "doc_type")).where("chapter_id is not null")
    c = d.groupBy("chapter_id", "doc_type").agg(F.count(F.lit(1)).alias("c")).groupBy("chapter_id").agg(F.max("c").alias("k"), F.sum("c").alias("n")).where("n >= 2")
    return c.agg(F.round(F.sum("k") / F.sum("n"), 9).alias("weighted_share"), F.sum("n").alias("n"))


@query("SELECT CASE WHEN k >= 5 THEN '5+' ELSE CAST(k AS VARCHAR) END AS bin, count(*) AS n FROM (SELECT chapter_id, count(DISTINCT doc_type) AS k FROM documents WHERE chapter_id IS NOT NULL GROUP BY chapter_id) GROUP BY ALL")
def a09_clamped_histogram(spark: SparkSession, sf: str) -> DataFrame:
    k = read_table(spark, sf, "documents", ("chapter_id", "doc_type")).where("chapter_id is not null").groupBy("chapter_id").agg(F.countDistinct("doc_type").alias("k"))
    return k.groupBy(F.when(F.col("k") >= 5, "5+").otherwise(F.col("k").cast("string")).alias("bin")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT count(*) AS n_targets, count(*) FILTER (k > 1) AS n_collisions, round(avg(CAST(k > 1 AS INT)), 9) AS rate FROM (SELECT name_normalized, count(DISTINCT name_raw) AS k FROM wmdp_organisms WHERE name_normalized IS NOT NULL GROUP BY name_normalized)")
def a11_collisions(spark: SparkSession, sf: str) -> DataFrame:
    k = read_table(spark, sf, "wmdp_organisms", ("name_normalized", "name_raw")).where("name_normalized is not null").groupBy("name_normalized").agg(F.countDistinct("name_raw").alias("k"))
    return k.agg(F.count(F.lit(1)).alias("n_targets"), F.count_if(F.col("k") > 1).alias("n_collisions"), F.round(F.avg((F.col("k") > 1).cast("double")), 9).alias("rate"))


@query("""WITH n AS (SELECT taxon_id, array_to_string(regexp_extract_all(lower(name_txt), '[a-z0-9]+'), ' ') AS g FROM gazetteer_names WHERE taxon_rank = 'species'), t AS (SELECT doc_id, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i+1])) AS g FROM (SELECT doc_id, regexp_extract_all(lower(title), '[a-z0-9]+') AS w FROM documents WHERE title IS NOT NULL) WHERE len(w) > 1),
  a AS (SELECT doc_id, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i+1])) AS g FROM (SELECT doc_id, regexp_extract_all(lower(abstract), '[a-z0-9]+') AS w FROM documents WHERE abstract IS NOT NULL) WHERE len(w) > 1),
  h AS (SELECT taxon_id, doc_id, true AS title FROM t JOIN n USING (g) UNION SELECT taxon_id, doc_id, false FROM a JOIN n USING (g)) SELECT taxon_id, count(DISTINCT doc_id) FILTER (title) AS n_title, count(DISTINCT doc_id) FILTER (NOT title) AS n_abstract, count(DISTINCT doc_id) AS n_either FROM h GROUP BY taxon_id""")
def a18_document_frequency(spark: SparkSession, sf: str) -> DataFrame:
    """Documents that name each species in title, abstract, either."""
    d = read_table(spark, sf, "documents", ("doc_id", "title", "abstract"))
    names = read_table(spark, sf, "gazetteer_names", ("taxon_id", "name_txt", "taxon_rank")).where("taxon_rank = 'species'")
    hits = joins.phrase_hits(d, "doc_id", "title", names, "taxon_id", "name_txt").withColumn("t", F.lit(True)).union(joins.phrase_hits(d, "doc_id", "abstract", names, "taxon_id", "name_txt").withColumn("t", F.lit(False)))
    per = hits.groupBy("taxon_id", "doc_id").agg(F.bool_or("t").alias("t"), F.bool_or(~F.col("t")).alias("a"))
    return per.groupBy("taxon_id").agg(F.count_if("t").alias("n_title"), F.count_if("a").alias("n_abstract"), F.count(F.lit(1)).alias("n_either"))


@query("SELECT size, count(*) AS n_components FROM (SELECT parent_genus, count(DISTINCT organism_id) AS size FROM wmdp_organisms WHERE parent_genus IS NOT NULL GROUP BY parent_genus) GROUP BY size")
def g10_taxonomic_groups(spark: SparkSession, sf: str) -> DataFrame:
    d = read_table(spark, sf, "wmdp_organisms", ("organism_id", "parent_genus")).where("parent_genus is not null").distinct()
    return graph.size_distribution(d.select(F.col("parent_genus").alias("component")))


@query("""WITH RECURSIVE l AS (SELECT DISTINCT organism_id AS entity, unnest(from_json(question_ids, '["VARCHAR"]')) AS item FROM wmdp_organisms WHERE question_ids IS NOT NULL), e AS (SELECT 'e' || entity AS a, 'i' || item AS b FROM l UNION SELECT 'i' || item, 'e' || entity FROM l),
  r(node, seen) AS (SELECT DISTINCT a, a FROM e WHERE a[1] = 'i' UNION SELECT r.node, e.b FROM r JOIN e ON r.seen = e.a), c AS (SELECT node, min(seen) AS component FROM r WHERE seen[1] = 'i' GROUP BY node), m AS (SELECT component, count(*) AS size FROM c GROUP BY component)
  SELECT size, count(*) AS n_components FROM m GROUP BY size""")
def g04_item_components(spark: SparkSession, sf: str) -> DataFrame:
    """Sizes of the components of items that entities tie together."""
    all_ = links(spark, sf)
    return graph.size_distribution(graph.components(graph.star(all_, "entity", "item"), all_.select("item")))


@query("SELECT doc_id, CAST(conv AS BIGINT) AS stable FROM (SELECT doc_id, CAST('0x' || substr(sha256(doi), 1, 8) AS BIGINT) AS conv FROM documents WHERE doi IS NOT NULL)")
def h04_stable_int(spark: SparkSession, sf: str) -> DataFrame:
    return read_table(spark, sf, "documents", ("doc_id", "doi")).where("doi is not null").select("doc_id", V.stable_int(F.col("doi")).alias("stable"))


@query(f"WITH {_Q} SELECT format('{{}}-{{:04d}}', subset, row_number() OVER (PARTITION BY subset ORDER BY question_id) - 1) AS dense_id, question_id FROM q")
def h05_dense_ids(spark: SparkSession, sf: str) -> DataFrame:
    """Ids by subset and place; the items are a fixed set."""
    n = F.row_number().over(W.partitionBy("subset").orderBy("question_id")) - 1
    return items(spark, sf).select(F.format_string("%s-%04d", F.col("subset"), n).alias("dense_id"), "question_id")


@query("WITH g AS (SELECT DISTINCT call_id, attempt_index, prompt_text FROM raw_llm_log WHERE prompt_text IS NOT NULL), h AS (SELECT sha256(trim(regexp_replace(prompt_text, '[ \\t\\n\\r\\f\\v]+', ' ', 'g'), ' ')) AS h, count(*) AS n, count(DISTINCT call_id) AS n_calls FROM g GROUP BY h) SELECT n, n_calls, count(*) AS n_prompts FROM h GROUP BY n, n_calls")
def d02_repeated_prompts(spark: SparkSession, sf: str) -> DataFrame:
    d = read_table(spark, sf, "raw_llm_log", ("call_id", "attempt_index", "prompt_text")).where("prompt_text is not null")
    d = d.select("call_id", "attempt_index", V.digest(X.norm_ws(F.col("prompt_text"))).alias("h"), F.xxhash64("prompt_text").alias("t")).distinct()
    h = d.groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("call_id").alias("n_calls"))
    return h.groupBy("n", "n_calls").agg(F.count(F.lit(1)).alias("n_prompts"))


@query("SELECT section_id, arg_min(part_id, (length(text), part_id)) AS part_id, min(length(text)) AS n_chars FROM spine_parts WHERE length(text) > 0 GROUP BY section_id")
def d03_shortest(spark: SparkSession, sf: str) -> DataFrame:
    d = read_table(spark, sf, "spine_parts", ("section_id", "part_id", "text")).select("section_id", "part_id", F.length("text").cast("long").alias("n")).where("n > 0")
    return d.groupBy("section_id").agg(F.min_by("part_id", F.struct("n", "part_id")).alias("part_id"), F.min("n").alias("n_chars"))


@query("SELECT a.policy_revision AS revision, count(*) AS n_new FROM (SELECT DISTINCT policy_revision, section_id, part_index FROM spine_parts WHERE policy_revision = 'r4') a ANTI JOIN (SELECT section_id, part_index FROM spine_parts WHERE policy_revision = 'r2') b USING (section_id, part_index) GROUP BY ALL")
def d12_fresh(spark: SparkSession, sf: str) -> DataFrame:
    d = read_table(spark, sf, "spine_parts", ("policy_revision", "section_id", "part_index"))
    return dedupe.fresh(d.where("policy_revision = 'r4'"), d.where("policy_revision = 'r2'"), ["section_id", "part_index"]).agg(F.count(F.lit(1)).alias("n_new")).select(F.lit("r4").alias("revision"), "n_new")


@query("SELECT section_id, part_id, k FROM (SELECT section_id, part_id, row_number() OVER (PARTITION BY section_id ORDER BY part_index, part_id) AS k FROM (SELECT DISTINCT section_id, part_id, part_index FROM spine_parts)) WHERE k <= 8")
def w15_first_contexts(spark: SparkSession, sf: str) -> DataFrame:
    """The first eight parts of each section, which is a small group."""
    d = read_table(spark, sf, "spine_parts", ("section_id", "part_id", "part_index")).distinct()
    return d.withColumn("k", F.row_number().over(W.partitionBy("section_id").orderBy("part_index", "part_id"))).where("k <= 8").select("section_id", "part_id", "k")


@query("""WITH t AS (SELECT doc_id, regexp_extract_all(lower(abstract), '[a-z0-9]+') AS w FROM documents WHERE abstract IS NOT NULL), s AS (SELECT doc_id, w, CAST(ceil(len(w) / 3.0) AS BIGINT) AS z FROM t WHERE len(w) > 0), d AS (SELECT *, greatest(1, z - 5) AS d FROM s)
  SELECT doc_id, unnest(range(greatest(1, CAST(ceil((len(w) - z) / d) AS BIGINT) + 1))) AS chunk, z AS size FROM (SELECT *, CAST(d AS DOUBLE) AS dd FROM d)""")
def w16_chunks(spark: SparkSession, sf: str) -> DataFrame:
    t = read_table(spark, sf, "documents", ("doc_id", "abstract")).where("abstract is not null").select("doc_id", X.words(F.col("abstract")).alias("w"))
    size = F.ceil(F.size("w") / F.lit(3))
    chunks = windows.overlapping_chunks(t, "doc_id", "w", 3, 5).select("doc_id", F.col("chunk").cast("long").alias("chunk"))
    return chunks.join(t.select("doc_id", size.alias("size")), "doc_id")


@query("""WITH p AS (SELECT DISTINCT run_id, checkpoint_step, question_id, p_a, p_b, p_c, p_d FROM predictions WHERE p_a IS NOT NULL AND p_b IS NOT NULL AND p_c IS NOT NULL AND p_d IS NOT NULL)
  SELECT a.run_id, count(*) AS n, round(max(greatest(abs(a.p_a - b.p_a), abs(a.p_b - b.p_b), abs(a.p_c - b.p_c), abs(a.p_d - b.p_d))), 9) AS max_diff FROM p a JOIN p b ON a.run_id = b.run_id AND a.question_id = b.question_id AND a.checkpoint_step = 1 AND b.checkpoint_step = 0 GROUP BY a.run_id""")
def w17_step_identity(spark: SparkSession, sf: str) -> DataFrame:
    """Largest difference between the probabilities of step 1 and of step 0."""
    p = predictions(spark, sf).where("chosen is not null")
    b = p.where("checkpoint_step = 0").select("run_id", "question_id", *[F.col(c).alias(f"{c}_0") for c in PS])
    diff = F.greatest(*[F.abs(F.col(c) - F.col(f"{c}_0")) for c in PS])
    return p.where("checkpoint_step = 1").join(b, ["run_id", "question_id"]).groupBy("run_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.max(diff), 9).alias("max_diff"))


@query("SELECT label, count(*) AS n, min(vec_id) AS first_id FROM embeddings GROUP BY label")
def i34_labels(spark: SparkSession, sf: str) -> DataFrame:
    d = read_table(spark, sf, "embeddings", ("vec_id", "label"))
    return d.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.min("vec_id").alias("first_id"))


@query("""WITH e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), f AS (SELECT label, arg_min(vec_id, vec_id) AS id, arg_min(v, vec_id) AS u FROM e GROUP BY label) SELECT e.vec_id, round(list_dot_product(v, u) / sqrt(list_dot_product(v, v) * list_dot_product(u, u)), 6) AS similarity FROM e JOIN f USING (label)""")
def i34_cosine(spark: SparkSession, sf: str) -> DataFrame:
    """Cosine of each vector with the first of its label."""
    e = read_table(spark, sf, "embeddings", ("vec_id", "label", "embedding")).withColumn("v", F.col("embedding").cast("array<double>"))
    first = e.groupBy("label").agg(F.min_by("v", "vec_id").alias("u"))
    return e.join(F.broadcast(first), "label").select("vec_id", F.round(V.cosine(F.col("v"), F.col("u")), 6).alias("similarity"))


@query("SELECT subset, count(*) AS n, count(n_tokens) AS n_known, round(avg(n_tokens), 6) AS mean_tokens, round(coalesce(max(n_tokens) * 1.8, 0), 6) AS projected FROM (SELECT DISTINCT question_id, subset, n_tokens FROM wmdp_questions) GROUP BY subset")
def z10_projection(spark: SparkSession, sf: str) -> DataFrame:
    d = items(spark, sf).select("question_id", "subset", "n_tokens").distinct()
    return d.groupBy("subset").agg(F.count(F.lit(1)).alias("n"), F.count("n_tokens").alias("n_known"), F.round(F.avg("n_tokens"), 6).alias("mean_tokens"), F.round(F.coalesce(F.max("n_tokens") * 1.8, F.lit(0.0)), 6).alias("projected"))


@query(f"""WITH {_Q}, t AS (SELECT question_id, coalesce(question, '') || chr(10) || 'Choices: ' || concat_ws(' | ', choice_a, choice_b, choice_c, choice_d) AS t FROM q),
  m AS (SELECT question_id, unnest(regexp_extract_all(t, '\\b(?:[A-Z][a-z]{{2,}}|[A-Z]\\.)\\s+[a-z][a-z-]{{2,}}(?:\\s+(?:virus|bacterium|strain))?\\b')) AS m FROM t
    UNION ALL SELECT question_id, regexp_replace(unnest(regexp_extract_all(t, '(?i)\\b(?:[a-z0-9][a-z0-9.''’-]*\\s+){{0,3}}(?:virus|viruses|bacterium|bacteria|fungus|fungi|parasite|prion|pathogen|pathogens)\\b')), '\\s+', ' ', 'g') FROM t
    UNION ALL SELECT question_id, m FROM (SELECT question_id, unnest(regexp_extract_all(t, '\\b[A-Za-z][A-Za-z0-9]*(?:-[A-Za-z0-9]+)+\\b|\\b[A-Z]{{2,}}[A-Z0-9]*\\b')) AS m FROM t) WHERE length(m) >= 3)
  SELECT DISTINCT question_id, trim(m, ' ,.;:()[]{{}}') AS surface_form FROM m WHERE length(trim(m, ' ,.;:()[]{{}}')) BETWEEN 3 AND 80""")
def z01_candidate_names(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct candidate mentions of each item's question and choices: binomials, phrases that end in a kind of agent, and tokens with hyphens or in capitals."""
    text = F.concat(F.coalesce("question", F.lit("")), F.lit("\nChoices: "), F.concat_ws(" | ", *[f"choice_{c}" for c in "abcd"]))
    binomials, agents, tokens = (F.regexp_extract_all(text, F.lit(p), F.lit(0)) for p in MENTIONS)
    found = F.concat(binomials, F.transform(agents, X.norm_ws), F.filter(tokens, lambda t: F.length(t) >= 3))
    stripped = F.transform(found, lambda m: F.regexp_replace(m, r"^[ ,.;:()\[\]{}]+|[ ,.;:()\[\]{}]+\z", ""))
    return items(spark, sf).select("question_id", F.explode(stripped).alias("surface_form")).where("length(surface_form) between 3 and 80").distinct()


@query()
def o17_packed_components(spark: SparkSession, sf: str) -> DataFrame:
    """Whole genera packed largest first into a split of half of the organisms; genera are a bounded list."""
    from windrow.session import collect_bounded

    g = read_table(spark, sf, "wmdp_organisms", ("organism_id", "parent_genus")).where("parent_genus is not null").groupBy("parent_genus").agg(F.countDistinct("organism_id").alias("n"))
    sizes = [(r.parent_genus, r.n) for r in collect_bounded(g, 100_000)]
    chosen, _ = sampling.pack_largest_first(sizes, sum(n for _, n in sizes) // 2)
    picked = set(chosen)
    return spark.createDataFrame([(k, n, k in picked) for k, n in sizes], "parent_genus string, n long, chosen boolean")


@query("SELECT chapter_id, round(avg(length(text)), 6) AS mean, count(text) AS n_text, count(*) - count(text) AS n_null, median(length(text)) AS median FROM (SELECT DISTINCT part_id, chapter_id, text FROM spine_parts) GROUP BY chapter_id")
def a41_medians(spark: SparkSession, sf: str) -> DataFrame:
    d = read_table(spark, sf, "spine_parts", ("part_id", "chapter_id", "text")).select("part_id", "chapter_id", F.length("text").alias("n"), F.xxhash64("text").alias("h")).distinct()
    return d.groupBy("chapter_id").agg(F.round(F.avg("n"), 6).alias("mean"), F.count("n").alias("n_text"), F.count_if(F.col("n").isNull()).alias("n_null"), F.median("n").alias("median"))


@query("SELECT *, round(tokens / sum(tokens) OVER (PARTITION BY corpus_alias), 9) AS share FROM (SELECT corpus_alias, part_kind, count(*) AS n, CAST(sum(target_tokens) AS BIGINT) AS tokens FROM (SELECT DISTINCT part_id, corpus_alias, part_kind, target_tokens FROM spine_parts) GROUP BY ALL)")
def a30_corpus_shares(spark: SparkSession, sf: str) -> DataFrame:
    d = read_table(spark, sf, "spine_parts", ("part_id", "corpus_alias", "part_kind", "target_tokens")).distinct()
    g = d.groupBy("corpus_alias", "part_kind").agg(F.count(F.lit(1)).alias("n"), F.sum("target_tokens").alias("tokens"))
    return g.withColumn("share", F.round(F.col("tokens") / F.sum("tokens").over(W.partitionBy("corpus_alias")), 9))


@query("""WITH p AS (SELECT DISTINCT run_id, checkpoint_step, question_id, p_a, p_b, p_c, p_d FROM predictions WHERE p_a IS NOT NULL) SELECT run_id, checkpoint_step, count(*) FILTER (abs(p_a + p_b + p_c + p_d - 1) > 1e-5) AS n_off, count(*) AS n, round(avg(greatest(p_a, p_b, p_c, p_d)), 8) AS mean_top FROM p GROUP BY ALL""")
def c06_grid_rows(spark: SparkSession, sf: str) -> DataFrame:
    p = predictions(spark, sf).where("p_a is not null")
    return p.groupBy("run_id", "checkpoint_step").agg(F.count_if(F.abs(sum((F.col(c) for c in PS[1:]), F.col("p_a")) - 1) > 1e-5).alias("n_off"), F.count(F.lit(1)).alias("n"), F.round(F.avg(F.greatest(*PS)), 8).alias("mean_top"))


@query("SELECT event_type, time_bucket(INTERVAL 1 HOUR, ts) AS start, count(*) AS n, round(sum(value), 4) AS total FROM events WHERE ts IS NOT NULL GROUP BY ALL")
def x_events_by_hour(spark: SparkSession, sf: str) -> DataFrame:
    """An addition: events in tumbling hours."""
    d = read_table(spark, sf, "events", ("ts", "event_type", "value")).where("ts is not null")
    return d.groupBy("event_type", F.date_trunc("hour", "ts").alias("start")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total")).withColumn("start", F.col("start").cast("timestamp_ntz"))
