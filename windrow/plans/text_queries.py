"""Queries over texts: normal forms, n-grams, containment, differences, sentences, styles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from windrow.functions import text as X
from windrow.functions import values as V
from windrow.operators import aggregates, dedupe, filters, joins
from windrow.registry import query
from windrow.session import widened
from windrow.sources import read_table

STOPWORDS = ("a", "an", "and", "at", "by", "for", "from", "in", "is", "it", "of", "on", "or", "the", "to", "was", "with")

_Q = "q AS (SELECT DISTINCT question_id, subset, question, correct_text FROM wmdp_questions)"
_WORDS = "regexp_extract_all(lower({0}), '[a-z0-9]+')"


def items(spark: SparkSession, sf: str) -> DataFrame:
    return read_table(spark, sf, "wmdp_questions", ("question_id", "subset", "question", "correct_text")).distinct()


@query("SELECT doc_id, trim(regexp_replace(title, '[ \\t\\n\\r\\f\\v]+', ' ', 'g')) AS title, length(regexp_extract_all(title, '\\S+')) AS n_words, coalesce(length(text), 0) AS n_text FROM documents")
def t01_norm_ws(spark: SparkSession, sf: str) -> DataFrame:
    d = read_table(spark, sf, "documents", ("doc_id", "title", "text"))
    return d.select("doc_id", X.norm_ws(F.col("title")).alias("title"), X.ws_count(F.col("title")).cast("long").alias("n_words"), F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("n_text"))


#: SQL class of white space in Unicode, of which the pattern language there has ASCII only.
_WS = r"[ \t\n\x0b\f\r\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
_SIGNS = r"[^\p{L}\p{N}\p{M}_]+"


@query(f"""SELECT organism_id, regexp_replace(regexp_replace(regexp_replace(lower(trim(regexp_replace(name_normalized, '{_WS}', ' ', 'g'), ' ')), '^{_SIGNS}', ''), '{_SIGNS}$', ''), '[''’]s$', '') AS term FROM (SELECT DISTINCT organism_id, name_normalized FROM wmdp_organisms)""")
def t02_norm_term(spark: SparkSession, sf: str) -> DataFrame:
    d = read_table(spark, sf, "wmdp_organisms", ("organism_id", "name_normalized")).distinct()
    return d.select("organism_id", X.norm_term(F.col("name_normalized")).alias("term"))


@query()
def t03_casefold(spark: SparkSession, sf: str) -> DataFrame:
    d = read_table(spark, sf, "wmdp_organisms", ("organism_id", "name_raw")).distinct()
    return d.select("organism_id", X.casefold_nfkc(F.col("name_raw")).alias("folded"))


@query(f"WITH {_Q} SELECT question_id, array_to_string({_WORDS.format('question')}, ' ') AS alnum, len({_WORDS.format('question')}) AS n_words FROM q")
def t05_alnum(spark: SparkSession, sf: str) -> DataFrame:
    return items(spark, sf).select("question_id", X.alnum(F.col("question")).alias("alnum"), F.size(X.words(F.col("question"))).cast("long").alias("n_words"))


@query(f"""WITH {_Q}, w AS (SELECT question_id, {_WORDS.format('question')} AS w FROM q), g AS (SELECT question_id, unnest(list_transform(range(1, len(w) - 6), lambda i: array_to_string(w[i:i+7], ' '))) AS g FROM w WHERE len(w) >= 8)
  SELECT question_id, count(*) AS n_grams, count(DISTINCT g) AS n_distinct FROM g GROUP BY question_id""")
def t10_ngrams(spark: SparkSession, sf: str) -> DataFrame:
    g = items(spark, sf).select("question_id", X.words(F.col("question")).alias("w")).select("question_id", F.explode(X.ngrams(F.col("w"), 8)).alias("g"))
    return g.groupBy("question_id").agg(F.count("g").alias("n_grams"), F.countDistinct("g").alias("n_distinct"))


@query(f"""WITH {_Q}, w AS (SELECT question_id, {_WORDS.format('question')} AS w FROM q), g AS (SELECT question_id, len(w) AS n, unnest(range(1, len(w) - 6)) AS i, unnest(list_transform(range(1, len(w) - 6), lambda i: array_to_string(w[i:i+7], ' '))) AS g FROM w WHERE len(w) >= 8),
  a AS (SELECT {_WORDS.format('abstract')} AS w FROM documents WHERE abstract IS NOT NULL), c AS (SELECT DISTINCT unnest(list_transform(range(1, len(w) - 6), lambda i: array_to_string(w[i:i+7], ' '))) AS g FROM a WHERE len(w) >= 8),
  h AS (SELECT question_id, n, i FROM g SEMI JOIN c USING (g)), p AS (SELECT DISTINCT question_id, n, unnest(range(i, i + 8)) AS pos FROM h)
  SELECT question_id, count(*) AS n_covered, round(count(*) / max(n), 9) AS coverage FROM p GROUP BY question_id""")
def t11_overlap_coverage(spark: SparkSession, sf: str) -> DataFrame:
    """Share of an item's words that lie in an 8-gram which the abstracts hold."""
    w = items(spark, sf).select("question_id", X.words(F.col("question")).alias("w"))
    g = w.select("question_id", F.size("w").alias("n"), F.posexplode(X.ngrams(F.col("w"), 8)).alias("i", "g"))
    corpus = widened(read_table(spark, sf, "documents", ("abstract",))).select(X.words(F.col("abstract")).alias("w")).select(F.explode(F.array_distinct(X.ngrams(F.col("w"), 8))).alias("g"))
    wanted = g.select("g").distinct()
    there = corpus.join(F.broadcast(wanted), "g", "left_semi").distinct()  # items are a bounded set, so their grams are
    covered = g.join(F.broadcast(there), "g", "left_semi").select("question_id", "n", F.explode(F.sequence("i", F.col("i") + 7)).alias("pos")).distinct()
    return covered.groupBy("question_id").agg(F.count(F.lit(1)).alias("n_covered"), F.round(F.count(F.lit(1)) / F.max("n"), 9).alias("coverage"))


@query(f"""WITH {_Q}, o AS (SELECT DISTINCT organism_id, ' ' || array_to_string({_WORDS.format('name_normalized')}, ' ') || ' ' AS n FROM wmdp_organisms WHERE name_normalized IS NOT NULL), t AS (SELECT question_id, ' ' || array_to_string({_WORDS.format('question')}, ' ') || ' ' AS t FROM q)
  SELECT organism_id, count(DISTINCT question_id) AS n_items FROM o JOIN t ON contains(t, n) WHERE n <> '  ' GROUP BY organism_id""")
def j19_padded_phrase(spark: SparkSession, sf: str) -> DataFrame:
    """Items that hold a name as whole words, through n-grams of the names' widths."""
    names = read_table(spark, sf, "wmdp_organisms", ("organism_id", "name_normalized")).distinct()
    hits = joins.phrase_hits(items(spark, sf), "question_id", "question", names, "organism_id", "name_normalized")
    return hits.groupBy("organism_id").agg(F.countDistinct("question_id").alias("n_items"))


@query(f"""WITH w AS (SELECT doc_id, {_WORDS.format('title')} AS w FROM documents WHERE title IS NOT NULL), g AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, len(w)), lambda i: array_to_string(w[i:i+1], ' '))) AS g FROM w WHERE len(w) > 1),
  n AS (SELECT taxon_id, array_to_string({_WORDS.format('name_txt')}, ' ') AS g FROM gazetteer_names WHERE taxon_rank = 'species') SELECT doc_id, taxon_id FROM g JOIN n USING (g) GROUP BY ALL""")
def j18_phrase_join(spark: SparkSession, sf: str) -> DataFrame:
    names = read_table(spark, sf, "gazetteer_names", ("taxon_id", "name_txt", "taxon_rank")).where("taxon_rank = 'species'")
    return joins.phrase_hits(read_table(spark, sf, "documents", ("doc_id", "title")), "doc_id", "title", names, "taxon_id", "name_txt")


@query("SELECT doc_id FROM documents WHERE regexp_matches(lower(abstract), '(^|[^a-z0-9_])leaf\\s+margin([^a-z0-9_]|$)')")
def t14_bounded_phrase(spark: SparkSession, sf: str) -> DataFrame:
    return read_table(spark, sf, "documents", ("doc_id", "abstract")).where(X.phrase_present(F.col("abstract"), "leaf margin")).select("doc_id")


@query(f"""WITH w AS (SELECT doc_id, {_WORDS.format('abstract')} AS w FROM documents WHERE abstract IS NOT NULL), t AS (SELECT doc_id, i FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM w) WHERE w[i] IN ('light', 'shade')),
  c AS (SELECT doc_id, i FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM w) WHERE w[i] IN ('low', 'dense')) SELECT DISTINCT t.doc_id FROM t JOIN c ON t.doc_id = c.doc_id AND abs(t.i - c.i) <= 8""")
def t13_context_window(spark: SparkSession, sf: str) -> DataFrame:
    d = read_table(spark, sf, "documents", ("doc_id", "abstract"))
    return d.where(X.within_window(X.words(F.col("abstract")), ["light", "shade"], ["low", "dense"])).select("doc_id")


@query(f"""SELECT organism_id, list_sort(list_distinct([b, replace(b, '-', ' '), replace(b, ' ', '-'), b || 's', b || chr(39) || 's'])) AS forms FROM (SELECT DISTINCT organism_id, trim(regexp_replace(lower(name_normalized), '{_WS}', ' ', 'g'), ' ') AS b FROM wmdp_organisms WHERE name_normalized IS NOT NULL)""")
def t16_variants(spark: SparkSession, sf: str) -> DataFrame:
    d = read_table(spark, sf, "wmdp_organisms", ("organism_id", "name_normalized")).distinct().where("name_normalized is not null")
    return d.select("organism_id", X.variants(F.col("name_normalized")).alias("forms"))


@query("""SELECT organism_id, CASE WHEN regexp_matches(n, '^[A-Z][a-z]+ [a-z]+ .*\\b(strain|str\\.|subsp\\.|var\\.|isolate)\\b') THEN 'strain' WHEN regexp_matches(n, '^[A-Z][a-z]+ [a-z-]+$') THEN 'species' WHEN regexp_matches(n, '^[A-Z][a-z]+( spp?\\.)?$') THEN 'genus' WHEN n IS NOT NULL THEN 'informal' END AS rank
  FROM (SELECT DISTINCT organism_id, name_raw AS n FROM wmdp_organisms)""")
def t28_rank_of_name(spark: SparkSession, sf: str) -> DataFrame:
    return read_table(spark, sf, "wmdp_organisms", ("organism_id", "name_raw")).distinct().select("organism_id", X.rank_of_name(F.col("name_raw")).alias("rank"))


@query("SELECT count(*) FILTER (regexp_matches(text, '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f]')) AS n_control, count(*) FILTER (text IS NULL) AS n_null, count(*) FILTER (trim(text, ' ') = '') AS n_blank FROM documents")
def t31_anomalies(spark: SparkSession, sf: str) -> DataFrame:
    d = read_table(spark, sf, "documents", ("text",))
    return d.agg(F.count_if(X.has_control(F.col("text"))).alias("n_control"), F.count_if(F.col("text").isNull()).alias("n_null"), F.count_if(F.trim("text") == "").alias("n_blank"))


@query("""WITH p AS (SELECT doc_id, trim(unnest(regexp_split_to_array(text, '\\n\\s*\\n')), ' ') AS p FROM documents WHERE text IS NOT NULL), m AS (SELECT doc_id, regexp_replace(p, '[0-9]+(\\.[0-9]+)?', '#', 'g') AS t, count(*) AS c FROM p WHERE p <> '' AND len(regexp_extract_all(p, '\\S+')) >= 20 GROUP BY ALL)
  SELECT doc_id, count(*) AS n_repeated FROM m WHERE c > 1 GROUP BY doc_id""")
def d10_repeated_paragraphs(spark: SparkSession, sf: str) -> DataFrame:
    """Documents with paragraphs of 20 words or more that repeat but for numbers."""
    p = read_table(spark, sf, "documents", ("doc_id", "text")).select("doc_id", F.explode(X.paragraphs(F.col("text"))).alias("p")).where(X.ws_count(F.col("p")) >= 20)
    m = p.groupBy("doc_id", X.mask_values(F.col("p")).alias("t")).agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    return m.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_repeated"))


@query("""SELECT part_id, list_filter([CASE WHEN regexp_matches(text, '\\b(ORG|CH|CP|E)-?[0-9]{2,}\\b') THEN 'identifier' END, CASE WHEN regexp_matches(text, '(^|\\n)#{1,6}\\s') THEN 'heading' END,
  CASE WHEN regexp_matches(lower(text), '\\b(as an ai|in conclusion|in summary)\\b') THEN 'boilerplate' END], lambda x: x IS NOT NULL) AS failures FROM (SELECT DISTINCT part_id, text FROM spine_parts WHERE text IS NOT NULL)""")
def t34_style(spark: SparkSession, sf: str) -> DataFrame:
    d = read_table(spark, sf, "spine_parts", ("part_id", "text")).where("text is not null")
    return d.select("part_id", X.style_failures(F.col("text")).alias("failures"), F.xxhash64("text").alias("h")).distinct().drop("h")


@query()
def t22_diff(spark: SparkSession, sf: str) -> DataFrame:
    """Replaced token runs between each question and its correct text."""
    return X.diff_pairs(items(spark, sf), "question_id", "question", "correct_text")


@query()
def a06_modal_mapping(spark: SparkSession, sf: str) -> DataFrame:
    """Term mapping of typed names to normal names: occurrences, modal target and whether it is one to one."""
    d = read_table(spark, sf, "wmdp_organisms", ("organism_id", "name_raw", "name_normalized")).distinct().where("name_raw is not null and name_normalized is not null")
    t = d.select("organism_id", X.norm_term(F.col("name_raw")).alias("source"), X.norm_term(F.col("name_normalized")).alias("target"))
    return aggregates.modal_mapping(t, "source", "target", "organism_id")


@query("""WITH t AS (SELECT chapter_id AS source, doc_type AS target, doc_id FROM documents WHERE chapter_id IS NOT NULL AND doc_type IS NOT NULL), c AS (SELECT source, target, count(*) AS c FROM t GROUP BY ALL),
  m AS (SELECT source, CAST(sum(c) AS BIGINT) AS n, count(*) AS n_targets, arg_min(target, (-c, target)) AS modal_target, max(c) AS modal_count FROM c GROUP BY source), r AS (SELECT *, count(*) FILTER (n >= 3) OVER (PARTITION BY modal_target) AS rivals FROM m),
  d AS (SELECT source, count(DISTINCT doc_id) AS n_docs FROM t GROUP BY source)
  SELECT source, n, n_targets, modal_target, modal_count, n_docs, round(modal_count / n, 9) AS modal_share, n >= 3 AND modal_count / n >= 0.9 AND rivals = 1 AS clean_1to1 FROM r JOIN d USING (source)""")
def a05_modal_share(spark: SparkSession, sf: str) -> DataFrame:
    d = read_table(spark, sf, "documents", ("doc_id", "chapter_id", "doc_type")).where("chapter_id is not null and doc_type is not null")
    return aggregates.modal_mapping(d.withColumnsRenamed({"chapter_id": "source", "doc_type": "target"}), "source", "target", "doc_id").withColumn("modal_share", F.round("modal_share", 9))


@query("""WITH c AS (SELECT chapter_id AS source, doc_type AS target, count(*) AS c FROM documents WHERE chapter_id IS NOT NULL AND doc_type IS NOT NULL GROUP BY ALL), m AS (SELECT source, sum(c) AS n, arg_min(target, (-c, target)) AS t, max(c) / sum(c) AS s FROM c GROUP BY source),
  e AS (SELECT o AS min_n, m.*, count(*) OVER (PARTITION BY o, t) AS k FROM m CROSS JOIN (SELECT unnest([2, 3, 5, 10]) AS o) WHERE n >= o)
  SELECT min_n, h AS min_share, count(*) FILTER (s >= h AND k = 1) AS n_clean FROM e CROSS JOIN (SELECT unnest([0.2::DOUBLE, 0.3::DOUBLE, 0.5::DOUBLE]) AS h) GROUP BY ALL""")
def a07_threshold_yield(spark: SparkSession, sf: str) -> DataFrame:
    return aggregates.threshold_yield(a05_modal_share(spark, sf), [2, 3, 5, 10], [0.2, 0.3, 0.5])


@query("""SELECT source, count(length(text)) AS n, round(avg(length(text)), 6) AS mean, quantile_cont(length(text), 0.5) AS median, quantile_cont(length(text), 0.05) AS p5, quantile_cont(length(text), 0.95) AS p95, min(length(text)) AS low, max(length(text)) AS high,
  count(*) FILTER (length(text) > 1000) AS n_over_0, round(coalesce(avg(CAST(length(text) > 1000 AS INT)), 0), 9) AS share_over_0 FROM documents GROUP BY source""")
def a12_distribution(spark: SparkSession, sf: str) -> DataFrame:
    d = read_table(spark, sf, "documents", ("source", "text")).select("source", F.length("text").cast("long").alias("n_text"))
    return aggregates.distribution(d, ["source"], "n_text", [1000]).withColumn("mean", F.round("mean", 6)).withColumn("share_over_0", F.round("share_over_0", 9))


@query("""WITH k AS (SELECT part_id, count(*) AS c, count(*) FILTER (text IS NULL) AS n, count(*) FILTER (trim(text, ' ') = '') AS b FROM spine_parts GROUP BY part_id)
  SELECT CAST(sum(c) AS BIGINT) AS n_rows, count(*) AS n_keys, count(*) FILTER (c > 1) AS n_repeated, CAST(sum(c - 1) AS BIGINT) AS surplus, CAST(sum(n) AS BIGINT) AS text_null, CAST(sum(b) AS BIGINT) AS text_blank FROM k""")
def a16_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    return aggregates.duplicate_inventory(read_table(spark, sf, "spine_parts", ("part_id", "text")), ["part_id"], ["text"])


@query(f"""SELECT min(doc_id) AS doc_id, count(*) AS n FROM (SELECT doc_id, sha256(trim(regexp_replace(abstract, '{_WS}', ' ', 'g'), ' ')) AS h FROM documents WHERE abstract IS NOT NULL) GROUP BY h""")
def d01_keep_first(spark: SparkSession, sf: str) -> DataFrame:
    """The first document of each abstract, by digest of its normal form, and how many share it."""
    d = read_table(spark, sf, "documents", ("doc_id", "abstract")).where("abstract is not null")
    keyed = d.select("doc_id", V.digest(X.norm_ws(F.col("abstract"))).alias("h"))  # texts aren't shuffled, only digests
    first = dedupe.keep_first(keyed, F.col("h"), "doc_id")
    return keyed.groupBy("h").agg(F.count(F.lit(1)).alias("n")).join(first, "h").select("doc_id", "n")


#: The ordered rules of sound parts: the first that holds removes a part.
def _part_rules() -> list:
    t = F.col("text")
    return [("no text", t.isNull() | (F.trim(t) == "")), ("too short", X.ws_count(t) < 20), ("too long", X.ws_count(t) > 300), ("table", t.contains("|---")), ("heading", t.rlike(r"(?m)^#"))]


_RULES = "CASE WHEN text IS NULL OR trim(text, ' ') = '' THEN 'no text' WHEN len(regexp_extract_all(text, '\\S+')) < 20 THEN 'too short' WHEN len(regexp_extract_all(text, '\\S+')) > 300 THEN 'too long' WHEN contains(text, '|---') THEN 'table' WHEN regexp_matches(text, '(^|\\n)#') THEN 'heading' END"


@query(f"SELECT part_id, CASE r WHEN 'no text' THEN 0 WHEN 'too short' THEN 1 WHEN 'too long' THEN 2 WHEN 'table' THEN 3 WHEN 'heading' THEN 4 END AS stage, r AS reason FROM (SELECT DISTINCT part_id, {_RULES} AS r FROM spine_parts)")
def f02_cascade(spark: SparkSession, sf: str) -> DataFrame:
    d = read_table(spark, sf, "spine_parts", ("part_id", "text"))
    return filters.cascade(d, _part_rules()).select("part_id", "stage", "reason").distinct()


@query(f"SELECT coalesce({_RULES}, 'accepted') AS reason, count(*) AS n FROM (SELECT DISTINCT part_id, text FROM spine_parts) GROUP BY ALL")
def f03_funnel(spark: SparkSession, sf: str) -> DataFrame:
    d = filters.cascade(read_table(spark, sf, "spine_parts", ("part_id", "text")), _part_rules())
    rows = d.select("part_id", F.coalesce("reason", F.lit("accepted")).alias("reason"), F.xxhash64("text").alias("h")).distinct()
    return rows.groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT CASE WHEN n_mentions < 1 THEN NULL WHEN n_mentions <= 2 THEN CAST(n_mentions AS VARCHAR) WHEN n_mentions <= 5 THEN '3-5' WHEN n_mentions <= 10 THEN '6-10' WHEN n_mentions <= 25 THEN '11-25' WHEN n_mentions > 25 THEN '26+' END AS bin, count(*) AS n FROM (SELECT DISTINCT organism_id, n_mentions FROM wmdp_organisms) GROUP BY ALL""")
def f13_histogram(spark: SparkSession, sf: str) -> DataFrame:
    d = read_table(spark, sf, "wmdp_organisms", ("organism_id", "n_mentions")).distinct()
    return d.groupBy(V.histogram_bin(F.col("n_mentions")).alias("bin")).agg(F.count(F.lit(1)).alias("n"))


@query()
def t20_sentences(spark: SparkSession, sf: str) -> DataFrame:
    d = read_table(spark, sf, "documents", ("doc_id", "abstract"))
    s = d.select("doc_id", F.explode(X.sentences(F.col("abstract"))).alias("s")).select("doc_id", "s.*")
    reject = filters.first_match([("under_6_words", X.ws_count(F.col("sentence")) < 6), ("over_60_words", X.ws_count(F.col("sentence")) > 60), ("reference", F.col("sentence").rlike(r"(?i)\b(?:table|figure|fig\.)\s*\d")), ("heading", F.col("sentence").rlike(r"^\W*\w+(?: \w+){0,3}$"))])
    return s.withColumn("reject", reject).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_sentences"), F.count_if(F.col("reject").isNotNull()).alias("n_rejected"), F.min("start").alias("first"), F.max("end").alias("last"))


@query()
def j27_nearest_string(spark: SparkSession, sf: str) -> DataFrame:
    """Of each unsettled species name of known genus the list's most similar name of that genus."""
    d = read_table(spark, sf, "wmdp_organisms", ("organism_id", "name_normalized", "parent_genus", "gazetteer_match")).distinct().where("name_normalized is not null and parent_genus is not null and coalesce(gazetteer_match, '') <> 'true'")
    names = read_table(spark, sf, "gazetteer_names", ("name_txt", "parent_genus")).select("parent_genus", F.lower("name_txt").alias("name"))
    return joins.nearest_string(d, "organism_id", "name_normalized", names, "parent_genus", "name")


@query("""SELECT call_id, attempt_index, json_valid(raw_response) AND starts_with(ltrim(raw_response), '{') AS whole FROM raw_llm_log WHERE raw_response IS NOT NULL AND starts_with(raw_response, '{') GROUP BY ALL""")
def z19_parse_json(spark: SparkSession, sf: str) -> DataFrame:
    """Responses that begin as an object, and whether they are one as a whole."""
    d = read_table(spark, sf, "raw_llm_log", ("call_id", "attempt_index", "raw_response")).where(F.col("raw_response").startswith("{"))
    whole = F.try_parse_json("raw_response").isNotNull()  # no Python: a text that begins as an object and is JSON is one object
    return d.select("call_id", "attempt_index", whole.alias("whole")).distinct()
