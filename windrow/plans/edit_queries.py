"""Queries on differences of text pairs and on variants of names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from windrow.functions import edits
from windrow.functions import text as X
from windrow.registry import query
from windrow.sources import read_table


def _pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Each item's first choice against its right answer."""
    return read_table(spark, sf, "wmdp_questions", ("question_id", "question", "choice_a", "correct_text")).distinct()


@query()
def t23_minimal_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """T-23 and C-02's pair rule: items whose first choice differs from the right answer in one run of tokens."""
    return edits.minimal_pairs(_pairs(spark, sf), "question_id", "choice_a", "correct_text")


@query()
def t24_aligned_sentences(spark: SparkSession, sf: str) -> DataFrame:
    """T-21 and T-24: the first sentence of an abstract that the text has otherwise, and what the text has for it."""
    return edits.aligned_sentences(read_table(spark, sf, "documents", ("doc_id", "title", "abstract")).where("title is not null"), "doc_id", "abstract", "title")


@query()
def t25_word_diffs(spark: SparkSession, sf: str) -> DataFrame:
    return edits.rendered_diffs(_pairs(spark, sf), "question_id", "choice_a", "correct_text")


@query("""WITH q AS (SELECT DISTINCT question_id, question, choice_a, correct_text FROM wmdp_questions), f AS (SELECT question_id, array_to_string(regexp_extract_all(lower(correct_text), '[a-z0-9]+'), ' ') AS t, array_to_string(regexp_extract_all(lower(question), '[a-z0-9]+'), ' ') AS x FROM q)
  SELECT question_id, t <> '' AND contains(' ' || x || ' ', ' ' || t || ' ') AS leaks FROM f""")
def t15_residual_leakage(spark: SparkSession, sf: str) -> DataFrame:
    """T-15: whether the answer still stands in the question."""
    return _pairs(spark, sf).select("question_id", edits.still_there(F.col("correct_text"), F.col("question")).alias("leaks"))


@query("""WITH s AS (SELECT DISTINCT organism_id, name_raw, regexp_extract(name_raw, '^([A-Z])\\.\\s*([a-z]+)$', 1) AS i, regexp_extract(name_raw, '^([A-Z])\\.\\s*([a-z]+)$', 2) AS e FROM wmdp_organisms WHERE name_raw IS NOT NULL), g AS (SELECT DISTINCT name_txt AS f, left(name_txt, 1) AS i, split_part(name_txt, ' ', -1) AS e FROM gazetteer_names WHERE contains(name_txt, ' '))
  SELECT organism_id, name_raw, CASE WHEN count(f) = 1 THEN min(f) END AS expanded, count(f) AS n_options FROM s LEFT JOIN g USING (i, e) WHERE s.i <> '' GROUP BY ALL""")
def t29_expanded(spark: SparkSession, sf: str) -> DataFrame:
    """T-29: abbreviated names with the one full name of the list that they may stand for."""
    d = read_table(spark, sf, "wmdp_organisms", ("organism_id", "name_raw")).where("name_raw is not null").distinct()
    return edits.expanded(d, "organism_id", "name_raw", read_table(spark, sf, "gazetteer_names", ("name_txt",)), "name_txt")


@query(r"""WITH d AS (SELECT DISTINCT organism_id AS k, trim(regexp_replace(name_raw, '[\s\p{Z}]+', ' ', 'g'), ' ') AS n FROM wmdp_organisms WHERE name_raw IS NOT NULL), m AS (SELECT k, trim(regexp_replace(regexp_replace(regexp_replace(lower(n), '^[^\p{L}\p{M}\p{N}_]+', ''), '[^\p{L}\p{M}\p{N}_]+$', ''), '''s$', ''), ' ') AS m FROM d),
  b AS (SELECT k, left(n, 1) AS i, split_part(n, ' ', 2) AS e FROM d WHERE regexp_full_match(n, '[A-Z][a-z]+ [a-z-]+')), s AS (SELECT k AS s, regexp_extract(n, '^([A-Z])\.\s*([a-z]+)$', 1) AS i, regexp_extract(n, '^([A-Z])\.\s*([a-z]+)$', 2) AS e FROM d WHERE regexp_full_match(n, '[A-Z]\.\s*[a-z]+')), o AS (SELECT s, min(k) AS k FROM s JOIN b USING (i, e) GROUP BY s HAVING count(*) = 1),
  p AS (SELECT x.k AS a, y.k AS b, 'normalization' AS rule FROM m x JOIN m y ON x.m = y.m AND x.k < y.k UNION SELECT least(s, k), greatest(s, k), 'abbreviation' FROM o WHERE s <> k UNION SELECT least(c.k, b.k), greatest(c.k, b.k), 'epithet_containment' FROM b JOIN d c ON lower(c.n) = b.e AND regexp_full_match(c.n, '[A-Za-z][A-Za-z-]+') WHERE c.k <> b.k)
  SELECT a, b, list_sort(list(DISTINCT rule)) AS rules FROM p GROUP BY ALL""")
def t30_merge_candidates(spark: SparkSession, sf: str) -> DataFrame:
    """T-30 over all names as they were typed."""
    return edits.merge_candidates(read_table(spark, sf, "wmdp_organisms", ("organism_id", "name_raw")), "organism_id", "name_raw")


@query()
def t22_edit_terms(spark: SparkSession, sf: str) -> DataFrame:
    """T-22 and F-08: replaced terms of each item's first choice, with the reason if a replacement is trivial."""
    from windrow.plans.text_queries import STOPWORDS

    subs = X.diff_pairs(_pairs(spark, sf), "question_id", "choice_a", "correct_text").select("question_id", "ordinal", X.norm_term(F.col("left_raw")).alias("source"), X.norm_term(F.col("right_raw")).alias("target"))
    return subs.withColumn("reason", X.trivial_reason(F.col("source"), F.col("target"), STOPWORDS))
