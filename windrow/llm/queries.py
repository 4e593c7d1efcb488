"""Queries of the operators on texts, over whole tables with production parameters.

None has SQL beside it: n-gram models, tokenizers, tiling and name matching are beyond SQL. They are tested against brute
force, exact round trips and held-out cases in tests/llm.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from windrow.llm import encoding, leakage, linking, mixing, pairs, residue, splitting, truncation
from windrow.session import written
from windrow.sources import read_table

LOG = ("call_id", "attempt_index", "prompt_text", "raw_response", "model_version")
#: The source of a part, as it is reported.
def part_source() -> Column:
    return F.concat_ws("/", F.coalesce("corpus_alias", F.lit("?")), F.coalesce("policy_revision", F.lit("?")))



def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return pairs.find_defects(read_table(spark, sf, "raw_llm_log", LOG)).select("call_id", "attempt_index", "defect")


def p1_by_model(spark: SparkSession, sf: str) -> DataFrame:
    """Defects of each model: model_version, defect, n."""
    found = pairs.find_defects(read_table(spark, sf, "raw_llm_log", LOG))
    return found.groupBy(F.col("source").alias("model_version"), "defect").agg(F.count(F.lit(1)).alias("n"))


def _leaks(spark: SparkSession, sf: str) -> DataFrame:
    items = read_table(spark, sf, "wmdp_questions", ("question_id", "question", "correct_text"))
    return _both(spark, sf, "abstract", lambda df: leakage.find_item_leaks(df, ["src_table", "rec_key"], "text", items, "question_id", ["question", "correct_text"]))


def _both(spark: SparkSession, sf: str, document_text: str, f: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``f`` of the two corpus tables as src_table, rec_key, text."""
    docs = read_table(spark, sf, "documents", ("doc_id", document_text)).select(F.lit("documents").alias("src_table"), F.col("doc_id").cast("string").alias("rec_key"), F.col(document_text).alias("text"))
    parts = read_table(spark, sf, "spine_parts", ("part_id", "text")).select(F.lit("spine_parts").alias("src_table"), F.col("part_id").alias("rec_key"), "text")
    return f(docs.unionByName(parts))


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return _leaks(spark, sf).select("src_table", "rec_key", "question_id")


def p2_items(spark: SparkSession, sf: str) -> DataFrame:
    """Which test items leaked, and into how many records of each table."""
    found = _leaks(spark, sf)
    return found.groupBy("question_id").agg(F.count_if(F.col("src_table") == "documents").alias("n_documents"), F.count_if(F.col("src_table") == "spine_parts").alias("n_parts"))


def _residue_model(spark: SparkSession, sf: str) -> residue.ResidueModel:
    return _both(spark, sf, "text", lambda df: residue.fit(df, "rec_key", "text"))


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    model = _residue_model(spark, sf)
    return _both(spark, sf, "text", lambda df: residue.find_residue(df, model, ["src_table", "rec_key"], "text")).select("src_table", "rec_key").distinct()


def p3_coverage(spark: SparkSession, sf: str) -> DataFrame:
    """Kinds of residue and the share of the text they cover, for each record with residue."""
    model = _residue_model(spark, sf)
    found = _both(spark, sf, "text", lambda df: residue.find_residue(df, model, ["src_table", "rec_key"], "text"))
    return found.groupBy("src_table", "rec_key").agg(F.max("kinds").alias("kinds"), F.max("n_spans").alias("n_spans"), F.round(F.max("coverage"), 6).alias("coverage"))


def _truncated(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Cut pairs and cut parts, each with key and source."""
    log = read_table(spark, sf, "raw_llm_log", LOG)
    parts = read_table(spark, sf, "spine_parts", ("part_id", "corpus_alias", "policy_revision", "text"))
    model = truncation.fit_ends(log.select(F.col("call_id").alias("k"), F.col("raw_response").alias("t")).unionByName(parts.select(F.col("part_id").alias("k"), F.col("text").alias("t"))), "k", "t", 2 * truncation.FIT_ROWS)
    cut_log = pairs.find_defects(log, model, only_truncated=True)
    # what residue explains is no cut; only the few cut parts are looked at
    cut_parts = written(truncation.find_truncated(parts, ["part_id"], "text", part_source(), model), "cut")
    plain = residue.fit(parts, "part_id", "text")
    spoilt = residue.find_residue(cut_parts, plain, ["part_id"], "text").select("part_id").distinct()
    return cut_log, cut_parts.join(spoilt, "part_id", "left_anti").groupBy("part_id").agg(F.min("source").alias("source"))


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    log, parts = _truncated(spark, sf)
    a = log.select(F.lit("raw_llm_log").alias("src_table"), F.col("call_id").alias("rec_key"), F.col("attempt_index").cast("int"))
    return a.unionByName(parts.select(F.lit("spine_parts").alias("src_table"), F.col("part_id").alias("rec_key"), F.lit(-1).alias("attempt_index")))


def p4_shares(spark: SparkSession, sf: str) -> DataFrame:
    """How often each source truncates: src_table, source, n, n_cut, share_cut."""
    cut_log, cut_parts = _truncated(spark, sf)
    log = read_table(spark, sf, "raw_llm_log", ("call_id", "attempt_index", "model_version")).withColumnRenamed("model_version", "source")
    parts = read_table(spark, sf, "spine_parts", ("part_id", "corpus_alias", "policy_revision")).select("part_id", part_source().alias("source"))
    a = truncation.shares_cut(log, cut_log, ["call_id", "attempt_index"]).select(F.lit("raw_llm_log").alias("src_table"), "*")
    return a.unionByName(truncation.shares_cut(parts, cut_parts, ["part_id"]).select(F.lit("spine_parts").alias("src_table"), "*"))


def _links(spark: SparkSession, sf: str) -> DataFrame:
    names = read_table(spark, sf, "wmdp_organisms", ("organism_id", "name_raw", "name_normalized", "parent_genus", "gazetteer_match"))
    entries = read_table(spark, sf, "gazetteer_names", ("taxon_id", "name_txt", "parent_genus", "synonyms"))
    open_ = names.where(F.col("gazetteer_match").isNull() | (F.col("gazetteer_match") != "true"))
    return linking.link_to_list(open_, entries, "organism_id", ["name_raw", "name_normalized"], "parent_genus")


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return _links(spark, sf).select("organism_id", "taxon_id")


def p5_unmatched(spark: SparkSession, sf: str) -> DataFrame:
    """The typed values without an entry and how many organisms have them."""
    lost = _links(spark, sf).where("taxon_id = 0")
    names = read_table(spark, sf, "wmdp_organisms", ("organism_id", "name_raw", "name_normalized")).groupBy("organism_id").agg(F.min(F.coalesce("name_raw", "name_normalized")).alias("value"))
    return lost.join(names, "organism_id").groupBy("value").agg(F.count(F.lit(1)).alias("n_organisms"))


def p7_ids(spark: SparkSession, sf: str) -> DataFrame:
    return encoding.encode_texts(read_table(spark, sf, "documents", ("doc_id", "text")), "doc_id", "text")


def p7_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Documents and tokens of each source."""
    counted = encoding.count_tokens(read_table(spark, sf, "documents", ("source", "text")), "text")
    return counted.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))


def _mixture(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.mix(read_table(spark, sf, "documents", ("doc_id", "source", "text")), read_table(spark, sf, "mix_targets"))


def p8_mix(spark: SparkSession, sf: str) -> DataFrame:
    """The chosen copies in the mixture's order."""
    return mixing.in_order(_mixture(spark, sf))


def p8_shares(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.shares(_mixture(spark, sf), read_table(spark, sf, "mix_targets"))


def p9_pieces(spark: SparkSession, sf: str) -> DataFrame:
    """The pieces of every document over the limit."""
    return splitting.split_texts(read_table(spark, sf, "documents", ("doc_id", "text"))).where("n_pieces > 1")


def p9_boundaries(spark: SparkSession, sf: str) -> DataFrame:
    """At what boundaries the pieces end, and their sizes."""
    return splitting.split_texts(read_table(spark, sf, "documents", ("doc_id", "text"))).groupBy("boundary").agg(F.count(F.lit(1)).alias("n_pieces"), F.max("n_tokens").alias("most_tokens"), F.max("overlap_tokens").alias("most_overlap"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (p1_found, p1_by_model, p2_found, p2_items, p3_found, p3_coverage, p4_found, p4_shares, p5_found, p5_unmatched, p7_ids, p7_counts, p8_mix, p8_shares, p9_pieces, p9_boundaries)
}
SQL: dict[str, str] = {}
