"""Queries over the log of calls: attempts, outcomes, reconciliation, windows of time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from windrow.functions import text as X
from windrow.operators import filters, gates, windows
from windrow.registry import query
from windrow.sources import read_table
from windrow.streaming import ledgers

LOG = ("call_id", "attempt_index", "prompt_hash", "prompt_text", "raw_response", "model_version", "timestamp_utc")
_LOG = "g AS (SELECT DISTINCT call_id, attempt_index, prompt_hash, prompt_text, raw_response, model_version, timestamp_utc FROM raw_llm_log)"


def log(spark: SparkSession, sf: str) -> DataFrame:
    return read_table(spark, sf, "raw_llm_log", LOG).distinct()


@query(f"""WITH {_LOG} SELECT call_id, count(DISTINCT attempt_index) AS n_attempts, max(attempt_index) AS last_attempt, coalesce(bool_or(raw_response IS NOT NULL AND length(raw_response) > 20), false) AS succeeded,
  NOT coalesce(bool_or(raw_response IS NOT NULL AND length(raw_response) > 20), false) AND count(DISTINCT attempt_index) < 2 AS may_retry FROM g GROUP BY call_id""")
def x02_attempts(spark: SparkSession, sf: str) -> DataFrame:
    d = log(spark, sf).withColumn("ok", F.col("raw_response").isNotNull() & (F.length("raw_response") > 20))
    return ledgers.attempts(d, "call_id", "attempt_index", "ok")


@query(f"WITH {_LOG} SELECT call_id, attempt_index, timestamp_utc FROM g QUALIFY row_number() OVER (PARTITION BY call_id ORDER BY attempt_index DESC, timestamp_utc NULLS FIRST) = 1")
def x03_latest(spark: SparkSession, sf: str) -> DataFrame:
    return ledgers.latest(log(spark, sf), "call_id", "attempt_index", ["timestamp_utc"])


@query(f"WITH {_LOG}, c AS (SELECT sha256(prompt_hash || chr(31) || model_version) AS cache_key, count(*) AS n, count(DISTINCT call_id) AS n_calls FROM g WHERE prompt_hash IS NOT NULL AND model_version IS NOT NULL GROUP BY ALL) SELECT cache_key, n, n_calls FROM c WHERE n_calls > 1")
def x04_cache_hits(spark: SparkSession, sf: str) -> DataFrame:
    """Cache keys that several calls share."""
    d = log(spark, sf).where("prompt_hash is not null and model_version is not null")
    return d.groupBy(ledgers.cache_key("prompt_hash", "model_version").alias("cache_key")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("call_id").alias("n_calls")).where("n_calls > 1")


@query("SELECT call_id, attempt_index FROM (SELECT call_id, attempt_index, count(*) AS c FROM (SELECT DISTINCT call_id, attempt_index, raw_response FROM raw_llm_log) GROUP BY ALL) WHERE c > 1")
def x01_immutable_keys(spark: SparkSession, sf: str) -> DataFrame:
    """Keys that the log has with different responses."""
    d = read_table(spark, sf, "raw_llm_log", ("call_id", "attempt_index", "raw_response")).distinct()
    return d.groupBy("call_id", "attempt_index").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("call_id", "attempt_index")


@query("""WITH a AS (SELECT call_id, attempt_index, count(*) AS n_ledger FROM raw_llm_log GROUP BY ALL), b AS (SELECT call_id, attempt_index, count(*) AS n_raw FROM (SELECT DISTINCT * FROM raw_llm_log) WHERE raw_response IS NOT NULL GROUP BY ALL)
  SELECT coalesce(a.call_id, b.call_id) AS call_id, coalesce(a.attempt_index, b.attempt_index) AS attempt_index, coalesce(n_ledger, 0) AS n_ledger, coalesce(n_raw, 0) AS n_raw FROM a FULL JOIN b ON a.call_id = b.call_id AND a.attempt_index = b.attempt_index WHERE coalesce(n_ledger, 0) <> 1 OR coalesce(n_raw, 0) <> 1""")
def x05_outstanding(spark: SparkSession, sf: str) -> DataFrame:
    d = read_table(spark, sf, "raw_llm_log")
    return ledgers.outstanding(d, d.distinct().where("raw_response is not null"), ["call_id", "attempt_index"])


@query("SELECT p.call_id FROM (SELECT DISTINCT call_id FROM raw_llm_log) p ANTI JOIN (SELECT call_id FROM raw_llm_log WHERE raw_response IS NOT NULL AND length(raw_response) > 20) d USING (call_id)")
def j10_pending(spark: SparkSession, sf: str) -> DataFrame:
    d = read_table(spark, sf, "raw_llm_log", ("call_id", "raw_response"))
    return ledgers.pending(d.select("call_id").distinct(), d.where("raw_response is not null and length(raw_response) > 20"), ["call_id"])


_SHAPE = """CASE WHEN raw_response IS NULL OR trim(raw_response, ' ') = '' THEN 'empty' WHEN regexp_matches(lower(raw_response), 'i cannot|i can''t|i must decline|unable to assist|i am unable') THEN 'refusal' WHEN starts_with(raw_response, '{') AND json_valid(raw_response) THEN 'object'
  WHEN starts_with(raw_response, '```') THEN 'fenced' WHEN length(raw_response) - length(replace(replace(raw_response, '{', ''), '[', '')) > length(raw_response) - length(replace(replace(raw_response, '}', ''), ']', '')) THEN 'open' WHEN contains(raw_response, '{') THEN 'wrapped' ELSE 'prose' END"""


@query(f"WITH {_LOG} SELECT model_version, {_SHAPE} AS shape, count(*) AS n FROM g GROUP BY ALL")
def f12_shapes(spark: SparkSession, sf: str) -> DataFrame:
    """Shape of each response by ordered rules, counted by model."""
    r = F.col("raw_response")
    count = lambda a, b: F.length(r) - F.length(F.replace(F.replace(r, F.lit(a), F.lit("")), F.lit(b), F.lit("")))
    rules = [
        ("empty", r.isNull() | (F.trim(r) == "")),
        ("refusal", F.lower(r).rlike("i cannot|i can't|i must decline|unable to assist|i am unable")),
        ("object", r.startswith("{") & F.try_parse_json(r).isNotNull()),
        ("fenced", r.startswith("```")),
        ("open", count("{", "[") > count("}", "]")),
        ("wrapped", r.contains("{")),
    ]
    return log(spark, sf).select("model_version", F.coalesce(filters.first_match(rules), F.lit("prose")).alias("shape")).groupBy("model_version", "shape").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT time_bucket(INTERVAL 1 DAY, timestamp_utc) AS start, time_bucket(INTERVAL 1 DAY, timestamp_utc) + INTERVAL 1 DAY AS \"end\", model_version, count(*) AS n FROM raw_llm_log WHERE timestamp_utc IS NOT NULL GROUP BY ALL")
def x_tumbling(spark: SparkSession, sf: str) -> DataFrame:
    """An addition: calls a day and model."""
    d = read_table(spark, sf, "raw_llm_log", ("timestamp_utc", "model_version")).withColumn("timestamp_utc", F.col("timestamp_utc").cast("timestamp"))
    out = ledgers.windowed_counts(d, "timestamp_utc", ["model_version"], "1 day")
    return out.withColumn("start", F.col("start").cast("timestamp_ntz")).withColumn("end", F.col("end").cast("timestamp_ntz"))


@query(f"""WITH {_LOG}, o AS (SELECT call_id, attempt_index, raw_response IS NULL OR length(raw_response) <= 20 AS failed FROM g), i AS (SELECT *, row_number() OVER (PARTITION BY call_id ORDER BY attempt_index) - row_number() OVER (PARTITION BY call_id, failed ORDER BY attempt_index) AS isle FROM o)
  SELECT call_id, failed, min(attempt_index) AS "first", max(attempt_index) AS "last", count(*) AS n FROM i GROUP BY call_id, failed, isle HAVING count(*) >= 2""")
def w14_streaks(spark: SparkSession, sf: str) -> DataFrame:
    d = log(spark, sf).select("call_id", "attempt_index", (F.col("raw_response").isNull() | (F.length("raw_response") <= 20)).alias("failed"))
    return windows.streaks(d, ["call_id"], "attempt_index", "failed", 2)


_CHAPTERS = """WITH p AS (SELECT DISTINCT part_id, chapter_id, section_id, part_index, target_tokens FROM spine_parts), c AS (SELECT chapter_id, count(*) AS n, min(part_index) AS low, max(part_index) AS high, count(DISTINCT section_id) AS n_sections, CAST(sum(target_tokens) AS BIGINT) AS target_tokens, bool_and(starts_with(section_id, chapter_id)) AS own_sections, bool_and(target_tokens > 0) AS has_targets FROM p GROUP BY chapter_id)
  SELECT *, list_filter([CASE WHEN NOT coalesce(own_sections, false) THEN 'sections' END, CASE WHEN NOT coalesce(has_targets, false) THEN 'targets' END, CASE WHEN n_sections > n THEN 'coverage' END, CASE WHEN high - low + 1 < n_sections THEN 'places' END], lambda x: x IS NOT NULL) AS failures FROM c"""


@query(_CHAPTERS)
def c18_chapters(spark: SparkSession, sf: str) -> DataFrame:
    """Each chapter's size and all rules that it breaks: sections that are its own, targets, coverage, places."""
    d = read_table(spark, sf, "spine_parts", ("part_id", "chapter_id", "section_id", "part_index", "target_tokens")).distinct()
    c = d.groupBy("chapter_id").agg(F.count(F.lit(1)).alias("n"), F.min("part_index").alias("low"), F.max("part_index").alias("high"), F.countDistinct("section_id").alias("n_sections"), F.sum("target_tokens").alias("target_tokens"), F.bool_and(F.startswith("section_id", "chapter_id")).alias("own_sections"), F.bool_and(F.col("target_tokens") > 0).alias("has_targets"))
    broken = lambda holds, name: F.when(~F.coalesce(holds, F.lit(False)), name)
    return c.withColumn("failures", F.array_compact(F.array(broken(F.col("own_sections"), "sections"), broken(F.col("has_targets"), "targets"), broken(F.col("n_sections") <= F.col("n"), "coverage"), broken(F.col("high") - F.col("low") + 1 >= F.col("n_sections"), "places"))))


_WORDS = "len(regexp_extract_all(text, '\\S+'))"
#: Row rules of parts: name, the condition in SQL.
_PARTS = (
    ("has text", "length(trim(text, ' ')) > 0"), ("not over length", f"{_WORDS} <= 1.75 * target_tokens"), ("not under length", f"{_WORDS} >= 0.6 * target_tokens"), ("identity", "starts_with(part_id, section_id) AND starts_with(section_id, chapter_id)"),
    ("style", "NOT regexp_matches(text, '\\b(ORG|CH|CP|E)-?[0-9]{2,}\\b') AND NOT regexp_matches(text, '(^|\\n)#{1,6}\\s') AND NOT regexp_matches(lower(text), '\\b(as an ai|in conclusion|in summary)\\b')"), ("kind known", "part_kind IS NOT NULL"),
)
_PART_GATES = " UNION ALL ".join(f"SELECT '{n}', count(*) = 0, count(*), min(part_id) FROM p WHERE NOT coalesce({c}, false)" for n, c in _PARTS)


@query(f"""WITH p AS (SELECT DISTINCT part_id, chapter_id, section_id, part_kind, text, policy_revision, target_tokens, entity_ids FROM spine_parts), e AS (SELECT DISTINCT x AS id FROM (SELECT unnest(entity_ids) AS x FROM p) WHERE x NOT IN (SELECT organism_id FROM wmdp_organisms))
  SELECT 'key unique' AS name, count(*) = 0 AS passes, count(*) AS n_violations, min(part_id) AS least_id FROM (SELECT part_id FROM p GROUP BY part_id HAVING count(*) > 1) UNION ALL SELECT 'entities exist', count(*) = 0, count(*), min(id) FROM e UNION ALL {_PART_GATES}""")
def c17_part_gates(spark: SparkSession, sf: str) -> DataFrame:
    """Eight rules of parts. Rules are judged where the text lies, and only their verdicts are made distinct."""
    t, n = F.col("text"), X.ws_count(F.col("text"))
    holds = {
        "has text": F.length(F.trim(t)) > 0, "not over length": n <= 1.75 * F.col("target_tokens"), "not under length": n >= 0.6 * F.col("target_tokens"), "identity": F.startswith("part_id", "section_id") & F.startswith("section_id", "chapter_id"),
        "style": F.size(X.style_failures(t)) == 0, "kind known": F.col("part_kind").isNotNull(),
    }
    rows = read_table(spark, sf, "spine_parts", ("part_id", "chapter_id", "section_id", "part_kind", "text", "policy_revision", "target_tokens", "entity_ids"))
    verdicts = [F.when(t.isNull() & F.lit(k == "style"), F.lit(False)).otherwise(F.coalesce(h, F.lit(False))).alias(k) for k, h in holds.items()]
    d = rows.select("part_id", F.xxhash64("chapter_id", "section_id", "part_kind", "text", "policy_revision", "target_tokens", "entity_ids").alias("_h"), *verdicts).distinct()
    cited = rows.select(F.explode("entity_ids").alias("id"))
    tables = gates.suite([("key unique", gates.unique(d, ["part_id"])), ("entities exist", gates.foreign_key(cited, "id", read_table(spark, sf, "wmdp_organisms", ("organism_id",)), "organism_id"))])
    return tables.unionByName(gates.suite_of_rules(d, "part_id", [(k, F.col(f"`{k}`")) for k in holds]))


@query("""WITH d AS (SELECT DISTINCT part_id, policy_revision, section_id, part_index FROM spine_parts), r AS (SELECT *, max(policy_revision) OVER (PARTITION BY section_id, part_index) AS top FROM d) SELECT part_id, policy_revision FROM r WHERE policy_revision < top""")
def f20_superseded(spark: SparkSession, sf: str) -> DataFrame:
    """Parts of a place that a later revision has filled."""
    d = read_table(spark, sf, "spine_parts", ("part_id", "policy_revision", "section_id", "part_index")).distinct()
    top = d.groupBy("section_id", "part_index").agg(F.max("policy_revision").alias("top"))
    return d.join(top, ["section_id", "part_index"]).where("policy_revision < top").select("part_id", "policy_revision")


@query("""WITH k AS (SELECT call_id, json_valid(prompt_text) AND starts_with(prompt_text, '{') AS j, prompt_hash IS NULL AS h, raw_response IS NULL AS r FROM (SELECT DISTINCT call_id, attempt_index, prompt_text, prompt_hash, raw_response FROM raw_llm_log) WHERE prompt_text IS NOT NULL) SELECT h AS no_hash, r AS no_response, count(*) AS n, count(*) FILTER (j) AS n_json FROM k GROUP BY h, r""")
def a23_patterns(spark: SparkSession, sf: str) -> DataFrame:
    d = read_table(spark, sf, "raw_llm_log", ("call_id", "attempt_index", "prompt_text", "prompt_hash", "raw_response")).where("prompt_text is not null")
    j = F.col("prompt_text").startswith("{") & F.try_parse_json("prompt_text").isNotNull()
    rows = d.select("call_id", "attempt_index", F.col("prompt_hash").isNull().alias("no_hash"), F.col("raw_response").isNull().alias("no_response"), j.alias("j"), F.xxhash64("prompt_text", "prompt_hash", "raw_response").alias("h")).distinct()
    return rows.groupBy("no_hash", "no_response").agg(F.count(F.lit(1)).alias("n"), F.count_if("j").alias("n_json"))
