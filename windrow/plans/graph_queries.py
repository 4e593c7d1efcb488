"""Queries over the graph of entities and items: co-occurrence, components, coverage, sampling, allocation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from windrow.functions import values as V
from windrow.operators import aggregates, filters, gates, graph, joins, sampling, windows
from windrow.registry import query
from windrow.sources import read_table

#: SQL of the distinct (entity, item) pairs.
_L = "l AS (SELECT DISTINCT organism_id AS entity, unnest(from_json(question_ids, '[\"VARCHAR\"]')) AS item FROM wmdp_organisms WHERE question_ids IS NOT NULL)"
_E = f"{_L}, e AS (SELECT a.entity AS src, b.entity AS dst, count(*) AS weight FROM l a JOIN l b ON a.item = b.item AND a.entity < b.entity GROUP BY ALL)"


def links(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct (entity, item) pairs from the JSON lists."""
    d = read_table(spark, sf, "wmdp_organisms", ("organism_id", "question_ids")).distinct()
    return d.select(F.col("organism_id").alias("entity"), F.explode(F.from_json("question_ids", "array<string>")).alias("item")).distinct()


def small_links(spark: SparkSession, sf: str) -> DataFrame:
    """Links of the items that few entities have; items with many tie everything together."""
    return filters.high_degree(links(spark, sf), "entity", "item", 12)


@query(f"WITH {_L}, d AS (SELECT item FROM l GROUP BY item HAVING count(DISTINCT entity) > 12) SELECT entity, item FROM l ANTI JOIN d USING (item)")
def f19_high_degree(spark: SparkSession, sf: str) -> DataFrame:
    return small_links(spark, sf).select("entity", "item")


@query(f"WITH {_E} SELECT src, dst, weight FROM e")
def j11_cooccurrence(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs of entities that share items."""
    return joins.cooccurrence(links(spark, sf), "item", "entity")


@query(f"""WITH RECURSIVE {_L}, e AS (SELECT 'e' || entity AS a, 'i' || item AS b FROM l UNION SELECT 'i' || item, 'e' || entity FROM l), r(node, seen) AS (SELECT DISTINCT a, a FROM e WHERE a[1] = 'e' UNION SELECT r.node, e.b FROM r JOIN e ON r.seen = e.a)
  SELECT node[2:] AS node, min(seen[2:]) AS component FROM r WHERE seen[1] = 'e' GROUP BY ALL""")
def g01_components(spark: SparkSession, sf: str) -> DataFrame:
    """Components of the entities that share items."""
    all_ = links(spark, sf)
    return graph.components(graph.star(all_, "item", "entity"), all_.select("entity"))


@query(f"WITH {_E}, x AS (SELECT src AS node, weight FROM e UNION ALL SELECT dst, weight FROM e), g AS (SELECT node, count(*) AS degree, CAST(sum(weight) AS BIGINT) AS strength FROM x GROUP BY node) SELECT n.node, coalesce(degree, 0) AS degree, coalesce(strength, 0) AS strength FROM (SELECT DISTINCT entity AS node FROM l) n LEFT JOIN g USING (node)")
def g05_degrees(spark: SparkSession, sf: str) -> DataFrame:
    all_ = links(spark, sf)
    return graph.degrees(joins.cooccurrence(all_, "item", "entity"), all_.select("entity"))


_M = "m AS (SELECT DISTINCT organism_id AS node, taxon_rank AS grp FROM wmdp_organisms WHERE taxon_rank IS NOT NULL)"


@query(f"""WITH {_E}, {_M}, w AS (SELECT a.grp, sum(weight) AS w FROM e JOIN m a ON e.src = a.node JOIN m b ON e.dst = b.node WHERE a.grp = b.grp GROUP BY a.grp), z AS (SELECT grp, count(*) AS n FROM m GROUP BY grp)
  SELECT z.grp, n AS n_members, round(coalesce(w.w / (n * (n - 1) / 2), 0), 9) AS density FROM z LEFT JOIN w ON w.grp = z.grp""")
def g07_density(spark: SparkSession, sf: str) -> DataFrame:
    m = read_table(spark, sf, "wmdp_organisms", ("organism_id", "taxon_rank")).where("taxon_rank is not null").select(F.col("organism_id").alias("node"), F.col("taxon_rank").alias("grp"))
    return graph.link_density(links(spark, sf), "item", "entity", m, "node", "grp").withColumn("density", F.round("density", 9))


@query(f"WITH {_E}, {_M} SELECT least(a.grp, b.grp) AS group_a, greatest(a.grp, b.grp) AS group_b, CAST(sum(weight) AS BIGINT) AS weight FROM e JOIN m a ON e.src = a.node JOIN m b ON e.dst = b.node WHERE a.grp <> b.grp GROUP BY ALL")
def j22_cross_weights(spark: SparkSession, sf: str) -> DataFrame:
    m = read_table(spark, sf, "wmdp_organisms", ("organism_id", "taxon_rank")).where("taxon_rank is not null").select(F.col("organism_id").alias("node"), F.col("taxon_rank").alias("grp"))
    return graph.link_cross_weights(links(spark, sf), "item", "entity", m, "node", "grp")


@query(f"""WITH {_L}, z AS (SELECT entity, count(*) AS n_docs FROM l GROUP BY entity), r AS (SELECT *, row_number() OVER (ORDER BY n_docs DESC, entity) AS rank FROM z), h AS (SELECT item, min(rank) AS rank FROM l JOIN r USING (entity) GROUP BY item),
  g AS (SELECT rank, count(*) AS g FROM h GROUP BY rank) SELECT entity, n_docs, rank, coalesce(g, 0) AS gain, CAST(sum(coalesce(g, 0)) OVER (ORDER BY rank) AS BIGINT) AS covered FROM r LEFT JOIN g USING (rank)""")
def w02_coverage_curve(spark: SparkSession, sf: str) -> DataFrame:
    return windows.coverage_curve(links(spark, sf), "entity", "item")


@query(f"""WITH {_L}, z AS (SELECT entity, count(*) AS n FROM l GROUP BY entity), r AS (SELECT *, row_number() OVER (ORDER BY n DESC, entity) AS rank FROM z), h AS (SELECT item, min(rank) AS rank FROM l JOIN r USING (entity) GROUP BY item),
  c AS (SELECT rank, sum(coalesce(g, 0)) OVER (ORDER BY rank) AS c FROM r LEFT JOIN (SELECT rank, count(*) AS g FROM h GROUP BY rank) USING (rank)) SELECT s AS share, min(rank) AS rank FROM c CROSS JOIN (SELECT unnest([0.5::DOUBLE, 0.8::DOUBLE, 0.9::DOUBLE]) AS s) WHERE c / (SELECT max(c) FROM c) >= s GROUP BY s""")
def w03_ranks_reaching(spark: SparkSession, sf: str) -> DataFrame:
    return windows.ranks_reaching(windows.coverage_curve(links(spark, sf), "entity", "item"), [0.5, 0.8, 0.9])


@query("""WITH n AS (SELECT chapter_id, count(*) AS c FROM documents WHERE chapter_id IS NOT NULL GROUP BY chapter_id), x AS (SELECT *, CAST(100 * c AS DOUBLE) / sum(c) OVER () AS e FROM n), f AS (SELECT *, floor(e) AS f FROM x),
  o AS (SELECT *, row_number() OVER (ORDER BY round(e - f, 9) DESC, chapter_id) AS o, 100 - sum(f) OVER () AS l FROM f) SELECT chapter_id, c, CAST(f + CASE WHEN o <= l THEN 1 ELSE 0 END AS BIGINT) AS quota FROM o""")
def o08_largest_remainder(spark: SparkSession, sf: str) -> DataFrame:
    n = read_table(spark, sf, "documents", ("chapter_id",)).where("chapter_id is not null").groupBy("chapter_id").agg(F.count(F.lit(1)).alias("c"))
    return sampling.largest_remainder(n, "chapter_id", "c", 100)


@query("""WITH n AS (SELECT lang, count(*) AS c FROM documents WHERE lang IS NOT NULL GROUP BY lang), x AS (SELECT *, CAST((200 - 2 * count(*) OVER ()) * c AS DOUBLE) / sum(c) OVER () AS e, 200 - 2 * count(*) OVER () AS rest FROM n), f AS (SELECT *, floor(e) AS f FROM x),
  o AS (SELECT *, row_number() OVER (ORDER BY round(e - f, 9) DESC, lang) AS o, rest - sum(f) OVER () AS l FROM f) SELECT lang, c, CAST(2 + f + CASE WHEN o <= l THEN 1 ELSE 0 END AS BIGINT) AS quota FROM o""")
def o07_with_floors(spark: SparkSession, sf: str) -> DataFrame:
    n = read_table(spark, sf, "documents", ("lang",)).where("lang is not null").groupBy("lang").agg(F.count(F.lit(1)).alias("c"))
    return sampling.largest_remainder(n, "lang", "c", 200, least=2)


@query("""WITH n AS (SELECT source, count(*) AS c FROM documents WHERE source IS NOT NULL GROUP BY source), x AS (SELECT *, CAST(50 * c AS DOUBLE) / sum(c) OVER () AS e FROM n), f AS (SELECT *, floor(e) AS f FROM x),
  q AS (SELECT source, f + CASE WHEN row_number() OVER (ORDER BY round(e - f, 9) DESC, source) <= 50 - sum(f) OVER () THEN 1 ELSE 0 END AS q FROM f), r AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY sha256('42|' || doc_id), doc_id) AS r FROM documents)
  SELECT source, doc_id FROM r JOIN q USING (source) WHERE r <= q""")
def o04_stratified_sample(spark: SparkSession, sf: str) -> DataFrame:
    """50 documents by source in proportion, chosen by digest. The sample is what is asked, so it has a size."""
    d = read_table(spark, sf, "documents", ("doc_id", "source")).where("source is not null")
    quotas = sampling.largest_remainder(d.groupBy("source").agg(F.count(F.lit(1)).alias("c")), "source", "c", 50)
    return sampling.hash_sample(d, "source", "doc_id", quotas, "42").select("source", "doc_id")


@query("""WITH r AS (SELECT DISTINCT subset, question_id FROM wmdp_questions), t AS (SELECT *, row_number() OVER (PARTITION BY subset ORDER BY question_id) AS t FROM r) SELECT subset, question_id FROM t ORDER BY t, subset LIMIT 40""")
def o11_round_robin(spark: SparkSession, sf: str) -> DataFrame:
    d = read_table(spark, sf, "wmdp_questions", ("subset", "question_id")).distinct()
    return sampling.round_robin(d, "subset", "question_id", 40).select("subset", "question_id")


@query("""SELECT question_id, list_transform(list_sort(list_transform([choice_a, choice_b, choice_c, choice_d], lambda o: {'h': sha256(question_id || '|' || o), 'o': o})), lambda s: s.o) AS options FROM (SELECT DISTINCT question_id, choice_a, choice_b, choice_c, choice_d FROM wmdp_questions)""")
def o14_shuffled_options(spark: SparkSession, sf: str) -> DataFrame:
    d = read_table(spark, sf, "wmdp_questions", ("question_id", "choice_a", "choice_b", "choice_c", "choice_d")).distinct()
    return d.select("question_id", sampling.shuffled_options(F.col("question_id"), F.array("choice_a", "choice_b", "choice_c", "choice_d")).alias("options"))


@query("""WITH d AS (SELECT DISTINCT question_id, sha256(question_id) AS h FROM wmdp_questions), v AS (SELECT question_id, (strpos('0123456789abcdef', h[64]) - 1 + 6 * list_sum(list_transform(range(1, 64), lambda i: strpos('0123456789abcdef', h[i]) - 1))) % 10 AS m FROM d) SELECT question_id, CAST(m AS INT) AS m FROM v WHERE m < 3""")
def o15_hash_inclusion(spark: SparkSession, sf: str) -> DataFrame:
    d = read_table(spark, sf, "wmdp_questions", ("question_id",)).distinct()
    return d.select("question_id", V.mod10(F.col("question_id")).cast("int").alias("m")).where("m < 3")


@query("""WITH r AS (SELECT question_id, row_number() OVER (ORDER BY question_id) - 1 AS r, count(*) OVER () AS n FROM (SELECT DISTINCT question_id FROM wmdp_questions)) SELECT question_id FROM r WHERE list_contains(list_transform(range(5), lambda i: CAST(round_even(i * (n - 1) / 4, 0) AS BIGINT)), r)""")
def z11_evenly_spaced(spark: SparkSession, sf: str) -> DataFrame:
    return sampling.evenly_spaced(read_table(spark, sf, "wmdp_questions", ("question_id",)).distinct(), "question_id", 5)


@query("SELECT cutoff, count(*) FILTER (v >= cutoff) AS n_reach, round(avg(CAST(v >= cutoff AS INT)), 9) AS share FROM (SELECT coalesce(n_docs_either, 0) AS v FROM (SELECT DISTINCT organism_id, n_docs_either FROM wmdp_organisms)) CROSS JOIN (SELECT CAST(unnest([2, 3, 4, 5, 8]) AS INT) AS cutoff) GROUP BY cutoff")
def a37_coverage_at(spark: SparkSession, sf: str) -> DataFrame:
    d = read_table(spark, sf, "wmdp_organisms", ("organism_id", "n_docs_either")).distinct()
    return aggregates.coverage_at(d, "n_docs_either", [2, 3, 4, 5, 8]).withColumn("share", F.round("share", 9))


@query("""WITH n AS (SELECT DISTINCT parent_genus, name_raw FROM wmdp_organisms WHERE parent_genus IS NOT NULL AND name_raw IS NOT NULL) SELECT parent_genus, count(*) AS n_names, list_sort(list(name_raw)) AS names,
  arg_min(name_raw, (-len(regexp_split_to_array(trim(name_raw, ' '), '\\s+')), -length(name_raw), lower(name_raw), name_raw)) AS preferred FROM n GROUP BY parent_genus""")
def a20_name_sets(spark: SparkSession, sf: str) -> DataFrame:
    """The names typed for each genus and the one preferred for display."""
    d = read_table(spark, sf, "wmdp_organisms", ("parent_genus", "name_raw")).where("parent_genus is not null and name_raw is not null").distinct()
    return d.groupBy("parent_genus").agg(F.count(F.lit(1)).alias("n_names"), F.array_sort(F.collect_set("name_raw")).alias("names"), aggregates.preferred_name("name_raw").alias("preferred"))


@query("SELECT parent_genus, count(DISTINCT taxon_rank) AS n_values FROM wmdp_organisms WHERE parent_genus IS NOT NULL GROUP BY parent_genus HAVING count(DISTINCT taxon_rank) > 1")
def a39_agreement(spark: SparkSession, sf: str) -> DataFrame:
    return aggregates.functional_violations(read_table(spark, sf, "wmdp_organisms", ("parent_genus", "taxon_rank")).where("parent_genus is not null"), ["parent_genus"], "taxon_rank")


@query("""SELECT extraction_source, count(*) AS n, round(CASE WHEN count(*) > 1 AND stddev_pop(n_mentions) > 0 AND stddev_pop(n_docs_title) > 0 THEN covar_pop(n_mentions, n_docs_title) / (stddev_pop(n_mentions) * stddev_pop(n_docs_title)) END, 7) AS r FROM (SELECT DISTINCT organism_id, extraction_source, n_mentions, n_docs_title FROM wmdp_organisms) GROUP BY extraction_source""")
def a25_correlation(spark: SparkSession, sf: str) -> DataFrame:
    d = read_table(spark, sf, "wmdp_organisms", ("organism_id", "extraction_source", "n_mentions", "n_docs_title")).distinct()
    return d.groupBy("extraction_source").agg(F.count(F.lit(1)).alias("n"), F.round(aggregates.guarded_corr("n_mentions", "n_docs_title"), 7).alias("r"))


@query("""SELECT extraction_source, n, k, round(greatest(0.0, (k / n + 1.959963984540054 * 1.959963984540054 / (2 * n)) / (1 + 1.959963984540054 * 1.959963984540054 / n) - 1.959963984540054 * sqrt(k / n * (1 - k / n) / n + 1.959963984540054 * 1.959963984540054 / (4 * n * n)) / (1 + 1.959963984540054 * 1.959963984540054 / n)), 9) AS low,
  round(least(1.0, (k / n + 1.959963984540054 * 1.959963984540054 / (2 * n)) / (1 + 1.959963984540054 * 1.959963984540054 / n) + 1.959963984540054 * sqrt(k / n * (1 - k / n) / n + 1.959963984540054 * 1.959963984540054 / (4 * n * n)) / (1 + 1.959963984540054 * 1.959963984540054 / n)), 9) AS high
  FROM (SELECT extraction_source, count(*) AS n, count(*) FILTER (gazetteer_match = 'true') AS k FROM (SELECT DISTINCT organism_id, extraction_source, gazetteer_match FROM wmdp_organisms) GROUP BY extraction_source)""")
def a24_wilson(spark: SparkSession, sf: str) -> DataFrame:
    d = read_table(spark, sf, "wmdp_organisms", ("organism_id", "extraction_source", "gazetteer_match")).distinct()
    g = d.groupBy("extraction_source").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("gazetteer_match") == "true").alias("k"))
    low, high = V.wilson(F.col("k"), F.col("n"))
    return g.select("*", F.round(low, 9).alias("low"), F.round(high, 9).alias("high"))


#: Row rules of the inventory: name, and the condition as SQL that both engines read alike.
_INVENTORY = (
    ("has a name", "coalesce(trim(name_raw), '') <> '' OR coalesce(trim(name_normalized), '') <> ''"),
    ("rank known", "taxon_rank IN ('species', 'genus')"),
    ("flag known", "gazetteer_match IS NULL OR gazetteer_match IN ('true', 'false', 'unchecked')"),
    ("either covers both", "n_docs_either >= greatest(n_docs_title, n_docs_abstract)"),
    ("either within sum", "n_docs_either <= n_docs_title + n_docs_abstract"),
    ("frequency is a share", "corpus_doc_frequency BETWEEN 0 AND 1"),
    ("mentions not negative", "n_mentions >= 0"),
)
_ROW_GATES = " UNION ALL ".join(f"SELECT '{name}', count(*) = 0, count(*), min(organism_id) FROM d WHERE NOT coalesce({holds}, false)" for name, holds in _INVENTORY)


@query(f"""WITH {_L}, d AS (SELECT DISTINCT * FROM wmdp_organisms), g AS (SELECT organism_id FROM d GROUP BY organism_id HAVING count(*) > 1), f AS (SELECT DISTINCT item FROM l WHERE item NOT IN (SELECT question_id FROM wmdp_questions)), s AS (SELECT organism_id FROM d WHERE first_seen_question_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM l WHERE l.entity = organism_id AND l.item = first_seen_question_id))
  SELECT 'key unique' AS name, count(*) = 0 AS passes, count(*) AS n_violations, min(organism_id) AS least_id FROM g UNION ALL SELECT 'items exist', count(*) = 0, count(*), min(item) FROM f UNION ALL SELECT 'first seen cited', count(*) = 0, count(*), min(organism_id) FROM s UNION ALL {_ROW_GATES}""")
def c02_inventory_gates(spark: SparkSession, sf: str) -> DataFrame:
    """Ten rules of the inventory; those of single rows in one pass."""
    d = read_table(spark, sf, "wmdp_organisms").distinct()
    items = read_table(spark, sf, "wmdp_questions", ("question_id",))
    cited = d.where("first_seen_question_id is not null")
    tables = gates.suite([
        ("key unique", gates.unique(d, ["organism_id"])),
        ("items exist", gates.foreign_key(links(spark, sf), "item", items, "question_id")),
        ("first seen cited", gates.rule(cited, F.array_contains(F.from_json("question_ids", "array<string>"), F.col("first_seen_question_id")), ["organism_id"])),
    ])
    return tables.unionByName(gates.suite_of_rules(d, "organism_id", [(name, F.expr(holds)) for name, holds in _INVENTORY]))


@query(f"""WITH {_L} SELECT entity, count(DISTINCT q.subset) AS n_sides FROM l JOIN wmdp_questions q ON q.question_id = l.item GROUP BY entity HAVING count(DISTINCT q.subset) > 1""")
def g06_leakage(spark: SparkSession, sf: str) -> DataFrame:
    """Entities whose items lie in more than one subset."""
    side = links(spark, sf).join(read_table(spark, sf, "wmdp_questions", ("question_id", "subset")).distinct(), F.col("item") == F.col("question_id"))
    return graph.leaks(side, "item", "entity", "subset")
