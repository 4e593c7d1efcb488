"""Queries over small tables whose hubs, hot words and clusters a cap would lose; compared with brute force."""

import json
import random
import re
from collections import Counter, defaultdict
from itertools import combinations

import pytest

from windrow.operators import graph, information, joins
from windrow.plans import claim_queries, graph_queries, metric_queries


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols or df.columns) for r in df.collect())


#: 15 entities share item h, 3 share t; x and y have items of their own.
LINKS = {f"e{i:02d}": ["h"] for i in range(15)} | {"e15": ["t"], "e16": ["t", "u"], "e17": ["t", "u", "v", "w"], "x": ["x1"], "y": ["y1", "y2", "y3"]}


ANSWERS = [f"a Hot word of note{i // 2}, and été élan" for i in range(9)] + ["an oak is at it", "an oak is at it", None]
TEXTS = ["The Ostjamloa melvarisipes virus and E. coli-like H5N1-ab strains (COVID-19) spread.", "A  very small leaf\npathogen; MRSA, Bacillus anthracis strain. Some fungi", "No names here, in a box.", "Émile's bacterium and Canis lupus"]
QUESTIONS = [(f"q{i:02d}", "bio", TEXTS[i % 4], "none", "Felis catus", f"type {i} virus", None, a) for i, a in enumerate(ANSWERS)]


#: Entity y is right on its three items; h, t and x1 are wrong, and lone items of no entity are right by turns.
PREDICTIONS = [("r", 1, i, 0.7, 0.1, 0.1, 0.1, "A" if ok else "B") for i, ok in [("y1", 1), ("y2", 1), ("y3", 1), ("h", 0), ("x1", 0), ("t", 0), ("u", 0), ("v", 0), ("w", 0), *[(f"lone{n}", n % 2) for n in range(4)]]]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("whole")
    organisms = [(e, json.dumps(q), "genus" if n % 3 else "species") for n, (e, q) in enumerate(sorted(LINKS.items()))]
    spark.createDataFrame(organisms, "organism_id string, question_ids string, taxon_rank string").write.parquet(f"{root}/wmdp_organisms.parquet")
    spark.createDataFrame(QUESTIONS, "question_id string, subset string, question string, choice_a string, choice_b string, choice_c string, choice_d string, correct_text string").write.parquet(f"{root}/wmdp_questions.parquet")
    spark.createDataFrame(PREDICTIONS, "run_id string, checkpoint_step int, question_id string, p_a double, p_b double, p_c double, p_d double, gold string").write.parquet(f"{root}/predictions.parquet")
    return str(root)


def united(groups):
    """Least member of the component of every member, by brute force."""
    label = {m: m for g in groups for m in g}
    for _ in label:
        for g in groups:
            least = min(label[m] for m in g)
            label |= {m: least for m in g}
    return label


def entities_by_item():
    by = defaultdict(set)
    for e, q in LINKS.items():
        for i in q:
            by[i].add(e)
    return by


def test_g01_ties_all_entities_of_an_item(spark, folder):
    got = dict(rows(graph_queries.g01_components(spark, folder), "node", "component"))
    assert got == united(entities_by_item().values()) and len(set(got.values())) == 4


def test_g04_entities_with_many_items_tie_them(spark, folder):
    label = united([set(q) for q in LINKS.values()])
    assert dict(rows(claim_queries.g04_item_components(spark, folder), "size", "n_components")) == Counter(Counter(label.values()).values())


def edges():
    return Counter(p for es in entities_by_item().values() for p in combinations(sorted(es), 2))


def test_j11_g05_keep_items_with_many_entities(spark, folder):
    e = edges()
    assert {(r.src, r.dst): r.weight for r in graph_queries.j11_cooccurrence(spark, folder).collect()} == e
    want = {n: (sum(n in p for p in e), sum(w for p, w in e.items() if n in p)) for n in LINKS}
    assert {r.node: (r.degree, r.strength) for r in graph_queries.g05_degrees(spark, folder).collect()} == want


def test_g07_j22_keep_items_with_many_entities(spark, folder):
    rank = {e: "genus" if n % 3 else "species" for n, e in enumerate(sorted(LINKS))}
    size = Counter(rank.values())
    within, across = Counter(), 0
    for (a, b), w in edges().items():
        within[rank[a]] += w if rank[a] == rank[b] else 0
        across += w if rank[a] != rank[b] else 0
    assert rows(graph_queries.g07_density(spark, folder)) == [(g, n, round(within[g] / (n * (n - 1) / 2), 9)) for g, n in sorted(size.items())]
    assert rows(graph_queries.j22_cross_weights(spark, folder)) == [("genus", "species", across)]


def test_link_measures_equal_those_of_edges(spark):
    """Also where a node is in several groups."""
    links = spark.createDataFrame([(f"n{i * k % 7}", f"i{k % 5}") for i in range(6) for k in range(12)], "e string, i string")
    m = spark.createDataFrame([(f"n{i}", g) for i in range(7) for g in "abc" if (i + ord(g)) % 3 or i == 2], "n string, g string")
    e = joins.cooccurrence(links, "i", "e")
    assert rows(graph.link_density(links, "i", "e", m, "n", "g")) == rows(graph.density(e, m, "n", "g"))
    assert rows(graph.link_cross_weights(links, "i", "e", m, "n", "g")) == rows(graph.cross_weights(e, m, "n", "g"))


def test_j13_keeps_words_of_many_items(spark, folder):
    terms = {q[0]: set(re.findall(r"\b\w{4,}\b", (q[-1] or "").lower())) for q in QUESTIONS}
    want = {(a, b): len(terms[a] & terms[b]) for a, b in combinations(sorted(terms), 2) if terms[a] & terms[b]}
    assert {(r.a, r.b): r.n_shared for r in claim_queries.j13_shared_words(spark, folder).collect()} == want and len(want) == 36


def cluster_interval(clusters, draws=20_000):
    rng = random.Random(3)
    means = []
    for _ in range(draws):
        picked = [x for c in rng.choices(clusters, k=len(clusters)) for x in c]
        means.append(sum(picked) / len(picked))
    means.sort()
    return means[int(0.025 * draws)], means[int(0.975 * draws)]


def test_bootstrap_of_clusters(spark):
    rng = random.Random(9)
    clusters = [[int(rng.random() < p)] * rng.choice((1, 3, 8)) for p in [0.5] * 60]
    df = spark.createDataFrame([("k", ok, u) for u, c in enumerate(clusters) for ok in c], "k string, c int, e int")
    got = information.bootstrap_accuracy(df, ["k"], "c", "e", 4000).first()
    low, high = cluster_interval(clusters)
    assert got.low == pytest.approx(low, abs=0.02) and got.high == pytest.approx(high, abs=0.02) and got.n == sum(map(len, clusters))


def test_i23_draws_entities(spark, folder):
    got = metric_queries.i23_bootstrap(spark, folder).first()
    low, high = cluster_interval([[1, 1, 1], [0], [0], [0, 0, 0, 0], [0], [1], [0], [1]])
    assert got.n == 13 and got.mean == pytest.approx(5 / 13) and got.low == pytest.approx(low, abs=0.03) and got.high == pytest.approx(high, abs=0.03)


def test_z01_reads_three_families_from_the_text(spark, folder):
    want = set()
    for q in QUESTIONS:
        text, found = q[2] + "\nChoices: " + " | ".join(c for c in q[3:7] if c), set()
        found |= {m.group() for m in re.finditer(r"\b(?:[A-Z][a-z]{2,}|[A-Z]\.)\s+[a-z][a-z-]{2,}(?:\s+(?:virus|bacterium|strain))?\b", text)}
        found |= {" ".join(m.group().split()) for m in re.finditer(r"\b(?:[A-Za-z0-9][A-Za-z0-9.'’-]*\s+){0,3}(?:virus|viruses|bacterium|bacteria|fungus|fungi|parasite|prion|pathogen|pathogens)\b", text, re.I)}
        found |= {t for t in re.findall(r"\b[A-Za-z][A-Za-z0-9]*(?:-[A-Za-z0-9]+)+\b|\b[A-Z]{2,}[A-Z0-9]*\b", text) if len(t) >= 3}
        want |= {(q[0], m) for x in found if 2 < len(m := x.strip(" ,.;:()[]{}")) <= 80}
    got = rows(claim_queries.z01_candidate_names(spark, folder), "question_id", "surface_form")
    assert got == sorted(want) and {"MRSA", "E. coli-like", "COVID-19", "very small leaf pathogen"} <= {m for _, m in got}
