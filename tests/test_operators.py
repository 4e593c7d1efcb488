import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from windrow.operators import aggregates, dedupe, filters, gates, graph, information, joins, sampling, windows


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols or df.columns) for r in df.collect())


def test_cascade_and_funnel(spark):
    df = spark.createDataFrame([(1, 5), (2, -1), (3, None), (4, 50)], "k int, v int")
    rules = [("negative", F.col("v") < 0), ("large", F.col("v") > 10), ("never", F.col("v") < -5)]
    assert rows(filters.cascade(df, rules), "k", "stage", "reason") == [(1, None, None), (2, 0, "negative"), (3, None, None), (4, 1, "large")]
    assert rows(filters.funnel(df, rules)) == [("accepted", 2), ("large", 1), ("negative", 1)]
    with pytest.raises(ValueError):
        filters.cascade(df.withColumn("stage", F.lit(1)), rules)


def test_joins(spark):
    a = spark.createDataFrame([(1, "A"), (2, "B")], "q int, gold string")
    with pytest.raises(Exception, match="no agreeing partner for 2"):
        joins.aligned(a, a.withColumn("gold", F.when(F.col("q") == 2, "C").otherwise(F.col("gold"))), ["q"], ["gold"]).collect()
    assert joins.aligned(a, a, ["q"], ["gold"]).count() == 2
    assert rows(joins.reconcile(a.select("q"), spark.createDataFrame([(2,), (3,)], "q int"), ["q"])) == [(1, "left_only"), (3, "right_only")]
    texts = spark.createDataFrame([(1, "The Red fox, red foxes"), (2, None), (3, "")], "k int, t string")
    phrases = spark.createDataFrame([("p", "red fox"), ("q", "fox"), ("r", " "), ("s", "fox red foxes")], "pk string, p string")
    assert rows(joins.phrase_hits(texts, "k", "t", phrases, "pk", "p")) == [(1, "p"), (1, "q"), (1, "s")]
    assert joins.phrase_hits(texts, "k", "t", phrases.limit(0), "pk", "p").count() == 0
    g = spark.createDataFrame([(1, "a"), (1, "b"), (1, "b"), (1, "c"), (2, "a"), (2, "b"), (3, None)], "g int, m string")
    assert rows(joins.cooccurrence(g, "g", "m")) == [("a", "b", 2), ("a", "c", 1), ("b", "c", 1)]
    cite = spark.createDataFrame([(1, ["x", "y"]), (2, ["x"]), (3, ["z", "x"])], "k int, c array<string>")
    own = spark.createDataFrame([("A", ["x", "y"]), ("B", ["x"])], "o string, ids array<string>")
    assert rows(joins.unique_owner(cite, "k", "c", own, "o", "ids")) == [(1, "A")]
    near = joins.nearest_string(spark.createDataFrame([(1, "abcd", "g")], "k int, t string, g string"), "k", "t", spark.createDataFrame([("g", "abce"), ("g", "abcf"), ("g", "zz")], "g string, c string"), "g", "c")
    assert near.first().candidate == "abce"


def test_aggregates_against_python(spark):
    rng = random.Random(1)
    data = [("g%d" % rng.randint(0, 2), rng.choice([None, *range(20)])) for _ in range(200)]
    got = {r.g: r for r in aggregates.distribution(spark.createDataFrame(data, "g string, v int"), ["g"], "v", [10]).collect()}
    for g, r in got.items():
        v = [x for k, x in data if k == g and x is not None]
        assert r.n == len(v) and abs(r.p95 - np.percentile(v, 95)) < 1e-9 and r.n_over_0 == sum(x > 10 for x in v)
    m = aggregates.modal_mapping(spark.createDataFrame([("a", "x", i) for i in range(9)] + [("a", "y", 1), ("b", "x", 1), ("c", "q", 1), ("c", "p", 2)], "s string, t string, d int"), "s", "t", "d")
    r = {x.s: x for x in m.collect()}
    assert (r["a"].modal_target, r["a"].n, r["a"].clean_1to1) == ("x", 10, True) and r["c"].modal_target == "p" and not r["b"].clean_1to1
    d = aggregates.duplicate_inventory(spark.createDataFrame([(1, "a"), (1, "a"), (2, None), (3, " ")], "k int, t string"), ["k"], ["t"]).first()
    assert (d.n_rows, d.n_keys, d.n_repeated, d.surplus, d.t_null, d.t_blank) == (4, 3, 1, 1, 1, 1)
    df = spark.createDataFrame([("k", 1.0, 2.0), ("k", 2.0, 4.0), ("c", 1.0, 1.0), ("c", 1.0, 5.0), ("n", None, 1.0)], "g string, x double, y double")
    assert {r.g: r.r for r in df.groupBy("g").agg(aggregates.guarded_corr("x", "y").alias("r")).collect()} == {"k": 1.0, "c": None, "n": None}
    assert [r.variance for r in aggregates.between_seed(df, ["g"], "x").orderBy("g").collect()] == [0.0, 0.5, None]
    train, test = spark.createDataFrame([("a", "x"), ("a", "x"), ("b", "y"), ("b", "y"), ("b", "y")], "k string, l string"), spark.createDataFrame([("a", "x"), ("z", "y"), ("b", "x")], "k string, l string")
    assert abs(aggregates.majority_predictor(train, test, "k", "l").first().accuracy - 2 / 3) < 1e-9


def test_dedupe(spark):
    df = spark.createDataFrame([(3, "a"), (1, "a"), (2, None), (4, None)], "k int, t string")
    assert rows(dedupe.keep_first(df, F.col("t"), "k"), "k") == [(1,), (2,), (4,)]
    assert rows(dedupe.overlap(df, spark.createDataFrame([("a",), (None,)], "t string"), "t")) == [("a",)]
    assert rows(dedupe.same_composition(df, df.where("k > 1"), ["t"])) == [("a", 2, 1)]
    assert dedupe.fresh(df, df, ["t"]).count() == 0


def test_windows(spark):
    pairs = spark.createDataFrame([("a", 1), ("a", 2), ("a", 3), ("b", 3), ("b", 4), ("c", 1)], "e string, d int")
    assert rows(windows.coverage_curve(pairs, "e", "d"), "rank", "e", "n_docs", "gain", "covered") == [(1, "a", 3, 3, 3), (2, "b", 2, 1, 4), (3, "c", 1, 0, 4)]
    assert rows(windows.ranks_reaching(windows.coverage_curve(pairs, "e", "d"), [0.5, 0.9])) == [(0.5, 1), (0.9, 2)]
    s = spark.createDataFrame([("r", 0, 0.1), ("r", 1, None), ("r", 2, 0.7), ("r", 4, 0.7), ("q", 0, None)], "r string, s int, v double")
    assert dict(rows(windows.first_step(s, ["r"], "s", "v", 0.5))) == {"r": 2.0, "q": float("inf")}
    assert {r.r: (r.peak_step, r.peak_value) for r in windows.peak(s, ["r"], "s", "v").collect()} == {"r": (2, 0.7), "q": (None, None)}
    assert {(r.r, r.s): r.delta_start for r in windows.delta_from_start(s, ["r"], "s", "v").collect()}["r", 4] == pytest.approx(0.6)
    assert windows.densified(s, ["r"], "s", ["v"], [0, 1, 8]).count() == 6
    ok = s.withColumn("ok", F.col("v") > 0)
    assert dict(rows(windows.certified_through(ok, ["r"], "s", "ok"))) == {"r": 0, "q": None}
    k = spark.createDataFrame([(1, i, x) for i, x in enumerate("aabbbab")], "g int, o int, x string")
    assert rows(windows.streaks(k, ["g"], "o", "x", 3)) == [(1, "b", 2, 4, 3)]
    t = spark.createDataFrame([(1, list("abcdefghij")), (2, [])], "k int, t array<string>")
    assert [r.tokens for r in windows.overlapping_chunks(t, "k", "t", 3, 1).orderBy("chunk").collect()] == [list("abcd"), list("defg"), list("ghij")]


def test_sampling(spark):
    q = spark.createDataFrame([("a", 5), ("b", 3), ("c", 2)], "s string, w int")
    assert rows(sampling.largest_remainder(q, "s", "w", 7), "s", "quota") == [("a", 4), ("b", 2), ("c", 1)] or sum(r[1] for r in rows(sampling.largest_remainder(q, "s", "w", 7), "s", "quota")) == 7
    assert sum(r.quota for r in sampling.largest_remainder(q, "s", "w", 11, least=2).collect()) == 11
    import hashlib

    d = spark.createDataFrame([("a" if i % 3 else "b", i) for i in range(90)], "s string, k int")
    got = rows(sampling.hash_sample(d, "s", "k", spark.createDataFrame([("a", 7), ("b", 100)], "s string, quota int"), "z"))
    best = sorted((i for i in range(90) if i % 3), key=lambda i: hashlib.sha256(f"z|{i}".encode()).hexdigest())[:7]
    assert [k for s, k in got if s == "a"] == sorted(best) and sum(s == "b" for s, _ in got) == 30
    assert [r.k for r in sampling.round_robin(d, "s", "k", 4).collect()] == [1, 0, 2, 3]
    assert sampling.pack_largest_first([("a", 5), ("b", 4), ("c", 3), ("d", 1)], 9) == (["a", "b"], 9)
    assert [r.k for r in sampling.evenly_spaced(d, "k", 3).orderBy("k").collect()] == [0, 44, 89]


def test_components_against_union_find(spark):
    rng = random.Random(3)
    for n, m in ((60, 40), (200, 150), (30, 0)):
        edges = [(rng.randrange(n), rng.randrange(n)) for _ in range(m)] + ([(i, i + 1) for i in range(40)] if n == 200 else []) + [(None, 1), (2, 2)]
        parent = list(range(n))

        def find(x):
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        for a, b in edges:
            if a is not None:
                ra, rb = find(a), find(b)
                parent[max(ra, rb)] = min(ra, rb)
        got = dict(rows(graph.components(spark.createDataFrame(edges, "src int, dst int"), spark.range(n).selectExpr("cast(id as int) id")), "node", "component"))
        assert got == {i: find(i) for i in range(n)}


def test_graph_measures(spark):
    e = spark.createDataFrame([("a", "b", 2), ("b", "c", 1)], "src string, dst string, weight int")
    n = spark.createDataFrame([("a", 1), ("b", 1), ("c", 2), ("d", 2)], "node string, g int")
    assert rows(graph.degrees(e, n)) == [("a", 1, 2), ("b", 2, 3), ("c", 1, 1), ("d", 0, 0)]
    assert rows(graph.density(e, n, "node", "g")) == [(1, 2, 2.0), (2, 2, 0.0)]
    assert rows(graph.cross_weights(e, n, "node", "g")) == [(1, 2, 1)]
    assert rows(graph.leaks(n.withColumn("x", F.lit("e")), "node", "x", "g")) == [("e", 2)]


def test_information(spark):
    from collections import Counter
    from math import log2

    rng = random.Random(5)
    data = [("k", rng.choice("AB"), rng.choice("AB"), rng.choice("ABC")) for _ in range(300)] + [("k", None, "A", "A"), ("c", "A", "A", "A"), ("c", "A", "A", "A")]
    df = spark.createDataFrame(data, "k string, f string, y string, l string")

    def h(*cols):
        c = Counter(zip(*cols))
        n = sum(c.values())
        return -sum(v / n * log2(v / n) for v in c.values())

    f, y, l = zip(*[d[1:] for d in data[:300]])
    r = {x.k: x for x in information.decomposition(df, ["k"], "f", "y", "l").collect()}
    assert r["k"].i_f_y == pytest.approx(h(f) + h(y) - h(f, y)) and r["k"].i_f_y_given == pytest.approx(h(f, l) + h(y, l) - h(l) - h(f, y, l)) and r["c"].ratio is None
    assert {x.k: x.entropy for x in information.entropy(df, ["k"], ["f"]).collect()}["k"] == pytest.approx(h(f))
    skew = spark.createDataFrame([("k", x, x if rng.random() < 0.8 else "B") for x in "ABAB" * 60] + [("n", rng.choice("AB"), rng.choice("AB")) for _ in range(200)], "k string, f string, y string")
    band = {x.k: x for x in information.permutation_band(skew, ["k"], "f", "y", 100).collect()}
    assert band["k"].clears and band["k"].null_mean < 0.05 and band["n"].information < band["n"].null_p95 * 3
    boot = information.bootstrap_accuracy(spark.createDataFrame([("k", int(i % 4 > 0), i // 5) for i in range(400)], "k string, c int, e int"), ["k"], "c").first()
    assert boot.mean == 0.75 and 0.68 < boot.low < 0.75 < boot.high < 0.82
    assert information.channel_information(information.channel_for(0.7)) == pytest.approx(0.7) and information.channel_information(0.25) == pytest.approx(0)


def test_gates(spark):
    df = spark.createDataFrame([(1, 0.5, 0.5, "x"), (1, 0.7, 0.4, None), (2, float("nan"), 0.5, "y")], "k int, a double, b double, r string")
    ref = spark.createDataFrame([("x",)], "r string")
    got = {r.name: (r.passes, r.n_violations) for r in gates.suite([("unique", gates.unique(df, ["k"])), ("prob", gates.probability_rows(df, ["a", "b"], ["k"])), ("fk", gates.foreign_key(df, "r", ref, "r")), ("null", gates.not_null(df, ["r"], ["k"])), ("rows", gates.row_count(df, 3)), ("nested", gates.nested([("s", df.where("k = 1")), ("l", df)], "k")), ("covers", gates.covers(df, ["k"], spark.createDataFrame([(1,), (9,)], "k int")))]).collect()}
    assert got == {"unique": (False, 1), "prob": (False, 2), "fk": (False, 1), "null": (False, 1), "rows": (True, 0), "nested": (True, 0), "covers": (False, 1)}
    spans = spark.createDataFrame([("a", 0, 3), ("a", 3, 5), ("b", 0, 3), ("b", 2, 5), ("c", 1, 2)], "g string, s int, e int")
    assert rows(gates.contiguous(spans, ["g"], "s", "e")) == [("b",), ("c",)]
    assert dict(rows(gates.constant_columns(df, ["k", "b"]))) == {"k": "varies", "b": "varies"}
    with pytest.raises(ValueError):
        gates.forbidden_columns(spark.createDataFrame([((1,),)], "s struct<Secret:int>"), ["secret"])
