from collections import Counter, defaultdict

from tests_llm_helpers import ENCODER
from windrow.llm import mixing


def tables(spark, n=400):
    docs = [(i, "big" if i % 3 else "small" if i % 2 else "tiny", f"doc {i} " + "word " * (1 + i % 17)) for i in range(n)]
    docs += [(n, None, "no source"), (n + 1, "unlisted", "x y z"), (n + 2, "big", None), (n + 3, "big", ""), (n + 4, "small", "same " * 9), (n + 5, "small", "same " * 9)]
    t = [("big", 0.5, 2), ("small", 0.3, 3), ("tiny", 0.2, 4), ("absent", 0.4, 2), (None, 0.1, 1), ("big", 0.5, 2)]
    return spark.createDataFrame(docs, "doc_id long, source string, text string"), spark.createDataFrame(t, "source string, target_weight double, max_repeats int")


def test_shares_repeats_and_budget(spark):
    docs, targets = tables(spark)
    rows = mixing.mix(docs, targets).collect()
    size = {r.doc_id: len(ENCODER.encode(r.text)) for r in docs.collect()}
    assert all(r.n_tokens == size[r.doc_id] and r.n_tokens > 0 for r in rows)
    used = Counter((r.doc_id, r.source) for r in rows)
    most = {"big": 2, "small": 3, "tiny": 4}
    assert all(c <= most[s] for (_, s), c in used.items()) and len({(r.doc_id, r.repeat) for r in rows}) == len(rows)
    tokens = defaultdict(int)
    for r in rows:
        tokens[r.source] += r.n_tokens
    whole = sum(tokens.values())
    for s, w in (("big", 0.5), ("small", 0.3), ("tiny", 0.2)):
        assert abs(tokens[s] / whole - w) < 0.02
    # a second copy only after every document of the source was used once
    by = defaultdict(set)
    for r in rows:
        by[r.source, r.repeat].add(r.doc_id)
    for (s, k), ids in by.items():
        if k:
            assert len(by[s, k - 1]) == sum(1 for d in docs.collect() if d.source == s and d.text)
    # positions are the running sum in the order of finish times
    order = sorted(rows, key=lambda r: r.position)
    assert [r.finish for r in order] == sorted(r.finish for r in order)
    total = 0
    for r in order:
        total += r.n_tokens
        assert r.position == total


def test_against_brute_force_order(spark):
    docs, targets = tables(spark, 60)
    rows = mixing.mix(docs, targets, seed=3).collect()
    served = defaultdict(int)
    weight = {"big": 0.5, "small": 0.3, "tiny": 0.2}
    for r in sorted(rows, key=lambda r: r.finish):
        served[r.source] += r.n_tokens
        assert abs(r.finish - served[r.source] / weight[r.source]) < 1e-6


def test_budget_beyond_capacity_and_empty(spark):
    docs, targets = tables(spark, 60)
    rows = mixing.mix(docs, targets, budget=10**9).collect()
    assert max(Counter(r.doc_id for r in rows if r.source == "tiny").values()) == 4
    s = {r.source: r for r in mixing.shares(mixing.mix(docs, targets, budget=10**9), targets).collect()}
    assert s["absent"].n_tokens == 0 and abs(sum(r.actual_share for r in s.values()) - 1) < 1e-6
    assert mixing.mix(docs.limit(0), targets).count() == 0
    assert mixing.mix(docs, targets.limit(0)).count() == 0


def test_the_plan_is_the_same_whatever_the_partitions(spark):
    docs, targets = tables(spark, 90)
    a = {(r.doc_id, r.repeat, r.position) for r in mixing.mix(docs, targets).collect()}
    b = {(r.doc_id, r.repeat, r.position) for r in mixing.mix(docs.repartition(7), targets).collect()}
    assert a == b
