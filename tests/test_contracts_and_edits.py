import difflib
import json
import math
import random
import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from windrow.functions import edits
from windrow.functions import values as V
from windrow.operators import allocation, contracts, gates, graph, joins, resampling, windows
from windrow.sources import readers, sinks


def rows(df, *cols):
    return sorted((tuple(r[c] for c in cols or df.columns) for r in df.collect()), key=str)


def test_floor_and_fill():
    rng = random.Random(3)
    for _ in range(300):
        counts = {f"s{i}": rng.randint(0, 40) for i in range(rng.randint(1, 9))}
        live = {k: n for k, n in counts.items() if n}
        floor, total = rng.randint(0, 4), rng.randint(0, 60)
        if floor * len(live) > total or sum(live.values()) < total:
            with pytest.raises(ValueError):
                allocation.floor_and_fill(counts, total, floor)
            continue
        got = allocation.floor_and_fill(counts, total, floor)
        assert all(min(floor, live[k]) <= n <= live[k] for k, n in got.items()) and set(got) == set(live)
        assert sum(got.values()) == max(total, sum(min(floor, n) for n in live.values()))
    assert allocation.floor_and_fill({"a": 10, "b": 10, "c": 80}, 20, 2) == {"a": 3, "b": 3, "c": 14}


def test_greedy_quotas():
    rng = random.Random(4)
    for _ in range(200):
        counts = {f"s{i}": rng.randint(1, 30) for i in range(rng.randint(1, 8))}
        total = rng.randint(len(counts), 50)
        got = allocation.greedy_quotas(counts, total)
        assert sum(got.values()) == min(total, sum(counts.values())) and all(1 <= got[k] <= counts[k] for k in counts)
    assert allocation.greedy_quotas({"a": 1, "b": 1}, 5) == {"a": 1, "b": 1}
    with pytest.raises(ValueError):
        allocation.greedy_quotas({"a": 9, "b": 9, "c": 9}, 2)


def test_pack_sections_and_agglomerate():
    rng = random.Random(5)
    for _ in range(200):
        sizes = {f"s{i:02d}": rng.randint(0, 90) for i in range(rng.randint(0, 12))}
        bins = allocation.pack_sections(sizes)
        assert sum(n for b in bins for _, n in b) == sum(sizes.values()) and all(sum(n for _, n in b) <= 40 for b in bins)
        assert {k for b in bins for names, _ in b for k in names} == {k for k, n in sizes.items() if n}
    for _ in range(200):
        names = [f"g{i}" for i in range(rng.randint(1, 9))]
        sizes = {k: rng.randint(1, 6) for k in names}
        weights = {(a, b): rng.randint(0, 5) for a in names for b in names if a < b and rng.random() < 0.5}
        home = allocation.agglomerate(sizes, weights)
        total = {h: sum(sizes[k] for k in names if home[k] == h) for h in set(home.values())}
        assert set(home) == set(names) and all(home[h] == h and h == min(k for k in names if home[k] == h) for h in total)
        assert all(n >= 3 for n in total.values()) or len(total) == 1
    assert allocation.agglomerate({"a": 1, "b": 9, "c": 4}, {("a", "b"): 9, ("a", "c"): 2}) == {"a": "a", "b": "a", "c": "c"}


def test_fixed_point_against_brute_force(spark):
    rng = random.Random(6)
    links = {(f"e{rng.randint(0, 25)}", f"i{rng.randint(0, 25)}") for _ in range(70)}
    kept = set(links)
    while True:
        bad = {x for x in kept if sum(y[0] == x[0] for y in kept) < 3 or sum(y[1] == x[1] for y in kept) < 2}
        if not bad:
            break
        kept -= bad
    df = spark.createDataFrame([*links, *list(links)[:3], (None, "i1"), ("e1", None)], "entity string, item string")
    assert rows(allocation.core_of(df, "entity", "item", 3, 2)) == sorted(kept)
    assert allocation.core_of(df.limit(0), "entity", "item", 3, 2).count() == 0


def test_ranked_choices(spark):
    df = spark.createDataFrame([(1, "a red fox", ["a red hen", "a red fox", None, "blue", "a red owl in it"]), (2, None, ["x"]), (3, "!!", ["??", "a"])], "k int, r string, o array<string>")
    got = {r.k: r.x for r in df.select("k", allocation.ranked_choices(F.col("r"), F.col("o")).alias("x")).collect()}
    assert got[1] == ["a red hen", "a red owl in it", "blue"] and got[2] == [] and got[3] == ["??", "a"]


PAIRS = [("the red fox ran", "the blue fox ran"), ("the red fox", "the red fox"), ("a b c", "a x c y"), ("one two. three four.", "one two. three five."), ("", "x"), ("x", ""), (None, "x"), ("x", None), ("Ein Haus, ein Baum.", "Ein Haus, zwei Bäume."), ("a " * 400 + "b", "a " * 400 + "c")]


def test_edits_against_difflib(spark):
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(PAIRS)], "k int, l string, r string").withColumn("diff", F.lit(1))
    got = {r.k: r for r in edits.minimal_pairs(df, "k", "l", "r").collect()}
    for i, (a, b) in enumerate(PAIRS):
        if a is None or b is None:
            assert i not in got
            continue
        x, y = re.findall(r"\w+|[^\w\s]", a), re.findall(r"\w+|[^\w\s]", b)
        changed = [o for o in difflib.SequenceMatcher(None, x, y, autojunk=False).get_opcodes() if o[0] != "equal"]
        sole = len(changed) == 1 and changed[0][0] == "replace"
        assert (i in got) == sole
        if sole:
            assert (got[i].first, got[i].last) == changed[0][1:3] and got[i].left_part in a and got[i].right_part in b
    diffs = {r.k: r.diff for r in edits.rendered_diffs(df, "k", "l", "r").collect()}
    assert diffs[0] == "the [-red-] {+blue+} fox ran" and diffs[1] == "the red fox" and diffs[4] == "{+x+}" and 6 not in diffs
    for i, d in diffs.items():  # the diff gives both texts back
        left = " ".join(re.sub(r"\{\+.*?\+\}", "", d).replace("[-", "").replace("-]", "").split())
        assert left == " ".join(PAIRS[i][0].split())
    aligned = {r.k: (r.sentence, r.aligned) for r in edits.aligned_sentences(df, "k", "l", "r").collect()}
    # runs that both texts share count as a whole, so what lies against a sentence may begin before it
    assert aligned[3] == ("three four.", "one two. three five.") and 1 not in aligned
    assert edits.minimal_pairs(df.limit(0), "k", "l", "r").collect() == []


def test_sentences_and_residual_terms(spark):
    text = "One is here. Two, e.g. this, is there.  Three!"
    for i in range(len(text)):
        s = edits.containing_sentence(text, i)
        assert s is None or text[s[0] : s[1]] in ("One is here.", "Two, e.g. this, is there.", "Three!")
    assert edits.containing_sentence(text, 0) == (0, 12) and edits.containing_sentence("", 0) is None
    df = spark.createDataFrame([(1, "Red Fox", "a red  fox!"), (2, "fox", "foxes"), (3, None, "x"), (4, "--", "a -- b"), (5, "x", None)], "k int, t string, x string")
    assert [r.v for r in df.select("k", edits.still_there(F.col("t"), F.col("x")).alias("v")).orderBy("k").collect()] == [True, False, None, False, None]


def test_names(spark):
    d = spark.createDataFrame([("o1", "Alba mira"), ("o2", "A. mira"), ("o3", "alba  mira"), ("o4", "mira"), ("o5", "B. rara"), ("o6", "Bora rara"), ("o7", "Bela rara"), ("o8", None), ("o1", "Alba mira")], "k string, n string")
    got = rows(edits.merge_candidates(d, "k", "n"))
    assert ("o1", "o3", ["normalization"]) in got and ("o1", "o2", ["abbreviation"]) in got and ("o1", "o4", ["epithet_containment"]) in got and not any("o5" in g[:2] for g in got)
    full = spark.createDataFrame([("Alba mira",), ("Bora rara",), ("Bela rara",), ("Alba",)], "f string")
    assert rows(edits.expanded(d, "k", "n", full, "f")) == [("o2", "A. mira", "Alba mira", 1), ("o5", "B. rara", None, 2)]


def test_contracts(spark):
    tree = spark.createDataFrame([("g", None, "genus"), ("s", "g", "species"), ("bad", "g", "genus"), ("lost", "zz", "species"), ("odd", None, "phylum"), ("none", None, None), ("two", "s", "species")], "k string, p string, l string")
    assert rows(contracts.taxonomy(tree, "k", "p", "l", "genus", "species")) == [("bad", "top with parent"), ("lost", "parent"), ("none", "level"), ("odd", "level"), ("two", "parent")]
    a, b = (contracts.manifest(spark.createDataFrame(x, "k int, t string"), ["k"], "t") for x in ([(1, "x"), (2, "y"), (3, None), (4, "q")], [(1, "x"), (2, "z"), (3, None), (5, "n")]))
    assert rows(contracts.manifest_changes(a, b, ["k"])) == [(2, "changed"), (4, "missing"), (5, "unexpected")]
    x = spark.createDataFrame([("g", 1, "a"), ("g", 2, "b"), ("h", 1, "a"), ("h", 2, "b"), ("i", 1, "a")], "g string, p int, i string")
    y = spark.createDataFrame([("g", 1, "a"), ("g", 2, "b"), ("h", 1, "b"), ("h", 2, "a"), ("i", 1, "z")], "g string, p int, i string")
    assert rows(contracts.ordered_equal(x, y, ["g"], "p", "i")) == [("g", 2, 2, True, True), ("h", 2, 2, True, False), ("i", 1, 1, False, False)]
    cells = spark.createDataFrame([("F", "T", True), ("F", "T", True), ("F", "W", True), ("F", "W", False)], "r string, c string, ok boolean")
    assert rows(contracts.polarity(cells, "r", "c", "ok", [("F", "T", True), ("F", "W", False), ("W", "W", True)])) == [("F", "T", True, True, True), ("F", "W", False, None, False), ("W", "W", True, None, False)]
    ag = spark.createDataFrame([("a", "a")] * 51 + [("a", "b")] * 9, "x string, y string")
    assert rows(contracts.agreement(ag, "x", "y", 0.85)) == [(60, 51, 0.85, True)] and not contracts.agreement(ag, "x", "y", 0.85, rows=100).first().passes
    assert not contracts.agreement(ag.limit(0), "x", "y", 0.85).first().passes
    p, q = (spark.createDataFrame(r, "run string, s int, k int, n int") for r in ([("r", 0, 5, 10), ("r", 1, 5, 10), ("r", 2, 9, 10)], [("r", 0, 5, 10), ("r", 1, 6, 10), ("r", 2, 1, 10)]))
    assert [r.passes for r in contracts.replication(p, q, ["run"], "s", "k", "n", 0.11).orderBy("s").collect()] == [True, True, False]
    f, s = (spark.createDataFrame(r, "k string, v double") for r in ([("a", 1.0), ("b", 2.0), ("c", None)], [("a", 1.05), ("b", 3.0), ("c", None), ("d", 1.0)]))
    assert {r.k: r.state for r in contracts.regression(f, s, ["k"], "v", 0.1).collect()} == {"a": "equal", "b": "differs", "c": "equal", "d": "missing"}
    j = spark.createDataFrame([(1, '{"a": 1, "b": "x"}'), (2, '{"a": "1", "b": "x"}'), (3, '{"a": 1.5}'), (4, "[1]"), (5, "no"), (6, None), (7, '{"a": null, "b": ""}')], "k int, p string")
    bad = {r.id: r.problems for r in contracts.typed_record(j, "p", [("a", "number"), ("b", "string")], ["k"]).collect()}
    assert bad == {"2": ["type a"], "3": ["missing b"], "4": ["no object"], "5": ["no object"], "6": ["no object"], "7": bad["7"]} and bad["7"][0].endswith("a")
    one = contracts.table_digest(x, ["g", "p", "i"]).first()
    assert one == contracts.table_digest(x.orderBy(F.rand(1)), ["g", "p", "i"]).first() and one != contracts.table_digest(y, ["g", "p", "i"]).first()
    with pytest.raises(Exception, match="no row for z"):
        contracts.exact_view(x, "i", spark.createDataFrame([("a",), ("z",)], "i string")).collect()
    r = rows(gates.suite_of_rules(x, "i", [("p", F.col("p") > 1), ("all", F.lit(True)), ("null", F.lit(None).cast("boolean"))]))
    assert r == [("all", True, 0, None), ("null", False, 5, "a"), ("p", False, 3, "a")]


def test_values_and_joins(spark):
    inf = float("inf")
    for v in ([], [1.0], [1.0, 3.0], [1.0, inf], [inf, inf], [1.0, 2.0, inf], [1.0, inf, inf]):
        got = spark.createDataFrame([(v,)], "v array<double>").select(V.extended_median(F.col("v")).alias("m")).first().m
        n = len(v)
        assert got == (None if not v else v[n // 2] if n % 2 else v[n // 2] if math.isinf(v[n // 2]) else (v[n // 2 - 1] + v[n // 2]) / 2)
    a = spark.createDataFrame([("g", "x", 1), ("g", "y", 2), ("h", "q", 3)], "g string, i string, v int")
    z = rows(joins.zipped(a, a.where("v <> 1"), ["g"], "i", ["v"]))
    assert z == [("g", "x", 1, "y", 2, False), ("h", "q", 3, "q", 3, True)]
    lab = spark.createDataFrame([("a", "a"), ("b", "a"), ("c", "c"), ("d", "c"), ("e", "e")], "node string, component string")
    assert rows(graph.largest(lab), "node") == [("a",), ("b",)] and graph.largest(lab.limit(0)).count() == 0
    curve = spark.createDataFrame([(1, 5), (2, 8), (3, 9)], "rank int, covered int")
    assert rows(windows.value_at(curve, "rank", "covered", [1, 3, 99])) == [(1, 5), (3, 9), (99, 9)]


def test_resampling(spark):
    d = spark.createDataFrame([("r", f"q{i:02d}", i % 2, i % 3) for i in range(40)], "run string, q string, a int, b int")
    picks = resampling.bootstrap_index(d, ["run"], "q", 50, "s").groupBy("draw").agg(F.count(F.lit(1)).alias("n")).collect()
    assert len(picks) == 50 and all(r.n == 40 for r in picks)
    assert rows(resampling.bootstrap_index(d, ["run"], "q", 5, "s")) == rows(resampling.bootstrap_index(d.repartition(7), ["run"], "q", 5, "s"))
    perm = resampling.permutation(d, ["run"], "q", 3, "s").groupBy("draw").agg(F.countDistinct("place").alias("p"), F.max("place").alias("m")).collect()
    assert all(r.p == r.m == 40 for r in perm)
    same = resampling.paired_bootstrap(d, ["run"], "q", "a", "a", 20, "s")
    assert {r.difference for r in same.collect()} == {0.0}
    v = spark.createDataFrame([("k", float(i)) for i in range(200)], "k string, v double")
    assert tuple(resampling.rank_interval(v, ["k"], "v").first()) == ("k", 200, 5.0, 195.0) and resampling.rank_interval(v, ["k"], "v", True).first().low == 4.0
    odd = spark.createDataFrame([("k", 1.0), ("k", float("inf")), ("k", float("nan")), ("k", None), ("z", None)], "k string, v double")
    assert rows(resampling.percentile_interval(odd, ["k"], "v")) == [("k", 1, 1.0, 1.0), ("z", 0, None, None)]
    t = spark.createDataFrame([("k", 5), ("k", 5), ("k", 4), ("k", 4), ("k", 3), ("k", None)], "k string, v int")
    assert tuple(resampling.top_k_threshold(t, ["k"], "v", 3).first()) == ("k", 4, 4) and tuple(resampling.top_k_threshold(t, ["k"], "v", 99).first()) == ("k", 3, 5)
    g = spark.createDataFrame([(3, 10), (8, 10), (6, 10), (0, 0)], "k int, n int").select(resampling.near_chance(F.col("k"), F.col("n")).alias("x"))
    assert [r.x for r in g.collect()] == ["near_chance", "high", "intermediate", None]


def test_sources_and_sinks(spark, tmp_path):
    schema = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.StringType())])
    table = pa.table({"a": pa.array(range(150), pa.int64()), "b": [str(i) for i in range(150)]})
    with pa.OSFile(str(tmp_path / "s.arrow"), "wb") as f, pa.ipc.new_stream(f, table.schema) as w:
        w.write_table(table)
    with pa.OSFile(str(tmp_path / "f.arrow"), "wb") as f, pa.ipc.new_file(f, table.schema) as w:
        w.write_table(table)
    got = readers.arrow_ipc(spark, str(tmp_path / "*.arrow"), schema, rows=64)
    assert got.count() == 300 and rows(got.distinct()) == sorted(((i, str(i)) for i in range(150)), key=str)
    with pytest.raises(Exception, match="expected"):
        readers.arrow_ipc(spark, str(tmp_path / "*.arrow"), T.StructType(schema.fields[:1])).collect()
    (tmp_path / "j" / "deep").mkdir(parents=True)
    (tmp_path / "j" / "a.jsonl").write_text('{"k": "1"}\n{"k": "1"}\nno\n\n')
    (tmp_path / "j" / "deep" / "b.jsonl").write_text('{"k": "2"}\n{"z": 1}\n')
    (tmp_path / "j" / "c.txt").write_text("x")
    prof = {r.file.rsplit("/", 1)[-1]: (r.n_rows, r.n_bad, r.n_repeated) for r in readers.profiled_lines(spark, str(tmp_path / "j"), "k").collect()}
    assert prof == {"a.jsonl": (3, 1, 1), "b.jsonl": (2, 0, 0)}
    e = tmp_path / "e"
    e.mkdir()
    for name, text in (("1.json", '{"x": "y", "n": 3}'), ("2.json", "{broken"), ("3.json", " ")):
        (e / name).write_text(text)
    env = {r.file.rsplit("/", 1)[-1]: (r.state, r.x, r.n) for r in readers.envelopes(spark, str(e), ["x", "n"]).collect()}
    assert env == {"1.json": ("sound", "y", "3"), "2.json": ("no object", None, None), "3.json": ("empty", None, None)}
    out = tmp_path / "v.json"
    sinks.write_atomically(str(out), {"b": 1, "a": [2]})
    sinks.write_atomically(str(out), {"b": 2, "a": [2]})
    assert json.loads(out.read_text()) == {"b": 2, "a": [2]} and sorted(p.name for p in tmp_path.glob(".v.json*")) == []
    with pytest.raises(TypeError):
        sinks.write_atomically(str(out), object())
    assert json.loads(out.read_text())["b"] == 2
    assert sinks.guarded(str(tmp_path / "x"), [str(tmp_path)]) and pytest.raises(PermissionError, sinks.guarded, str(tmp_path / ".." / "y"), [str(tmp_path)])
