import random

import pytest

from windrow.llm import truncation as T

rng = random.Random(2)
DIMS, PLACES, NAMES = ["wing span", "root depth", "leaf margin", "shell thickness"], ["Dremip Reach", "Lirgno Point", "Heltel Fell"], ["Orla vescaria", "Tindra mollisata", "Kasper brunatula"]
FORMS = ["The {d} of {n} rose by {i} percent near {p}.", "At {p} the decline in {d} was linked to dense shade rather than to trampling.", "Volunteers recorded {i} individuals of {n} with pitfall lines.", "Because the ditch floods in midsummer, {n} feeds beside higher ground instead.", "L'espèce {n} vit près de {p}, surtout dans les prairies humides.", "観察記録：{i}日後、{n}に変化が見られた。"]


def sentence(k=None):
    f = rng.choice(FORMS[:4]) if k is None else FORMS[k]
    return f.format(d=rng.choice(DIMS), n=rng.choice(NAMES), p=rng.choice(PLACES), i=rng.randint(2, 400))


def prose(n=5):
    return " ".join(sentence() for _ in range(n))


TRAIN = [prose() for _ in range(400)] + [sentence(4) + " " + sentence(4) for _ in range(40)] + [prose(2).rstrip(".") + " — end of part" for _ in range(8)]


@pytest.fixture(scope="module")
def model():
    return T.EndModel(TRAIN)


def test_cut_prose_is_found_and_whole_prose_is_not(model):
    whole = [prose() for _ in range(150)]
    assert not any(T.is_cut(t, model) for t in whole)
    bare = [t.rstrip(".") for t in whole]  # only the full stop lacks
    assert sum(bool(T.is_cut(t, model)) for t in bare) <= 2
    cut = []
    for t in whole:
        last = t.rstrip(".").rfind(". ") + 2
        cut.append(t[: rng.randint(last + 8, len(t) - 6)])
    assert sum(bool(T.is_cut(t, model)) for t in cut) >= 0.9 * len(cut)


@pytest.mark.parametrize("text,why", [("It stands by the riv�", "character"), ('{"text": "A fen lies', "structure"), ('{"a": [1, 2', "structure"), ("```json\n{}", "structure"), ("Volunteers recorded 5 individuals of,", "sentence"), ("| a | b |\n|---|---|\n| c", "structure"), ('One said: "It was the', "structure"), ("The root depth of Orla vescaria rose by 5 perc [...]", "word"), ("At Dremip Reach the decline in leaf…", "sentence")])
def test_kinds(model, text, why):
    assert T.is_cut(text, model) == why


@pytest.mark.parametrize("text", [None, "", "  \n", "B", "(b)", "yes", "- Orla vescaria, Dremip Reach\n- Tindra mollisata, Heltel Fell", prose() + "\n\nTable 3. Counts of Orla vescaria at Heltel Fell", '{"text": "All is well."}', "```json\n{\"a\": 1}\n```", "| a | b |\n|---|---|\n| c | d |", prose(2) + " (Heltel Fell, sheet 3)", prose(2) + ' One wrote: "We saw it."', prose(2).rstrip(".") + "!", prose(2).rstrip(".") + " — end of part", "==== ))) (((( ////"])
def test_sound(model, text):
    assert T.is_cut(text, model) is None


def test_options_are_whole(model):
    assert T.is_cut("C) a gain in root depth that fades before the", model, options=frozenset(["C) a gain in root depth that fades before the"])) is None


def test_spikes_and_operator(spark, model):
    rows = []
    for i in range(400):
        t = prose(rng.randint(2, 7))
        rows.append((f"a{i}", "s1" if i % 2 else None, t[:300] if i % 2 else t, 1))
    rows += [("n", "s1", None, 1), ("e", "s1", "", 1)]
    df = spark.createDataFrame(rows, "k string, src string, text string, source int")
    from pyspark.sql import functions as F

    spiky = T.spikes(df, F.col("src"), F.col("text"))
    assert ("c", 300) in spiky["s1"] and not spiky.get("")
    got = {r.k: r.cut for r in T.find_truncated(df.drop("source"), ["k"], "text", F.col("src"), model).collect()}
    cut = {r[0] for r in rows if r[1] == "s1" and r[2] and len(r[2]) == 300 and not r[2].rstrip().endswith(".")}
    assert cut <= set(got) and "n" not in got and "e" not in got
    assert len(set(got) - cut) <= 4
    assert T.find_truncated(df.drop("source").limit(0), ["k"], "text", F.col("src"), model).collect() == []
    share = {r.source: r for r in T.shares_cut(df.select("k", F.col("src").alias("source")), spark.createDataFrame([(k,) for k in got], "k string"), ["k"]).collect()}
    assert share["s1"].n_cut == len([k for k in got if dict((r[0], r[1]) for r in rows)[k] == "s1"])


def test_fit_on_an_empty_table(spark):
    m = T.fit_ends(spark.createDataFrame([], "k string, t string"), "k", "t")
    assert T.is_cut("any text at all without an end", m) is None and T.is_cut('{"a": ', m) == "structure"


def test_beyond_the_bound_spikes_are_joined(spark, model):
    from pyspark.sql import functions as F

    rows = [(f"a{i}", ("s1", "s2", None)[i % 3], t[:200] if i % 3 == 0 else t[:310] if i % 2 else t) for i, t in enumerate(prose(rng.randint(2, 7)) for _ in range(500))]
    df = spark.createDataFrame([*rows, ("n", None, None), ("e", "s1", "")], "k string, src string, text string")
    known, joined = (sorted(map(tuple, T.find_truncated(df, ["k"], "text", F.col("src"), model, m).collect()), key=str) for m in (1000, 0))
    assert known == joined and len(known) > 50
    maxima = {(r.source, r.n) for r in T.length_spikes(df, F.col("src"), F.col("text")).where("at_maximum").collect()}
    assert ("s1", 200) in maxima


def test_enclosing_elements_and_list_items(model):
    assert T.is_cut("<answer>\nThe wing span rose near the fen.", model) == "structure"
    assert T.is_cut("<answer>\nThe wing span rose near the fen.\n</answer>", model) is None
    assert T.is_cut("A line break<br>is no element that must end.", model) is None
    assert T.open_structure("(" + "word " * 900) == "bracket or quotation"


def test_the_model_counts_every_row(spark, monkeypatch):
    """A sample of ten rows knew next to no word; counted in tasks that give on early, it judges its texts as a model of all does."""
    texts = [prose(rng.randint(1, 4)) for _ in range(150)]
    texts += [t[: rng.randint(20, len(t) - 3)] for t in texts[:80]] + ["- " + t[:40] for t in texts[:10]] + ["Orla vescaria, Dremip Reach, in the fen"] * 150
    df = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)] + [("n", None), ("e", "")], "k string, t string")
    monkeypatch.setattr(T, "HELD_COUNTS", 50)
    got, counts = T.fit_ends(df.repartition(3), "k", "t", 10), T.Counts()
    for t in texts:
        counts.add(t)
    want = T.EndModel.of_counts(counts.all(), len(texts), 10)
    assert [T.is_cut(t, got) for t in texts] == [T.is_cut(t, want) for t in texts]
    assert sum(T.is_cut(t, got) in ("word", "sentence") for t in texts[150:230]) >= 60
    assert not set(got.seen) - set(want.seen) and got.bare <= want.bare == {T.hash_of(["in", "the", "fen"])}
    assert all(got.seen[k] == want.seen[k] and got.ends.get(k) == want.ends.get(k) for k in got.seen)


def test_ends_are_tested_once_and_on_their_last_signs(spark):
    """The pattern went over each whole text twice, once for either unit of length."""
    from pyspark.sql import functions as F

    ends = [".", "!", "?", "。", "؟", "।", ")", "”", "|", "a", ",", "", " ", "\u2028", "\r\n", "\n"]
    afters = ["", " ", "\n", '"', "”)]", "|", "\u2028", " \x85", "\xa0", "x"] + [c * n for c in (" ", "*", "\n", ")", "\r\n") for n in (30, 31, 32, 33, 90)]
    df = spark.createDataFrame([(b + e + a,) for b in ("", "The fen is wet", "𝒜 日本", "y" * 40) for e in ends for a in afters if b + e + a], "t string")
    assert df.where(T.ends_soundly(F.col("t")) != F.col("t").rlike(T.SOUND_END)).collect() == []
    assert 50 < df.where(T.ends_soundly(F.col("t"))).count() < df.count() - 50
    plan = T.length_spikes(df, F.lit("s"), F.col("t"))._jdf.queryExecution().optimizedPlan().toString().splitlines()
    doubled = next(i for i, line in enumerate(plan) if "Generate" in line)
    assert [i > doubled for i, line in enumerate(plan) if "RLIKE" in line] == [True]


@pytest.mark.parametrize("held", [0, 2000, 1 << 24])
def test_pieces_have_the_words_of_their_lines(monkeypatch, held):
    """Words are looked for once a piece between spaces, not once a line; the counts are those of lines, whatever is held."""
    texts = [prose(rng.randint(1, 3)) for _ in range(60)] + [sentence(5) + "\n" + sentence(4) for _ in range(10)]
    texts += [t[: rng.randint(5, len(t))] for t in texts] + ["A fen\n\n  of Orla\tvescaria\r\nin the fen ", "\n", " ", '{"text": "One line\\nand the next of the fen"}', "in the fen", "日本 の fen,well-known it's\x1f[...]"] * 4
    asked, want = T.Asked(), T.Counts()
    for t in texts:
        T.is_cut(t, asked)
        want.add(t)
    monkeypatch.setattr(T, "HELD_PIECES", held)
    monkeypatch.setattr(T, "words_of", None)
    got = T.AskedCounts(asked)
    for i in range(0, len(texts), 25):
        got.add(texts[i : i + 25])
    of = {"seen": asked.contexts, "bare": asked.closes, "known": asked.words, "begins": asked.words}
    assert sorted(got.all()) == sorted(x for x in want.all() if x[1] in of[x[0]]) and {x[0] for x in got.all()} == {*of}


@pytest.mark.parametrize("text,left", [('{"a": "b\\"}', "JSON string"), ('{"a": "b\\\\"}', None), ('{"a": "b\\', "JSON string"), ('{"a": "}{", "b": [1', "JSON"), ('{"a": 1}}} {', "JSON"), ('["a\n\\\nb"]', None)])
def test_strings_and_signs_of_json(text, left):
    assert T._json_stack(text) == left
