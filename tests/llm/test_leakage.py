import random

import pytest

from windrow.llm import leakage

rng = random.Random(1)
WORDS = [f"w{i}" for i in range(60)] + ["the", "of", "in", "and"] * 6
ITEMS = [(f"q{i}", " ".join(rng.choice(WORDS) for _ in range(rng.randint(5, 40)))) for i in range(120)]


def brute(text):
    w = leakage.words_of(text)
    grams = {tuple(w[i : i + 8]) for i in range(len(w) - 7)}
    return {k for k, t in ITEMS for x in [leakage.words_of(t)] if any(tuple(x[i : i + 8]) in grams for i in range(len(x) - 7))}


def passages(n):
    out = []
    for _ in range(n):
        w = [rng.choice(WORDS) for _ in range(rng.randint(0, 60))]
        if rng.random() < 0.6:
            item = rng.choice(ITEMS)[1].split()
            k = rng.randint(5, 12)
            s = rng.randint(0, max(0, len(item) - k))
            w[3:3] = item[s : s + k]
        out.append(" ".join(w))
    return out


def test_retrieval_loses_nothing():
    texts = passages(600)
    index = leakage.Index(ITEMS)
    assert index.search(texts) == [brute(t) for t in texts]


QUESTION = "Suppose a keeper moves ten trays holding wind-swept mosses from the river into cellars where low light lasts five days"
CASES = {
    "case": QUESTION.upper(), "punctuation": QUESTION.replace(" ", ", "), "spacing": QUESTION.replace(" ", " \n "), "markup": "<p>" + " ".join(f"<i>{w}</i>" if i % 3 else f"**{w}**" for i, w in enumerate(QUESTION.split())) + "</p>", "width": "".join(chr(ord(c) + 0xFEE0) if "!" <= c <= "~" else c for c in QUESTION),
    "hidden": "­".join(QUESTION).replace("­ ­", " "), "zero width": "​".join(QUESTION), "broken": QUESTION.replace("holding", "hold-\ning").replace("cellars", "cel-\nlars"), "lookalike": QUESTION.replace("a", "а").replace("e", "е"), "entity": QUESTION.replace(" ", "&nbsp;"), "accents": QUESTION.replace("e", "é"), "hyphen at the end": QUESTION.replace("wind-swept", "wind-\nswept"), "part": "It was said: " + " ".join(QUESTION.split()[4:12]) + " and no more.",
}


@pytest.mark.parametrize("name", CASES)
def test_forms(name):
    index = leakage.Index([("q", QUESTION), ("other", "a b c d e f g h i j")])
    assert index.search([f"Before it. {CASES[name]} After it."]) == [{"q"}]


def test_seven_words_or_a_word_between_are_none():
    index = leakage.Index([("q", QUESTION)])
    w = leakage.words_of(QUESTION)
    assert index.search([" ".join(w[4:11]), " ".join([*w[:7], "indeed", *w[7:14]])]) == [set(), set()]


def test_edges(spark):
    items = spark.createDataFrame([("q1", QUESTION, None), ("q1", QUESTION, None), ("q2", "too short", QUESTION + " twice over"), (None, QUESTION, None)], "question_id string, question string, correct_text string")
    shards = leakage.index_items(items, "question_id", ["question", "correct_text"])
    df = spark.createDataFrame([("a", None), ("b", ""), ("c", QUESTION), ("c", QUESTION), ("d", "filler " * 30_000 + QUESTION)], "rec_key string, text string").selectExpr("*", "1 as question_id", "2 as text2")
    got = {(r.rec_key, r.question_id) for r in leakage.find_leaks(df, ["rec_key"], "text", shards).collect()}
    assert got == {("c", "q1"), ("c", "q2"), ("d", "q1"), ("d", "q2")}
    assert leakage.find_leaks(df.limit(0), ["rec_key"], "text", shards).collect() == []
    empty = leakage.index_items(items.limit(0), "question_id", ["question"])
    assert leakage.find_leaks(df, ["rec_key"], "text", empty).collect() == []


def test_several_shards_find_what_one_finds(monkeypatch, spark):
    monkeypatch.setattr(leakage, "SHARD", 25)
    items = spark.createDataFrame(ITEMS, "question_id string, question string")
    shards = leakage.index_items(items, "question_id", ["question"])
    assert len(shards) == 5
    texts = passages(150)
    assert [set().union(*(s.search([t])[0] for s in shards)) for t in texts] == [brute(t) for t in texts]


@pytest.mark.parametrize("most", [{"most_items": 10}, {"most_bytes": 1}, {}])
def test_groups_of_items_find_what_one_finds(spark, most):
    items = spark.createDataFrame(ITEMS, "question_id string, question string")
    texts = passages(80)
    df = spark.createDataFrame(list(enumerate(texts)), "k int, text string")
    some = {(i, q) for i, t in enumerate(texts) for q in brute(t)}
    if "most_bytes" in most:
        items = items.where("question_id in ('q1', 'q2', 'q3', 'q4')")
        some = {x for x in some if x[1] in ("q1", "q2", "q3", "q4")}
    assert {tuple(r) for r in leakage.find_item_leaks(df, ["k"], "text", items, "question_id", ["question"], **most).collect()} == some


def test_pivots_lose_nothing(monkeypatch):
    monkeypatch.setattr(leakage, "DENSE_BYTES", 0)
    texts = passages(300)
    index = leakage.Index(ITEMS)
    assert index.maxima is None and index.search(texts) == [brute(t) for t in texts]
