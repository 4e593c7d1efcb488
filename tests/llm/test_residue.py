import pytest

from windrow.llm import residue

NAMES = ["Orla vesca", "Tindra molis", "Kasper bruna", "Velia porta"]
PROSE = [f"The {a} of {n} rose by {i} percent while a {b} wind eased in the {c}. Between the fen and the mere the species thins out, and its {a} becomes {d}. Young plants avoid standing water, which explains why every {b} meadow holds so few of them." for i, (a, b, c, d, n) in enumerate((a, b, c, d, n) for a in ("wing span", "root depth", "leaf margin") for b in ("dry", "late", "mossy") for c in ("thaw", "harvest", "autumn") for d in ("steady", "uneven") for n in NAMES)]
PROSE += [f"Les jeunes de {n} évitent la lumière et restent sous les pierres. Die Zählung ergab {i} Tiere, weit mehr als im Vorjahr am selben Ort." for i, n in enumerate(NAMES * 10)]
PROSE += [f'The recorder logged "503 service unavailable" for {i} minutes, so those counts came from the notebook. None of the {i} sheets has a null reading, and the undefined margin was left as drawn.' for i in range(2)]


@pytest.fixture(scope="module")
def model():
    return residue.ResidueModel(PROSE)


RESIDUE = [
    "Error 404: Not Found. The request could not be completed.", "Please enable JavaScript to view this page.", "503 Service Unavailable", '{"error":{"code":504,"message":"gateway timeout"}}', "Access denied. You do not have permission to open this record.",
    "<html><head><title>500 Internal Server Error</title></head><body><h1>Internal Server Error</h1></body></html>", "Bitte aktivieren Sie JavaScript, um diese Seite anzuzeigen.", "La page demandée est introuvable (erreur 404).",
    "Lorem ipsum dolor sit amet, consectetur adipiscing elit.", "xxx xxxxxx xxxx XXXXX xxx xxxx xxxxxx XXXXX.", "Text to follow.", "TBD - write the comparison before release.", "The name is {{ display_name }} and it lives here.", "It stands near ${locality} in spring.",
    "Its [value goes here] rose.", "Young <%= organism %> avoid shade.", "The plots at __LOCALITY__ were dry.", "The [INSERT HABITAT] is dry.", "It sits at <<season>> time.", "Rows of %(habitat)s are seen.", "Observers counted NaN individuals near null in undefined.", "The name is [object Object] and its place is None.",
]
SOUND = [
    "", "   \n\t", "​", "01234567890123456789" * 30, "====== ~~~~ ;;;; ))) (((", "A\x01B control \x7f marks ﻿ kept.", "The set {a, b, c} of plots was sampled 12 times (p < 0.05) [12].", "Entries marked [sic] or [...] keep the spelling.", "x" * 4000,
    'Labels followed the pattern "{genus}_{site}" and were checked by hand.', 'The recorder logged "503 service unavailable" for 26 minutes, so those counts came from the notebook.', "None of the 63 sheets has a null reading, and the undefined margin was left as drawn.", "| taxon | count |\n|---|---|\n| Orla vesca | 12 |",
]


@pytest.mark.parametrize("text", RESIDUE)
def test_residue_alone_and_within_prose(model, text):
    alone, within = model.find([text, f"{PROSE[0]}\n\n{text}\n\n{PROSE[1]}"])
    assert alone and within


@pytest.mark.parametrize("text", SOUND)
def test_sound(model, text):
    assert model.find([text]) == [[]]


def test_spans_lie_in_the_text(model):
    for text in RESIDUE:
        for a, b, _ in model.find([text])[0]:
            assert 0 <= a + 1 and a < b <= len(text) + 1


def test_batches_give_what_single_texts_give(model):
    texts = [*RESIDUE, *SOUND, *PROSE[:20]]
    assert [bool(x) for x in model.find(texts)] == [bool(model.find([t])[0]) for t in texts]


def test_held_out_prose(model):
    held = [p.replace("fen", "moor").replace("Young", "Older") for p in PROSE[::3]]
    assert sum(bool(x) for x in model.find(held)) == 0


def test_operator_edges(spark, model):
    df = spark.createDataFrame([("a", "Text to follow."), ("a", "Text to follow."), ("b", None), ("c", ""), ("d", PROSE[0])], "rec_key string, text string").selectExpr("*", "'x' as kinds", "1 as coverage")
    got = residue.find_residue(df, model, ["rec_key"], "text").collect()
    assert [r.rec_key for r in got] == ["a", "a"] and got[0].coverage > 0.9 and got[0].kinds == ["notice_or_filler"]
    assert residue.find_residue(df.limit(0), model, ["rec_key"], "text").collect() == []


def test_fit_on_an_empty_table(spark):
    m = residue.fit(spark.createDataFrame([], "k string, t string"), "k", "t")
    assert m.find(["Please enable JavaScript to view this page."])[0]


def test_prose_is_counted_in_every_row(spark):
    """A sample of the least hashes left out all but some rows: here every row has a word of its own."""
    texts = [f"The {'abcdefghij'[i // 10]}{'klmnopqrst'[i % 10]}vorn plant {i} grew beside the ditch in wet years." for i in range(100)] + ["Lorem ipsum dolor sit amet, consectetur adipiscing elit."] * 3
    df = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)] + [("n", None), ("e", "")], "k string, t string")
    got, want = residue.fit(df, "k", "t", 10), residue.ResidueModel(texts, 10)
    assert all((got.tables[k] == want.tables[k]).all() for k in want.tables)
    counts = residue._prose_counts(df.select("t"), None)
    assert counts.rows == 103 and (counts.flat() == residue.ProseCounts(texts).flat()).all()
    # a corpus weighs as so many rows whatever its size, so a larger one of the same texts has the same model
    more = residue.fit(df.unionByName(df).unionByName(df.repartition(7)), "k", "t", 10)
    assert all((more.tables[k] == want.tables[k]).all() for k in want.tables)


def test_prose_is_counted_in_blocks(monkeypatch):
    """Each text was sorted by itself; the counts of a block are those of its texts, each scored as if alone."""
    texts = [f"The fen {i % 7} lies\nwest of the ditch, {'né日' * (i % 3)}." for i in range(300)] + ["", "\n", "a", "\n\n\n\n", "aaaa aaaa aaaa"]
    want = {base: {} for base in (residue.N_LITERAL, residue.N_SHAPE)}
    for t in texts:
        for table, base in ((residue.LITERAL, residue.N_LITERAL), (residue.SHAPE, residue.N_SHAPE)):
            for g in set(residue._grams(table[residue._codes(t + "\n")], base).tolist()):
                want[base][g] = want[base].get(g, 0) + 1
    calls, grams = [], residue._grams
    monkeypatch.setattr(residue, "_grams", lambda symbols, base: calls.append(base) or grams(symbols, base))
    got = residue.ProseCounts(texts)
    assert got.rows == len(texts) and len(calls) == 2
    for counts, base in ((got.literal, residue.N_LITERAL), (got.shape, residue.N_SHAPE)):
        assert {int(g): int(counts[g]) for g in counts.nonzero()[0]} == want[base]
    assert max(residue.N_LITERAL, residue.N_SHAPE) ** 4 < 1 << 22
    split = residue.ProseCounts()
    for block in residue._blocks(texts, 50):
        split.add(block)
    assert (split.flat() == got.flat()).all()
