import hashlib

import pytest
from pyspark.sql import functions as F

from windrow.functions import text as X
from windrow.functions import values as V


def one(spark, f, *values, kinds=None):
    kinds = kinds or ["string"] * len(values)
    df = spark.createDataFrame([values], ", ".join(f"c{i} {k}" for i, k in enumerate(kinds)))
    return df.select(f(*[F.col(f"c{i}") for i in range(len(values))]).alias("r")).first().r


@pytest.mark.parametrize("f,x,want", [
    (X.norm_ws, " a\t b \nc ", "a b c"), (X.norm_ws, None, None), (X.norm_term, "“The Fen’s”", "the fen"), (X.norm_term, "(the fen's", "the fen"), (X.casefold_nfkc, "Straße Ａ", "strasse a"), (X.casefold_nfkc, None, None), (X.alnum, "A-b, C3!", "a b c3"), (X.ws_count, " a  b ", 2),
    (X.paragraphs, "a\n\n b \n \n\nc", ["a", "b", "c"]), (X.mask_values, "1.5 of 20", "# of #"), (X.md_escape, "a|b\nc", "a\\|b c"), (X.has_control, "a\x01", True), (X.is_quantity, "12.5 mm", True), (X.is_quantity, "mm 3", False), (X.rank_of_name, "Orla vesca", "species"), (X.rank_of_name, "Orla", "genus"), (X.rank_of_name, "orla", "informal"),
    (X.variants, "Sea-fan", ["sea fan", "sea-fan", "sea-fan's", "sea-fans"]), (X.first_object, 'x {"a": {"b": "}"}} y', '{"a": {"b": "}"}}'), (X.first_object, "{ no", None), (X.strip_fence, "```json\n{}\n```", "{}"), (X.style_failures, "# T\nORG-123", ["identifier", "heading"]),
])
def test_text(spark, f, x, want):
    assert one(spark, f, x) == want


def test_ngrams(spark):
    assert one(spark, lambda x: X.ngrams(X.words(x), 2), "a b c") == ["a b", "b c"]
    assert one(spark, lambda x: X.ngrams(X.words(x), 4), "a b c") == []
    assert one(spark, lambda x: X.ngrams(X.words(x), 4), None) is None


def test_presence_windows_contexts(spark):
    assert one(spark, lambda x: X.phrase_present(x, "leaf margin"), "The Leaf\n margin.") and not one(spark, lambda x: X.phrase_present(x, "leaf margin"), "leaf margins")
    assert one(spark, lambda x: X.within_window(X.words(x), ["b"], ["a"], 2), "a x b") and not one(spark, lambda x: X.within_window(X.words(x), ["b"], ["a"], 2), "a x x b")
    assert one(spark, lambda x: X.context(x, F.lit(5), F.lit(2), 3), "0123456789") == "23456789"
    assert one(spark, lambda x, y: X.field_text(x, y), " a ", " ") == "a"
    assert one(spark, lambda x: X.mask_terms(x, ["fen", "fen edge"]), "The fen edge, fens") == "The @, fens"


def test_sentences_and_offsets(spark):
    text = "It rose (cf. Fig. 2). No one saw it! E.g. here."
    got = [text[a:b] for a, b in X.sentence_spans(text)]
    assert got == ["It rose (cf. Fig. 2).", "No one saw it!", "E.g. here."]
    assert [r.token for r in one(spark, X.token_offsets, "a-b")] == ["a", "-", "b"]
    assert one(spark, X.sentences, None) is None


def test_diff_and_triviality(spark):
    df = spark.createDataFrame([(1, "The red fox ran fast", "The blue fox ran"), (2, None, "x"), (3, "same", "same")], "k int, a string, b string")
    rows = X.diff_pairs(df, "k", "a", "b").collect()
    assert [(r.k, r.left_raw, r.right_raw, r.left_start, r.n_delete) for r in rows] == [(1, "red", "blue", 4, 1)]
    reasons = [one(spark, lambda a, b: X.trivial_reason(a, b, ["of", "in"]), *p) for p in (("a", "a"), ("of", "in"), ("sea-fan", "sea fan"), ("fen", "fens"), ("abcdefghij", "abcdefghix"), ("red", "blue"))]
    assert reasons == ["normalized_equal", "function_words", "hyphenation_or_casing", "pluralization", "high_string_similarity", None]


def test_digests(spark):
    for s in ("a", "b", "abc", ""):
        h = hashlib.sha256(s.encode()).hexdigest()
        assert one(spark, V.stable_int, s) == int(h[:8], 16) and one(spark, V.mod10, s) == int(h, 16) % 10


def test_values(spark):
    d = ["double"] * 4
    letters = [one(spark, lambda *p: V.argmax_letter(list(p)), *ps, kinds=d) for ps in ((0.1, 0.4, 0.4, 0.1), (0.7, 0.1, 0.1, 0.1), (None, 0.5, 0.2, 0.3))]
    assert letters == ["B", "A", None]
    assert one(spark, lambda *p: V.ties(list(p)), 0.1, 0.4, 0.4, 0.1, kinds=d)
    inf = float("inf")
    assert [one(spark, V.order_verdict, a, b, kinds=d[:2]) for a, b in ((inf, inf), (1.0, inf), (inf, 1.0), (2.0, 2.0))] == ["not_evaluable", "earlier", "later", "equal"]
    assert [one(spark, V.histogram_bin, n, kinds=["int"]) for n in (0, 1, 2, 5, 10, 25, 26, None)] == [None, "1", "2", "3-5", "6-10", "11-25", "26+", None]
    assert [one(spark, V.score_band, x, kinds=["double"]) for x in (0.49, 0.5, 0.7, 0.8, 0.81)] == ["<0.5", "0.5-<0.7", "0.7-<0.8", "exactly_0.8", ">0.8"]
    assert one(spark, V.safe_divide, 1.0, 0.0, kinds=d[:2]) is None and abs(sum(one(spark, V.softmax, [1.0, 2.0, 900.0], kinds=["array<double>"])) - 1) < 1e-12
    assert abs(one(spark, V.cosine, [1.0, 0.0], [1.0, 1.0], kinds=["array<double>"] * 2) - 0.5**0.5) < 1e-12
    low, high = (one(spark, lambda k, n: V.wilson(k, n)[i], 5, 10, kinds=["int", "int"]) for i in (0, 1))
    assert 0.23 < low < 0.24 and 0.76 < high < 0.77 and one(spark, lambda k, n: V.wilson(k, n)[0], 0, 0, kinds=["int", "int"]) is None
    assert abs(one(spark, lambda *p: V.row_entropy(list(p)), 0.5, 0.5, 0.0, 0.0, kinds=d) - 0.6931471805599453) < 1e-12
