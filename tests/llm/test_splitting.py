import random

import pytest

from tests_llm_helpers import ENCODER
from windrow.llm import splitting


def check(text, limit, overlap):
    pieces = list(splitting.pieces_of(ENCODER, text, limit, overlap))
    ids = ENCODER.encode(text)
    assert pieces[0][0] == 0 and pieces[-1][1] == len(text)
    for a, b, n, shared, _ in pieces:
        assert n <= limit and len(ENCODER.encode(text[a:b])) <= limit
    for (_, b, _, _, _), (a, _, _, shared, _) in zip(pieces, pieces[1:]):
        assert a <= b and (shared == 0 or shared >= overlap or overlap == 0)
    # without the shared tokens the pieces are the text's tokens
    assert sum(n - shared for _, _, n, shared, _ in pieces) == len(ids)
    rebuilt, at = "", 0
    for a, b, *_ in pieces:
        rebuilt += text[max(a, at) : b]
        at = b
    assert rebuilt == text
    return pieces


def test_boundaries_are_preferred():
    para = "The meadow lies above the river. " * 6
    pieces = check("\n\n".join([para.strip()] * 6), 64, 8)
    assert {k for *_, k in pieces} <= {"paragraph", "sentence", "end", "line"} and any(k == "paragraph" for *_, k in pieces)


@pytest.mark.parametrize("text", ["x" * 4000, "漢字" * 1500, "🌿" * 700, "a'b" * 900, " " * 2000 + "end", "word " * 2000, "1. a\n" * 900, "é" * 800])
def test_hard_texts(text):
    check(text, 64, 16)


def test_random_texts():
    rng = random.Random(5)
    parts = ["word", " ", ". ", "\n", "\n\n", "漢", "🌿", "'s", " it's", "123", "  ", "é", "!? "]
    for _ in range(150):
        check("".join(rng.choice(parts) for _ in range(400)), 48, rng.choice([0, 1, 7, 20]))


def test_edges(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "short"), (4, "word " * 900), (4, "word " * 900)], "doc_id long, text string").selectExpr("*", "1 as piece", "2 as boundary")
    got = splitting.split_texts(df, limit=100, overlap=10).collect()
    assert {r.doc_id for r in got} == {3, 4}
    assert [r.piece for r in got if r.doc_id == 3] == ["short"]
    assert len([r for r in got if r.doc_id == 4 and r.piece_index == 0]) == 2
    assert all(r.overlap_tokens == (0 if r.piece_index == 0 else 10) for r in got)
    assert splitting.split_texts(df.limit(0)).collect() == []
    with pytest.raises(ValueError):
        splitting.split_texts(df, limit=20, overlap=15)
