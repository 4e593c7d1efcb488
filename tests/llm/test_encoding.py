import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from windrow.llm import encoding

with open(encoding.VOCABULARY, "rb") as f:
    ENCODER = encoding.FragmentEncoder(f.read())


@pytest.fixture(scope="module")
def reference():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(encoding.VOCABULARY.replace(".tiktoken", ".json"))
    t.encode_special_tokens = True
    return lambda s: t.encode(s, add_special_tokens=False).ids


TRICKY = ["", " ", "\n\n\n", "a  b", "don't 'll's", "à la voilà le", "\x1c\x85 x​", "<|endoftext|> x", "漢字かな", "🌿🧭‍🌿", "é", "x" * 5000, "漢" * 3000, " " * 3000 + "a", "\t\r\n    a"]


@pytest.mark.parametrize("text", TRICKY)
def test_ids_are_the_tokenizers(reference, text):
    assert ENCODER.encode(text) == reference(text)


@settings(max_examples=300, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.text(max_size=60))
def test_any_text(reference, text):
    assert ENCODER.encode(text) == reference(text)


def test_mixed_alphabet(reference):
    rng = random.Random(3)
    parts = list("ab.'s \n\t  é漢字\x1c\x85!12") + ["à ", "\r\n", "'re", "  "]
    for _ in range(2000):
        s = "".join(rng.choice(parts) for _ in range(30))
        assert ENCODER.encode(s) == reference(s)


def test_certain_pairs_occur_in_no_token():
    import base64

    with open(encoding.VOCABULARY, "rb") as f:
        tokens = [base64.b64decode(x.split()[0]) for x in f.read().splitlines() if x]
    assert not any(ENCODER.certain[a, b] for t in tokens for a, b in zip(t, t[1:]))
    assert ENCODER.certain[ord("x"), ord(" ")] and not ENCODER.certain[ord("t"), ord("h")]


def test_null_empty_long_repeated_and_clashing(spark, reference):
    long = "Lorem 12 ipsum\n" * 20_000
    rows = [(1, None, "a", 0), (2, "", "b", 0), (3, long, None, 0), (4, "same text", "c", 0), (4, "same text", "c", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string, _text int")
    got = [(r.doc_id, r.ids) for r in encoding.encode_texts(df).collect()]
    assert sorted(got, key=lambda x: x[0])[0:2] == [(1, []), (2, [])]
    assert dict(got)[3] == reference(long) and sum(k == 4 for k, _ in got) == 2
    assert encoding.encode_texts(df.limit(0)).collect() == []
    assert encoding.encode_texts(df).columns == ["doc_id", "ids"]


def test_counts_and_name_clash(spark):
    df = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    assert {r.doc_id: r.n_tokens for r in encoding.count_tokens(df).collect()} == {1: 2, 2: 0}
    with pytest.raises(ValueError):
        encoding.count_tokens(df.withColumnRenamed("doc_id", "n_tokens"))
