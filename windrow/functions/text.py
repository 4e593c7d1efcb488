"""Text functions as columns. Built-in expressions wherever they suffice; Arrow functions only where they can't.

Every function gives null for a null text.
"""

from __future__ import annotations

import difflib
import re
import unicodedata
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _span(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields])


def norm_ws(x: Column) -> Column:
    """White space collapsed to single spaces, ends trimmed."""
    return F.trim(F.regexp_replace(x, r"(?U)\s+", " "))


def norm_term(x: Column) -> Column:
    """A term in small letters without one run of signs on either side and without possessive."""
    t = F.regexp_replace(F.lower(norm_ws(x)), r"(?U)^[^\w]+|[^\w]+$", "")
    return norm_ws(F.regexp_replace(t, r"['’]s\z", ""))


@F.udf(T.StringType(), useArrow=True)
def casefold_nfkc(x: str | None) -> str | None:
    """Compatibility form and case folding, which no built-in gives."""
    return None if x is None else unicodedata.normalize("NFKC", x).casefold()


def alnum(x: Column) -> Column:
    """ASCII letters and digits of the text in small letters, as words joined by single spaces."""
    return F.array_join(F.regexp_extract_all(F.lower(x), F.lit("[a-z0-9]+"), F.lit(0)), " ")


def words(x: Column) -> Column:
    """ASCII words of the text in small letters."""
    return F.regexp_extract_all(F.lower(x), F.lit("[a-z0-9]+"), F.lit(0))


def ws_count(x: Column) -> Column:
    """Number of runs without white space."""
    return F.size(F.regexp_extract_all(x, F.lit(r"\S+"), F.lit(0)))


def ngrams(ws: Column, n: int) -> Column:
    """All runs of ``n`` words, joined by spaces; none where there are fewer words.

    ``ws`` is read at each place, so it should be a column of its own, not an expression that makes the words.
    """
    count = F.size(ws) - (n - 1)
    return F.when(ws.isNull(), F.lit(None)).when(count < 1, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(count, F.lit(1))), lambda i: F.array_join(F.slice(ws, i, n), " ")))


def contains_verbatim(text: Column, part: Column) -> Column:
    return F.contains(F.lower(text), F.lower(part))


def bounded(phrase: str) -> str:
    """Pattern of a phrase that isn't part of a longer word, with any white space between its words."""
    return r"(?<!\w)" + r"\s+".join(re.escape(w) for w in phrase.split()) + r"(?!\w)"


def phrase_present(text: Column, phrase: str) -> Column:
    return text.rlike(f"(?i){bounded(phrase)}")


def alternation(terms: Sequence[str]) -> str:
    """Pattern of any of the terms, the longest first."""
    return r"(?<!\w)(?:" + "|".join(re.escape(t) for t in sorted(set(terms), key=lambda t: (-len(t), t))) + r")(?!\w)"


def variants(x: Column) -> Column:
    """Spellings of a term: as it is, with spaces for hyphens and the other way round, plural and possessive; sorted."""
    base = norm_ws(F.lower(x))
    forms = F.array(base, F.regexp_replace(base, "-", " "), F.regexp_replace(base, " ", "-"), F.concat(base, F.lit("s")), F.concat(base, F.lit("'s")))
    return F.array_sort(F.array_distinct(forms))


def context(text: Column, start: Column, length: Column, reach: int) -> Column:
    """The text around a place (start from 0) and ``reach`` characters on either side."""
    left = F.greatest(start - reach, F.lit(0))
    return F.substr(text, left + 1, start - left + length + reach)


def field_text(*fields: Column) -> Column:
    """The fields that aren't blank, joined by spaces."""
    return F.concat_ws(" ", *[F.nullif(F.trim(f), F.lit("")) for f in fields])


def rank_of_name(x: Column) -> Column:
    """Rank of a scientific name by its form: strain, species, genus or informal."""
    return (
        F.when(x.rlike(r"^[A-Z][a-z]+ [a-z]+ .*\b(?:strain|str\.|subsp\.|var\.|isolate)\b"), "strain")
        .when(x.rlike(r"^[A-Z][a-z]+ [a-z-]+$"), "species")
        .when(x.rlike(r"^[A-Z][a-z]+(?: spp?\.)?$"), "genus")
        .when(x.isNotNull(), "informal")
    )


def has_control(x: Column) -> Column:
    return x.rlike(r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]")


def paragraphs(x: Column) -> Column:
    """Paragraphs that aren't blank, trimmed."""
    return F.filter(F.transform(F.split(x, r"\n\s*\n"), lambda p: F.trim(p)), lambda p: p != "")


def mask_values(x: Column) -> Column:
    """Numbers masked, so that texts of one template become equal."""
    return F.regexp_replace(x, r"\d+(?:\.\d+)?", "#")


def mask_terms(x: Column, terms: Sequence[str], by: str = "@") -> Column:
    return F.regexp_replace(x, f"(?i){alternation(terms)}", by)


def md_escape(x: Column) -> Column:
    return F.replace(F.replace(x, F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" "))


def is_quantity(x: Column) -> Column:
    """Whether the whole text is a number with an optional unit."""
    return x.rlike(r"^[+-]?\d+(?:[.,]\d+)?\s*(?:%|percent|mm|cm|m|km|g|kg|mg|l|ml|days?|weeks?|hours?|h|min|s|steps?|plots?)?$")


def style_failures(x: Column) -> Column:
    """Labels of what a finished text mustn't hold: identifiers, headings, boilerplate."""
    return F.array_compact(F.array(F.when(x.rlike(r"\b(?:ORG|CH|CP|E)-?\d{2,}\b"), "identifier"), F.when(x.rlike(r"(?m)^#{1,6}\s"), "heading"), F.when(x.rlike(r"(?i)\b(?:as an ai|in conclusion|in summary)\b"), "boilerplate")))


def within_window(ws: Column, terms: Sequence[str], contexts: Sequence[str], reach: int = 8) -> Column:
    """Whether, in an array of words, a term stands within ``reach`` words of a context word.

    One fold over the words with the last places of either kind: the nearest pair is always of neighbours.
    """
    far = -1_000_000_000
    start = F.struct(F.lit(0).alias("i"), F.lit(far).alias("t"), F.lit(far // 2).alias("c"), F.lit(False).alias("hit"))

    def step(a: Column, w: Column) -> Column:
        t = F.when(w.isin(*terms), a["i"]).otherwise(a["t"])
        c = F.when(w.isin(*contexts), a["i"]).otherwise(a["c"])
        return F.struct((a["i"] + 1).alias("i"), t.alias("t"), c.alias("c"), (a["hit"] | (F.abs(t - c) <= reach)).alias("hit"))

    return F.aggregate(ws, start, step, lambda a: a["hit"])


_ABBREVIATED = re.compile(r"(?:\b(?:e\.g|i\.e|cf|vs|fig|dr|mr|mrs|ms|st|no|sp|spp|approx|ca|al)|\b[A-Z])\.$", re.IGNORECASE)
_TOKEN = re.compile(r"\w+|[^\w\s]")


def sentence_spans(text: str) -> list[tuple[int, int]]:
    """(first, end) of each sentence; abbreviations and initials end none."""
    out, start = [], 0
    for m in re.finditer(r"[.!?]+[\"')\]]*\s+|\n{2,}", text):
        if m.group()[0] == "." and _ABBREVIATED.search(text[start : m.start() + 1]):
            continue
        end = m.start() + len(m.group().rstrip())
        if text[start:end].strip():
            out.append((start, end))
        start = m.end()
    if text[start:].strip():
        out.append((start, len(text.rstrip())))
    return out


@F.udf(T.ArrayType(_span(("start", T.IntegerType()), ("end", T.IntegerType()), ("sentence", T.StringType()))), useArrow=True)
def sentences(text: str | None) -> list[dict] | None:
    return None if text is None else [{"start": a, "end": b, "sentence": text[a:b]} for a, b in sentence_spans(text)]


@F.udf(T.ArrayType(_span(("token", T.StringType()), ("start", T.IntegerType()), ("end", T.IntegerType()))), useArrow=True)
def token_offsets(text: str | None) -> list[dict] | None:
    return None if text is None else [{"token": m.group(), "start": m.start(), "end": m.end()} for m in _TOKEN.finditer(text)]


@F.udf(T.DoubleType(), useArrow=True)
def ratio(a: str | None, b: str | None) -> float | None:
    """Ratio of matching characters of two strings, which edit distance isn't."""
    return None if a is None or b is None else difflib.SequenceMatcher(None, a, b, autojunk=False).ratio()


def diff_pairs(df: DataFrame, key: str, left: str, right: str, reach: int = 40) -> DataFrame:
    """One row a token run that the right text has in place of the left's.

    key, ordinal, left_raw, right_raw, left_start, context_left, context_right, n_insert, n_delete (of the pair). A pair
    with a null side has no rows; pairs without replaced runs have none either.
    """

    def tokens(text: str) -> list[tuple[str, int, int]]:
        return [(m.group(), m.start(), m.end()) for m in _TOKEN.finditer(text)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            take, rows = [], []
            for i, (a, b) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())):
                if a is None or b is None:
                    continue
                x, y = tokens(a), tokens(b)
                ops = difflib.SequenceMatcher(None, [t[0] for t in x], [t[0] for t in y], autojunk=False).get_opcodes()
                n_in, n_del = sum(o[0] == "insert" for o in ops), sum(o[0] == "delete" for o in ops)
                for k, (_, i1, i2, j1, j2) in enumerate(o for o in ops if o[0] == "replace"):
                    s, e = x[i1][1], x[i2 - 1][2]
                    take.append(i)
                    rows.append((k, a[s:e], b[y[j1][1] : y[j2 - 1][2]], s, a[max(0, s - reach) : s], a[e : e + reach], n_in, n_del))
            kinds = (pa.int32(), pa.string(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.int32(), pa.int32())
            cols = list(zip(*rows)) or [()] * 8
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(take, pa.int64())), *(pa.array(c, t) for c, t in zip(cols, kinds))], names=[key, "ordinal", "left_raw", "right_raw", "left_start", "context_left", "context_right", "n_insert", "n_delete"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, left, right).mapInArrow(run, f"`{key}` {kind}, ordinal int, left_raw string, right_raw string, left_start int, context_left string, context_right string, n_insert int, n_delete int")


def trivial_reason(a: Column, b: Column, stopwords: Sequence[str]) -> Column:
    """Why replacing ``a`` by ``b`` (normalised terms) is trivial; null if it isn't. Five ordered rules."""
    stop = lambda x: x.isin(*stopwords)
    compact = lambda x: F.regexp_replace(x, r"[-\s]", "")
    single = lambda x: F.regexp_replace(x, "(?:es|s)$", "")
    return F.when(a == b, "normalized_equal").when(stop(a) & stop(b), "function_words").when(compact(a) == compact(b), "hyphenation_or_casing").when(single(a) == single(b), "pluralization").when(ratio(a, b) > 0.85, "high_string_similarity")


@F.udf(T.StringType(), useArrow=True)
def first_object(text: str | None) -> str | None:
    """The first JSON object within free text, or null."""
    import json

    at = text.find("{") if text else -1
    while at >= 0:
        try:
            _, end = json.JSONDecoder().raw_decode(text, at)
            return text[at:end]
        except ValueError:
            at = text.find("{", at + 1)
    return None


def strip_fence(x: Column) -> Column:
    return F.regexp_replace(F.trim(x), r"(?s)^```[\w-]*\s*\n?(.*?)\n?```$", "$1")
