"""Defects of prompt and response pairs: empty, refusal, echo, language, truncated.

A response is taken out of its wrapping (fences, answer tags, JSON) and tested in that order; the first that holds is
its defect. Refusals are found by the grammar of :mod:`windrow.llm.refusals`, echoes by greedy string tiling of the
response with the prompt, languages by scripts and character n-gram profiles (:mod:`windrow.llm.languages`), truncation by
the pushdown parser, length spikes and the model of sentence ends of :mod:`windrow.llm.truncation`.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from windrow.llm.languages import Evidence
from windrow.llm.refusals import is_denial
from windrow.llm.truncation import MOST_SPIKES, EndModel, at_spike, fit_ends, is_cut, spiked, unwrapped
from windrow.session import widened

#: Words of a response that tiles of the prompt must cover for an echo; shortest tile.
ECHO_COVER, TILE = 0.8, 3
#: Nats within which languages may be the prompt's; nats, and nats a word, by which an answer's own must lead those.
PROMPT_LEAD, ANSWER_LEAD, ANSWER_RATE = 4.0, 5.0, 0.3
#: Words beside a refusal that may follow it without being an answer.
REFUSAL_REST = 14

# What stands for no answer.
NO_ANSWER = frozenset("null none nil nan n/a na undefined empty blank answer response output text result (no response) no response no answer (empty) (none) (no answer) [no response] [empty] not available no output (no output) ... - -- — ? .".split()) | frozenset(["(no response)", "no response", "(no answer)", "no answer", "[no response]", "(no output)", "no output", "not available", "no content", "(no content)", "sin respuesta", "keine antwort", "pas de réponse", "sem resposta"])

_COURTESY = re.compile(r"\b(?:is there (?:something|anything) else|let me know|i hope you understand|hope (?:this|that) helps|if you have (?:another|any|other)|happy to help|please (?:consult|contact|ask|try|refer|see|reach)|i can offer|i can help with|feel free|something else|thanks? (?:you )?for|instead|apologies|sorry)\b", re.IGNORECASE)
_EASTERN = re.compile(r"[\u3040-\u30ff\u4e00-\u9fff]")
_SENTENCE = re.compile(r"(?<=[.!?。！？])\s+|\n+|(?<=[。！？])")

_LEAD = re.compile(r"^\s*(?:>|#+|\*+)*\s*(?:you asked|you said|question|prompt|user|human|instruction|the question was|the prompt was|input|query|q|task)\s*[:\-–]\s*", re.IGNORECASE)
_OPTION = re.compile(r"^\s*\(?([A-Ha-h])[).:]\s*(\S.*?)\s*$", re.MULTILINE)
_LETTER = re.compile(r"^[\s>*_`\"'(\[]*(?:(?:the )?(?:correct )?(?:option|answer|choice|letter)(?: is)?\s*:?\s*)?[(\[]?[A-Ha-h][)\].:]*[\s*_`\"'.]*$", re.IGNORECASE)

# Names of languages in requests.
LANGUAGE_NAMES = {
    "en": "english englisch anglais inglés ingles inglês inglese английском 英語", "fr": "french französisch franzosisch français francais francés frances francês francese французском フランス語", "de": "german deutsch allemand alemán aleman alemão tedesco немецком ドイツ語",
    "es": "spanish spanisch espagnol español espanol castellano espanhol spagnolo испанском スペイン語", "pt": "portuguese portugiesisch portugais portugués portugues português portoghese португальском ポルトガル語", "it": "italian italienisch italien italiano итальянском イタリア語",
    "nl": "dutch niederländisch néerlandais holandés neerlandés holandês", "pl": "polish polnisch polonais polaco", "ru": "russian russisch russe ruso russo русском ロシア語", "ja": "japanese japanisch japonais japonés japonês giapponese японском 日本語", "zh": "chinese chinesisch chinois chino chinês cinese китайском 中文 中国語", "ko": "korean koreanisch coréen coreano", "ar": "arabic arabisch arabe árabe",
}
_NAMED = {n: lang for lang, names in LANGUAGE_NAMES.items() for n in names.split()}
_ASKED = re.compile(rf"\b(?:answer|reply|respond|response|write|written|translate|output|responde|responda|contesta|escribe|escreva|réponds|répondez|réponse|écri\w+|antwort\w*|schreib\w*|ответ\w*|напиши\w*)\b[^.!?\n]{{0,40}}?\b({'|'.join(sorted(map(re.escape, _NAMED), key=len, reverse=True))})\b|(日本語|英語|中文|フランス語|ドイツ語|スペイン語)で", re.IGNORECASE)
_QUOTED = re.compile(r"\"[^\"\n]{4,400}\"|“[^”\n]{4,400}”|«[^»\n]{4,400}»|„[^“”\n]{4,400}[“”]")
_TOKEN = re.compile(r"[^\W_]+|[぀-ヿ㐀-鿿]")


def asked_language(prompt: str, words: list[str]) -> str | None:
    """The language that ``prompt`` asks for in words, or None."""
    if not _NAMED.keys().isdisjoint(words) or not prompt.isascii() and _EASTERN.search(prompt):
        named = [m for m in _ASKED.finditer(prompt)]
        if named:
            return _NAMED.get((named[-1].group(1) or named[-1].group(2)).lower())
    return None


def tiles(pattern: list[str], text: list[str], least: int = TILE) -> list[tuple[int, int, int]]:
    """Greedy string tiling: longest common runs first, each word of either side in one tile at most.

    (start in pattern, start in text, length) of each tile of ``least`` words or more.
    """
    free_p, free_t = [True] * len(pattern), [True] * len(text)
    at: dict[tuple[str, ...], list[int]] = {}
    for i in range(len(pattern) - least + 1):
        at.setdefault(tuple(pattern[i : i + least]), []).append(i)
    found: list[tuple[int, int, int]] = []
    while True:
        best: list[tuple[int, int, int]] = []
        longest = least - 1
        j = 0
        while j <= len(text) - least:
            reach = 0
            if free_t[j]:
                for i in at.get(tuple(text[j : j + least]), ()):
                    n = 0
                    while i + n < len(pattern) and j + n < len(text) and pattern[i + n] == text[j + n] and free_p[i + n] and free_t[j + n]:
                        n += 1
                    if n > longest:
                        longest, best = n, [(i, j, n)]
                    elif n == longest and n >= least:
                        best.append((i, j, n))
                    reach = max(reach, n)
            j += max(1, reach - longest + 1) if reach > least else 1
        if longest < least:
            return found
        for i, j, n in best:
            if all(free_p[i : i + n]) and all(free_t[j : j + n]):
                found.append((i, j, n))
                free_p[i : i + n] = [False] * n
                free_t[j : j + n] = [False] * n


def _words(s: str) -> list[str]:
    return _TOKEN.findall(s.lower())


def is_empty(response: str | None, inner: str | None = None) -> bool:
    if response is None:
        return True
    if inner is None:
        inner, _ = unwrapped(response)
    bare = inner.strip()
    if len(bare) > 60 and any(c.isalnum() for c in bare):
        return False
    bare = re.sub(r"[\s\u200b-\u200f\u2060\ufeff\xad]+", " ", bare).strip().strip("*_`#>").strip()
    if not bare or bare.lower().strip(" .:!") in NO_ANSWER or bare.lower() in NO_ANSWER:
        return True
    if not any(c.isalnum() for c in bare):
        return True
    return bool(re.fullmatch(r"(?i)<[^<>]*>\s*</[^<>]*>", bare))


def is_refusal(answer: str) -> bool:
    """A denial by the grammar, in an answer of any length, with no more than courtesies and a few words beside its denials."""
    rest, denied = 0, False
    at = 0
    while at < len(answer):  # sentence by sentence, since the first few decide
        m = _SENTENCE.search(answer, at + 1)
        p, at = (answer[at : m.start()], m.end()) if m else (answer[at:], len(answer))
        if not p.strip():
            continue
        n = len(_TOKEN.findall(p))
        if n <= 60 and is_denial(p):
            denied = True
        elif not _COURTESY.search(p):
            rest += n
            if rest > REFUSAL_REST:
                return False
    return denied


def is_echo(prompt: str, answer: str, asked: list[str], words: list[str]) -> bool:
    """Whether tiles of the prompt, whose words are ``asked``, cover the answer, whose words are ``words``, and no choice is made."""
    said = _LEAD.sub("", answer.strip())
    if len(said) < len(answer.strip()):
        words = _words(said)
    if len(words) < 4 or not asked:
        return False
    # an upper bound of what tiles can cover; a prompt may be given back more than once
    reach = {w for w in zip(asked, asked[1:], asked[2:])}
    near = [False] * len(words)
    for j, w in enumerate(zip(words, words[1:], words[2:])):
        if w in reach:
            near[j : j + TILE] = [True] * TILE
    if sum(near) < ECHO_COVER * len(words):
        return False
    options = [(m.group(1).lower(), " ".join(_words(m.group(2)))) for m in _OPTION.finditer(prompt)]
    if len(options) >= 2:
        flat = " ".join(words)
        bare = re.sub(r"^\(?[a-h]\)? ", "", flat)
        if any(o and (bare == o or flat == o) for _, o in options):
            return False
        lines = [x for x in said.strip().splitlines() if x.strip()]
        inside = [o for _, o in options if o and f" {o} " in f" {flat} "]
        if len(inside) == 1 or len(lines) > 1 and not inside and _LETTER.match(lines[-1]) or not inside and re.search(r"(?i)\b(?:answer|option|choice)\b\s*(?:is|:)?\s*\(?[a-h]\)?[.\s]*$", said):
            return False
    covered, remaining, longest = 0, words, 0
    while got := tiles(asked, remaining):
        longest = max(longest, max(n for *_, n in got))
        keep = [True] * len(remaining)
        for _, j, n in got:
            keep[j : j + n] = [False] * n
        covered += sum(n for *_, n in got)
        remaining = [w for w, k in zip(remaining, keep) if k]
    return covered >= ECHO_COVER * len(words) and longest >= min(5, len(words))


@lru_cache(256)
def _prompt_languages(prompt: str) -> tuple[str, ...]:
    """The languages that a prompt may be written in; attempts at one call follow one another, so the last ones are kept."""
    return tuple(Evidence(prompt).near(PROMPT_LEAD))


def is_other_language(prompt: str, answer: str, asked: list[str]) -> bool:
    """Whether ``answer``, without its quotations, is in another language than the one that ``prompt`` asks for, or is written in."""
    rest = answer
    if '"' in answer or not answer.isascii():
        rest = _QUOTED.sub(" ", answer)
        if len(rest) < len(answer) and len(_words(rest)) < 4:
            rest = answer
    said = Evidence(rest)
    if said.n < 4 or said.share < 0.5:
        return False
    named = asked_language(prompt, asked)
    wanted = (named,) if named else _prompt_languages(prompt)
    if not wanted:
        return False
    behind = min(said.behind(w) for w in wanted)
    return behind == math.inf or behind >= max(ANSWER_LEAD, ANSWER_RATE * said.n_words)


def defect_of(prompt: str | None, response: str | None, model: EndModel, spike: bool = False) -> str | None:
    """The defect of one pair, or None. A null or blank prompt leaves only empty, refusal and truncated."""
    if response is None:
        return "empty"
    answer, was_json = unwrapped(response)
    if is_empty(response, answer):
        return "empty"
    words = _words(answer)
    if is_refusal(answer):
        return "refusal"
    lines: frozenset[str] = frozenset()
    if prompt and prompt.strip():
        asked = _words(prompt)
        if is_echo(prompt, answer, asked, words) or was_json and is_echo(prompt, response, asked, _words(response)):
            return "echo"
        if is_other_language(prompt, answer, asked):
            return "language"
        lines = frozenset(x.strip() for x in prompt.split("\n")) | frozenset(m.group(2) for m in _OPTION.finditer(prompt))
    if len(answer) < 60 and _LETTER.match(answer):
        return None
    return "truncated" if is_cut(response, model, spike, lines, (answer, was_json)) else None


def is_truncated(prompt: str | None, response: str | None, model: EndModel, spike: bool = False) -> bool:
    """As ``defect_of(...) == "truncated"``; the end is tested first, since few texts don't pass that."""
    if not response or not is_cut(response, model, spike):
        return False
    return defect_of(prompt, response, model, spike) == "truncated"


def find_defects(log: DataFrame, model: EndModel | None = None, only_truncated: bool = False, most_spikes: int = MOST_SPIKES) -> DataFrame:
    """call_id, attempt_index, source (model_version) and defect of every defective pair of ``log``, one row a key.

    ``log`` has call_id, attempt_index, prompt_text, raw_response and model_version; further columns aren't read. A null
    response is empty; a null prompt allows no echo and no language; repeated rows of a key count once (of rows
    that differ the least defect by name); an empty table gives an empty result. The texts are never shuffled.
    """
    if model is None:
        model = fit_ends(log, "call_id", "raw_response")
    log, spiky = spiked(log, F.col("model_version"), F.col("raw_response"), most_spikes)
    shared = log.sparkSession.sparkContext.broadcast((model, spiky))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ends, known = shared.value
        for batch in batches:
            take, what = [], []
            prompts, responses, sources, at = (batch.column(i).to_pylist() for i in (0, 1, 2, 5))
            for i, (p, r, s, a) in enumerate(zip(prompts, responses, sources, at)):
                spike = bool(r) and (at_spike(known, s, r) if a is None else a)
                d = defect_of(p, r, ends, spike) if not only_truncated else "truncated" if is_truncated(p, r, ends, spike) else None
                if d:
                    take.append(i)
                    what.append(d)
            rows = pa.array(take, pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(i).take(rows) for i in (3, 4, 2)), pa.array(what, pa.string())], names=["call_id", "attempt_index", "source", "defect"])

    found = widened(log.select("prompt_text", "raw_response", "model_version", "call_id", "attempt_index", "_spike")).mapInArrow(judge, f"call_id string, attempt_index {log.schema['attempt_index'].dataType.simpleString()}, source string, defect string")
    return found.groupBy("call_id", "attempt_index").agg(F.min("source").alias("source"), F.min("defect").alias("defect"))
