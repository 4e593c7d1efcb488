"""Texts cut off by field limits or in transfer.

Two kinds of evidence. Length histograms of each source and column, in characters and in bytes, are tested for spikes,
first at the source's maximum, then below it, where a limit held for a part of the source only: values at a spike's
length that don't end as a text does were cut by the limit. Elsewhere the end of the text
decides: a pushdown parser finds structures left open (fences, JSON, brackets, quotations, markup, table rows), a model
of sentence ends, counted in all texts, finds stops in mid-word and mid-sentence. Lists, tables, captions, short answers and a sentence that
only lacks its full stop end soundly.
"""

from __future__ import annotations

import json
import re
from array import array
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from windrow.session import widened

#: Texts up to which three that end with the same words make a customary close; of more, as large a share.
FIT_ROWS = 4000
#: Different words that a task holds before it gives its counts on; characters (and 64 a piece) of pieces of text whose words it keeps at hand.
HELD_COUNTS, HELD_PIECES = 1_000_000, 1 << 24
#: Neighbours of a length on either side; shortest length tested; chance, over all lengths tested, of a spike by accident.
SPIKE_REACH, SPIKE_LEAST, SPIKE_CHANCE = 25, 20, 1e-3
#: Share of a spike's values that its neighbours don't explain, and of these that must have no end.
SPIKE_EXCESS, SPIKE_BARE = 0.6, 0.6
#: Spikes that are looked up from a broadcast table, at most.
MOST_SPIKES = 100_000
#: Probability of a sentence end below which a text that lacks end punctuation was cut.
CUT_BELOW = 0.25
#: The same where the text ends in a mark of omission.
MARKED_BELOW = 0.6

#: SQL pattern of texts that end as a text does; what else may end one is left to the model of sentence ends.
SOUND_END = r"""[.!?。！？؟।][\s"'”’»)\]}*_`>]*$|[")”»\]}|>`]\s*$"""
#: SQL pattern of what may stand between such an end and the text's.
SOUND_AFTER = r"""^[\s"'”’»)\]}*_`>]*$"""

_WORD = re.compile(r"[^\W_]\w*(?:['’\-]\w+)*|[.!?。！？,;:()\[\]{}\"“”«»|…—–�]", re.UNICODE)
_WORD_OR_LINE = re.compile(_WORD.pattern + r"|\n", re.UNICODE)
_TERMINAL = set(".!?。！？")
_CJK = re.compile(r"[぀-ヿ㐀-鿿가-힯]")
#: Marks of an omission at a text's end.
_MARK = re.compile(r"(?:\s*(?:\[(?:\.\.\.|…)\]|\.{3,}|…))+\s*$")
_LIST = re.compile(r"^\s*(?:[-*•–]|\d{1,3}[.)]|[A-Za-z][.)])\s")
_CAPTION = re.compile(r"^\s*(?:#{1,6}\s|(?:table|figure|fig|box|plate|chart|note|tabelle|abbildung|tableau|tabla|figura|tabela|quadro)\b[ .]*\d*)", re.IGNORECASE)
_CLOSERS = "\"'”’»)]}*_`"
_ENCLOSING = re.compile(r"[()\[\]“”«»「」\"]")


def words_of(text: str) -> list[str]:
    """Words and punctuation signs; each sign of scripts without spaces is a word; numbers are ``#``, names keep a capital class."""
    return _signs_apart(_WORD.findall(text), text)


def _signs_apart(found: list[str], text: str) -> list[str]:
    """The words found in ``text``, with each sign of scripts without spaces a word."""
    if text.isascii() or not _CJK.search(text):
        return found
    out: list[str] = []
    for w in found:
        if _CJK.search(w):
            out.extend(re.findall(r"[぀-ヿ㐀-鿿가-힯]|[^぀-ヿ㐀-鿿가-힯]+", w))
        else:
            out.append(w)
    return out


class EndModel:
    """Counts of contexts of one to six words: how often a sentence, or the text, ends after them."""

    ORDERS = (1, 2, 3, 4, 5, 6)

    def __init__(self, texts: Iterable[str]) -> None:
        """The model of texts that are at hand, for any text; ``fit_ends`` counts those of a table, for its own texts."""
        counts, rows = Counts(), 0
        for text in texts:
            counts.add(text)
            rows += 1
        self._take(counts.all(), rows, FIT_ROWS)

    @classmethod
    def of_counts(cls, counts: Iterable[tuple[str, str, int, int]], texts: int, rows: int) -> EndModel:
        """kind, key, n and ends of each count of ``texts`` texts."""
        out = cls.__new__(cls)
        out._take(counts, texts, rows)
        return out

    def _take(self, counts: Iterable[tuple[str, str, int, int]], texts: int, rows: int) -> None:
        self.seen: dict[str, int] = {}
        self.ends: dict[str, int] = {}
        #: Three words with which several texts end: a customary close, unless its last word never ends a sentence.
        self.bare: set[str] = set()
        self.known: set[str] = set()
        #: What begins a longer word.
        self.begins: set[str] = set()
        for kind, key, n, ends in counts:
            if kind == "seen":
                if n >= 2:
                    self.seen[key] = n
                    if ends:
                        self.ends[key] = ends
            elif kind == "bare":
                if n >= 3 and n * rows >= 3 * texts:
                    self.bare.add(key)
            else:
                (self.known if kind == "known" else self.begins).add(key)

    @staticmethod
    def _label(ws: list[str], i: int) -> str:
        w = ws[i]
        if w[0].isdigit():
            return "#"
        if w[0].isupper() and len(w) > 1 and i:
            return "N"
        if i and ws[i - 1][0].isupper() and w[0].islower() and len(w) > 7:
            return "n"  # second part of a binomial
        return w.lower()

    def cut_word(self, w: str) -> bool:
        """Whether ``w`` was never seen as a word but begins one."""
        return w not in self.known and w[0].isalpha() and w in self.begins

    def never_ends(self, w: str) -> bool:
        """Whether sentences go on after ``w``, seen often enough to tell, as after a function word."""
        n = self.seen.get(hash_of([w.lower()]), 0)
        return n >= 40 and self.ends.get(hash_of([w.lower()]), 0) * 200 <= n

    def ends_after(self, ws: list[str]) -> float | None:
        """Probability that a sentence ends after ``ws``, by the longest context seen; None where none was."""
        cs = [self._label(ws, i) for i in range(len(ws))]
        for k in reversed(self.ORDERS):
            if len(cs) >= k:
                key = hash_of(cs[-k:])
                if (n := self.seen.get(key, 0)) >= (2 if k > 1 else 3):
                    return self.ends.get(key, 0) / n
        return None


def hash_of(words: list[str]) -> str:
    return "\x1f".join(words)


class Asked:
    """In a model's place, what ``is_cut`` asks of it: contexts, which come with all that end them, closes and words."""

    def __init__(self) -> None:
        self.contexts: set[str] = set()
        self.closes: set[str] = set()
        self.words: set[str] = set()

    @property
    def bare(self) -> Asked:
        return self

    def __contains__(self, close: str) -> bool:
        self.closes.add(close)
        return True

    def cut_word(self, w: str) -> bool:
        self.words.add(w)
        return False

    def never_ends(self, w: str) -> bool:
        self.contexts.add(w.lower())
        return False

    def ends_after(self, ws: list[str]) -> None:
        cs = [EndModel._label(ws, i) for i in range(len(ws))]
        self.contexts.update(hash_of(cs[-k:]) for k in EndModel.ORDERS if k <= len(cs))


def counted_of(text: str) -> str:
    """What a model counts of a text: the answer, without marks of omission at its end."""
    t = unwrapped(text)[0]
    return _MARK.sub("", t) if t.rstrip().endswith(("...", "…", "]")) else t


def lines_of(text: str) -> list[list[str]]:
    """The words of each line that a model counts."""
    return [ws for line in counted_of(text).split("\n") if (ws := words_of(line))]


class Counts:
    """What a model of sentence ends counts in texts."""

    def __init__(self) -> None:
        self.seen: Counter = Counter()
        self.ends: Counter = Counter()
        self.bare: Counter = Counter()
        self.known: set[str] = set()

    def add(self, text: str) -> None:
        for ws in lines_of(text):
            n = len(ws)
            cs = [EndModel._label(ws, i) for i in range(n)]
            for i, w in enumerate(ws):
                if not w[0].isalnum():
                    continue
                if i + 1 == n:  # a text's bare end says nothing of sentences
                    if n >= 3:
                        self.bare[hash_of(ws[-3:])] += 1
                    continue
                self.known.add(w)
                for k in EndModel.ORDERS:
                    if i + 1 >= k:
                        key = hash_of(cs[i + 1 - k : i + 1])
                        self.seen[key] += 1
                        self.ends[key] += ws[i + 1] in _TERMINAL

    def all(self) -> Iterator[tuple[str, str, int, int]]:
        """kind, key, n and ends of each count."""
        yield from (("seen", k, n, self.ends[k]) for k, n in self.seen.items())
        yield from (("bare", k, n, 0) for k, n in self.bare.items())
        yield from (("known", w, 1, 0) for w in self.known)
        yield from (("begins", w, 1, 0) for w in {w[:k] for w in self.known for k in range(1, len(w))})


class _Words(dict):
    """Number of each word, 0 of a line's end; beside it its labels at a line's start, after a capital, elsewhere, and what it is (``WORD`` and so on)."""

    WORD, CAPITAL, STOP, CLOSE = 1, 2, 4, 8

    def __init__(self, closes: set[str]) -> None:
        """closes: words that end a close which is asked for."""
        self.closes = closes
        self.labels: dict[str, int] = {}
        self.start, self.after, self.other, self.kind = array("i"), array("i"), array("i"), array("b")
        self.names: list[str] = []
        self["\n"]

    def label(self, s: str) -> int:
        return self.labels.setdefault(s, len(self.labels))

    def __missing__(self, w: str) -> int:
        self.start.append(self.label(EndModel._label([w], 0)))
        self.after.append(self.label(EndModel._label(["A", w], 1)))
        self.other.append(self.label(EndModel._label(["a", w], 1)))
        self.kind.append(self.WORD * w[0].isalnum() | self.CAPITAL * w[0].isupper() | self.STOP * (w in _TERMINAL) | self.CLOSE * (w in self.closes))
        self.names.append(w)
        self[w] = len(self)
        return self[w]


class _Pieces(dict):
    """Number of each piece between spaces, whose words are looked for once; no word goes over a space."""

    def __init__(self, words: _Words) -> None:
        self.words, self.held = words, 0
        self.flat, self.stops = array("i"), array("q")

    def __missing__(self, piece: str) -> int:
        self.flat.extend(map(self.words.__getitem__, _signs_apart(_WORD_OR_LINE.findall(piece), piece)))
        self.stops.append(len(self.flat))
        self.held += len(piece) + 64
        self[piece] = len(self)
        return self[piece]

    def ids(self, text: str) -> np.ndarray:
        """The numbers of the words of ``text`` and of its lines' ends."""
        if not text:
            return np.empty(0, np.int32)
        pieces = np.array(list(map(self.__getitem__, text.replace("\n", " \n ").split(" "))), np.int32)
        flat, stops = np.frombuffer(self.flat, np.int32), np.frombuffer(self.stops, np.int64)
        sizes = np.diff(stops, prepend=0)
        first, n = (stops - sizes)[pieces], sizes[pieces]
        ends = np.cumsum(n)
        return flat[np.repeat(first - ends + n, n) + np.arange(ends[-1])]


class AskedCounts:
    """As ``Counts``, of what is asked alone, a block of texts at a time: contexts are nodes of a tree that is read from the last word back."""

    def __init__(self, asked: Asked) -> None:
        self.asked, self.words = asked, _Words({c.rsplit("\x1f", 1)[-1] for c in asked.closes})
        self.pieces = _Pieces(self.words)
        self.nodes = {"": 0}
        edges = []
        for context in sorted(asked.contexts, key=lambda c: c.count("\x1f")):
            first, _, rest = context.partition("\x1f")
            edges.append((self.nodes[rest] << 32) + self.words.label(first))
            self.nodes[context] = len(self.nodes)
        order = np.argsort(edges, kind="stable") if edges else np.empty(0, np.int64)
        self.edges, self.targets = np.array(edges, np.int64)[order], order + 1
        #: The node of a last word by its label; 0 of those that aren't asked for, whose labels come later.
        self.first = np.zeros(len(self.words.labels) + 1, np.int64)
        roots = self.edges < 1 << 32
        self.first[self.edges[roots]] = self.targets[roots]
        self.seen, self.ends = np.zeros(len(self.nodes), np.int64), np.zeros(len(self.nodes), np.int64)
        self.bare: Counter = Counter()
        #: Whether each word was seen before a line's last word.
        self.inner = np.zeros(0, bool)

    def add(self, texts: Iterable[str]) -> None:
        if self.pieces.held > HELD_PIECES:
            self.pieces = _Pieces(self.words)
        ids = self.pieces.ids("\n".join(map(counted_of, texts)) + "\n")
        line_ends = np.flatnonzero(ids == 0)
        sizes = np.diff(line_ends, prepend=-1) - 1
        ids, sizes = ids[ids != 0], sizes[sizes > 0]
        if not len(ids):
            return
        kind = np.frombuffer(self.words.kind, np.int8)[ids]
        stops = np.cumsum(sizes)
        inner = np.ones(len(ids), bool)
        inner[stops - 1] = False  # a text's bare end says nothing of sentences
        self.inner = np.concatenate([self.inner, np.zeros(len(self.words) - len(self.inner), bool)])
        self.inner[ids[inner]] = True
        names = self.words.names
        closing = stops[(sizes >= 3) & (kind[stops - 1] & _Words.WORD != 0) & (kind[stops - 1] & _Words.CLOSE != 0)] - 1
        for a, b, c in zip(ids[closing - 2].tolist(), ids[closing - 1].tolist(), ids[closing].tolist()):
            if (close := hash_of([names[a], names[b], names[c]])) in self.asked.closes:
                self.bare[close] += 1
        place = np.arange(len(ids)) - np.repeat(stops - sizes, sizes)
        start, after, other = (np.frombuffer(x, np.int32) for x in (self.words.start, self.words.after, self.words.other))
        label = np.where(place == 0, start[ids], np.where(np.roll(kind & _Words.CAPITAL, 1) > 0, after[ids], other[ids]))
        at = np.flatnonzero(inner & (kind & _Words.WORD > 0))
        node = np.zeros(len(at), np.int64)
        for k in EndModel.ORDERS:
            if k > 1:
                within = place[at] >= k - 1
                at, node = at[within], node[within]
            if not len(at):
                break
            if k == 1:
                child = self.first[np.minimum(label[at], len(self.first) - 1)]
            else:
                edge = (node << 32) + label[at - k + 1]
                j = np.minimum(np.searchsorted(self.edges, edge), len(self.edges) - 1)
                child = np.where(self.edges[j] == edge, self.targets[j], 0)
            hit = child > 0
            at, node = at[hit], child[hit]
            self.seen += np.bincount(node, minlength=len(self.seen))
            self.ends += np.bincount(node[kind[at + 1] & _Words.STOP > 0], minlength=len(self.ends))

    def all(self) -> Iterator[tuple[str, str, int, int]]:
        """kind, key, n and ends of each count."""
        yield from (("seen", k, int(self.seen[i]), int(self.ends[i])) for k, i in self.nodes.items() if self.seen[i])
        yield from (("bare", k, n, 0) for k, n in self.bare.items())
        wanted, known = self.asked.words, [self.words.names[i] for i in np.flatnonzero(self.inner)]
        yield from (("known", w, 1, 0) for w in known if w in wanted)
        yield from (("begins", w, 1, 0) for w in {w[:k] for w in known for k in range(1, len(w)) if w[:k] in wanted})


class Open(Exception):
    """The parsed structure is left open at the end of the text."""


def open_structure(text: str) -> str | None:
    """The structure left open at the text's end, found by a pushdown parser, or None.

    Fences, JSON (objects, arrays, strings), table rows and tags count in the whole text; brackets and quotations of
    prose only in the last paragraph, since stray signs elsewhere say nothing of the end.
    """
    t = text.rstrip()
    fences = re.findall(r"(?m)^\s*(```|~~~)", t) if "```" in t or "~~~" in t else []
    body = t
    if len(fences) % 2:
        return "fence"
    if fences:
        m = re.search(r"(?s)(```|~~~)[^\n]*\n(.*?)\n?\s*\1\s*$", t)
        body = m.group(2) if m else t
    at = _json_start(body)
    if at is not None:
        state = _json_stack(body[at:])
        if state:
            return state
        return None
    last = body.rsplit("\n", 1)[-1]
    if last.lstrip().startswith("|") and not last.rstrip().endswith("|") and last.count("|") >= 1:
        return "table row"
    if "<" in last and re.search(r"<[a-zA-Z/][^<>]*$", last):
        return "tag"
    if "<" in body and (left := _open_element(body)) is not None:
        return left
    paragraph = body.rsplit("\n\n", 1)[-1]
    if paragraph.rstrip(_CLOSERS)[-1:] not in _TERMINAL:
        stack: list[str] = []
        pairs = {")": "(", "]": "[", "”": "“", "»": "«", "」": "「"}
        for c in _ENCLOSING.findall(paragraph):
            if c in "([“«「":
                stack.append(c)
            elif c == '"':
                if stack and stack[-1] == '"':
                    stack.pop()
                else:
                    stack.append(c)
            elif c in pairs and stack and stack[-1] == pairs[c]:
                stack.pop()
        if stack and any(c.isalnum() for c in paragraph[paragraph.rindex(stack[-1]) :]):
            return "bracket or quotation"
    return None


# Elements that have no end.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr p li td tr th dt dd option".split())
_ELEMENT = re.compile(r"<(/?)([A-Za-z][\w-]*)(?:\s[^<>]*)?(/?)>")


def _open_element(body: str) -> str | None:
    """The element that encloses the text and isn't closed: one whose tag begins a line. Stray tags within lines say nothing."""
    stack: list[str] = []
    for m in _ELEMENT.finditer(body):
        name = m.group(2).lower()
        if name in VOID or m.group(3):
            continue
        if m.group(1):
            if name in stack:
                while stack.pop() != name:
                    pass
        elif not body[body.rfind("\n", 0, m.start()) + 1 : m.start()].strip():
            stack.append(name)
    return "element" if stack else None


def _json_start(body: str) -> int | None:
    s = body.lstrip()
    if s[:1] in "{[" and re.match(r"[{\[]\s*(?:[\"{\[\]}]|$)", s):
        return len(body) - len(s)
    m = re.search(r"\n\s*(?=\{\s*\")", body) if "{" in body else None
    return m.end() if m else None


#: A string, to its end or that of the text, or a sign beside strings.
_JSON_SIGN = re.compile(r'("[^"\\]*(?:\\.[^"\\]*)*("?)|[{}\[\]])', re.DOTALL)


def _json_stack(s: str) -> str | None:
    depth = 0
    for c, closed in _JSON_SIGN.findall(s):
        if c[0] == '"':
            if not closed:
                return "JSON string"
        elif c in "{[":
            depth += 1
        elif depth:
            depth -= 1
    return "JSON" if depth else None


_FENCE = re.compile(r"^\s*(?:```|~~~)[\w-]*[ \t]*\n?(.*?)\n?\s*(?:```|~~~)\s*$", re.DOTALL)
#: Fields that hold an answer.
ANSWER_FIELDS = ("text", "answer", "response", "content", "output", "result", "message", "completion", "refusal")


def unwrapped(text: str) -> tuple[str, bool]:
    """The answer within fences, answer tags or a JSON object, and whether it was JSON."""
    t = text.strip().strip("​‌‍⁠﻿").strip()
    for _ in range(3):
        m = _FENCE.match(t) if t.startswith(("```", "~~~")) else None
        if m:
            t = m.group(1).strip()
            continue
        m = re.match(r"(?is)^<(answer|response|output)>(.*)</\1>$", t) if t.startswith("<") else None
        if m:
            t = m.group(2).strip()
            continue
        break
    at = _json_start(t)
    if at is None:
        if t in ('""', "''"):
            return "", True
        return t, False
    try:
        value = json.loads(t[at:])
    except ValueError:
        return t, False
    if isinstance(value, dict):
        named = [value[k] for k in ANSWER_FIELDS if k in value]
        if named:
            return " ".join(_leaves(named)).strip(), True
    return " ".join(_leaves([value])).strip(), True


def _leaves(values: list) -> list[str]:
    out: list[str] = []
    stack = list(reversed(values))
    while stack:
        v = stack.pop()
        if isinstance(v, str):
            out.append(v)
        elif isinstance(v, bool) or v is None:
            pass
        elif isinstance(v, (int, float)):
            out.append(str(v))
        elif isinstance(v, dict):
            stack.extend(reversed(list(v.values())))
        elif isinstance(v, list):
            stack.extend(reversed(v))
    return out


def is_cut(text: str | None, model: EndModel, at_spike: bool = False, options: frozenset[str] = frozenset(), taken: tuple[str, bool] | None = None) -> str | None:
    """Why ``text`` was cut (limit, structure, character, word or sentence), or None if it wasn't.

    ``options`` are lines that are whole answers as they stand, ``taken`` the text out of its wrapping if known. Null, empty and blank texts weren't cut.
    """
    if not text or not text.strip():
        return None
    t = text.rstrip()
    if t.endswith("�"):
        return "character"
    if (left := open_structure(t)) is not None:
        return "limit" if at_spike else "structure"
    inner, was_json = unwrapped(t) if taken is None else taken
    if was_json:
        t = inner
    elif inner:
        t = inner
    if not t.strip():
        return None
    last = t.rsplit("\n", 1)[-1].strip()
    if last in options or t in options:
        return None
    marked = _MARK.search(t[-40:]) if t.rstrip().endswith(("...", "…", "]")) else None
    if marked:
        t = t[: len(t[:-40]) + marked.start()].rstrip()
        last = t.rsplit("\n", 1)[-1].strip()
        if not t:
            return None
    bare = t.rstrip(_CLOSERS + " ")
    if not bare or bare[-1] in _TERMINAL:
        return None
    if t[-1] in "|>" or (t[-1] in "\"”»)]}`" and not marked):
        return None
    if bare[-1] in ",(/&" and any(c.isalnum() for c in last):
        return "sentence"
    ws = words_of(last)
    while ws and not ws[-1][0].isalnum():
        ws.pop()
    if not ws:
        return None
    if at_spike:
        return "limit"
    if model.cut_word(ws[-1]) and bare[-1].isalnum() and len(words_of(t)) > 2:
        return "word"
    if _LIST.match(last) and model.never_ends(ws[-1]):
        return "sentence"
    plain = _LIST.match(last) or _CAPTION.match(last) or last.startswith("|")
    if plain or len(words_of(t)) <= 4:
        return None
    if hash_of(ws[-3:]) in model.bare and (model.ends_after(ws[-1:]) or 0) >= 0.1:
        return None
    # the last sentence only, so that contexts don't reach over its start
    start = max((i + 1 for i, w in enumerate(ws) if w in _TERMINAL), default=0)
    p = model.ends_after(ws[start:] if start < len(ws) else ws)
    if p is None:  # never seen: a mark of omission, or one or two letters, are no end
        return "sentence" if marked else "word" if len(ws[-1]) <= 2 and ws[-1].isalpha() and ws[-1].islower() else None
    return "sentence" if p < (MARKED_BELOW if marked else CUT_BELOW) else None


def fit_ends(df: DataFrame, key: str, text: str, rows: int = FIT_ROWS) -> EndModel:
    """The model of sentence ends, counted in all texts of ``df``, for these same texts. Three texts of ``rows`` make a customary close.

    One pass finds what their ends ask of the model, the other counts that alone; a task gives on its sums. What is asked comes to the
    driver and to every worker: it grows with the different ends of texts that don't end soundly. Null and empty texts don't
    count; ``key`` isn't read.
    """
    texts = widened(df.select(F.col(text).alias("_text")).where("_text is not null and _text <> ''"))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, n = Asked(), 0
        for batch in batches:
            n += batch.num_rows
            for t in batch.column(0).to_pylist():
                is_cut(t, asked)
        kinds = [("context", k) for k in asked.contexts] + [("close", k) for k in asked.closes] + [("word", k) for k in asked.words] + [("texts", "")]
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in kinds], pa.string()), pa.array([k for _, k in kinds], pa.string()), pa.array([0] * (len(kinds) - 1) + [n], pa.int64())], names=["kind", "key", "n"])

    asked, n_texts = Asked(), 0
    wanted = {"context": asked.contexts, "close": asked.closes, "word": asked.words}
    for batch in texts.mapInArrow(ask, "kind string, key string, n bigint").groupBy("kind", "key").agg(F.sum("n").alias("n")).toArrow().to_batches():
        for kind, k, n in zip(*(batch.column(i).to_pylist() for i in range(3))):
            if kind == "texts":
                n_texts = n
            else:
                wanted[kind].add(k)
    shared = df.sparkSession.sparkContext.broadcast(asked)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = AskedCounts(shared.value)
        types = (pa.string(), pa.string(), pa.int64(), pa.int64())

        def given() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*counts.all()), types)] or [pa.array([], t) for t in types], names=["kind", "key", "n", "ends"])

        for batch in batches:
            block, size = [], 0
            for t in batch.column(0).to_pylist():
                block.append(t)
                size += len(t)
                if size > 1 << 20:
                    counts.add(block)
                    block, size = [], 0
            counts.add(block)
            if len(counts.words) > HELD_COUNTS:
                yield given()
                counts = AskedCounts(shared.value)
        yield given()

    sums = texts.mapInArrow(count, "kind string, key string, n bigint, ends bigint").groupBy("kind", "key").agg(F.sum("n").alias("n"), F.sum("ends").alias("ends")).toArrow()
    return EndModel.of_counts((x for batch in sums.to_batches() for x in zip(*(batch.column(i).to_pylist() for i in range(4)))), n_texts, rows)


def _accident(c: Column, mean: Column) -> Column:
    """Log of a bound on the chance that a Poisson count of that mean reaches ``c`` (Chernoff); 0 where it isn't above it."""
    return F.when(c > mean, c - mean - c * F.log(c / mean)).otherwise(F.lit(0.0))


def ends_soundly(text: Column) -> Column:
    """Whether ``SOUND_END`` is found in ``text``: in its last signs alone, unless these are all such as may follow an end."""
    last = F.right(text, F.lit(32))
    return last.rlike(SOUND_END) | last.rlike(SOUND_AFTER) & text.rlike(SOUND_END)


def length_spikes(df: DataFrame, source: Column, text: Column) -> DataFrame:
    """source, unit ('c' or 'b'), n, c, bare and at_maximum of each length at which a source's values pile up without an end.

    A spike's count is one that its neighbours' mean (and one more) makes by accident less than ``SPIKE_CHANCE`` times over all
    lengths of all sources; most of the excess has no end. at_maximum: no value of the source is longer. Histograms cover all
    rows. Null and empty texts don't count; a null source is ''.
    """
    t = df.select(F.coalesce(source.cast("string"), F.lit("")).alias("source"), text.alias("t")).where("t is not null and t <> ''")
    # before the rows are doubled, so that a text's end is tested once
    sizes = t.select("source", F.length("t").alias("c"), F.octet_length("t").alias("b"), (~ends_soundly(F.col("t"))).cast("int").alias("bare"))
    lengths = sizes.select("source", "bare", F.expr("stack(2, 'c', c, 'b', b) as (unit, n)"))
    counts = lengths.groupBy("source", "unit", "n").agg(F.count(F.lit(1)).alias("c"), F.sum("bare").alias("bare"))
    own = W.partitionBy("source", "unit")
    near = own.orderBy("n").rangeBetween(-SPIKE_REACH, SPIKE_REACH)
    beside = F.greatest((F.sum("c").over(near) - F.col("c")) / F.lit(2.0 * SPIKE_REACH), F.lit(0.0))
    bare_beside = F.greatest((F.sum("bare").over(near) - F.col("bare")) / F.lit(2.0 * SPIKE_REACH), F.lit(0.0))
    d = counts.withColumns({"mean": beside, "bare_mean": bare_beside, "most": F.max("n").over(own), "tests": F.count(F.lit(1)).over(own)})
    excess = F.col("c") - F.col("mean")
    rare = _accident(F.col("c"), F.col("mean") + 1) < F.log(F.lit(SPIKE_CHANCE) / F.col("tests"))
    found = d.where((F.col("n") > SPIKE_LEAST) & rare & (excess >= SPIKE_EXCESS * F.col("c")) & (F.col("bare") - F.col("bare_mean") >= SPIKE_BARE * excess))
    return found.select("source", "unit", F.col("n").cast("int").alias("n"), "c", "bare", (F.col("n") == F.col("most")).alias("at_maximum"))


Spikes = dict[str, set[tuple[str, int]]]


def spikes(df: DataFrame, source: Column, text: Column, most: int = MOST_SPIKES) -> Spikes | None:
    """The spikes of each source, those at its maximum among them; None if there are more than ``most``, for which the joined way holds."""
    got = length_spikes(df, source, text).limit(most + 1).collect()
    if len(got) > most:
        return None
    out: Spikes = {}
    for r in got:
        out.setdefault(r.source, set()).add((r.unit, r.n))
    return out


def spiked(df: DataFrame, source: Column, text: Column, most: int = MOST_SPIKES) -> tuple[DataFrame, Spikes]:
    """``df`` with _spike, and the spikes that are still to be looked up.

    Up to ``most`` spikes they are looked up from the table that is returned, and _spike is null; beyond, rows are joined with them
    by source and length (texts stay with their rows; the spikes are the smaller side).
    """
    known = spikes(df, source, text, most)
    if known is not None:
        return df.withColumn("_spike", F.lit(None).cast("boolean")), known
    found = length_spikes(df, source, text).select(F.col("source").alias("_s"), F.col("unit").alias("_u"), F.col("n").alias("_n")).distinct()
    out = df.withColumn("_source", F.coalesce(source.cast("string"), F.lit("")))
    for unit, size in (("c", F.length(text)), ("b", F.octet_length(text))):
        side = found.where(F.col("_u") == unit).select("_s", "_n", F.lit(True).alias(f"_at_{unit}"))
        out = out.withColumn("_size", size).join(side, (F.col("_source") == F.col("_s")) & (F.col("_size") == F.col("_n")), "left").drop("_s", "_n", "_size")
    return out.withColumn("_spike", F.coalesce("_at_c", F.lit(False)) | F.coalesce("_at_b", F.lit(False))).drop("_source", "_at_c", "_at_b"), {}


def at_spike(spiky: Spikes, source: str | None, text: str) -> bool:
    s = spiky.get(source or "")
    return bool(s) and (("c", len(text)) in s or ("b", len(text.encode("utf-8", "surrogatepass"))) in s)


def find_truncated(df: DataFrame, id_columns: list[str], text_column: str, source: Column, model: EndModel, most_spikes: int = MOST_SPIKES) -> DataFrame:
    """``id_columns``, source, cut (why) and the text of every text of ``df`` that was cut; repeated rows repeat.

    Null, empty and blank texts weren't cut; a null source is a source of its own; one pass after the histograms,
    no shuffle of texts.
    """
    df, spiky = spiked(df, source, F.col(text_column), most_spikes)
    shared = df.sparkSession.sparkContext.broadcast((model, spiky))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ends, known = shared.value
        for batch in batches:
            take, why = [], []
            for i, (t, s, at) in enumerate(zip(*(batch.column(j).to_pylist() for j in range(3)))):
                if t and (w := is_cut(t, ends, at_spike(known, s, t) if at is None else at)):
                    take.append(i)
                    why.append(w)
            rows = pa.array(take, pa.int64())
            yield pa.RecordBatch.from_arrays([*(c.take(rows) for i, c in enumerate(batch.columns) if i != 2), pa.array(why, pa.string())], names=["_text", "source", *id_columns, "cut"])

    ids = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in id_columns)
    found = widened(df.select(F.col(text_column).alias("_text"), source.cast("string").alias("source"), "_spike", *id_columns)).mapInArrow(judge, f"_text string, source string, {ids}, cut string")
    return found.select(*id_columns, "source", "cut", F.col("_text").alias(text_column))


def shares_cut(rows: DataFrame, cut: DataFrame, key: list[str]) -> DataFrame:
    """For each source of ``rows`` (key columns and source) the number of keys, of those in ``cut``, and their share."""
    all_ = rows.groupBy(*key).agg(F.min("source").alias("source"))
    marked = all_.join(cut.select(*key).distinct().withColumn("_cut", F.lit(1)), key, "left")
    return marked.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count("_cut").alias("n_cut")).withColumn("share_cut", F.round(F.col("n_cut") / F.col("n"), 9))
