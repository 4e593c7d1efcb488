"""Evaluation texts in training passages: BM25 over an inverted index of test items, retrieved by block-max WAND.

The test items (their questions and answers as fields of their own) are the indexed side; every passage of the corpus
queries it by each of its windows of ``run`` words, whose terms have weight one. Each field's threshold is the least
score that a window taken from it can have. Impacts are divided by it, so that one threshold, 1, holds for all fields
and nothing that reaches it is lost. A window whose terms' largest impacts don't add up to the threshold is skipped. In
the others the terms with the longest postings, as long as their largest impacts alone stay below the threshold, are
passed over (in an index whose maxima are too many for a table): a field needs one of the rest, the pivot terms, whose postings alone give the candidate blocks. The
largest impacts of all terms in a candidate block bound it, and only blocks whose bound reaches the threshold are
scored. What is retrieved is then verified on the words themselves.

Postings are sparse. Items are indexed in shards; passages are turned into words once for all shards of a broadcast. More
items than one broadcast may hold are searched in groups, over each of which the passages pass once.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from windrow.session import widened, written

RUN, BLOCK = 8, 32
#: Bytes up to which the largest impacts of all terms and blocks are kept as a table; beyond, candidates come from pivot terms.
DENSE_BYTES = 8 << 20
#: The threshold, less what sums of rounded impacts may lack.
ENOUGH = 0.999
K1, B = 1.2, 0.75
#: Fields of one index shard; fields, and bytes of their indexes, of one broadcast.
SHARD, MOST_ITEMS, MOST_BYTES = 20_000, 100_000, 128 << 20

_MARKUP = re.compile(r"</?[A-Za-z][^<>\n]{0,200}>|<!--.*?-->", re.DOTALL)
_ENTITY = re.compile(r"&(?:#\d{1,7}|#x[0-9a-fA-F]{1,6}|[A-Za-z]{2,31});")
_BROKEN = re.compile(r"(?<=\w)[-‐‑]\s*\n\s*(?=\w)")
_TOKEN = re.compile(r"[^\W_]+")
#: Letters of other scripts, and signs, that look like Latin ones.
_LOOKALIKE = str.maketrans("авеіјкмнорсѕтухһԁԛԝѵгєАВЕІЈКМНОРСЅТУХοανρτικυωΑΒΕΖΗΙΚΜΝΟΡΤΥΧıłøđ", "abeijkmhopcstyxhdqwvreabeijkmhopcstyxoavptikuwabezhikmnoptyxilod")
_MIXED = re.compile(r"(?=\w*[a-zA-Zß-ɏ])(?=\w*[Ͱ-ӿԀ-ԯ])\w+")
_HIDDEN = dict.fromkeys([0xAD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF, 0x34F, 0x180E, 0x200E, 0x200F, *range(0x202A, 0x202F), *range(0xFE00, 0xFE10)])


def plain(text: str) -> str:
    """``text`` without case, markup, hidden signs, accents, width variants, lookalike letters and broken words."""
    if "<" in text:
        text = _MARKUP.sub(" " if "<br" in text or "<p" in text else "", text)
    if "&" in text and _ENTITY.search(text):
        text = html.unescape(text)
    if not text.isascii():
        text = text.translate(_HIDDEN)
        text = unicodedata.normalize("NFKD", text)
        text = "".join(c for c in text if not unicodedata.combining(c)) if not text.isascii() else text
        if not text.isascii():
            text = _MIXED.sub(lambda m: m.group().translate(_LOOKALIKE), text)
            text = text.casefold()
    if "\n" in text:
        text = _BROKEN.sub("", text)
    return text.lower()


def words_of(text: str) -> list[str]:
    """The words of ``plain(text)``. Marks between letters of a word (``**``, ``_``) part no word from its own letters."""
    t = plain(text)
    if "*" in t or "_" in t or "`" in t or "~" in t:
        t = re.sub(r"[*_`~]+", "", t)
    return _TOKEN.findall(t)


class Index:
    """The inverted index of item fields, with block maxima."""

    def __init__(self, items: list[tuple[str, str]], run: int = RUN) -> None:
        """items: (item id, text of one field); fields with fewer than ``run`` words can't occur and aren't indexed."""
        self.run = run
        fields = [(k, w) for k, t in items if t and len(w := words_of(t)) >= run]
        # items that share rare terms lie in one block, so that block maxima bound tightly
        df: dict[str, int] = defaultdict(int)
        for _, w in fields:
            for t in set(w):
                df[t] += 1
        fields.sort(key=lambda f: sorted((df[t], t) for t in set(f[1]))[:2])
        self.ids = [k for k, _ in fields]
        n = max(1, len(fields))
        mean = sum(len(w) for _, w in fields) / n
        self.terms = {t: i for i, t in enumerate(sorted(df))}
        self.blocks = -(-len(fields) // BLOCK)
        postings: list[list[tuple[int, float]]] = [[] for _ in self.terms]
        self.grams: list[frozenset[tuple[str, ...]]] = []
        for i, (_, w) in enumerate(fields):
            impact = {}
            for t in set(w):
                tf = w.count(t)
                idf = np.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5))
                impact[t] = float(idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(w) / mean)))
            least = min(sum(impact[t] for t in set(w[j : j + run])) for j in range(len(w) - run + 1))
            for t, v in impact.items():
                postings[self.terms[t]].append((i, v / least))
            self.grams.append(frozenset(tuple(w[j : j + run]) for j in range(len(w) - run + 1)))
        none = len(postings)
        # postings by term, then field; each has its block, of which fields lie side by side
        self.term_start = np.concatenate([[0], np.cumsum([len(p) for p in postings])]).astype(np.int64)
        self.field = np.array([i for p in postings for i, _ in p], np.int32)
        self.impact = np.array([v for p in postings for _, v in p], np.float32)
        #: One row a term and block: key, first posting, largest impact.
        term = np.repeat(np.arange(none, dtype=np.int64), np.diff(self.term_start))
        key = term * max(1, self.blocks) + self.field // BLOCK
        self.block_key, self.block_start = np.unique(key, return_index=True) if len(key) else (key, key)
        self.block_most = np.maximum.reduceat(self.impact, self.block_start) if len(key) else np.zeros(0, np.float32)
        self.block_end = np.append(self.block_start[1:], len(key)).astype(np.int64)
        #: Rows of ``block_key`` of each term; the last two terms are words of no item and ends, without postings.
        self.rows = np.searchsorted(self.block_key, np.arange(none + 3, dtype=np.int64) * max(1, self.blocks))
        self.rows[none:] = len(self.block_key)
        self.most = np.zeros(none + 2)
        if len(key):
            np.maximum.at(self.most, term, self.impact)
        self.most[none + 1] = -1e9
        #: The largest impacts as a table of terms and blocks, where that is small; they are added up faster than looked up.
        self.maxima: np.ndarray | None = None
        if (none + 2) * max(1, self.blocks) * 4 <= DENSE_BYTES:
            self.maxima = np.zeros((none + 2, max(1, self.blocks)), np.float32)
            if len(key):
                self.maxima.reshape(-1)[self.block_key] = self.block_most
            self.maxima[none + 1] = -1e9

    @property
    def nbytes(self) -> int:
        """About the bytes that the index takes."""
        arrays = (self.field, self.impact, self.block_key, self.block_start, self.block_end, self.block_most, self.rows, self.most)
        return sum(a.nbytes for a in arrays) + (0 if self.maxima is None else self.maxima.nbytes) + 100 * len(self.terms) + sum(200 * len(g) for g in self.grams)

    def retrieve(self, ids: np.ndarray) -> Iterator[tuple[int, int]]:
        """(first word, field) of all windows of ``run`` words in ``ids`` whose score for the field reaches the threshold.

        ids: terms of consecutive words; len(terms) stands for words of no item, one more for the end of a passage.
        """
        run = self.run
        if len(ids) < run or not self.blocks:
            return
        total = np.concatenate([[0.0], np.cumsum(self.most[ids])])
        windows = np.flatnonzero(total[run:] - total[:-run] >= ENOUGH)
        for k in range(0, len(windows), 4096):
            part = windows[k : k + 4096]
            yield from self._score(part, ids[part[:, None] + np.arange(run)])

    def _pivots(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Windows and candidate blocks: those in which a pivot term of the window stands."""
        nb = self.blocks
        lengths = self.rows[terms + 1] - self.rows[terms]
        # pivots: all terms but the commonest, as long as those alone can't reach the threshold
        order = np.argsort(-lengths, axis=1, kind="stable")
        passed = np.cumsum(np.take_along_axis(self.most[terms], order, 1), axis=1) < ENOUGH
        pivot = np.ones(terms.shape, bool)
        np.put_along_axis(pivot, order, ~passed, 1)
        w, j = np.nonzero(pivot & (lengths > 0))
        rows, owner = _ranges(self.rows[terms[w, j]], self.rows[terms[w, j] + 1])
        pairs = np.unique(w[owner].astype(np.int64) * nb + self.block_key[rows] % nb)
        return pairs // nb, pairs % nb

    def _score(self, part: np.ndarray, terms: np.ndarray) -> Iterator[tuple[int, int]]:
        nb = self.blocks
        if self.maxima is not None:
            bound = self.maxima[terms[:, 0]]
            for j in range(1, self.run):
                bound += self.maxima[terms[:, j]]
            window, block = np.nonzero(bound >= ENOUGH)
        else:
            window, block = self._pivots(terms)
        if not len(window):
            return
        # the bound of each candidate block, from the row that each term of the window has there
        wanted = terms[window] * nb + block[:, None]
        at = np.minimum(np.searchsorted(self.block_key, wanted), len(self.block_key) - 1)
        there = (self.block_key[at] == wanted) & (terms[window] < len(self.terms))
        chosen = np.flatnonzero(np.where(there, self.block_most[at], 0).sum(1) >= ENOUGH)
        if not len(chosen):
            return
        c, j = np.nonzero(there[chosen])
        row = at[chosen][c, j]
        posts, owner = _ranges(self.block_start[row], self.block_end[row])
        cell = c[owner].astype(np.int64) * BLOCK + self.field[posts] % BLOCK
        scores = np.bincount(cell, weights=self.impact[posts], minlength=len(chosen) * BLOCK)
        for x in np.flatnonzero(scores >= ENOUGH).tolist():
            p = chosen[x // BLOCK]
            yield int(part[window[p]]), int(block[p]) * BLOCK + x % BLOCK

    def search(self, texts: list[str]) -> list[set[str]]:
        """For each text the ids of the items of which it holds ``run`` consecutive words."""
        return self.search_words(Words(texts))

    def search_words(self, read: Words) -> list[set[str]]:
        """``search`` of texts that are words already."""
        found: list[set[str]] = [set() for _ in range(read.n)]
        none, end = len(self.terms), len(self.terms) + 1
        # each distinct word is looked up once
        term = np.array([end if w == "" else self.terms.get(w, none) for w in read.vocabulary], np.int64)
        for at, field in self.retrieve(term[read.ids]):
            i = read.owner[int(np.searchsorted(read.starts, at, "right")) - 1]
            if self.ids[field] not in found[i] and tuple(read.words[at : at + self.run]) in self.grams[field]:
                found[i].add(self.ids[field])
        return found


class Words:
    """The words of some texts in each of their readings, one after another, parted by '': made once for all shards."""

    def __init__(self, texts: list[str]) -> None:
        self.n = len(texts)
        self.words: list[str] = []
        self.owner: list[int] = []
        starts: list[int] = []
        for i, text in enumerate(texts):
            for w in self._readings(text):
                self.owner.append(i)
                starts.append(len(self.words))
                self.words += w
                self.words.append("")
        known: dict[str, int] = {}
        self.ids = np.array([known.setdefault(w, len(known)) for w in self.words], np.int64)
        self.vocabulary = list(known)
        self.starts = np.array(starts, np.int64)

    @staticmethod
    def _readings(text: str) -> Iterator[list[str]]:
        yield words_of(text)
        # a hyphen at a line's end may belong to the word: then its parts are two words, as elsewhere
        if "\n" in text and _BROKEN.search(text):
            yield words_of(_BROKEN.sub("- ", text))


def _ranges(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of the ranges [first, last), one after another, and the range that each is of."""
    n = last - first
    owner = np.repeat(np.arange(len(n)), n)
    return np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n), owner


def item_fields(items: DataFrame, id_column: str, text_columns: list[str]) -> DataFrame:
    """id and text of the items' fields; rows without id or text are left out, repeated ones count once."""
    return items.select(F.col(id_column).cast("string").alias("id"), F.explode(F.array(*[F.col(c) for c in text_columns])).alias("t")).where("id is not null and t is not null").distinct()


def _shards(rows: Sequence[tuple[str, str]], run: int) -> list[Index]:
    rows = sorted(rows)
    return [Index(rows[i : i + SHARD], run) for i in range(0, len(rows), SHARD)] or [Index([], run)]


def index_items(items: DataFrame, id_column: str, text_columns: list[str], run: int = RUN) -> list[Index]:
    """Index shards of test items that one broadcast holds; ``find_item_leaks`` takes any number."""
    return _shards([(r.id, r.t) for r in item_fields(items, id_column, text_columns).collect()], run)


def find_item_leaks(passages: DataFrame, id_columns: list[str], text_column: str, items: DataFrame, id_column: str, item_texts: list[str], item_name: str = "question_id", run: int = RUN, most_items: int | None = None, most_bytes: int | None = None) -> DataFrame:
    """``find_leaks`` of any number of items: in groups by hash of the id, of ``most_items`` fields and ``most_bytes`` about.

    One group is searched lazily; of several each is searched and its rows written before the next is made, so that the
    driver and the executors hold one group at a time. A group that comes out larger than its bytes is halved.
    """
    most_items, most_bytes = most_items or MOST_ITEMS, most_bytes or MOST_BYTES
    fields = item_fields(items, id_column, item_texts)
    n = fields.count()
    todo = [(g, groups) for groups in [max(1, -(-n // most_items))] for g in range(groups)]
    single = len(todo) == 1
    if not single:
        fields = written(fields, "items")
    parts: list[DataFrame] = []
    while todo:
        g, groups = todo.pop()
        shards = _shards([(r.id, r.t) for r in fields.where(F.pmod(F.xxhash64("id"), F.lit(groups)) == g).collect()], run)
        if sum(s.nbytes for s in shards) > most_bytes and sum(len(s.ids) for s in shards) > 1 and groups < 1 << 40:
            single = False
            todo += [(g, 2 * groups), (g + groups, 2 * groups)]
            continue
        found = find_leaks(passages, id_columns, text_column, shards, item_name)
        if single:
            return found
        parts.append(written(found, "leaks"))
    return reduce(DataFrame.unionByName, parts).distinct()


def find_leaks(passages: DataFrame, id_columns: list[str], text_column: str, shards: list[Index], item_name: str = "question_id") -> DataFrame:
    """``id_columns`` and the item id of every passage that holds ``run`` consecutive words of an item; distinct rows.

    Every passage queries every shard. Null, empty and short texts hold nothing; texts of any length are read whole;
    an item found twice in a passage, and repeated rows, count once. No shuffle but of the found keys.
    """
    shared = passages.sparkSession.sparkContext.broadcast(shards)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        indexes = shared.value
        for batch in batches:
            take: list[int] = []
            items: list[str] = []
            texts = batch.column(0).to_pylist()
            block: list[int] = []
            size = 0
            for i, t in enumerate(texts):
                if t:
                    block.append(i)
                    size += len(t)
                if block and (size > 1 << 19 or i == len(texts) - 1):
                    words = Words([texts[j] for j in block])
                    for index in indexes:
                        for r, got in zip(block, index.search_words(words)):
                            take += [r] * len(got)
                            items += sorted(got)
                    block, size = [], 0
            rows = pa.array(take, pa.int64())
            yield pa.RecordBatch.from_arrays([*(c.take(rows) for c in batch.columns[1:]), pa.array(items, pa.string())], names=[*id_columns, item_name])

    ids = ", ".join(f"`{c}` {passages.schema[c].dataType.simpleString()}" for c in id_columns)
    return widened(passages.select(text_column, *id_columns)).mapInArrow(search, f"{ids}, `{item_name}` string").distinct()
