"""Mapping of freely typed names to the entries of a reference list.

Values are deduplicated and normalised; candidates come from an inverted index of character trigrams over all names
and synonyms of the list and are scored by weighted cosine. The best is accepted above a threshold and with a margin
over every other entry, and verified part by part (genus and epithet), since two species of one genus share
most of their trigrams. Abbreviated genera and squashed or swapped parts are read as such; where a name fits several
entries, the parent genus decides. What isn't accepted is unmatched: entry 0.

A list of more names than one index may hold is searched in groups: each gives its candidates with weights from the
trigrams of the whole list, and the decision is made over the candidates of all.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from windrow.llm.leakage import _HIDDEN, _LOOKALIKE
from windrow.session import written

THRESHOLD, MARGIN = 0.45, 0.02
#: Entries of a reference list in one index, and bytes of the index, at most.
MOST_NAMES, MOST_BYTES = 100_000, 128 << 20

# Words beside a name that are no part of it, and what stands for a genus as a whole or for no name.
QUALIFIERS = frozenset("cf aff nr near prob probably possibly ca vel sensu lato stricto s l agg complex group ined nov nom dub syn auct auctt non nec hort et al ex in de van von der the a".split())
INFRA = frozenset("subsp ssp subspecies var variety f forma form morph cv strain str isolate serotype serovar biovar pv pathovar clone line type race no nr".split())
WHOLE_GENUS = frozenset("sp spp species indet gen genus all forms any unidentified undetermined".split())
NOTHING = frozenset(["", "none", "n a", "na", "null", "unknown", "not stated", "not given", "not known", "no name", "unnamed", "nan", "nil", "tbd", "misc", "various", "other", "unclear"])
_LEET = str.maketrans("013457$@", "oleastsa")
_AUTHOR = re.compile(r"\(?\b[A-Z][\w.'’-]+(?:\s*(?:&|and|et|,)\s*[A-Z][\w.'’-]+)*,?\s+(?:1[5-9]|20)\d\d\)?")
_PAREN = re.compile(r"\([^()]*\)|\[[^\[\]]*\]")


def folded(s: str) -> str:
    """``s`` without hidden signs, width variants, accents, lookalike letters and case."""
    s = unicodedata.normalize("NFKD", s.translate(_HIDDEN))
    s = "".join(c for c in s if not unicodedata.combining(c))
    if not s.isascii():
        s = s.translate(_LOOKALIKE)
    return s.casefold()


def _unleet(word: str) -> str:
    return word.translate(_LEET) if sum(c.isalpha() for c in word) >= 3 and any(c in "013457$@" for c in word) else word


class Reading:
    """What a typed value says: words of the name, an abbreviated genus, or a genus as a whole."""

    __slots__ = ("words", "abbreviated", "genus_only", "squashed")

    def __init__(self, value: str) -> None:
        raw = unicodedata.normalize("NFKC", value.translate(_HIDDEN))
        raw = _AUTHOR.sub(" ", raw) if not raw.isupper() else re.sub(r"\(?\b\w+,?\s+(?:1[5-9]|20)\d\d\)?\s*$", " ", raw)
        text = folded(raw)
        genus_only = bool(re.search(r"\((?:all|any)[^()]*\)|\b(?:sp|spp|species|indet)\b\.?\s*(?:\d*|[a-z])?\s*$", text)) or bool(re.match(r"\W*(?:genus|gen\.)\s+\w+\W*$", text))
        text = _PAREN.sub(" ", text)
        text = re.sub(r"\s+-\s+.*$", " ", text)  # "- adult form"
        text = re.sub(r"\b(?:auct|auctt)\b.*$|\b(?:nec|non)\s+\w+.*$", " ", text)
        parts = re.findall(r"[^\W_]+", re.sub(r"[`'’\"“”]", "", text))
        words: list[str] = []
        i = 0
        while i < len(parts):
            w = parts[i]
            if w in INFRA and i:
                break  # what follows names something below the species
            if w in ("genus", "gen", "species") and i + 1 < len(parts):
                i += 1
                continue
            if w in QUALIFIERS and not (len(w) == 1 and not words):
                i += 1
                continue
            if w in WHOLE_GENUS or w.isdigit():
                i += 1
                continue
            words.append(_unleet(w))
            i += 1
        first = re.match(r"\W*([^\W\d_]{1,4})(\.|\b)", text)
        self.abbreviated = words[0] if len(words) == 2 and len(words[0]) <= 4 and len(words[1]) >= 4 and (first is not None and (first.group(2) == "." or len(words[0]) <= 2)) else None
        self.words = words
        self.genus_only = genus_only
        self.squashed = "".join(words)


def _grams(s: str) -> Counter:
    t = f"^{s}$"
    return Counter(t[i : i + 3] for i in range(len(t) - 2))


def edits(a: str, b: str, most: int) -> int:
    """Damerau-Levenshtein distance (neighbours swapped count once), or ``most + 1`` where it is greater."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    before: list[int] = []
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row = row, [i] + [0] * len(b)
        for j, y in enumerate(b, 1):
            row[j] = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                row[j] = min(row[j], before[j - 2] + 1)
        if min(row) > most:
            return most + 1
        before = last
    return row[-1]


class Trigrams:
    """An inverted index of strings by character trigrams with weighted cosines."""

    def __init__(self, strings: list[str], df: dict[str, int] | None = None, n: int | None = None) -> None:
        """df, n: how many strings have each trigram, and how many strings there are, of the whole list if this is a part."""
        grams = [_grams(s) for s in strings]
        if df is None:
            df = Counter()
            for g in grams:
                df.update(g.keys())
        n = max(1, len(strings) if n is None else n)
        own = sorted({t for g in grams for t in g})
        self.term = {g: i for i, g in enumerate(own)}
        self.idf = np.array([np.log(1 + n / df[g]) for g in own])
        self.df, self.n = df, n
        self.unseen = float(np.log(1 + n))
        rows: list[list[tuple[int, float]]] = [[] for _ in own]
        for k, g in enumerate(grams):
            weight = {self.term[t]: (1 + np.log(c)) * self.idf[self.term[t]] for t, c in g.items()}
            norm = np.sqrt(sum(v * v for v in weight.values())) or 1.0
            for t, v in weight.items():
                rows[t].append((k, v / norm))
        self.start = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int64)
        self.post = np.array([k for r in rows for k, _ in r], np.int32)
        self.weight = np.array([w for r in rows for _, w in r])

    def cosines(self, s: str, least: float = THRESHOLD) -> dict[int, float]:
        """Strings whose weighted cosine with ``s`` is at least ``least``, from the postings of its trigrams."""
        at, gain, norm = [], [], 0.0
        for g, c in _grams(s).items():
            tf = 1 + np.log(c)
            t = self.term.get(g)
            w = tf * (np.log(1 + self.n / self.df[g]) if g in self.df else self.unseen)
            norm += w * w
            if t is not None:
                a, b = self.start[t], self.start[t + 1]
                at.append(self.post[a:b])
                gain.append(self.weight[a:b] * w)
        if not at:
            return {}
        score = np.bincount(np.concatenate(at), weights=np.concatenate(gain)) / np.sqrt(norm)
        found = np.flatnonzero(score >= least)
        return dict(zip(found.tolist(), score[found].tolist()))


Entry = tuple[int, str, "str | None", "list[str] | None"]
#: One candidate of a value: reading (0 as it stands, 1 its first two words, 2 abbreviated), edits (-1: written alike), entry, its genus, cosine.
Candidate = tuple[int, int, int, str, float]


def _forms(entry: Entry) -> Iterator[tuple[tuple[str, ...], str, str]]:
    """Words, joined form and abbreviated form of the name and of each synonym."""
    for n in [entry[1], *(entry[3] or [])]:
        words = tuple(re.findall(r"[^\W_]+", folded(n or "")))
        if words:
            yield words, "".join(words), words[0][:1] + words[1] if len(words) == 2 else ""


class Gazetteer:
    """The reference list, or a part of it, with its trigram indexes of whole and of abbreviated names."""

    def __init__(self, entries: list[Entry], counts: tuple[dict[str, int], int, dict[str, int], int] | None = None) -> None:
        """entries: (id, name, parent genus, synonyms); counts: trigrams and names, whole and abbreviated, of the whole list."""
        self.names: list[tuple[int, tuple[str, ...], str]] = []
        self.short: list[tuple[int, tuple[str, ...]]] = []
        self.parent: dict[int, str] = {}
        short: list[str] = []
        for e in entries:
            own = folded(e[1] or "")
            self.parent[e[0]] = folded(e[2]) if e[2] else own.split(" ")[0]
            for words, joined, brief in _forms(e):
                self.names.append((e[0], words, joined))
                if brief:
                    self.short.append((e[0], words))
                    short.append(brief)
        self.whole = Trigrams([s for *_, s in self.names], *(counts[:2] if counts else ()))
        self.brief = Trigrams(short, *(counts[2:] if counts else ()))
        self.term, self.idf, self.unseen = self.whole.term, self.whole.idf, self.whole.unseen

    @property
    def nbytes(self) -> int:
        """About the bytes that the index takes."""
        return sum(t.post.nbytes + t.weight.nbytes + 100 * len(t.df) for t in (self.whole, self.brief)) + 300 * len(self.names)

    def cosines(self, s: str, least: float = THRESHOLD) -> dict[int, float]:
        return self.whole.cosines(s, least)

    @staticmethod
    def _verified(words: list[str], squashed: str, name: tuple[str, ...], joined: str) -> int | None:
        """Edits between the value and a name if each part may be a mistyping of the name's, else None."""

        def allowed(s: str) -> int:
            return 0 if len(s) < 4 else 1 if len(s) < 7 else 2

        if len(words) == len(name):
            best = None
            for order in (words, words[::-1]) if len(words) == 2 else (words,):
                each = [edits(a, b, allowed(b)) for a, b in zip(order, name)]
                if all(e <= allowed(b) for e, b in zip(each, name)):
                    best = min(sum(each), best if best is not None else 99)
            if best is not None:
                return best
        if len(words) != len(name) or len(words) == 1:
            most = 1 if len(joined) < 8 else 2
            e = edits(squashed, joined, most)
            return e if e <= most else None
        return None

    def candidates(self, value: str) -> list[Candidate]:
        """The entries that ``value`` may mean, in each of its readings."""
        r = Reading(value)
        words = r.words
        if not words or " ".join(words) in NOTHING or len(r.squashed) < 3:
            return []
        if r.genus_only:
            words = words[:1]
        if r.abbreviated and len(words) == 2:
            return self._abbreviated(words[0], words[1])
        got = self._similar(0, words)
        return got + self._similar(1, words[:2]) if len(words) > 2 else got  # the first two are the name, the rest was added

    def _similar(self, reading: int, words: list[str]) -> list[Candidate]:
        squashed, swapped = "".join(words), "".join(words[::-1])
        found = self.cosines(squashed)
        if len(words) == 2:
            for k, v in self.cosines(swapped).items():
                found[k] = max(v, found.get(k, 0.0))
        best: dict[int, tuple[int, float]] = {}
        for k, v in found.items():
            taxon, name, joined = self.names[k]
            # of the candidates, those written alike: as they stand, swapped or as one word
            e = -1 if joined == squashed or len(words) == 2 and joined == swapped else self._verified(words, squashed, name, joined)
            if e is not None and (taxon not in best or (e, -v) < (best[taxon][0], -best[taxon][1])):
                best[taxon] = (e, v)
        return [(reading, e, t, self.parent[t], v) for t, (e, v) in best.items()]

    def _abbreviated(self, short: str, epithet: str) -> list[Candidate]:
        """Entries whose genus begins with ``short`` and whose epithet is ``epithet`` or a few edits from it, by the same threshold."""
        best: dict[int, tuple[int, float]] = {}
        for k, v in self.brief.cosines(short[:1] + epithet).items():
            taxon, words = self.short[k]
            if words[0].startswith(short) and (d := edits(epithet, words[1], 2)) <= (1 if len(words[1]) < 7 else 2):
                # without a parent a name goes before a synonym
                own = self.parent.get(taxon, "").startswith(short)
                if taxon not in best or (d, -v) < (best[taxon][0], -best[taxon][1]):
                    best[taxon] = (d, v if own else v - 1)
        return [(2, d, t, self.parent[t], v) for t, (d, v) in best.items()]

    def match(self, value: str, parent: str | None) -> int:
        """The id that ``value`` means, or 0."""
        return decide(self.candidates(value), parent)


def decide(candidates: list[Candidate], parent: str | None) -> int:
    """Of a value's candidates the entry meant, or 0: the fewest edits, then the parent genus, then the cosine with its margin."""
    parent = folded(parent.strip()) if parent and parent.strip() else None
    for reading in (0, 1, 2):
        mine = [c for c in candidates if c[0] == reading]
        if not mine:
            continue
        fewest = min(e for _, e, *_ in mine)
        near = [c for c in mine if c[1] == fewest]
        if len(near) > 1 and parent:
            own = [c for c in near if c[3] == parent]
            near = own or ([] if fewest < 0 or reading == 2 else near)
        if len(near) == 1:
            return near[0][2]
        if fewest < 0 or not near:
            return 0  # written alike, and nothing tells them apart
        order = sorted((v for *_, v in near), reverse=True)
        return 0 if order[0] - order[1] < MARGIN else max(near, key=lambda c: c[4])[2]
    return 0


def _entries(df: DataFrame, id_column: str, name: str, parent: str, synonyms: str) -> DataFrame:
    return df.where(F.col(id_column).isNotNull()).select(F.col(id_column).cast("long").alias("id"), F.col(name).alias("name"), F.col(parent).alias("parent"), F.col(synonyms).alias("synonyms")).distinct()


def _read(entries: DataFrame) -> list[Entry]:
    return [(r[0], r[1], r[2], list(r[3] or [])) for r in sorted(entries.collect(), key=lambda r: (r[0], r[1] or ""))]


def gazetteer_of(df: DataFrame, id_column: str = "taxon_id", name: str = "name_txt", parent: str = "parent_genus", synonyms: str = "synonyms") -> Gazetteer:
    """The index of a reference list that one index holds; rows without id or name are left out, repeated rows count once."""
    return Gazetteer(_read(_entries(df, id_column, name, parent, synonyms)))


def _trigram_counts(entries: DataFrame) -> tuple[dict[str, int], int, dict[str, int], int]:
    """How many names, whole and abbreviated, have each trigram, and how many there are; trigrams are bounded by the alphabet."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            for name, synonyms in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for _, joined, brief in _forms((0, name, None, synonyms)):
                    for kind, s in (("w", joined), ("b", brief)):
                        if s:
                            seen[kind, ""] += 1
                            seen.update((kind, g) for g in _grams(s))
        keys = sorted(seen)
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in keys], pa.string()), pa.array([g for _, g in keys], pa.string()), pa.array([seen[k] for k in keys], pa.int64())], names=["kind", "g", "n"])

    rows = entries.select("name", "synonyms").mapInArrow(count, "kind string, g string, n bigint").groupBy("kind", "g").agg(F.sum("n").alias("n")).collect()
    of = {k: {r.g: r.n for r in rows if r.kind == k} for k in ("w", "b")}
    return of["w"], of["w"].pop("", 0), of["b"], of["b"].pop("", 0)


_CANDIDATES = "_v string, _p string, reading int, edits int, id bigint, genus string, cosine double"


def _candidates(values: DataFrame, gazetteer: Gazetteer) -> DataFrame:
    shared = values.sparkSession.sparkContext.broadcast(gazetteer)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = shared.value
        for batch in batches:
            take: list[int] = []
            rows: list[Candidate] = []
            for i, v in enumerate(batch.column(0).to_pylist()):
                got = g.candidates(v)
                take += [i] * len(got)
                rows += got
            at = pa.array(take, pa.int64())
            columns = list(zip(*rows)) or [()] * 5
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), *(pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.int64(), pa.string(), pa.float64())))], names=["_v", "_p", "reading", "edits", "id", "genus", "cosine"])

    return values.mapInArrow(search, _CANDIDATES)


def _matched(values: DataFrame, gazetteer: Gazetteer, out: str) -> DataFrame:
    shared = values.sparkSession.sparkContext.broadcast(gazetteer)

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = shared.value
        for batch in batches:
            ids = [g.match(v, p) for v, p in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ids, pa.int64())], names=["_v", "_p", out])

    return values.mapInArrow(match, f"_v string, _p string, `{out}` bigint")


def _matched_in_groups(values: DataFrame, entries: DataFrame, groups: int, out: str) -> DataFrame:
    counts = _trigram_counts(entries)
    values, parts = written(values, "values"), []
    for g in range(groups):
        part = Gazetteer(_read(entries.where(F.pmod(F.xxhash64("id"), F.lit(groups)) == g)), counts)
        parts.append(written(_candidates(values, part), "candidates"))
    found = reduce(DataFrame.unionByName, parts).groupBy("_v", "_p").agg(F.collect_list(F.struct("reading", "edits", "id", "genus", "cosine")).alias("c"))

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # several rows of one entry come where its names lie in one group only, so none is there twice
            ids = [decide([tuple(x.values()) for x in c], p) for p, c in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ids, pa.int64())], names=["_v", "_p", out])

    return found.mapInArrow(choose, f"_v string, _p string, `{out}` bigint")


def link_to_list(df: DataFrame, entries: DataFrame, key: str, names: list[str], parent: str | None = None, out: str = "taxon_id", id_column: str = "taxon_id", name: str = "name_txt", entry_parent: str = "parent_genus", synonyms: str = "synonyms", most_names: int | None = None, most_bytes: int | None = None) -> DataFrame:
    """``link_names`` with a reference list of any length: one index while it holds ``most_names`` entries and ``most_bytes``, else groups."""
    listed = _entries(entries, id_column, name, entry_parent, synonyms)
    groups = -(-listed.count() // (most_names or MOST_NAMES))
    if groups <= 1:
        gazetteer = Gazetteer(_read(listed))
        groups = -(-gazetteer.nbytes // (most_bytes or MOST_BYTES))
        if groups <= 1:
            return link_names(df, gazetteer, key, names, parent, out)
    listed = written(listed, "list")
    return _linked(df, key, names, parent, out, lambda values: _matched_in_groups(values, listed, groups, out))


def link_names(df: DataFrame, gazetteer: Gazetteer, key: str, names: list[str], parent: str | None = None, out: str = "taxon_id") -> DataFrame:
    """``key`` and ``out`` (an id of the list, 0 for unmatched) of every row of ``df``, distinct.

    The value is the first of the columns ``names`` that isn't null or blank; a row without any is unmatched, a null key
    stays null. A key whose rows hold several values means the one entry that they give, and 0 if they give several. Each
    distinct value (with its parent) is matched once, spread by value: a value that a third of all rows hold is one row
    there, and the join back is skewed only on the side of rows, where the few distinct values are broadcast or the
    skew is split by the engine.
    """
    return _linked(df, key, names, parent, out, lambda values: _matched(values, gazetteer, out))


def _linked(df: DataFrame, key: str, names: list[str], parent: str | None, out: str, matched: Callable[[DataFrame], DataFrame]) -> DataFrame:
    value = F.coalesce(*[F.when(F.trim(F.col(n)) != "", F.col(n)) for n in names])
    rows = df.select(F.col(key), value.alias("_value"), (F.col(parent) if parent else F.lit(None).cast("string")).alias("_parent")).distinct()
    values = rows.where(F.col("_value").isNotNull()).select("_value", "_parent").distinct()
    # matching costs much a row and its rows are small, so they are spread over all cores, not by their bytes
    values = values.repartition(df.sparkSession.sparkContext.defaultParallelism, "_value", "_parent")
    joined = rows.join(matched(values), F.col("_value").eqNullSafe(F.col("_v")) & F.col("_parent").eqNullSafe(F.col("_p")), "left")
    ids = F.when(F.col(out) > 0, F.col(out))
    return joined.groupBy(key).agg(F.when(F.min(ids) == F.max(ids), F.min(ids)).otherwise(0).cast("long").alias(out))
