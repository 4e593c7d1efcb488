"""Schemas that drift between files: one consistent table of JSON records, and every change between versions.

Fields of consecutive versions are matched by similarity flooding: a graph of each schema joins its fields to the
words of their names, their JSON types, their nested keys and their value profiles; scores of pairs are propagated over the
pairwise connectivity graph until they settle; the fixpoint scores, related to those of each field with itself, are
the similarities, of which a consistent one-to-one selection above a threshold gives the renames. Fields that were
ever seen side by side with other values hold different quantities and are never matched.

Distinct transitions of schemas are flooded on the executors. Profiles and renames are broadcast while they are small;
beyond that each transition gets its own by joins.
"""

from __future__ import annotations

import json
import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from windrow.session import collect_bounded, small_enough, widened, written

#: Fixpoint similarity from which two fields are one; rounds of flooding, at most.
ACCEPT, ROUNDS = 0.3, 100
#: Distinct field names, and transitions with renames, up to which profiles and renames are broadcast.
MOST_FIELDS, MOST_TRANSITIONS = 2_000, 50_000
#: Relative difference up to which two numbers side by side are one value, rounded otherwise.
SAME = 2e-3

_PARSED = "record string, version bigint, file bigint, names array<string>, types array<string>, numbers array<double>, texts array<string>, inner array<string>"


def json_type(v: object) -> str:
    if v is None:
        return "null"
    if isinstance(v, bool):
        return "boolean"
    if isinstance(v, (int, float)):
        return "number"
    if isinstance(v, str):
        return "string"
    return "array" if isinstance(v, list) else "object"


def as_number(v: object) -> float | None:
    """The number that ``v`` holds: as it is, as a string, in percent, or alone in an array or object with a count."""
    if isinstance(v, bool) or v is None:
        return None
    if isinstance(v, (int, float)):
        return float(v) if math.isfinite(v) else None
    if isinstance(v, str):
        s = v.strip()
        scale = 1.0
        if s.endswith("%"):
            s, scale = s[:-1].strip(), 100.0
        try:
            x = float(s) / scale
        except ValueError:
            return None
        return x if math.isfinite(x) else None
    if isinstance(v, list):
        return as_number(v[0]) if len(v) == 1 else None
    if isinstance(v, dict):
        for k in ("value", "mean", "score"):
            if k in v:
                return as_number(v[k])
        return as_number(next(iter(v.values()))) if len(v) == 1 else None
    return None


def nested_keys(v: dict | list) -> list[str]:
    """The keys within an object with the types of their values, or the types of an array's items."""
    return sorted(f"{k} {json_type(x)}" for k, x in v.items()) if isinstance(v, dict) else sorted({f"item {json_type(x)}" for x in v})


def parse_records(df: DataFrame, record: str, version: str, file: str, payload: str) -> DataFrame:
    """record, version, file and the top-level fields of each payload: names (sorted), JSON types, numbers, texts, nested keys.

    Rows whose record, version or payload is null, and payloads that are no JSON object, are left out: they are no
    version of any schema.
    """

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            take, names, types, numbers, texts, inner = [], [], [], [], [], []
            for i, p in enumerate(batch.column(3).to_pylist()):
                try:
                    o = json.loads(p)
                except (ValueError, RecursionError):
                    continue
                if not isinstance(o, dict):
                    continue
                keys = sorted(o)
                take.append(i)
                names.append(keys)
                types.append([json_type(o[k]) for k in keys])
                numbers.append([as_number(o[k]) for k in keys])
                inner.append([f"{k}\x1f{x}" for k in keys if isinstance(o[k], (dict, list)) for x in nested_keys(o[k])])
                texts.append([None if o[k] is None else o[k] if isinstance(o[k], str) else json.dumps(o[k], sort_keys=True, separators=(",", ":")) for k in keys])
            rows = pa.array(take, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), batch.column(2).take(rows), pa.array(names, pa.list_(pa.string())), pa.array(types, pa.list_(pa.string())), pa.array(numbers, pa.list_(pa.float64())), pa.array(texts, pa.list_(pa.string())), pa.array(inner, pa.list_(pa.string()))], names=["record", "version", "file", "names", "types", "numbers", "texts", "inner"])

    rows = df.select(F.col(record).cast("string"), F.col(version).cast("long"), F.col(file).cast("long"), F.col(payload)).where(F.col(record).isNotNull() & F.col(version).isNotNull() & F.col(payload).isNotNull())
    return widened(rows).mapInArrow(parse, _PARSED)


def versions(parsed: DataFrame) -> DataFrame:
    """One row a record and version: that of the least file id; repeated copies are dropped, files in arrival order don't matter."""
    return parsed.groupBy("record", "version").agg(F.min_by(F.struct("names", "types", "numbers", "texts", "inner"), F.coalesce("file", F.lit(1 << 62))).alias("_f")).select("record", "version", "_f.*")


class Field:
    """What is known of one field over all versions."""

    __slots__ = ("n", "n_held", "n_numbers", "median", "low", "high", "least", "most", "types", "inner")

    def __init__(self, row: object) -> None:
        for c in self.__slots__[:-2]:
            setattr(self, c, row[c])
        self.types: list[str] = []
        self.inner: list[str] = []


class Profiles:
    """What is known of each field over all versions, and of each pair that was seen side by side."""

    def __init__(self, fields: list, seen: list) -> None:
        """fields: rows of ``field_profiles``, seen: rows of ``seen_elements``."""
        self.fields = {r["name"]: Field(r) for r in fields}
        self.pairs: dict[tuple[str, str], tuple[int, int]] = {}
        for r in sorted(seen, key=lambda r: (r["kind"], r["a"], r["b"])):
            if r["kind"] == "pair":
                self.pairs[r["a"], r["b"]] = (r["n_equal"], r["n_other"])
            elif r["a"] in self.fields:
                (self.fields[r["a"]].types if r["kind"] == "type" else self.fields[r["a"]].inner).append(r["b"])

    def together(self, a: str, b: str) -> tuple[int, int]:
        return self.pairs.get((min(a, b), max(a, b)), (0, 0))


def field_profiles(vs: DataFrame) -> DataFrame:
    """Per field over all versions: versions with it, values held, numbers, their median and range, least and greatest text."""
    one = vs.select(F.explode(F.arrays_zip("names", "numbers", "texts")).alias("f")).select("f.*")
    return one.groupBy(F.col("names").alias("name")).agg(F.count(F.lit(1)).alias("n"), F.count("texts").alias("n_held"), F.count("numbers").alias("n_numbers"), F.percentile_approx("numbers", 0.5).alias("median"), F.min("numbers").alias("low"), F.max("numbers").alias("high"), F.min("texts").alias("least"), F.max("texts").alias("most"))


def seen_elements(vs: DataFrame) -> DataFrame:
    """kind, a, b, n_equal and n_other: of each pair of fields ('pair') how often they stood side by side with the same and with
    other numbers, and of each field its JSON types ('type') and nested keys ('key')."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple[str, str, str], list[int]] = defaultdict(lambda: [0, 0])
        for batch in batches:
            shapes: dict[tuple[str, ...], list[list]] = defaultdict(list)
            kinds: Counter = Counter()
            for names, types, numbers, inner in zip(*(batch.column(i).to_pylist() for i in range(4))):
                shape = tuple(names)
                shapes[shape].append(numbers)
                kinds[shape, tuple(types)] += 1
                for x in inner:
                    name, key = x.split("\x1f", 1)
                    seen["key", name, key][0] += 1
            for (names, types), n in kinds.items():
                for name, kind in zip(names, types):
                    if kind != "null":
                        seen["type", name, kind][0] += n
            for names, rows in shapes.items():
                x = np.array(rows, float)
                for i in range(len(names) - 1):
                    a, b = x[:, i : i + 1], x[:, i + 1 :]
                    held = ~np.isnan(a) & ~np.isnan(b)
                    equal = held & (np.abs(a - b) <= SAME * np.maximum(np.abs(a), np.abs(b)))
                    for name, n, e in zip(names[i + 1 :], held.sum(0).tolist(), equal.sum(0).tolist()):
                        if n:
                            pair = seen["pair", names[i], name]
                            pair[0] += e
                            pair[1] += n - e
        keys = sorted(seen)
        columns = [*(pa.array([k[i] for k in keys], pa.string()) for i in range(3)), *(pa.array([seen[k][i] for k in keys], pa.int64()) for i in range(2))]
        yield pa.RecordBatch.from_arrays(columns, names=["kind", "a", "b", "n_equal", "n_other"])

    found = vs.select("names", "types", "numbers", "inner").mapInArrow(count, "kind string, a string, b string, n_equal bigint, n_other bigint")
    return found.groupBy("kind", "a", "b").agg(F.sum("n_equal").alias("n_equal"), F.sum("n_other").alias("n_other"))


def profiles(vs: DataFrame, most: int = MOST_FIELDS) -> Profiles:
    """The profiles of all fields and pairs on the driver; ``OverflowError`` beyond ``most`` fields or a hundred pairs each."""
    return Profiles(collect_bounded(field_profiles(vs), most), collect_bounded(seen_elements(vs), most * 100))


def name_words(name: str) -> list[str]:
    """The words of a field's name: parted by signs, by capitals and between letters and digits."""
    return [w.lower() for w in re.findall(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+", name)]


def _word_similarity(a: str, b: str) -> float:
    if a == b:
        return 1.0
    short, long = sorted((a, b), key=len)
    if len(short) >= 3 and long.startswith(short):
        return 0.95
    grams = lambda s: {f"^{s}$"[i : i + 2] for i in range(len(s) + 1)}
    x, y = grams(a), grams(b)
    v = 2 * len(x & y) / (len(x) + len(y))
    return v if v >= 0.6 else 0.0


def name_similarity(a: str, b: str) -> float:
    """Soft Jaccard of the words of two names."""
    x, y = name_words(a), name_words(b)
    if not x or not y:
        return float(a == b)
    shared, left = 0.0, list(y)
    for w in x:
        if left and (s := max((_word_similarity(w, v), v) for v in left))[0] > 0:
            shared += s[0]
            left.remove(s[1])
    return shared / (len(x) + len(y) - shared)


def profile_similarity(p: Profiles, a: str, b: str) -> float:
    """How alike the values of two fields are over all versions, from 0 to 1."""
    f, g = p.fields.get(a), p.fields.get(b)
    if f is None or g is None:
        return 0.0
    numeric = f.n_numbers * 2 > f.n_held, g.n_numbers * 2 > g.n_held
    if all(numeric):
        if max(f.low, g.low) > min(f.high, g.high) + 1e-12:
            return 0.0  # ranges apart
        top = max(abs(f.median), abs(g.median))
        return 1.0 if top == 0 else max(0.0, 1 - abs(f.median - g.median) / top)
    if any(numeric):
        return 0.0
    constant = f.least == f.most or g.least == g.most
    overlap = f.least is not None and g.least is not None and max(f.least, g.least) <= min(f.most, g.most)
    return (0.2 if constant else 0.5) if overlap else 0.0


def barred(p: Profiles, a: str, b: str) -> bool:
    """Whether two fields were seen side by side with other values, more often than with the same: they hold different quantities."""
    equal, other = p.together(a, b)
    return a != b and other > equal


def _elements(p: Profiles, a: str, b: str) -> list[tuple[str, str, str, float]]:
    """The pairs of elements around two fields: (kind of edge, element of a, element of b, literal similarity of the two).

    Elements are the words of the names, JSON types, nested keys (each with its type), the value profile, and values seen
    side by side, which are one if both stand with the same value.
    """
    out = [("word", x, y, s) for x in dict.fromkeys(name_words(a)) for y in dict.fromkeys(name_words(b)) if (s := _word_similarity(x, y)) > 0]
    f, g = p.fields.get(a), p.fields.get(b)
    if f is None or g is None:
        return out
    out += [("type", x, y, 1.0) for x in f.types for y in g.types if x == y]
    out += [("key", x, y, s) for x in f.inner for y in g.inner if (s := name_similarity(x, y)) > 0]
    alike = 1.0 if a == b else profile_similarity(p, a, b)
    if alike > 0:
        out.append(("values", a, b, alike))
    varies = f.low != f.high or g.low != g.high
    if a == b or p.together(a, b)[0] and varies:
        out.append(("beside", a, b, 1.0))
    return out


def flood(p: Profiles, old: Sequence[str], new: Sequence[str], rounds: int = ROUNDS, settle: float = 1e-4) -> dict[tuple[str, str], float]:
    """The similarity of each field of ``old`` with each of ``new``, from the fixpoint of similarity flooding.

    The pairwise connectivity graph has a node for each pair of fields and for each pair of elements around them (words,
    types, nested keys, value profiles, values side by side). Pairs of fields start with the similarity of their names
    (half of it where their values disagree), other nodes with that of their elements. In each round every node passes its score to its neighbours, in equal parts
    among those of one kind of edge, until the scores settle. A pair's fixpoint score is then related to those of
    both its fields with themselves in the same graph, so that 1 stands for a field that can't be told from the other
    and a threshold means the same in every schema. Barred pairs have no node and similarity 0.
    """
    fields = sorted({*old, *new})
    node: dict[tuple, int] = {}
    start: list[float] = []
    source: list[int] = []
    target: list[int] = []
    share: list[tuple[int, str]] = []

    def at(key: tuple, score: float) -> int:
        if key not in node:
            node[key] = len(start)
            start.append(score)
        return node[key]

    for i, a in enumerate(fields):
        for b in fields[i:]:
            if barred(p, a, b):
                continue
            around = _elements(p, a, b)
            if not around:
                continue
            agree = any(kind == "values" for kind, *_ in around) or not (a in p.fields and b in p.fields)
            k = at(("field", a, b), name_similarity(a, b) * (1.0 if agree else 0.5))
            for kind, x, y, s in around:
                o = at((kind, *sorted((x, y))), s)
                source += [k, o]
                target += [o, k]
                share += [(k, kind), (o, "field")]
    if not source:
        return {(a, b): 0.0 for a in old for b in new}
    among = Counter(share)
    weight = np.array([1.0 / among[e] for e in share])
    src, dst, first = np.array(source), np.array(target), np.array(start)
    score = first.copy()
    for _ in range(rounds):
        given = first + score
        after = given + np.bincount(dst, weights=given[src] * weight, minlength=len(first))
        after /= after.max()
        moved = float(np.sqrt(((after - score) ** 2).sum()))
        score = after
        if moved < settle:
            break
    out = {}
    for a in old:
        for b in new:
            k = node.get(("field", *sorted((a, b))))
            own = score[node["field", a, a]] * score[node["field", b, b]] if ("field", a, a) in node and ("field", b, b) in node else 0.0
            out[a, b] = 0.0 if k is None or own <= 0 else min(1.0, float(score[k]) / math.sqrt(own))
    return out


def correspondences(p: Profiles, removed: Sequence[str], added: Sequence[str], accept: float = ACCEPT, rounds: int = ROUNDS) -> list[tuple[str, str]]:
    """One-to-one pairs of a removed and an added field that hold the same quantity, best first; ties by name."""
    scores = flood(p, removed, added, rounds)
    out, taken = [], set()
    for (a, b), v in sorted(scores.items(), key=lambda x: (-x[1], x[0])):
        if v >= accept and ("old", a) not in taken and ("new", b) not in taken:
            out.append((a, b))
            taken |= {("old", a), ("new", b)}
    return out


def transitions(vs: DataFrame) -> DataFrame:
    """The distinct pairs of fields removed and fields added between consecutive versions, where there are both."""
    before = W.partitionBy("record").orderBy("version")
    both = vs.select("names", F.lag("names").over(before).alias("past")).where("past is not null and past <> names")
    return both.select(F.array_sort(F.array_except("past", "names")).alias("removed"), F.array_sort(F.array_except("names", "past")).alias("added")).where("size(removed) > 0 and size(added) > 0").distinct()


_RENAMES = "removed array<string>, added array<string>, olds array<string>, news array<string>"


def _renames_batch(removed: list[list[str]], added: list[list[str]], known: list[Profiles], accept: float, rounds: int) -> pa.RecordBatch:
    found = [correspondences(p, r, a, accept, rounds) for p, r, a in zip(known, removed, added)]
    kept = [i for i, f in enumerate(found) if f]
    lists = pa.list_(pa.string())
    columns = [[removed[i] for i in kept], [added[i] for i in kept], [[a for a, _ in found[i]] for i in kept], [[b for _, b in found[i]] for i in kept]]
    return pa.RecordBatch.from_arrays([pa.array(c, lists) for c in columns], names=["removed", "added", "olds", "news"])


def find_renames(vs: DataFrame, accept: float = ACCEPT, rounds: int = ROUNDS, most: int = MOST_FIELDS) -> DataFrame:
    """removed, added, olds and news of each distinct transition with renames, flooded on the executors.

    Up to ``most`` field names their profiles are broadcast; beyond, each transition is joined with those of its own fields and pairs.
    """
    ts = transitions(vs)
    fields, seen = field_profiles(vs), seen_elements(vs)
    cores = vs.sparkSession.sparkContext.defaultParallelism
    if small_enough(vs.select(F.explode("names").alias("n")).distinct(), most):
        fields, seen = collect_bounded(fields, most), written(seen, "seen")
        if small_enough(seen, most * 100):
            shared = vs.sparkSession.sparkContext.broadcast(Profiles(fields, seen.collect()))

            def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    yield _renames_batch(batch.column(0).to_pylist(), batch.column(1).to_pylist(), [shared.value] * batch.num_rows, accept, rounds)

            return ts.repartition(cores, "removed", "added").mapInArrow(match, _RENAMES)
        fields = field_profiles(vs)
    key = F.xxhash64("removed", "added")
    names = ts.select("removed", "added", F.explode(F.array_union("removed", "added")).alias("name"))
    own = names.join(fields, "name").select("removed", "added", F.struct(F.lit("field").alias("kind"), F.col("name").alias("a"), F.lit("").alias("b"), F.lit(0).cast("long").alias("n_equal"), F.lit(0).cast("long").alias("n_other"), F.struct(*fields.columns).alias("profile")).alias("e"))
    around = names.join(seen.where("kind <> 'pair'"), F.col("name") == F.col("a")).select("removed", "added", "kind", "a", "b", "n_equal", "n_other")
    both = names.alias("x").join(seen.where("kind = 'pair'"), F.col("x.name") == F.col("a")).where(F.array_contains(F.array_union("removed", "added"), F.col("b"))).select("removed", "added", "kind", "a", "b", "n_equal", "n_other")
    others = around.unionByName(both).select("removed", "added", F.struct("kind", "a", "b", "n_equal", "n_other", F.lit(None).cast(own.schema["e"].dataType["profile"].dataType).alias("profile")).alias("e"))
    grouped = own.unionByName(others).groupBy(key.alias("_k"), "removed", "added").agg(F.collect_list("e").alias("elements"))

    def match_own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            removed, added, elements = (batch.column(i).to_pylist() for i in range(3))
            known = [Profiles([e["profile"] for e in es if e["kind"] == "field"], [e for e in es if e["kind"] != "field"]) for es in elements]
            yield _renames_batch(removed, added, known, accept, rounds)

    return grouped.select("removed", "added", "elements").mapInArrow(match_own, _RENAMES)


def find_changes(df: DataFrame, record: str, version: str, file: str, payload: str, accept: float = ACCEPT, rounds: int = ROUNDS, most_fields: int = MOST_FIELDS, most_transitions: int = MOST_TRANSITIONS) -> DataFrame:
    """record, version, change, field_name and new_name of every change of a record's top-level fields.

    Each version is compared with the record's previous existing one. change is added, removed, renamed (new_name is the
    new name, else '') or retyped; null has no type, so the last value that isn't null counts, also over a rename. A field
    that returns after a removal begins anew. Copies of a version, and rows without record, version or JSON object,
    are no change; an empty table gives an empty result. Up to ``most_transitions`` transitions with renames are
    broadcast; beyond, they are joined to the versions.
    """
    vs = written(versions(parse_records(df, record, version, file, payload)), "versions")
    renames = written(find_renames(vs, accept, rounds, most_fields), "renames")
    ordered = vs.select("record", "version", "names", "types")
    if small_enough(renames, most_transitions):
        table = {(tuple(r.removed), tuple(r.added)): list(zip(r.olds, r.news)) for r in renames.collect()}
        ordered = ordered.withColumn("olds", F.lit(None).cast("array<string>")).withColumn("news", F.lit(None).cast("array<string>"))
    else:
        table = {}
        past = F.lag("names").over(W.partitionBy("record").orderBy("version"))
        ordered = ordered.withColumn("_past", past).withColumn("removed", F.array_sort(F.array_except("_past", "names"))).withColumn("added", F.array_sort(F.array_except("names", "_past")))
        ordered = ordered.join(renames, ["removed", "added"], "left").select("record", "version", "names", "types", "olds", "news")
    shared = df.sparkSession.sparkContext.broadcast(table)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        current, last, same = None, {}, None
        for batch in batches:
            out: list[tuple] = []
            for rec, ver, names, types, olds, news in zip(*(batch.column(i).to_pylist() for i in range(6))):
                if rec == current and same == (names, types):
                    continue  # as the version before, whose nulls have been seen to
                same = (names, types)
                now = dict(zip(names, types))
                if rec == current:
                    removed, added = sorted(set(last) - set(now)), sorted(set(now) - set(last))
                    pairs = {b: a for a, b in (zip(olds, news) if olds else known.get((tuple(removed), tuple(added)), ()))}
                    out += [(rec, ver, "renamed", a, b) for b, a in pairs.items()]
                    out += [(rec, ver, "removed", a, "") for a in removed if a not in pairs.values()]
                    out += [(rec, ver, "added", b, "") for b in added if b not in pairs]
                    kept = {}
                    for name, kind in now.items():
                        past = last.get(pairs.get(name, name)) if name not in added or name in pairs else None
                        if past is not None and kind != "null" and kind != past:
                            out.append((rec, ver, "retyped", name, ""))
                        kept[name] = kind if kind != "null" else past
                    last = kept
                else:
                    current, last = rec, {n: (k if k != "null" else None) for n, k in now.items()}
            cols = list(zip(*out)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.string(), pa.string(), pa.string()))], names=["record", "version", "change", "field_name", "new_name"])

    # sorted streams: the state of one record at a time, of any number of versions
    return ordered.repartition("record").sortWithinPartitions("record", "version").mapInArrow(compare, "record string, version bigint, change string, field_name string, new_name string")


def families(p: Profiles, accept: float = ACCEPT) -> dict[str, str]:
    """The name under which each field stands in the consistent table: of those that hold its quantity the most frequent."""
    names = sorted(p.fields, key=lambda n: (-p.fields[n].n, n))
    scores = flood(p, names, names)
    home: dict[str, str] = {}
    for n in names:  # frequent names first; a field joins the family whose every member may be it
        fits = [(scores.get((h, n), 0.0), h) for h in dict.fromkeys(home.values()) if not any(barred(p, m, n) for m, o in home.items() if o == h)]
        best = max(fits, default=(0.0, n))
        home[n] = best[1] if best[0] >= accept else n
    return home


def consistent_table(df: DataFrame, record: str, version: str, file: str, payload: str) -> DataFrame:
    """One row a record and version with one column a quantity, whatever its field was called or typed.

    A quantity whose values are mostly numbers is a double, any other a string (JSON where it is nested); where two
    names of it stand side by side, the most frequent is taken unless it is null. Columns are sorted by name; names that
    clash with record or version, or differ in case only, get a number.
    """
    vs = written(versions(parse_records(df, record, version, file, payload)), "versions")
    p = profiles(vs)
    home = families(p)
    members: dict[str, list[str]] = defaultdict(list)
    for n in sorted(home, key=lambda n: (-p.fields[n].n, n)):
        members[home[n]].append(n)
    numbers = F.map_from_arrays("names", "numbers")
    texts = F.map_from_arrays("names", "texts")
    columns, taken = [], {"record", "version"}
    for h in sorted(members):
        numeric = sum(p.fields[n].n_numbers for n in members[h]) * 2 > sum(p.fields[n].n_held for n in members[h])
        name, k = h, 1
        while name.lower() in taken:
            k += 1
            name = f"{h}_{k}"
        taken.add(name.lower())
        columns.append(F.coalesce(*[F.try_element_at(numbers if numeric else texts, F.lit(n)) for n in members[h]]).alias(name))
    return vs.select("record", "version", *columns)
