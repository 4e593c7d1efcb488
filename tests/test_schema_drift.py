import json

import pytest

from windrow.operators import schema_drift as D


def frame(spark, runs):
    rows, k = [], 0
    for run, steps in runs.items():
        for step, payload in steps:
            k += 1
            rows.append((run, step, k, payload if payload is None or isinstance(payload, str) else json.dumps(payload), "x"))
    return spark.createDataFrame(rows, "run_id string, checkpoint_step int, file_id long, payload string, record string")


ARGS = ("run_id", "checkpoint_step", "file_id", "payload")


def changes(spark, runs):
    return {(r.record, r.version, r.change, r.field_name, r.new_name) for r in D.find_changes(frame(spark, runs), *ARGS).collect()}


def background():
    """Runs without change, from which profiles of the fields are taken; both names of accuracy stand side by side in some."""
    out = {}
    for i in range(12):
        acc = lambda s: round(0.3 + 0.05 * ((i + s) % 7), 4)  # noqa: B023, E731
        names = [("acc_main", "rows_main"), ("accuracyMain", "n_main_rows"), ("acc_main", "mainRows")][i % 3]
        out[f"bg{i}"] = [(s, {names[0]: acc(s), names[1]: 102, "acc_full_512": 0.9 - acc(s) / 3, "rows_full_512": 512, "sha256": f"{i}{s}", "view": "main", "bio_n": 454}) for s in (0, 1, 2)]
    return out


def test_each_kind_of_change(spark):
    runs = background() | {
        "r1": [(0, {"acc_main": 0.4, "rows_main": 102, "sha256": "a"}), (4, {"accuracyMain": 0.45, "rows_main": 102, "sha256": "b"}), (2, {"acc_main": 0.4, "rows_main": "102", "sha256": "c"})],
        "r2": [(0, {"acc_main": 0.4, "rows_main": 102}), (1, {"acc_main": None, "n_main_rows": [102]}), (2, {"acc_main": {"value": 0.5}, "n_main_rows": [102], "view": "main"})],
        "r3": [(0, {"acc_main": 0.4, "sha256": "x"}), (1, {"acc_full_512": 0.8, "sha256": "x"}), (2, {"acc_full_512": 0.8, "code": "r1"})],
    }
    got = {c for c in changes(spark, runs) if c[0].startswith("r")}
    assert got == {
        ("r1", 2, "retyped", "rows_main", ""), ("r1", 4, "retyped", "rows_main", ""), ("r1", 4, "renamed", "acc_main", "accuracyMain"),
        ("r2", 1, "renamed", "rows_main", "n_main_rows"), ("r2", 1, "retyped", "n_main_rows", ""), ("r2", 2, "retyped", "acc_main", ""), ("r2", 2, "added", "view", ""),
        ("r3", 1, "removed", "acc_main", ""), ("r3", 1, "added", "acc_full_512", ""), ("r3", 2, "removed", "sha256", ""), ("r3", 2, "added", "code", ""),
    }


def test_an_added_alias_is_no_rename_and_copies_are_no_change(spark):
    p = {"acc_main": 0.4, "rows_main": 102}
    runs = background() | {"a": [(0, p), (0, json.dumps(p, indent=1)), (1, p | {"accuracyMain": 0.4}), (2, {"accuracyMain": 0.5, "rows_main": 102}), (2, {"rows_main": 102, "accuracyMain": 0.5})]}
    assert {c for c in changes(spark, runs) if c[0] == "a"} == {("a", 1, "added", "accuracyMain", ""), ("a", 2, "removed", "acc_main", "")}


def test_defined_results_of_odd_rows(spark):
    runs = {"a": [(0, None), (1, "no json"), (2, "[1]"), (3, "{}"), (4, {"x": 1}), (None, {"x": 1})], None: [(0, {"x": 1})], "b": [(0, {"x": None}), (1, {"x": 1}), (2, {"x": "1"}), (3, {}), (4, {"x": 1})]}
    assert changes(spark, runs) == {("a", 4, "added", "x", ""), ("b", 2, "retyped", "x", ""), ("b", 3, "removed", "x", ""), ("b", 4, "added", "x", "")}
    assert D.find_changes(frame(spark, runs).limit(0), *ARGS).collect() == []


def test_consistent_table(spark):
    runs = background() | {"z": [(0, {"acc_main": "40%", "rows_main": [102], "record": 5}), (1, {"accuracyMain": {"value": 0.5}, "mainRows": "102"})]}
    t = D.consistent_table(frame(spark, runs), *ARGS)
    z = {r.version: r for r in t.where("record = 'z'").collect()}
    acc = "acc_main" if "acc_main" in t.columns else "accuracyMain"
    rows = next(c for c in t.columns if c in ("rows_main", "mainRows", "n_main_rows"))
    assert (z[0][acc], z[1][acc]) == (0.4, 0.5) and (z[0][rows], z[1][rows]) == (102.0, 102.0)
    assert "acc_full_512" in t.columns and t.where("record like 'bg%'").where("acc_full_512 is null").count() == 0
    assert "record_2" in t.columns and t.count() == 12 * 3 + 2


@pytest.mark.parametrize("a,b,low,high", [("wmdp_acc", "wmdp_accuracy", 0.9, 1), ("accuracy_wmdp", "wmdpAccuracy", 0.99, 1), ("wmdp_rows", "code_rev", 0, 0.01), ("n_rows", "rowCount", 0.2, 0.7)])
def test_names(a, b, low, high):
    assert low <= D.name_similarity(a, b) <= high == max(high, D.name_similarity(b, a))


@pytest.mark.parametrize("value,number", [("62.75%", 0.6275), ("0.5", 0.5), ([102], 102.0), ({"value": 0.3, "n": 5}, 0.3), (True, None), (None, None), ("abc", None), ([1, 2], None), (float("inf"), None), ({}, None)])
def test_numbers(value, number):
    got = D.as_number(value)
    assert got == number or abs(got - number) < 1e-12


def flooded():
    """The names alone mislead: `score` gives way to `top1`, while `scores` only looks like it; values and nested keys tell."""
    out = {f"s{i}": [(s, {"score": {"value": 0.3 + 0.01 * ((i + s) % 9), "n": 7}, "note": f"{i}"}) for s in range(3)] for i in range(8)}
    out |= {f"t{i}": [(s, {"top1": {"value": 0.3 + 0.01 * ((i + s) % 9), "n": 7}, "scores": 3 + i + s, "note": f"{i}"}) for s in range(3)] for i in range(8)}
    return out | {"r": [(0, {"score": {"value": 0.35, "n": 7}, "note": "a"}), (1, {"top1": {"value": 0.36, "n": 7}, "scores": 5, "note": "a"})]}


def test_flooding_decides_where_names_mislead(spark):
    vs = D.written(D.versions(D.parse_records(frame(spark, flooded()), *ARGS)), "t").cache()
    p = D.profiles(vs)
    assert D.correspondences(p, ["score"], ["scores", "top1"], rounds=0) == [("score", "scores")]
    assert D.correspondences(p, ["score"], ["scores", "top1"]) == [("score", "top1")]
    assert ("r", 1, "renamed", "score", "top1") in changes(spark, flooded())


def test_beyond_the_bounds_the_joined_way_gives_the_same(spark):
    runs = flooded() | background() | {"q": [(0, {"acc_main": 0.4, "rows_main": 102}), (1, {"accuracyMain": 0.4, "mainRows": "102"})]}
    whole = {tuple(r) for r in D.find_changes(frame(spark, runs), *ARGS).collect()}
    assert {tuple(r) for r in D.find_changes(frame(spark, runs), *ARGS, most_fields=2, most_transitions=0).collect()} == whole
    assert {tuple(r) for r in D.find_changes(frame(spark, runs), *ARGS, most_transitions=0).collect()} == whole and len(whole) > 4
