"""Paired draws, streamed by group, against SQL and against the rows of the picks."""

import duckdb
import pytest
from pyspark.sql import functions as F

from windrow.operators import resampling
from windrow.plans import resampling_queries as Q


def sets(rows):
    return sorted((tuple(r) for r in rows), key=str)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Runs of 1 to 40 items, some of one step, with copies that are equal, copies that differ, and rows without a key or a gold letter."""
    root = tmp_path_factory.mktemp("draws")
    rows = []
    for run in range(6):
        for step in (0, 1, 7) if run else (3,):
            for i in range((1, 3, 9, 40, 40, 17)[run]):
                p = [((run * 7 + step * 5 + i * 3 + j * j * (i + 2)) % 11) / 11 for j in range(4)]
                row = (f"r{run}", step, f"q{i * 37 % 41}", *p, "ABCD"[(i + run) % 4])
                rows += [row, row] if i % 5 == 0 else [row]
                if i % 4 == 1:
                    rows.append((*row[:3], *p[::-1], row[-1]))
    rows += [("r1", 7, None, 0.9, 0.1, 0.0, 0.0, "A"), ("r1", 0, None, 0.9, 0.1, 0.0, 0.0, "A"), (None, 0, "q1", 0.9, 0.1, 0.0, 0.0, "A"), ("r2", 9, "q1", 0.9, 0.1, 0.0, 0.0, None), ("r2", None, "q1", 0.9, 0.1, 0.0, 0.0, "A")]
    spark.createDataFrame(rows, "run_id string, checkpoint_step int, question_id string, p_a double, p_b double, p_c double, p_d double, gold string").coalesce(1).write.parquet(f"{root}/predictions.parquet")
    return str(root)


@pytest.fixture(scope="module")
def hot(spark, tmp_path_factory):
    """Two runs of seven items, one of which has 300 copies that differ at each step."""
    root = tmp_path_factory.mktemp("hot")
    rows = [(f"r{run}", step, f"q{i}", (k + 1) / 400, (k * 7 + step + run + i) % 300 / 400, 0.0, 0.1, "AB"[(i + step) % 2]) for run in range(2) for step in (0, 5) for i in range(7) for k in range(300 if i == 3 else 1)]
    spark.createDataFrame(rows, "run_id string, checkpoint_step int, question_id string, p_a double, p_b double, p_c double, p_d double, gold string").coalesce(1).write.parquet(f"{root}/predictions.parquet")
    return str(root)


def compare(spark, folder, name, n):
    from windrow.registry import SQL

    c = duckdb.connect()
    c.sql(f"CREATE VIEW predictions AS SELECT * FROM '{folder}/predictions.parquet/*.parquet'")
    got, want = getattr(Q, name)(spark, folder), c.sql(SQL[name])
    assert sets(got.select(*want.columns).collect()) == sets(want.fetchall()) and got.count() == n


@pytest.mark.parametrize("name", ["i24_paired_bootstrap", "a14_rank_interval", "a15_rank_interval_off_by_one"])
def test_draws_are_those_of_sql_where_copies_differ(spark, folder, name):
    c = duckdb.connect()
    c.sql(f"CREATE VIEW predictions AS SELECT * FROM '{folder}/predictions.parquet/*.parquet'")
    from windrow.registry import SQL

    got = getattr(Q, name)(spark, folder)
    want = c.sql(SQL[name])
    assert sets(got.select(*want.columns).collect()) == sets(want.fetchall())
    assert got.count() == (600 if name.startswith("i24") else 6)


def test_copies_of_an_item_are_counted_not_paired(spark, folder):
    """Each copy at the last step with each at the first was a row: 300 of both made 90,000, with a list of 300 in each."""
    ends = Q._ends(spark, folder)
    assert "Generate" not in ends._jdf.queryExecution().optimizedPlan().toString()
    rows = ends.collect()
    assert len({(r.run_id, r.question_id) for r in rows}) == len(rows) and max(r.pairs for r in rows) > 1


def test_rows_of_both_steps_are_shuffled_and_sorted_once(spark, folder):
    """A table of distinct rows, one of sums and three shuffles ran out of a heap of 750 MB at 1 GB, their spills in too many pieces."""
    d = Q.a15_rank_interval_off_by_one(spark, folder)
    plan = d._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan and plan.count("Repartition") == 1
    physical = d._jdf.queryExecution().executedPlan().toString()
    assert physical.count("Exchange hashpartitioning") == 1 and physical.count("Sort [") == 1


def test_rank_intervals_of_a_hot_item_are_those_of_sql(spark, hot):
    compare(spark, hot, "a15_rank_interval_off_by_one", 2)


def test_draws_of_a_hot_item_are_those_of_sql_from_one_shuffle(spark, hot):
    compare(spark, hot, "i24_paired_bootstrap", 200)
    plan = Q.i24_paired_bootstrap(spark, hot)._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan and plan.count("Repartition") == 1 and plan.count("Generate") == 1


def test_the_steps_are_joined_beyond_the_bound(spark, folder, monkeypatch):
    known = sets(Q.a14_rank_interval(spark, folder).collect())
    monkeypatch.setattr(Q, "small_enough", lambda df: False)
    assert sets(Q.a14_rank_interval(spark, folder).collect()) == known


def test_no_rows_are_made_but_the_draws(spark):
    """Rows of draws x units came to the driver's machine in one window and two joins."""
    d = spark.createDataFrame([(f"g{i % 3}", i % 10, i % 2, i % 3) for i in range(30)], "g string, u int, a int, b int")
    plan = resampling.paired_bootstrap(d, ["g"], "u", "a", "b", 10, "s")._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Generate" not in plan and "Window" not in plan


@pytest.mark.parametrize("keys,digests", [(["g"], 1 << 18), (["g", "h"], 70), (["g"], 10), ([], 33)])
def test_paired_draws_are_the_picks_of_the_index(spark, keys, digests):
    rows = [(f"g{i % 3}", i % 2, i * 7 % (5 + i % 3 * 20), (i * i) % 5 / 4 if i % 9 else None, i % 4 / 3) for i in range(200)]
    d = spark.createDataFrame(rows, "g string, h int, u int, a double, b double")
    picks = resampling.bootstrap_index(d, keys, "u", 10, "s").join(d, [*keys, "u"])
    want = picks.groupBy(*keys, "draw").agg((F.avg("a") - F.avg("b")).alias("difference"))
    got = resampling.paired_bootstrap(d.withColumn("x", F.lit(1)), keys, "u", "a", "b", 10, "s", digests)
    assert got.columns == [*keys, "draw", "difference"]
    rounded = lambda df: sets(df.withColumn("difference", F.round("difference", 9)).collect())
    assert rounded(got) == rounded(want) and got.count() >= 10
    assert resampling.paired_bootstrap(d.limit(0), keys, "u", "a", "b", 10, "s").collect() == []
