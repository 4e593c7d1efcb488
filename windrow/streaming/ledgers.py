"""Append-only ledgers of attempts, as tables and as streams.

The streams give, for the same rows in any order and any batches, what the tables give.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def stream(spark: SparkSession, folder: str, schema: str, files_a_batch: int = 16) -> DataFrame:
    """Ledger files of a folder as they arrive."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).parquet(folder)


def first_of_key(events: DataFrame, keys: Sequence[str], time: str, delay: str) -> DataFrame:
    """Of a stream each key's first event; state is dropped once the watermark has passed it."""
    return events.withWatermark(time, delay).dropDuplicatesWithinWatermark(list(keys))


def windowed_counts(events: DataFrame, time: str, by: Sequence[str], width: str, slide: str | None = None, delay: str | None = None) -> DataFrame:
    """Events in each window of time, tumbling or sliding; with ``delay``, of a stream with late data. An addition to the reference's ledgers."""
    d = events.withWatermark(time, delay) if delay else events
    w = F.window(time, width, slide) if slide else F.window(time, width)
    return d.where(F.col(time).isNotNull()).groupBy(w, *by).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *by, "n")


def session_counts(events: DataFrame, time: str, by: Sequence[str], gap: str) -> DataFrame:
    """Events in each session, which ends when nothing comes for ``gap``. An addition to the reference's ledgers."""
    return events.where(F.col(time).isNotNull()).groupBy(F.session_window(time, gap).alias("w"), *by).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *by, "n")


def attempts(ledger: DataFrame, key: str, attempt: str, ok: str) -> DataFrame:
    """State of each call: distinct attempts, the last, whether any succeeded, and whether it may be tried again (once at most)."""
    g = ledger.groupBy(key).agg(F.countDistinct(attempt).alias("n_attempts"), F.max(attempt).alias("last_attempt"), F.coalesce(F.bool_or(ok), F.lit(False)).alias("succeeded"))
    return g.withColumn("may_retry", ~F.col("succeeded") & (F.col("n_attempts") < 2))


def latest(ledger: DataFrame, key: str, attempt: str, values: Sequence[str]) -> DataFrame:
    """The values of each key's last attempt; of copies of one attempt the least in their values' order."""
    return ledger.groupBy(key).agg(F.min_by(F.struct(attempt, *values), F.struct(-F.col(attempt), *[F.col(v) for v in values])).alias("_r")).select(key, "_r.*")


def pending(planned: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    """What is planned and not done."""
    return planned.join(done.select(*keys).distinct(), list(keys), "left_anti")


def cache_key(prompt_hash: str, model: str) -> "F.Column":
    return F.sha2(F.concat_ws("\x1f", F.col(prompt_hash), F.col(model)), 256)


#: Folders by hash of the keys of a table that is written once a key.
BUCKETS = 64


def once_into(spark: SparkSession, table: str, keys: Sequence[str]) -> Callable[[DataFrame, int], None]:
    """A sink for ``foreachBatch`` that writes each key once, however often a batch is run again.

    Rows lie by hash of their keys in ``_bucket`` folders, within them by ``_batch``: of the table only the keys of the buckets
    that a batch has are read. A batch that is run again after a failure overwrites what it wrote before, whole or in part.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        new = batch.dropDuplicates(list(keys)).withColumn("_bucket", F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)).cast("int"))
        folder = spark._jvm.org.apache.hadoop.fs.Path(table)
        if folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
            buckets = [r[0] for r in new.select("_bucket").distinct().collect()]  # at most BUCKETS
            before = spark.read.parquet(table).where(F.col("_bucket").isin(buckets) & (F.col("_batch") != batch_id)).select(*keys)
            new = pending(new, before, keys)
        new.withColumn("_batch", F.lit(int(batch_id)).cast("long")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("_bucket", "_batch").parquet(table)

    return write


def outstanding(ledger: DataFrame, raw: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that only one of ledger and raw log has, or that either has twice: keys, n_ledger, n_raw."""
    a = ledger.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_ledger"))
    b = raw.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_raw"))
    both = a.join(b, list(keys), "full_outer").fillna({"n_ledger": 0, "n_raw": 0})
    return both.where("n_ledger <> 1 or n_raw <> 1")


def progress(snapshots: DataFrame, keys: Sequence[str], order: str, done: str, idle: int = 3) -> DataFrame:
    """Each snapshot's state: 'progress' if more was done than at the one before, 'stalled' after ``idle`` without, else 'waiting'."""
    from pyspark.sql import Window as W

    w = W.partitionBy(*keys).orderBy(order)
    moved = F.col(done) > F.coalesce(F.lag(done).over(w), F.lit(-1))
    last = F.max(F.when(F.col("_moved"), F.col("_i"))).over(w.rowsBetween(W.unboundedPreceding, 0))
    d = snapshots.withColumn("_moved", moved).withColumn("_i", F.row_number().over(w))
    d = d.withColumn("_last", last)
    return d.withColumn("state", F.when(F.col("_moved"), "progress").when(F.col("_i") - F.col("_last") >= idle, "stalled").otherwise("waiting")).drop("_moved", "_i", "_last")
