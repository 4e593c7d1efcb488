"""Session helpers: shared checkpoint folder, written intermediate tables, checked broadcasts, scan width."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes up to which a side may be broadcast; beyond, callers take their shuffled way.
BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 64 << 20


def checkpoint_root(spark: SparkSession) -> str:
    """The folder that all executors share.

    It is ``spark.checkpoint.dir`` of the session. Only where that is unset, as in local tests, a folder of
    this machine is made and set; a cluster has to name its own.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if root:
        return root.rstrip("/")
    if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    root = "file://" + tempfile.mkdtemp(prefix="windrow-")
    spark.conf.set("spark.checkpoint.dir", root)
    return root


def run_folder(spark: SparkSession) -> str:
    """The folder of this application's intermediate tables, within the shared one."""
    return f"{checkpoint_root(spark)}/windrow-{spark.sparkContext.applicationId}"


def written(df: DataFrame, name: str, replaces: DataFrame | None = None) -> DataFrame:
    """``df`` written once to the shared folder and read back: cuts the lineage and survives a lost executor.

    Unlike an eager checkpoint it computes ``df`` once, and the optimizer sees the real sizes of the result. ``replaces``
    is an earlier written table that nothing reads any more, as in rounds; it is deleted once the new one stands.
    """
    spark = df.sparkSession
    path = f"{run_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if replaces is not None and (old := getattr(replaces, "_windrow_path", None)):
        _delete(spark, old)
    out = spark.read.schema(df.schema).parquet(path)
    out._windrow_path = path
    return out


def clear(spark: SparkSession) -> None:
    """Deletes the intermediate tables of this application, to be called when its results have been written."""
    _delete(spark, run_folder(spark))


def _delete(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def collect_bounded(df: DataFrame, rows: int = BROADCAST_ROWS) -> list:
    """Rows of a table that the caller takes to be small; ``OverflowError`` if it has more than ``rows``."""
    got = df.limit(rows + 1).collect()
    if len(got) > rows:
        raise OverflowError(f"more than {rows} rows; use the shuffled way")
    return got


def small_enough(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """Whether ``df`` has at most ``rows`` rows, found without counting further than that."""
    return df.limit(rows + 1).agg(F.count(F.lit(1))).first()[0] <= rows


def widened(df: DataFrame) -> DataFrame:
    """``df`` spread over the cores where its files give fewer than half as many tasks, else unchanged.

    Only plans that scan without a shuffle are looked at; others have their partitions from it.
    """
    if "Exchange" in df._jdf.queryExecution().executedPlan().toString():
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() * 2 >= cores else df.repartition(cores)
