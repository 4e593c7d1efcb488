"""Writers: sorted JSON, tables with fixed columns, resumable shards, reports."""

from __future__ import annotations

import json
import os
import tempfile
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sorted_json(df: DataFrame) -> DataFrame:
    """Each row as compact JSON with sorted keys, nulls kept: value."""
    return df.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in sorted(df.columns)]), {"ignoreNullFields": "false"}).alias("value"))


def write_jsonl(df: DataFrame, path: str, order: Sequence[str], mode: str = "errorifexists") -> None:
    """JSON lines in the order of columns, range-sorted over as many files as the data need."""
    sorted_json(df.orderBy(*order)).write.mode(mode).text(path)


def write_csv(df: DataFrame, path: str, columns: Sequence[str], separator: str = ",", mode: str = "errorifexists") -> None:
    """CSV with exactly ``columns``: a missing one is written empty, one that isn't named raises."""
    extra = set(df.columns) - set(columns)
    if extra:
        raise ValueError(f"columns that aren't written: {', '.join(sorted(extra))}")
    df.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) if c in df.columns else F.lit("").alias(c) for c in columns]).write.mode(mode).option("header", True).option("sep", separator).option("emptyValue", "").csv(path)


def write_cells(df: DataFrame, path: str, cell: Sequence[str], resume: bool = True) -> DataFrame:
    """One folder a cell; cells that are there already are skipped. Returns the rows that were pending."""
    spark = df.sparkSession
    pending = df
    if resume:
        jvm = spark._jvm
        folder = jvm.org.apache.hadoop.fs.Path(path)
        if folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
            done = spark.read.parquet(path).select(*cell).distinct()
            pending = df.join(done, list(cell), "left_anti")
    pending.write.mode("append").partitionBy(*cell).parquet(path)
    return pending


def append_ledger(df: DataFrame, path: str, key: Sequence[str]) -> None:
    """Appends rows to a ledger whose keys never change; a key that is there already, or twice, raises."""
    spark = df.sparkSession
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    if df.groupBy(*key).count().where("count > 1").limit(1).count():
        raise ValueError("a key occurs twice")
    if folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder) and df.join(spark.read.parquet(path).select(*key), list(key), "left_semi").limit(1).count():
        raise ValueError("a key is in the ledger already")
    df.write.mode("append").parquet(path)


def verified_write(df: DataFrame, path: str) -> int:
    """Writes, reads back and compares the number of rows and a digest that doesn't depend on their order; the number."""
    df.write.mode("errorifexists").parquet(path)
    mark = [F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)")), F.lit(0))]
    a, b = df.agg(*mark).first(), df.sparkSession.read.parquet(path).select(*df.columns).agg(*mark).first()
    if tuple(a) != tuple(b):
        raise OSError(f"{path} isn't what was written: {tuple(b)}, expected {tuple(a)}")
    return a[0]


def markdown(df: DataFrame, columns: Sequence[str], rows: int = 1000) -> str:
    """A small result as a Markdown table; more than ``rows`` rows raise."""
    got = df.select(*columns).limit(rows + 1).collect()
    if len(got) > rows:
        raise OverflowError(f"more than {rows} rows for a report")
    cell = lambda v: "" if v is None else str(v).replace("|", "\\|").replace("\n", " ")
    return "\n".join(["| " + " | ".join(columns) + " |", "|" + "---|" * len(columns), *("| " + " | ".join(cell(v) for v in r) + " |" for r in got)])


def canonical(value: object) -> str:
    """JSON of a driver-side value with sorted keys."""
    return json.dumps(value, sort_keys=True, ensure_ascii=False, separators=(",", ":"))


def write_atomically(path: str, value: object) -> None:
    """A small driver-side value as JSON in a local file: written beside it, flushed to disk, then put in its place, so that a reader
    sees the old file or the new one. Tables are written by Spark, whose committer does the same."""
    folder = os.path.dirname(os.path.abspath(path))
    handle, beside = tempfile.mkstemp(dir=folder, prefix=f".{os.path.basename(path)}.")
    try:
        with os.fdopen(handle, "w", encoding="utf-8") as f:
            f.write(canonical(value))
            f.flush()
            os.fsync(f.fileno())
        os.replace(beside, path)
    except BaseException:
        os.unlink(beside)
        raise


def guarded(path: str, roots: Sequence[str]) -> str:
    """``path`` if it lies below one of the roots once links and dots are resolved, else ``PermissionError``."""
    real = os.path.realpath(path)
    if not any(real.startswith(os.path.realpath(r).rstrip(os.sep) + os.sep) for r in roots):
        raise PermissionError(f"{path} isn't below {', '.join(roots)}")
    return path
