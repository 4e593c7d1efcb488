"""Access to the named parquet tables of a data directory."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, sf_dir: str, name: str, columns: Sequence[str] | None = None) -> DataFrame:
    """Table ``name`` of ``sf_dir``; with ``columns``, only these, so that the scan prunes the rest.

    A missing column raises ``ValueError`` before any job is started.
    """
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    if columns is None:
        return df
    absent = [c for c in columns if c not in df.columns]
    if absent:
        raise ValueError(f"{name} has no column {', '.join(absent)}")
    return df.select(*columns)
