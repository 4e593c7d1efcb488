"""Queries of the core over whole tables, and the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from windrow.operators import schema_drift
from windrow.plans import audit_queries, claim_queries, composites, contract_queries, edit_queries, graph_queries, ledger_queries, metric_queries, relational_queries, resampling_queries, support_queries, text_queries  # noqa: F401 - they register
from windrow.registry import QUERIES, SQL, query
from windrow.sources import read_table

__all__ = ["QUERIES", "SQL"]

METRICS = ("run_id", "checkpoint_step", "file_id", "payload")


@query()
def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    found = schema_drift.find_changes(read_table(spark, sf, "run_metrics", METRICS), *METRICS)
    return found.select(F.col("record").alias("run_id"), F.col("version").cast("int").alias("checkpoint_step"), "change", "field_name", "new_name").distinct()


@query()
def p6_table(spark: SparkSession, sf: str) -> DataFrame:
    """All metrics files as one table, a row a checkpoint and a column a quantity."""
    table = schema_drift.consistent_table(read_table(spark, sf, "run_metrics", METRICS), *METRICS)
    return table.withColumnsRenamed({"record": "run_id", "version": "checkpoint_step"})
