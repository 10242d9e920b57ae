"""Versions of records over time."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def version_chain(rows: DataFrame, record: str, version: str, at: str, content: str) -> DataFrame:
    """Versions of each record where its content changed: ``<record>, <version>, valid_from, valid_to, is_current, superseded_by``.

    Rows that repeat the content before them add no version.
    """
    w = Window.partitionBy(record).orderBy(at, version)
    changed = rows.withColumn("_h", F.sha2(F.coalesce(F.col(content).cast("string"), F.lit("")), 256)).withColumn("_p", F.lag("_h").over(w)).where(F.col("_p").isNull() | (F.col("_p") != F.col("_h")))
    nxt = F.lead(version).over(w)
    return changed.select(record, version, F.col(at).alias("valid_from"), F.lead(at).over(w).alias("valid_to"), nxt.isNull().alias("is_current"), nxt.alias("superseded_by"))


def as_of(chain: DataFrame, at) -> DataFrame:
    """The versions that held at a time."""
    return chain.where((F.col("valid_from") <= at) & (F.col("valid_to").isNull() | (F.col("valid_to") > at)))


def status_latest(events: DataFrame, key: str, at: str, status: str, sequence: str) -> DataFrame:
    """``<key>, status, since, indexed_at``: the last status of each key, and when it was last INDEXED if it is that."""
    last = events.groupBy(key).agg(F.max_by(F.struct(F.col(status).alias("status"), F.col(at).alias("since")), F.struct(at, sequence)).alias("r"))
    return last.select(key, "r.status", "r.since", F.when(F.col("r.status") == "INDEXED", F.col("r.since")).alias("indexed_at"))
