"""Profiles and checks of data quality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def null_counts(rows: DataFrame, columns: list[str]) -> DataFrame:
    """``column, nulls, blanks`` in one pass over the rows."""
    one = rows.agg(*[F.count_if(F.col(c).isNull()).alias(f"n{i}") for i, c in enumerate(columns)], *[F.count_if(F.trim(F.col(c).cast("string")) == "").alias(f"b{i}") for i, c in enumerate(columns)])
    return one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"n{i}").alias("nulls"), F.col(f"b{i}").alias("blanks")) for i, c in enumerate(columns)])).alias("r")).select("r.*")


def value_counts(rows: DataFrame, column: Column, k: int = 20) -> DataFrame:
    """The k most frequent values, null as an empty one: a top-k report."""
    return rows.groupBy(F.coalesce(column, F.lit("")).alias("value")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "value").limit(k)


def length_profile(rows: DataFrame, length: Column) -> DataFrame:
    """One row: n, shortest, median, mean (2 places), p95, longest; exact percentiles of counts by length."""
    by = rows.select(length.alias("v")).where("v is not null").groupBy("v").agg(F.count(F.lit(1)).alias("c"))
    p = lambda q: F.percentile("v", F.lit(q), F.col("c"))
    return by.agg(F.sum("c").alias("n"), F.min("v").alias("shortest"), p(0.5).alias("median"), F.round(F.sum(F.col("v") * F.col("c")) / F.sum("c"), 2).alias("mean"), p(0.95).alias("p95"), F.max("v").alias("longest"))


def bad_documents(rows: DataFrame, key: str, title: Column, text: Column, least_text: int = 80, least_title: int = 5) -> DataFrame:
    """``<key>, reason`` of documents with too little text or title."""
    t, h = F.length(F.coalesce(text, F.lit(""))), F.length(F.coalesce(title, F.lit("")))
    reasons = F.array_compact(F.array(F.when(t < least_text, "short_text"), F.when(h < least_title, "short_title")))
    return rows.select(key, F.explode(reasons).alias("reason"))


def uniqueness(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Keys held by more than one row, with ``n``."""
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
