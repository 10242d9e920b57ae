"""Relationship graph: cleaning, degrees, summaries, neighbours."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def clean_edges(edges: DataFrame, source: str, target: str, label: str) -> DataFrame:
    """Distinct labelled edges without nulls and self-links."""
    return edges.select(source, target, F.trim(label).alias(label)).where(F.col(source).isNotNull() & F.col(target).isNotNull() & (F.col(source) != F.col(target))).distinct()


def edge_report(edges: DataFrame, source: str, target: str, columns: list[str]) -> DataFrame:
    """One row: raw, distinct_rows, duplicates, self_links, null_ends. Rows are folded by value first."""
    folded = edges.groupBy(*columns).agg(F.count(F.lit(1)).alias("_n"))
    self_link = F.col(source) == F.col(target)
    null_end = F.col(source).isNull() | F.col(target).isNull()
    return folded.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("raw"), F.count(F.lit(1)).alias("distinct_rows"), F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("duplicates"),
        F.count_if(self_link).alias("self_links"), F.count_if(null_end).alias("null_ends"),
    )


def degrees(edges: DataFrame, source: str, target: str) -> DataFrame:
    """``node, out_degree, in_degree``; partial aggregation folds a hot node before the shuffle."""
    ends = edges.select(F.explode(F.array(F.struct(F.col(source).alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col(target).alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("e"))
    return ends.select("e.*").where("node is not null").groupBy("node").agg(F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree"))


def relation_summary(edges: DataFrame, source: str, label: str) -> DataFrame:
    """``<source>, summary``: "label: n; ..." by falling count, then label."""
    per = edges.groupBy(source, label).agg(F.count(F.lit(1)).alias("n"))
    # labels are few per node: the list is over labels, not edges
    packed = per.groupBy(source).agg(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("m"), F.col(label).alias("l")))).alias("_labels"))
    return packed.select(source, F.array_join(F.transform("_labels", lambda x: F.concat(x.l, F.lit(": "), (-x.m).cast("string"))), "; ").alias("summary"))


def first_related(edges: DataFrame, source: str, order: list[str], k: int = 16) -> DataFrame:
    """The first k edges of each node by an order, with ``nth``."""
    return edges.withColumn("nth", F.row_number().over(Window.partitionBy(source).orderBy(*order))).where(F.col("nth") <= k)
