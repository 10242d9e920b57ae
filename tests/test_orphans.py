"""Orphan references: every kind, ties, nulls, repeats, empty tables, clashing columns, hot keys."""

import datetime as dt

from pyspark.sql import functions as F

from quillspark.operators.orphans import Child, Parent, orphan_counts, orphan_references

D = lambda d: dt.datetime(2024, 1, d)
DOCS, DELETED, EDGES = "id long, born timestamp, at string", "id long, gone timestamp", "rid long, a long, at timestamp, key string, tag int"


def found(spark, docs, deleted, edges):
    parent = Parent("docs", spark.createDataFrame(docs, DOCS), "id", "born", spark.createDataFrame(deleted, DELETED), "id", "gone")
    return orphan_references([parent], [Child("edges", spark.createDataFrame(edges, EDGES), "rid", "a", "at", "docs")])


def test_kinds(spark):
    docs = [(1, D(5), "x"), (1, D(9), "x"), (2, D(5), None), (3, D(5), None), (5, None, None)]
    deleted = [(2, D(6)), (3, D(4)), (4, D(1)), (4, D(1)), (6, None)]
    edges = [(10, 1, D(4), "k", 1), (11, 1, D(5), None, None), (12, 2, D(7), None, None), (13, 3, D(7), None, None), (14, 4, None, None, None), (15, 9, D(1), None, None), (15, 9, D(1), None, None), (16, None, D(1), None, None), (17, 1, None, None, None), (18, 5, D(1), None, None), (19, 6, D(1), None, None)]
    got = {(r.row_id, r.orphan_kind) for r in found(spark, docs, deleted, edges).collect()}
    assert got == {(10, "late"), (12, "deleted"), (14, "deleted"), (15, "missing"), (19, "deleted")}


def test_repeats_count_once_and_periods(spark):
    counts = orphan_counts(found(spark, [], [], [(1, 7, D(1), "", 0), (1, 7, D(1), "", 0), (2, 7, None, "", 0)])).collect()
    assert {(r.period, r.orphan_kind, r.n) for r in counts} == {("2024-01", "missing", 1), (None, "missing", 1)}


def test_empty(spark):
    assert found(spark, [], [], []).count() == 0
    assert found(spark, [(1, D(1), "")], [], []).count() == 0


def test_hot_key(spark):
    edges = spark.range(5000).select(F.col("id").alias("rid"), F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id")).cast("long").alias("a"), F.lit(D(1)).alias("at"))
    docs = spark.createDataFrame([(1, D(2), "x")], DOCS)
    got = orphan_references([Parent("d", docs, "id", "born")], [Child("e", edges, "rid", "a", "at", "d")])
    kinds = {r.orphan_kind: r["count"] for r in got.groupBy("orphan_kind").count().collect()}
    late = sum(1 for i in range(5000) if i % 3 == 0 or i == 1)
    assert kinds == {"late": late, "missing": 5000 - late}
