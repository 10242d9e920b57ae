"""Problem 6: references of legal_document_relationships to documents that do not exist."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.orphans import Child, Parent, orphan_counts, orphan_references
from ..sources.tables import table


def _orphans(spark: SparkSession, folder: str) -> DataFrame:
    name = "legal_document_relationships"
    edges = table(spark, folder, name)
    parent = Parent("legal_documents", table(spark, folder, "legal_documents"), "id", "created_at", table(spark, folder, "legal_document_deletions"), "document_id", "deleted_at")
    return orphan_references([parent], [Child(name, edges, "relationship_id", end, "created_at", parent.name) for end in ("document_id", "related_document_id")])


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return _orphans(spark, folder).select(F.col("row_id").alias("relationship_id"), "endpoint", "orphan_kind").distinct()


def p6_counts(spark: SparkSession, folder: str) -> DataFrame:
    return orphan_counts(_orphans(spark, folder))


QUERIES = {"p6_found": p6_found, "p6_counts": p6_counts}

_SQL = """
WITH born AS (SELECT id, count(*) AS n, min(created_at) AS c FROM legal_documents WHERE id IS NOT NULL GROUP BY id),
gone AS (SELECT document_id AS id, max(deleted_at) AS t FROM legal_document_deletions WHERE document_id IS NOT NULL GROUP BY document_id),
refs AS (
  SELECT relationship_id, 'document_id' AS endpoint, document_id AS id, created_at FROM legal_document_relationships
  UNION ALL SELECT relationship_id, 'related_document_id', related_document_id, created_at FROM legal_document_relationships),
kinds AS (
  SELECT DISTINCT r.relationship_id, r.endpoint, r.id, r.created_at,
    CASE WHEN g.id IS NOT NULL AND (b.id IS NULL OR g.t > b.c) THEN 'deleted'
         WHEN b.id IS NULL THEN 'missing' WHEN r.created_at < b.c THEN 'late' END AS orphan_kind
  FROM refs r LEFT JOIN born b ON b.id = r.id LEFT JOIN gone g ON g.id = r.id WHERE r.id IS NOT NULL)
"""

SQL = {
    "p6_found": _SQL + "SELECT DISTINCT relationship_id, endpoint, orphan_kind FROM kinds WHERE orphan_kind IS NOT NULL",
    "p6_counts": _SQL
    + """SELECT 'legal_document_relationships' AS child_table, endpoint, 'legal_documents' AS parent_table, orphan_kind,
strftime(created_at, '%Y-%m') AS period, count(*) AS n FROM kinds WHERE orphan_kind IS NOT NULL GROUP BY endpoint, orphan_kind, strftime(created_at, '%Y-%m')""",
}
