"""Queries: search, facets, identity, resolution, set operations, replacement."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import blank_to_null, clean_scalar, first_filled, identifier
from ..operators import graph, quality, relational
from ..sources.tables import latest_texts, table

COLUMNS = ["id", "title", "document_number", "document_type", "issuing_authority", "issued_date"]
ALLOWED = {"document_type", "issuing_authority", "validity_status"}


def doc_search_page(spark, folder):
    relational.check_filters({"document_type": "Quyết định"}, ALLOWED)
    docs = table(spark, folder, "legal_documents").select(*COLUMNS).distinct()
    found = relational.search(docs, contains={"title": "quy định", "issuing_authority": ""}, equals={"document_type": "Quyết định"}, since={"issued_date": "2000-01-01"}, until={"issued_date": "2020-12-31"})
    return relational.page(found, [F.desc_nulls_last("issued_date"), F.asc("id")], 1, 50)


def doc_facets(spark, folder):
    return relational.facets(table(spark, folder, "legal_documents"), ["document_type", "validity_status", "source"])


def ids_missing_extra(spark, folder):
    docs, texts = table(spark, folder, "legal_documents"), table(spark, folder, "legal_document_contents")
    return relational.missing_and_extra(docs.select(F.col("id").alias("document_id")), texts.where("length(content_text) > 0"), "document_id")


def doc_upsert(spark, folder):
    docs = table(spark, folder, "legal_documents").select("id", "title", "validity_status", "updated_at").distinct()
    old = docs.where("updated_at < timestamp '2025-01-01'")
    new = docs.where("updated_at >= timestamp '2025-01-01'")
    return relational.upsert(relational.latest(old, ["id"], [F.col("updated_at")]), new, ["id"], [F.col("updated_at")]).select("id", "updated_at")


def edges_replaced(spark, folder):
    edges = table(spark, folder, "legal_document_relationships").select("document_id", "related_document_id", "relationship_type", "created_at")
    day = F.lit("2025-01-01").cast("timestamp")
    old, new = edges.where(F.col("created_at") < day), edges.where(F.col("created_at") >= day)
    out = relational.replace_children(old, new, new, "document_id")
    return out.groupBy("document_id").agg(F.count(F.lit(1)).alias("n"))


def _number():
    return blank_to_null(identifier(F.col("document_number")))


def _resolved(spark, folder):
    cites = table(spark, folder, "government_qna_citations").select("citation_id", "qna_id", "document_number").distinct()
    return cites, relational.resolve(cites, table(spark, folder, "legal_documents"), citation_key="citation_id", key=_number(), document_id="id", document_key=_number())


def citation_resolve(spark, folder):
    return _resolved(spark, folder)[1]


def citation_item_status(spark, folder):
    cites, resolved = _resolved(spark, folder)
    return relational.citation_status(table(spark, folder, "government_qna_items"), resolved.join(cites.select("citation_id", "qna_id"), "citation_id"), "qna_id")


def duplicate_identity(spark, folder):
    docs = table(spark, folder, "legal_documents")
    return relational.duplicate_identity(docs, "id", [F.col("document_number"), F.col("issued_date"), F.col("issuing_authority")]).select("first_id", "id")


def units_union(spark, folder):
    region, nation, customer, orders = (table(spark, folder, t) for t in ("region", "nation", "customer", "orders"))
    row = lambda level, i, parent, name: [F.lit(level).alias("level"), F.col(i).cast("long").alias("unit_id"), F.col(parent).cast("long").alias("parent_id") if parent else F.lit(None).cast("long").alias("parent_id"), name.alias("name")]
    parts = [
        region.select(*row("region", "r_regionkey", None, F.col("r_name"))),
        nation.join(region, nation.n_regionkey == region.r_regionkey).select(*row("nation", "n_nationkey", "n_regionkey", F.concat_ws(" / ", "r_name", "n_name"))),
        customer.join(nation, customer.c_nationkey == nation.n_nationkey).select(*row("customer", "c_custkey", "c_nationkey", F.concat_ws(" / ", "n_name", "c_name"))),
        orders.join(customer, orders.o_custkey == customer.c_custkey).select(*row("order", "o_orderkey", "o_custkey", F.concat_ws(" / ", "c_name", "o_orderstatus"))),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def doc_detail(spark, folder):
    docs = table(spark, folder, "legal_documents").select("id", "title").distinct()
    texts = table(spark, folder, "legal_document_contents").groupBy(F.col("document_id").alias("id")).agg(F.max(F.length("content_text")).alias("text_length"))
    edges = graph.clean_edges(table(spark, folder, "legal_document_relationships"), "document_id", "related_document_id", "relationship_type").groupBy(F.col("document_id").alias("id")).agg(F.count(F.lit(1)).alias("relations"))
    return docs.join(texts, "id", "left").join(edges, "id", "left").select("id", "title", F.coalesce("text_length", F.lit(0)).alias("text_length"), F.coalesce("relations", F.lit(0)).alias("relations"))


def quality_issues(spark, folder):
    texts = table(spark, folder, "legal_document_contents").select("document_id", "content_text").distinct()
    empty = texts.where("octet_length(coalesce(content_text, '')) <= 80").select("document_id")
    with_article = texts.where(F.col("content_text").rlike(r"(?m)^Điều [0-9]+")).select("document_id")
    no_article = texts.where("octet_length(content_text) >= 2000").select("document_id").join(with_article, "document_id", "left_anti")
    long_title = table(spark, folder, "legal_documents").where("length(title) > 200").select(F.col("id").alias("document_id"))
    return empty.union(no_article).union(long_title).distinct()


def bad_documents(spark, folder):
    docs = table(spark, folder, "legal_documents").select("id", "title").distinct()
    texts = latest_texts(spark, folder).withColumnRenamed("document_id", "id")
    return quality.bad_documents(docs.join(texts, "id", "left"), "id", F.col("title"), F.col("content_text"))


def filled_fields(spark, folder):
    docs = table(spark, folder, "legal_documents")
    return docs.select("id", first_filled("source", "external_source").alias("origin"), clean_scalar(F.col("validity_status")).alias("validity"), clean_scalar(F.col("gazette_date_raw")).alias("gazette")).distinct()


def crawl_gaps(spark, folder):
    """Stretches of ids that follow each other without a gap, over all ids."""
    return relational.id_runs(table(spark, folder, "legal_documents"), "id")


QUERIES = {f.__name__: f for f in (doc_search_page, doc_facets, ids_missing_extra, doc_upsert, edges_replaced, citation_resolve, citation_item_status, duplicate_identity, units_union, doc_detail, quality_issues, bad_documents, filled_fields, crawl_gaps)}

_ID = r"upper(regexp_replace(regexp_replace(document_number, '[\s\x0B\x{0085}\p{Z}]+', '', 'g'), '^[.,;:)]+|[.,;:)]+$', '', 'g'))"
_RESOLVED = f"""
WITH named AS (SELECT k, count(DISTINCT id) AS n, min(id) AS d FROM (SELECT id, {_ID} AS k FROM legal_documents) WHERE k IS NOT NULL AND trim(k) <> '' GROUP BY k),
cites AS (SELECT DISTINCT citation_id, qna_id, document_number FROM government_qna_citations),
asked AS (SELECT citation_id, qna_id, CASE WHEN trim({_ID}) <> '' THEN {_ID} END AS k FROM cites),
resolved AS (SELECT citation_id, qna_id, CASE WHEN a.k IS NULL THEN 'UNRESOLVED' WHEN n = 1 THEN 'MATCHED' WHEN n > 1 THEN 'AMBIGUOUS' ELSE 'MISSING' END AS status, CASE WHEN n = 1 THEN d END AS matched_id
  FROM asked a LEFT JOIN named m ON m.k = a.k)
"""

SQL = {
    "doc_search_page": """SELECT DISTINCT id, title, document_number, document_type, issuing_authority, issued_date FROM legal_documents
WHERE contains(lower(title), 'quy định') AND document_type = 'Quyết định' AND issued_date >= DATE '2000-01-01' AND issued_date <= DATE '2020-12-31'
ORDER BY issued_date DESC NULLS LAST, id LIMIT 50 OFFSET 50""",
    "doc_facets": " UNION ALL ".join(f"SELECT '{c}' AS facet, {c} AS value, count(*) AS n FROM legal_documents WHERE trim({c}) <> '' GROUP BY {c}" for c in ("document_type", "validity_status", "source")),
    "ids_missing_extra": """WITH d AS (SELECT DISTINCT id FROM legal_documents WHERE id IS NOT NULL), t AS (SELECT DISTINCT document_id AS id FROM legal_document_contents WHERE length(content_text) > 0 AND document_id IS NOT NULL)
SELECT id AS document_id, 'missing' AS side FROM d WHERE id NOT IN (SELECT id FROM t) UNION ALL SELECT id, 'extra' FROM t WHERE id NOT IN (SELECT id FROM d)""",
    "doc_upsert": "SELECT id, max(updated_at) AS updated_at FROM legal_documents GROUP BY id HAVING max(updated_at) IS NOT NULL",
    "edges_replaced": """WITH e AS (SELECT document_id, related_document_id, relationship_type, created_at FROM legal_document_relationships),
n AS (SELECT DISTINCT * FROM e WHERE created_at >= TIMESTAMP '2025-01-01'), o AS (SELECT * FROM e WHERE created_at < TIMESTAMP '2025-01-01' AND (document_id IS NULL OR document_id NOT IN (SELECT document_id FROM n WHERE document_id IS NOT NULL)))
SELECT document_id, count(*) AS n FROM (SELECT * FROM n UNION ALL SELECT * FROM o) GROUP BY document_id""",
    "citation_resolve": _RESOLVED + "SELECT citation_id, status, matched_id FROM resolved",
    "citation_item_status": _RESOLVED
    + """, per AS (SELECT qna_id, count(*) AS citations, sum(CASE WHEN status = 'MATCHED' THEN 1 ELSE 0 END) AS matched, sum(CASE WHEN status = 'MISSING' THEN 1 ELSE 0 END) AS missing FROM resolved GROUP BY qna_id),
rows AS (SELECT i.qna_id, coalesce(citations, 0) AS citations, coalesce(matched, 0) AS matched, coalesce(missing, 0) AS missing FROM (SELECT DISTINCT qna_id FROM government_qna_items) i LEFT JOIN per p ON p.qna_id = i.qna_id)
SELECT *, CASE WHEN citations = 0 THEN 'NO_CITATIONS' WHEN missing > 0 THEN 'HAS_MISSING' WHEN matched = citations THEN 'ALL_MATCHED' ELSE 'PARTIAL' END AS status FROM rows""",
    "duplicate_identity": r"""WITH k AS (SELECT DISTINCT id, lower(trim(regexp_replace(document_number, '[\s\x0B]+', ' ', 'g'))) AS a, issued_date AS b, lower(trim(regexp_replace(issuing_authority, '[\s\x0B]+', ' ', 'g'))) AS c FROM legal_documents),
f AS (SELECT a, b, c, min(id) AS first_id FROM k WHERE a IS NOT NULL AND b IS NOT NULL AND c IS NOT NULL GROUP BY a, b, c HAVING count(*) > 1)
SELECT DISTINCT f.first_id, k.id FROM k JOIN f ON f.a = k.a AND f.b = k.b AND f.c = k.c WHERE k.id <> f.first_id""",
    "units_union": """SELECT 'region' AS level, CAST(r_regionkey AS BIGINT) AS unit_id, CAST(NULL AS BIGINT) AS parent_id, r_name AS name FROM region
UNION ALL SELECT 'nation', CAST(n_nationkey AS BIGINT), CAST(n_regionkey AS BIGINT), r_name || ' / ' || n_name FROM nation JOIN region ON n_regionkey = r_regionkey
UNION ALL SELECT 'customer', c_custkey, CAST(c_nationkey AS BIGINT), n_name || ' / ' || c_name FROM customer JOIN nation ON c_nationkey = n_nationkey
UNION ALL SELECT 'order', o_orderkey, o_custkey, c_name || ' / ' || o_orderstatus FROM orders JOIN customer ON o_custkey = c_custkey""",
    "doc_detail": """WITH d AS (SELECT DISTINCT id, title FROM legal_documents), t AS (SELECT document_id, max(length(content_text)) AS n FROM legal_document_contents GROUP BY document_id),
e AS (SELECT document_id, count(*) AS n FROM (SELECT DISTINCT document_id, related_document_id, trim(relationship_type) AS r FROM legal_document_relationships WHERE document_id IS NOT NULL AND related_document_id IS NOT NULL AND document_id <> related_document_id) GROUP BY document_id)
SELECT d.id, d.title, coalesce(t.n, 0) AS text_length, coalesce(e.n, 0) AS relations FROM d LEFT JOIN t ON t.document_id = d.id LEFT JOIN e ON e.document_id = d.id""",
    "quality_issues": r"""WITH t AS (SELECT DISTINCT document_id, content_text FROM legal_document_contents)
SELECT document_id FROM t WHERE strlen(coalesce(content_text, '')) <= 80
UNION SELECT document_id FROM t WHERE strlen(content_text) >= 2000 AND document_id NOT IN (SELECT document_id FROM t WHERE regexp_matches(content_text, '(?m)^Điều [0-9]+'))
UNION SELECT id FROM legal_documents WHERE length(title) > 200""",
    "bad_documents": """WITH d AS (SELECT DISTINCT id, title FROM legal_documents), t AS (SELECT document_id, content_text AS x FROM (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY updated_at DESC NULLS LAST, content_text DESC NULLS LAST) AS nth FROM legal_document_contents) WHERE nth = 1),
j AS (SELECT d.id, length(coalesce(d.title, '')) AS h, length(coalesce(t.x, '')) AS n FROM d LEFT JOIN t ON t.document_id = d.id)
SELECT id, 'short_text' AS reason FROM j WHERE n < 80 UNION ALL SELECT id, 'short_title' FROM j WHERE h < 5""",
    "filled_fields": r"""SELECT DISTINCT id, coalesce(CASE WHEN trim(source) <> '' THEN trim(source) END, CASE WHEN trim(external_source) <> '' THEN trim(external_source) END) AS origin,
CASE WHEN v NOT IN ('', '...', 'nan', 'NaN', 'None') THEN v END AS validity, CASE WHEN g NOT IN ('', '...', 'nan', 'NaN', 'None') THEN g END AS gazette
FROM (SELECT *, trim(regexp_replace(replace(validity_status, chr(160), ' '), '[ \t\r\f]+', ' ', 'g')) AS v, trim(regexp_replace(replace(gazette_date_raw, chr(160), ' '), '[ \t\r\f]+', ' ', 'g')) AS g FROM legal_documents)""",
    "crawl_gaps": """WITH i AS (SELECT DISTINCT id FROM legal_documents WHERE id IS NOT NULL), b AS (SELECT id, id - row_number() OVER (ORDER BY id) AS grp FROM i)
SELECT min(id) AS first_id, max(id) AS last_id, count(*) AS n FROM b GROUP BY grp""",
}
