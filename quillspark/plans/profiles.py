"""Queries: quality profiles, graph summaries, versions, streams."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import graph, quality, versions
from ..sources.tables import table
from ..streaming import jobs

DOC_COLUMNS = ["title", "document_number", "document_type", "issuing_authority", "issued_date", "effective_date", "expired_date", "source", "validity_status"]


def null_profile(spark, folder):
    return quality.null_counts(table(spark, folder, "legal_documents"), DOC_COLUMNS)


def authority_counts(spark, folder):
    return quality.value_counts(table(spark, folder, "legal_documents"), F.col("issuing_authority"))


def text_lengths(spark, folder):
    return quality.length_profile(table(spark, folder, "legal_document_contents"), F.length("content_text"))


def repeated_ids(spark, folder):
    return quality.uniqueness(table(spark, folder, "legal_documents"), ["id"])


EDGE = ["document_id", "related_document_id", "relationship_type"]


def edge_quality(spark, folder):
    return graph.edge_report(table(spark, folder, "legal_document_relationships"), "document_id", "related_document_id", EDGE)


def _edges(spark, folder):
    return graph.clean_edges(table(spark, folder, "legal_document_relationships"), *EDGE)


def edge_cleanup(spark, folder):
    return _edges(spark, folder)


def relation_degrees(spark, folder):
    return graph.degrees(_edges(spark, folder), "document_id", "related_document_id")


def relation_summaries(spark, folder):
    return graph.relation_summary(_edges(spark, folder).where("relationship_type is not null"), "document_id", "relationship_type")


def first_relations(spark, folder):
    titles = table(spark, folder, "legal_documents").groupBy(F.col("id").alias("related_document_id")).agg(F.min("title").alias("title"))
    first = graph.first_related(_edges(spark, folder), "document_id", ["related_document_id", "relationship_type"])
    return first.join(titles, "related_document_id", "left").select("document_id", "nth", "related_document_id", "title")


def order_versions(spark, folder):
    return versions.version_chain(table(spark, folder, "orders"), "o_custkey", "o_orderkey", "o_orderdate", "o_orderstatus")


def orders_as_of(spark, folder):
    return versions.as_of(order_versions(spark, folder), F.lit("1998-01-01").cast("timestamp")).select("o_custkey", "o_orderkey")


def events_per_hour(spark, folder):
    """Events per hour with the change to the hour before and the mean rate since the first.

    Windows see the hours of one day; what went before comes from the one row of each day.
    """
    hours = table(spark, folder, "events").where("ts is not null").groupBy(F.date_trunc("hour", "ts").alias("hour")).agg(F.count(F.lit(1)).alias("n")).withColumn("day", F.to_date("hour"))
    days = hours.groupBy("day").agg(F.max_by("n", "hour").alias("_end"), F.sum("n").alias("_n"), F.count(F.lit(1)).alias("_hours"))
    by_day = Window.orderBy("day")
    earlier = by_day.rowsBetween(Window.unboundedPreceding, -1)
    before = days.select("day", F.lag("_end").over(by_day).alias("_last"), *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(c) for c in ("_n", "_hours")])
    w = Window.partitionBy("day").orderBy("hour")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    rate = (F.col("_n") + F.sum("n").over(upto)) / (F.col("_hours") + F.count(F.lit(1)).over(upto))
    return hours.join(before, "day").select("hour", "n", (F.col("n") - F.coalesce(F.lag("n").over(w), "_last")).alias("change"), F.round(rate, 6).alias("rate"))


STATUS = {"view": "PENDING", "click": "INDEXING", "purchase": "INDEXED", "error": "FAILED"}


def _status():
    m = F.create_map(*[F.lit(x) for kv in STATUS.items() for x in kv])
    return F.try_element_at(m, F.col("event_type"))


def _indexed(spark, folder):
    stream = jobs.stream_of(spark, folder, "events")
    return jobs.index_events(spark, stream, valid=F.col("ts").isNotNull() & F.col("event_type").isin(*STATUS), key="user_id", at="ts", status=_status(), sequence="event_id")


def stream_status(spark, folder):
    return _indexed(spark, folder)[0]


def stream_dead_letters(spark, folder):
    return _indexed(spark, folder)[1].select("event_id", "event_type")


def stream_windows(spark, folder):
    return jobs.collected(spark, jobs.windowed_counts(jobs.stream_of(spark, folder, "events"), "ts", "1 day", "1 hour", "event_type"))


QUERIES = {f.__name__: f for f in (null_profile, authority_counts, text_lengths, repeated_ids, edge_quality, edge_cleanup, relation_degrees, relation_summaries, first_relations, order_versions, orders_as_of, events_per_hour, stream_status, stream_dead_letters, stream_windows)}

_E = "e AS (SELECT DISTINCT document_id, related_document_id, trim(relationship_type) AS relationship_type FROM legal_document_relationships WHERE document_id IS NOT NULL AND related_document_id IS NOT NULL AND document_id <> related_document_id)"
_V = """v AS (SELECT o_custkey, o_orderkey, o_orderdate, o_orderstatus, lag(o_orderstatus) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS p, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS nth FROM orders),
c AS (SELECT o_custkey, o_orderkey, o_orderdate AS valid_from, lead(o_orderdate) OVER w AS valid_to, lead(o_orderkey) OVER w AS superseded_by FROM v WHERE nth = 1 OR coalesce(p, '') <> coalesce(o_orderstatus, '') WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey))"""

SQL = {
    "null_profile": " UNION ALL ".join(f"SELECT '{x}' AS \"column\", count(*) - count({x}) AS nulls, coalesce(sum(CASE WHEN trim(CAST({x} AS VARCHAR)) = '' THEN 1 ELSE 0 END), 0) AS blanks FROM legal_documents" for x in DOC_COLUMNS),
    "authority_counts": "SELECT coalesce(issuing_authority, '') AS value, count(*) AS n FROM legal_documents GROUP BY 1 ORDER BY n DESC, value LIMIT 20",
    "text_lengths": "SELECT count(v) AS n, min(v) AS shortest, quantile_cont(v, 0.5) AS median, round(avg(v), 2) AS mean, quantile_cont(v, 0.95) AS p95, max(v) AS longest FROM (SELECT length(content_text) AS v FROM legal_document_contents)",
    "repeated_ids": "SELECT id, count(*) AS n FROM legal_documents GROUP BY id HAVING count(*) > 1",
    "edge_quality": """WITH f AS (SELECT document_id AS a, related_document_id AS b, relationship_type, count(*) AS n FROM legal_document_relationships GROUP BY 1, 2, 3)
SELECT sum(n) AS raw, count(*) AS distinct_rows, sum(n - 1) AS duplicates, sum(CASE WHEN a = b THEN 1 ELSE 0 END) AS self_links, sum(CASE WHEN a IS NULL OR b IS NULL THEN 1 ELSE 0 END) AS null_ends FROM f""",
    "edge_cleanup": f"WITH {_E} SELECT * FROM e",
    "relation_degrees": f"WITH {_E} SELECT node, sum(o) AS out_degree, sum(i) AS in_degree FROM (SELECT document_id AS node, 1 AS o, 0 AS i FROM e UNION ALL SELECT related_document_id, 0, 1 FROM e) GROUP BY node",
    "relation_summaries": f"WITH {_E}, n AS (SELECT document_id, relationship_type AS l, count(*) AS n FROM e WHERE relationship_type IS NOT NULL GROUP BY 1, 2) SELECT document_id, string_agg(l || ': ' || n, '; ' ORDER BY n DESC, l) AS summary FROM n GROUP BY document_id",
    "first_relations": f"""WITH {_E}, t AS (SELECT id, min(title) AS title FROM legal_documents GROUP BY id), n AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY related_document_id, relationship_type NULLS FIRST) AS nth FROM e)
SELECT document_id, nth, related_document_id, title FROM n LEFT JOIN t ON t.id = related_document_id WHERE nth <= 16""",
    "order_versions": f"WITH {_V} SELECT o_custkey, o_orderkey, valid_from, valid_to, superseded_by IS NULL AS is_current, superseded_by FROM c",
    "orders_as_of": f"WITH {_V} SELECT o_custkey, o_orderkey FROM c WHERE valid_from <= TIMESTAMP '1998-01-01' AND (valid_to IS NULL OR valid_to > TIMESTAMP '1998-01-01')",
    "events_per_hour": """WITH h AS (SELECT date_trunc('hour', ts) AS hour, count(*) AS n FROM events WHERE ts IS NOT NULL GROUP BY 1)
SELECT hour, n, n - lag(n) OVER (ORDER BY hour) AS change, round(avg(n) OVER (ORDER BY hour ROWS UNBOUNDED PRECEDING), 6) AS rate FROM h""",
    "stream_status": """WITH s AS (SELECT user_id, ts, CASE event_type """ + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in STATUS.items()) + """ END AS status, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS nth FROM events WHERE ts IS NOT NULL AND event_type IN ('view', 'click', 'purchase', 'error'))
SELECT user_id, status, ts AS since, CASE WHEN status = 'INDEXED' THEN ts END AS indexed_at FROM s WHERE nth = 1""",
    "stream_dead_letters": "SELECT event_id, event_type FROM events WHERE ts IS NULL OR event_type IS NULL OR event_type NOT IN ('view', 'click', 'purchase', 'error')",
    "stream_windows": "SELECT date_trunc('day', ts) AS window_start, event_type, count(*) AS n FROM events WHERE ts IS NOT NULL GROUP BY 1, 2",
}
