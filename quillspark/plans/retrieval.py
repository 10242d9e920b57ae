"""Queries: BM25, vectors, fusion, diversity, pinning, as-of, evaluation. The questions are the rows whose id is divisible by 20."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import blank_to_null, identifier
from ..operators import relational, retrieval
from ..session import cut
from ..sources.tables import latest_texts, table

K = 10


#: Weights of the fields in the index.
WEIGHTS = {"title": 2.0, "document_number": 4.0, "content_text": 1.0}


def _docs(spark, folder):
    docs = table(spark, folder, "legal_documents").groupBy("id").agg(F.min("title").alias("title"), F.min("document_number").alias("document_number"))
    return docs.join(latest_texts(spark, folder).withColumnRenamed("document_id", "id"), "id", "left")


def _questions(spark, folder):
    return table(spark, folder, "government_qna_citations").where("citation_id % 20 = 0").groupBy("citation_id").agg(F.min("raw_text").alias("raw_text"))


def _order():
    return [F.desc("score"), F.col("id")]


def _index(spark, folder):
    return retrieval.asked_index(retrieval.postings(_docs(spark, folder), "id", WEIGHTS), _questions(spark, folder), "id", "citation_id", "raw_text")


def _ranked(spark, folder, k=50):
    return retrieval.bm25_best(_index(spark, folder), k)


def bm25_topk(spark, folder):
    return _ranked(spark, folder, K)


#: Words of the text (3 each) and of title and number (1 each) that a question shares; fields by their place in WEIGHTS.
OVERLAP = [([2], 3.0), ([0, 1], 1.0)]


def term_overlap_topk(spark, folder):
    return retrieval.overlap_best(_index(spark, folder), K, OVERLAP)


def _fused(spark, folder):
    index = _index(spark, folder)
    return retrieval.fuse(retrieval.overlap_best(index, 50, OVERLAP), retrieval.bm25_best(index, 50), "citation_id", "id")


def hybrid_fusion(spark, folder):
    fused = _fused(spark, folder).select("citation_id", "id", F.round("score", 6).alias("score"))
    return retrieval.top_k(fused, ["citation_id"], _order(), K)


def hybrid_boosted(spark, folder):
    """The fused lists with the boost of what a question names: its score counts for the documents found."""
    met = cut(_fused(spark, folder).select("citation_id", "id", "score"))
    boosts = retrieval.named_boosts(met, _questions(spark, folder), _docs(spark, folder), key="id", query_key="citation_id", query_text="raw_text", number="document_number", texts=["content_text", "title"])
    boosted = met.join(boosts, ["citation_id", "id"], "left").select("citation_id", "id", F.round(F.col("score") + F.coalesce("boost", F.lit(0.0)), 6).alias("score"))
    return retrieval.top_k(boosted, ["citation_id"], _order(), K)


def dense_filtered(spark, folder):
    """Nearest vectors among those of even labels only: the filter comes before the search."""
    rows = table(spark, folder, "embeddings")
    kept = rows.where("label % 2 = 0").select("vec_id", "embedding")
    return retrieval.dense_top_k(kept, rows.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding"), "vec_id", "embedding", "query_id", K)


def dense_topk(spark, folder):
    rows = table(spark, folder, "embeddings")
    return retrieval.dense_top_k(rows.select("vec_id", "embedding"), rows.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding"), "vec_id", "embedding", "query_id", K)


def dense_diversified(spark, folder):
    rows = table(spark, folder, "embeddings")
    hits = retrieval.dense_top_k(rows.select("vec_id", "embedding"), rows.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding"), "vec_id", "embedding", "query_id", 50)
    return retrieval.diversify(hits.join(rows.select("vec_id", "label"), "vec_id"), "query_id", "label", "rank", K).select("query_id", "vec_id", "label", "place")


def pinned_hits(spark, folder):
    cites = table(spark, folder, "government_qna_citations").where("citation_id % 20 = 0").select("citation_id", blank_to_null(identifier(F.col("document_number"))).alias("k")).distinct()
    docs = table(spark, folder, "legal_documents").select(F.col("id"), blank_to_null(identifier(F.col("document_number"))).alias("k")).where("k is not null").groupBy("k").agg(F.min("id").alias("id"))
    required = cites.join(docs, "k").groupBy("citation_id", "id").agg(F.lit(1).alias("rank"))
    return retrieval.pin(_ranked(spark, folder, 20), required, "citation_id", "id", K)


def valid_hits(spark, folder):
    docs = table(spark, folder, "legal_documents").groupBy("id").agg(*[F.max(c).alias(c) for c in ("validity_status", "effective_date", "issued_date", "expired_date")])
    hits = _ranked(spark, folder, 20).join(docs, "id")
    valid = retrieval.valid_on(F.lit("2015-01-01").cast("date"), F.col("validity_status"), F.col("effective_date"), F.col("issued_date"), F.col("expired_date"), ["Hết hiệu lực toàn bộ"])
    return retrieval.prefer_valid(hits, "citation_id", valid, "rank", 3).select("citation_id", "id", "rank")


def _expected(spark, folder):
    return table(spark, folder, "government_qna_citations").where("citation_id % 20 = 0 and matched_document_id is not null").select("citation_id", F.col("matched_document_id").alias("id")).distinct()


def eval_metrics(spark, folder):
    out = retrieval.evaluation(_expected(spark, folder), _ranked(spark, folder), "citation_id", "id", K)
    return out.select("n", *[F.round(c, 6).alias(c) for c in ("recall", "mrr", "ndcg", "hit")])


def training_triples(spark, folder):
    return retrieval.training_triples(_ranked(spark, folder), _expected(spark, folder), "citation_id", "id")


def order_neighbours(spark, folder):
    lines = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    return retrieval.neighbours(lines, lines.where("l_quantity >= 49").select("l_orderkey", "l_linenumber").distinct(), "l_orderkey", "l_linenumber", 1)


def best_hits(spark, folder):
    """The best question of each document over all questions."""
    return retrieval.best_per_key(_ranked(spark, folder, K).select("id", "citation_id", "score"), ["id"], "score").select("id", "score")


QUERIES = {f.__name__: f for f in (bm25_topk, term_overlap_topk, hybrid_fusion, hybrid_boosted, dense_topk, dense_filtered, dense_diversified, pinned_hits, valid_hits, eval_metrics, training_triples, order_neighbours, best_hits)}

_T = "list_transform(regexp_extract_all(coalesce({}, ''), '([0-9a-zA-ZÀ-ỹĐđ/.-]+)', 1), lambda x: lower(x))"
_BASE = f"""
heads AS (SELECT id, min(title) AS title, min(document_number) AS document_number FROM legal_documents GROUP BY id),
bodies AS (SELECT document_id, content_text FROM (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY updated_at DESC NULLS LAST, content_text DESC NULLS LAST) AS nth FROM legal_document_contents) WHERE nth = 1),
docs AS (SELECT h.*, b.content_text FROM heads h LEFT JOIN bodies b ON b.document_id = h.id),
qs AS (SELECT citation_id, min(raw_text) AS raw_text FROM government_qna_citations WHERE citation_id % 20 = 0 GROUP BY citation_id),
terms AS (SELECT id, unnest({_T.format("title")}) AS term, 2.0 AS w, 1.0 AS o FROM docs UNION ALL SELECT id, unnest({_T.format("document_number")}), 4.0, 1.0 FROM docs UNION ALL SELECT id, unnest({_T.format("content_text")}), 1.0, 3.0 FROM docs),
asked AS (SELECT citation_id, unnest({_T.format("raw_text")}) AS term FROM qs),
post AS (SELECT id, term, sum(CAST(w AS DOUBLE)) AS tf FROM terms GROUP BY id, term),
len AS (SELECT id, sum(tf) AS len FROM post GROUP BY id),
whole AS (SELECT CAST(count(*) AS DOUBLE) AS n, greatest(avg(len), 1.0) AS avg_len FROM len),
df AS (SELECT term, count(*) AS df FROM post GROUP BY term),
qf AS (SELECT citation_id, term, count(*) AS qf FROM asked GROUP BY citation_id, term),
scores AS (SELECT q.citation_id, p.id, round(sum(q.qf * ln(1 + (w.n - d.df + 0.5) / (d.df + 0.5)) * p.tf * 2.5 / (p.tf + 1.5 * (0.25 + 0.75 * l.len / w.avg_len))), 6) AS score
  FROM qf q JOIN post p ON p.term = q.term JOIN df d ON d.term = q.term JOIN len l ON l.id = p.id, whole w GROUP BY q.citation_id, p.id),
ranks AS (SELECT *, row_number() OVER (PARTITION BY citation_id ORDER BY score DESC, id) AS rank FROM scores WHERE score > 0),
dw AS (SELECT id, term, sum(CAST(o AS DOUBLE)) AS o FROM (SELECT DISTINCT id, term, o FROM terms) GROUP BY id, term),
laps AS (SELECT a.citation_id, d.id, sum(d.o) AS score FROM (SELECT DISTINCT citation_id, term FROM asked) a JOIN dw d ON d.term = a.term GROUP BY a.citation_id, d.id),
lapranks AS (SELECT *, row_number() OVER (PARTITION BY citation_id ORDER BY score DESC, id) AS rank FROM laps),
expected AS (SELECT DISTINCT citation_id, matched_document_id AS id FROM government_qna_citations WHERE citation_id % 20 = 0 AND matched_document_id IS NOT NULL)
"""
_DENSE = """
e AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings),
sims AS (SELECT q.vec_id AS query_id, r.vec_id, r.label, round(list_cosine_similarity(q.v, r.v), 6) AS score FROM e q JOIN e r ON q.vec_id <> r.vec_id WHERE q.vec_id % 20 = 0),
near AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM sims)
"""
_ID = r"upper(regexp_replace(regexp_replace(document_number, '[\s\x0B\x{0085}\p{Z}]+', '', 'g'), '^[.,;:)]+|[.,;:)]+$', '', 'g'))"

SQL = {
    "bm25_topk": f"WITH {_BASE} SELECT citation_id, id, score, rank FROM ranks WHERE rank <= {K}",
    "term_overlap_topk": f"WITH {_BASE} SELECT citation_id, id, score, rank FROM lapranks WHERE rank <= {K}",
    "hybrid_fusion": f"""WITH {_BASE}, a AS (SELECT *, min(score) OVER (PARTITION BY citation_id) AS lo, max(score) OVER (PARTITION BY citation_id) AS hi FROM ranks WHERE rank <= 50),
b AS (SELECT *, min(score) OVER (PARTITION BY citation_id) AS lo, max(score) OVER (PARTITION BY citation_id) AS hi FROM lapranks WHERE rank <= 50),
f AS (SELECT coalesce(a.citation_id, b.citation_id) AS citation_id, coalesce(a.id, b.id) AS id,
 round(0.6 * coalesce(CASE WHEN b.hi = b.lo THEN 1.0 ELSE (b.score - b.lo) / (b.hi - b.lo) END, 0.0) + 0.4 * coalesce(CASE WHEN a.hi = a.lo THEN 1.0 ELSE (a.score - a.lo) / (a.hi - a.lo) END, 0.0), 6) AS score
 FROM a FULL JOIN b ON a.citation_id = b.citation_id AND a.id = b.id)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY citation_id ORDER BY score DESC, id) AS rank FROM f) WHERE rank <= {K}""",
    "dense_topk": f"WITH {_DENSE} SELECT query_id, vec_id, score, rank FROM near WHERE rank <= {K}",
    "dense_filtered": f"WITH {_DENSE}, f AS (SELECT query_id, vec_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM sims WHERE label % 2 = 0) SELECT * FROM f WHERE rank <= {K}",
    "dense_diversified": f"""WITH {_DENSE}, l AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY query_id, label ORDER BY rank) > 2 THEN 1 ELSE 0 END AS late FROM near WHERE rank <= 50)
SELECT query_id, vec_id, label, place FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY late, rank) AS place FROM l) WHERE place <= {K}""",
    "pinned_hits": f"""WITH {_BASE}, k AS (SELECT {_ID} AS k, min(id) AS id FROM legal_documents WHERE trim({_ID}) <> '' GROUP BY 1),
req AS (SELECT DISTINCT c.citation_id, k.id FROM (SELECT DISTINCT citation_id, {_ID} AS k FROM government_qna_citations WHERE citation_id % 20 = 0) c JOIN k ON k.k = c.k),
u AS (SELECT citation_id, id, 1 AS rank, 0 AS o FROM req UNION ALL SELECT citation_id, id, rank, 1 FROM ranks WHERE rank <= 20),
m AS (SELECT *, row_number() OVER (PARTITION BY citation_id, id ORDER BY o, rank) AS nth FROM u)
SELECT citation_id, id, o = 0 AS pinned, place FROM (SELECT *, row_number() OVER (PARTITION BY citation_id ORDER BY o, rank, id) AS place FROM m WHERE nth = 1) WHERE place <= {K}""",
    "valid_hits": f"""WITH {_BASE}, v AS (SELECT id, max(validity_status) AS s, max(effective_date) AS f, max(issued_date) AS i, max(expired_date) AS x FROM legal_documents GROUP BY id),
h AS (SELECT r.*, CASE WHEN coalesce(s, '') <> 'Hết hiệu lực toàn bộ' AND (coalesce(f, i) IS NULL OR coalesce(f, i) <= DATE '2015-01-01') AND (x IS NULL OR x > DATE '2015-01-01') THEN 1 ELSE 0 END AS ok FROM ranks r JOIN v ON v.id = r.id WHERE rank <= 20),
m AS (SELECT *, max(ok) OVER (PARTITION BY citation_id) AS anyok, row_number() OVER (PARTITION BY citation_id ORDER BY rank) AS nth FROM h)
SELECT citation_id, id, rank FROM m WHERE ok = 1 OR (anyok = 0 AND nth <= 3)""",
    "eval_metrics": f"""WITH {_BASE}, m AS (SELECT e.citation_id, e.id, r.rank FROM expected e LEFT JOIN (SELECT * FROM ranks WHERE rank <= 50) r ON r.citation_id = e.citation_id AND r.id = e.id)
SELECT count(*) AS n, round(avg(CASE WHEN rank IS NOT NULL THEN 1.0 ELSE 0.0 END), 6) AS recall, round(avg(CASE WHEN rank <= {K} THEN 1.0 / rank ELSE 0.0 END), 6) AS mrr,
round(avg(CASE WHEN rank <= {K} THEN 1.0 / log2(rank + 1) ELSE 0.0 END), 6) AS ndcg, round(avg(CASE WHEN rank <= {K} THEN 1.0 ELSE 0.0 END), 6) AS hit FROM m""",
    "training_triples": f"""WITH {_BASE}, m AS (SELECT r.citation_id, r.id, r.rank, CASE WHEN e.id IS NULL THEN 0 ELSE 1 END AS label FROM ranks r LEFT JOIN expected e ON e.citation_id = r.citation_id AND e.id = r.id WHERE rank <= 50)
SELECT citation_id, label, nth, id FROM (SELECT *, row_number() OVER (PARTITION BY citation_id, label ORDER BY rank, id) AS nth FROM m) WHERE nth <= CASE WHEN label = 1 THEN 3 ELSE 8 END""",
    "order_neighbours": """WITH l AS (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem), h AS (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity >= 49)
SELECT l.l_orderkey, l.l_linenumber, h.l_linenumber AS hit_position FROM l JOIN h ON l.l_orderkey = h.l_orderkey AND abs(l.l_linenumber - h.l_linenumber) = 1""",
    "best_hits": f"WITH {_BASE} SELECT id, max(score) AS score FROM ranks WHERE rank <= {K} GROUP BY id",
}
