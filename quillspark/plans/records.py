"""Queries: documents, their units, questions and answers as records; sinks and replacements."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import columns as c
from ..operators import graph, pages, quality, relational, retrieval, units, versions
from ..session import cut, shared_folder
from ..sources import files
from ..sources.tables import latest_texts, table


def _docs(spark, folder):
    return relational.latest(table(spark, folder, "legal_documents"), ["id"], [F.col("updated_at")])


def _items(spark, folder):
    return relational.latest(table(spark, folder, "government_qna_items"), ["qna_id"], [F.col("updated_at")])


# ---------------------------------------------------------------- search


def doc_search_full(spark, folder):
    """All twelve conditions of a search, with the number of all hits."""
    docs = table(spark, folder, "legal_documents").select("id", "title", "document_number", "document_type", "issuing_authority", "sector", "signer_title", "source", "validity_status", "issued_date", "effective_date").distinct()
    found = relational.search(
        docs,
        contains={"title": "phí", "document_number": "/", "issuing_authority": "tỉnh", "sector": " ", "signer_title": "chủ tịch"},
        equals={"validity_status": "Còn hiệu lực", "document_type": None, "source": ""},
        since={"issued_date": "1990-01-01", "effective_date": "1990-01-01"},
        until={"issued_date": "2024-12-31", "effective_date": "2025-12-31"},
    )
    return relational.page_with_total(found.select("id", "title", "issued_date"), [F.desc_nulls_last("issued_date"), F.asc("id")], 0, 20)


def doc_haystack(spark, folder):
    """Search in five fields at once, by date and title, the latest first."""
    docs = table(spark, folder, "legal_documents").select("id", "title", "document_number", "document_type", "issuing_authority", "validity_status", F.col("effective_date").cast("string").alias("effective")).distinct()
    found = relational.haystack(docs, ["title", "document_number", "document_type", "issuing_authority", "validity_status"], " Thông tư ")
    return relational.page(found, [F.desc(F.coalesce("effective", F.lit(""))), F.desc(F.coalesce("title", F.lit(""))), F.asc("id")], 1, 30).select("id", "effective")


def doc_by_id(spark, folder):
    """One document by its id: the filter prunes row groups by their statistics."""
    return table(spark, folder, "legal_document_contents").where("document_id = 1000").select("document_id", F.length("content_text").alias("n")).distinct()


def docs_until(spark, folder):
    """Filter by equal values and a last day of issue; unknown days drop out."""
    docs = table(spark, folder, "legal_documents").select("id", "document_type", "issued_date")
    return relational.search(docs, equals={"document_type": "Thông tư", "source": None}, until={"issued_date": "2015-12-31"}).select("id", "issued_date").distinct()


def answered_items(spark, folder):
    return table(spark, folder, "government_qna_items").where("length(answer_text) > 0").select("qna_id").distinct()


def match_reason_audit(spark, folder):
    """Reasons like a pattern with their number: a top-20 report."""
    return quality.value_counts(table(spark, folder, "government_qna_citations").where("match_reason like 'DOCUMENT\\_NUMBER%' or match_reason like '%MULTIPLE%'"), F.col("match_reason"))


def allowed_urls(spark, folder):
    u = F.col("source_url")
    return table(spark, folder, "legal_documents").select("id", c.allowed_host(u, ["van-ban.example", "cong-bao.example"]).alias("allowed"), c.url_slug(u).alias("slug")).distinct()


# ---------------------------------------------------------------- joins


def version_metadata(spark, folder):
    """Current versions of documents with the date of the version before that of the document."""
    docs = table(spark, folder, "legal_documents").select("id", "updated_at", "validity_status", "effective_date", "issued_date").distinct()
    chain = versions.version_chain(docs, "id", "updated_at", "updated_at", "validity_status").where("is_current").select("id", F.col("updated_at").alias("version"))
    return chain.join(_docs(spark, folder), "id").select("id", "version", F.coalesce("effective_date", "issued_date").alias("day"))


def doc_versions(spark, folder):
    docs = table(spark, folder, "legal_documents").select("id", "updated_at", "validity_status").distinct()
    return versions.version_chain(docs, "id", "updated_at", "updated_at", "validity_status").select("id", "updated_at", "is_current", "superseded_by")


def related_both_ways(spark, folder):
    """The first 16 documents a document names and the first 16 that name it, with their numbers."""
    edges = graph.clean_edges(table(spark, folder, "legal_document_relationships"), "document_id", "related_document_id", "relationship_type").select("document_id", "related_document_id").distinct()
    heads = _docs(spark, folder).select(F.col("id").alias("other"), "document_number")
    sides = [("out", "document_id", "related_document_id"), ("in", "related_document_id", "document_id")]
    both = None
    for name, a, b in sides:
        one = graph.first_related(edges.select(F.col(a).alias("id"), F.col(b).alias("other")), "id", ["other"]).select("id", F.lit(name).alias("side"), "nth", "other")
        both = one if both is None else both.unionByName(one)
    return both.join(heads, "other", "left")


def related_json(spark, folder):
    """Nested list of each document's first related ones as one line of JSON."""
    rows = related_both_ways(spark, folder).where("side = 'out'").groupBy("id").agg(F.sort_array(F.collect_list(F.struct("nth", "other"))).alias("r"))  # sixteen at most
    return rows.select("id", F.to_json(F.transform("r", lambda x: x.other)).alias("related"))


def related_unpacked(spark, folder):
    """The lines of JSON read again."""
    return related_json(spark, folder).select("id", F.posexplode(F.from_json("related", "array<bigint>")).alias("at", "other"))


def relation_totals(spark, folder):
    edges = graph.clean_edges(table(spark, folder, "legal_document_relationships"), "document_id", "related_document_id", "relationship_type")
    return graph.degrees(edges, "document_id", "related_document_id").withColumn("total", F.col("out_degree") + F.col("in_degree"))


def items_requeued(spark, folder):
    """Items with a missing citation go back to PENDING, all others keep their status."""
    bad = table(spark, folder, "government_qna_citations").where("match_status = 'MISSING'").select("qna_id").distinct().withColumn("_bad", F.lit(True))
    items = table(spark, folder, "government_qna_items").select("qna_id", "citation_status").distinct()
    return items.join(bad, "qna_id", "left").select("qna_id", F.when(F.col("_bad"), "PENDING").otherwise(F.col("citation_status")).alias("citation_status"))


def issue_counts(spark, folder):
    """Number of documents with each issue: empty text, long text without articles, long titles."""
    texts = latest_texts(spark, folder)
    n = F.octet_length(F.coalesce("content_text", F.lit("")))
    issues = F.array_compact(F.array(F.when(n <= 80, "empty_content"), F.when((n >= 2000) & ~F.coalesce(F.col("content_text"), F.lit("")).rlike(r"(?m)^Điều [0-9]+"), "no_article")))
    rows = texts.select("document_id", F.explode(issues).alias("issue")).unionByName(table(spark, folder, "legal_documents").where("length(title) > 200").select(F.col("id").alias("document_id"), F.lit("long_title").alias("issue")))
    return rows.distinct().groupBy("issue").agg(F.count("document_id").alias("documents"))


def title_hint_matches(spark, folder):
    cites = table(spark, folder, "government_qna_citations").where("document_number is null").groupBy("citation_id").agg(F.min("document_title").alias("document_title"))
    return relational.title_hints(cites, table(spark, folder, "legal_documents"), citation_key="citation_id", hint="document_title", document_id="id", columns=["title", "document_type"], least=8)


def title_shares(spark, folder):
    cites = table(spark, folder, "government_qna_citations")
    return cites.where("matched_document_title is not null").select("citation_id", F.round(c.token_share(F.col("document_title"), F.col("matched_document_title")), 6).alias("share")).distinct()


def citation_refs(spark, folder):
    """Articles of the refs column and of the raw text, each once, in that order."""
    both = F.array_distinct(F.concat(c.references(F.col("article_refs"), "article"), c.references(F.col("raw_text"), "article")))
    return table(spark, folder, "government_qna_citations").select("citation_id", F.array_join(both, ", ").alias("articles")).distinct()


# ---------------------------------------------------------------- units


def _units(spark, folder):
    return units.units(units.blocks(latest_texts(spark, folder), "document_id", "content_text"), "document_id")


def legal_units(spark, folder):
    """Articles, clauses, points and annexes with their stable anchors."""
    return units.anchors(_units(spark, folder), "document_id").select("document_id", "pos", "kind", "anchor")


def clause_texts(spark, folder):
    return units.unit_texts(_units(spark, folder), "document_id", "clause").select("document_id", "pos", "number", "blocks", F.length("text").alias("n"))


def unit_profile(spark, folder):
    """Articles per document: fewest, median, mean and most, and documents without any."""
    heads = _units(spark, folder).where("kind = 'article'").groupBy("document_id").agg(F.count(F.lit(1)).alias("n"))
    per = latest_texts(spark, folder).select("document_id").join(heads, "document_id", "left")
    return per.agg(F.min("n").alias("fewest"), F.median("n").alias("median"), F.round(F.avg("n"), 2).alias("mean"), F.max("n").alias("most"), F.count_if(F.col("n").isNull()).alias("without"))


def _article_chunks(spark, folder):
    """One chunk per article of a document that is asked for: its id ends in its place."""
    return units.unit_texts(_units(spark, folder), "document_id", "article").select(F.concat_ws(":", F.col("document_id").cast("string"), F.col("pos").cast("string")).alias("chunk_id"), "document_id", "pos", F.col("number").alias("article"), "text")


def chunk_ids(spark, folder):
    """Chunks in the order of their documents with an id made from their name, the same in every run."""
    return _article_chunks(spark, folder).select("chunk_id", "document_id", c.number_suffix(F.col("chunk_id")).alias("place"), c.name_uuid(F.col("chunk_id")).alias("point_id"))


def chunks_replaced(spark, folder):
    """Chunks of documents imported again are replaced, those of others stay: number and length of the chunks of each document."""
    new = _article_chunks(spark, folder).select("chunk_id", "document_id", F.length("text").alias("n"))
    imported = table(spark, folder, "legal_documents").where("updated_at >= timestamp '2025-01-01'").select(F.col("id").alias("document_id"))
    old = new.withColumn("n", F.lit(0))
    out = relational.replace_children(old, new.join(imported.distinct(), "document_id", "left_semi"), imported, "document_id")
    return out.groupBy("document_id").agg(F.count(F.lit(1)).alias("chunks"), F.sum("n").alias("n"))


def _articles(texts):
    """As _article_chunks, of the texts given."""
    marked = units.articles(units.blocks(texts, "document_id", "content_text"), "document_id")
    return units.unit_texts(marked, "document_id", "article").select(F.concat_ws(":", F.col("document_id").cast("string"), F.col("pos").cast("string")).alias("chunk_id"), "document_id", F.col("number").alias("article"), "text")


def article_eval(spark, folder):
    """Search over articles against the articles and clauses that citations name: recall, reciprocal rank, gain and hits of the first ten."""
    cites = table(spark, folder, "government_qna_citations").where("matched_document_id is not null")
    asked = cites.groupBy("citation_id").agg(F.min("raw_text").alias("raw_text"), F.min("matched_document_id").alias("document_id"), F.min("article_refs").alias("article_refs"), F.min("clause_refs").alias("clause_refs"))
    texts = latest_texts(spark, folder)
    index = retrieval.asked_index(retrieval.postings(_articles(texts), "chunk_id", {"article": 3.0, "text": 1.0}, ("document_id", "article")), asked, "chunk_id", "citation_id", "raw_text")
    # only hits in the document that is meant count, so texts are read again for these alone
    hits = cut(retrieval.bm25_ranks(index, asked.select("citation_id", "document_id"), "document_id", 50).select("citation_id", "chunk_id", "rank", "document_id"))
    chunks = _articles(texts.join(hits.select("document_id").distinct(), "document_id", "left_semi"))
    return retrieval.reference_evaluation(asked.select("citation_id", "document_id", c.references(F.col("article_refs"), "article").alias("articles"), c.references(F.col("clause_refs"), "clause").alias("clauses")), hits.drop("document_id").join(chunks, "chunk_id"), "citation_id", 10)


def best_per_article(spark, folder):
    """The best of a document's chunks that share an article number, over all questions."""
    asked = table(spark, folder, "government_qna_citations").groupBy("citation_id").agg(F.min("raw_text").alias("raw_text"))
    index = retrieval.asked_index(retrieval.postings(_articles(latest_texts(spark, folder)), "chunk_id", {"text": 1.0}, ("document_id", "article")), asked, "chunk_id", "citation_id", "raw_text")
    ranked = retrieval.bm25_best(index, 40).join(index.rows.select("chunk_id", "document_id", "article"), "chunk_id")
    return retrieval.best_per_key(ranked.select("citation_id", "document_id", "article", "chunk_id", "score"), ["citation_id", "document_id", "article"], "score").select("citation_id", "document_id", "article", "score")


# ---------------------------------------------------------------- texts of records


HEADER = {"Tiêu đề": "title", "Số/Ký hiệu": "document_number", "Loại văn bản": "document_type", "Tình trạng hiệu lực": "validity_status", "Ngày ban hành": "issued_date", "Ngày hiệu lực": "effective_date", "Ngày hết hiệu lực": "expired_date", "Cơ quan ban hành": "issuing_authority", "Nguồn": "source", "URL nguồn": "source_url", "Mã nguồn ngoài": "external_docid"}


def doc_headers(spark, folder):
    return table(spark, folder, "legal_documents").select("id", "updated_at", c.context_header({k: F.col(v) for k, v in HEADER.items()}).alias("header")).distinct()


def _pages(spark, folder):
    """The latest page of each document that has one."""
    rows = table(spark, folder, "legal_document_contents").where("content_html <> ''")
    return rows.groupBy("document_id").agg(F.max_by("content_html", F.struct("updated_at", "content_html")).alias("html"))


def page_blocks(spark, folder):
    return pages.page_blocks(_pages(spark, folder), "document_id", "html")


def page_titles(spark, folder):
    return _pages(spark, folder).select("document_id", pages.page(F.col("html")).title.alias("title"))


def html_or_text(spark, folder):
    """HTML of a content, its text where there is none, and the text, that of the HTML where there is none."""
    h, t = F.nullif("content_html", F.lit("")), F.nullif("content_text", F.lit(""))
    return table(spark, folder, "legal_document_contents").select("document_id", F.length(F.coalesce(h, t, F.lit(""))).alias("html_length"), F.length(F.coalesce(t, h, F.lit(""))).alias("text_length")).distinct()


def paragraphs(spark, folder):
    return latest_texts(spark, folder).where("content_text is not null").select("document_id", F.md5(c.paragraphs_html(F.col("content_text"))).alias("html_md5"))


def complete_answers(spark, folder):
    return table(spark, folder, "government_qna_items").select("qna_id", c.looks_complete(c.without_self_check(F.col("answer_text"))).alias("complete")).distinct()


def split_answers(spark, folder):
    """Question and answer of a page cut where a body answers: the length of both parts."""
    q, a = c.question_and_answer(F.concat_ws("\n", "question_text", "answer_text"))
    return _items(spark, folder).select("qna_id", F.length(q).alias("question_length"), F.length(a).alias("answer_length"))


def cleaned_citations(spark, folder):
    return table(spark, folder, "government_qna_citations").select("citation_id", c.citation_text(F.col("raw_text")).alias("cited")).distinct()


def item_times(spark, folder):
    return table(spark, folder, "government_qna_items").select("qna_id", c.event_time(F.col("updated_at")).alias("at"), c.safe_int(F.element_at(F.split("source_url", "/"), -1)).alias("number")).distinct()


def named_clauses(spark, folder):
    """Chunks of matched documents that are or name, also loosely, the clause a citation names."""
    cites = table(spark, folder, "government_qna_citations").where("matched_document_id is not null and clause_refs is not null").select("citation_id", F.col("matched_document_id").alias("document_id"), F.explode(c.references(F.col("clause_refs"), "clause")).alias("clause")).distinct()
    return cites.join(_article_chunks(spark, folder), "document_id").where(c.names_unit(F.col("text"), F.lit(None).cast("string"), "clause", F.col("clause"))).select("citation_id", "chunk_id", "clause")


# ---------------------------------------------------------------- sinks


def _sink(spark, rows, kind, schema=None):
    path = os.path.join(shared_folder(spark), f"sink-{uuid.uuid4().hex}")
    files.write(rows, path, kind, schema)
    return path


def bad_documents_csv(spark, folder):
    """The report of bad documents written as CSV and read as a look-up table."""
    bad = quality.bad_documents(_docs(spark, folder).join(latest_texts(spark, folder).withColumnRenamed("document_id", "id"), "id", "left"), "id", F.col("title"), F.col("content_text"))
    return files.csv_map(spark, _sink(spark, bad.select(F.col("id").cast("string").alias("id"), "reason"), "csv"), "id", "reason", header=True)


def seed_list(spark, folder):
    """Source URLs written as a list of seeds with remarks and read again."""
    urls = table(spark, folder, "legal_documents").where("source_url is not null").select(F.explode(F.array(F.col("source_url"), F.concat(F.lit("# "), "source_url"), F.lit(""))).alias("value"))
    path = os.path.join(shared_folder(spark), f"seeds-{uuid.uuid4().hex}")
    urls.write.mode("overwrite").text(path)
    return files.seeds(spark, path)


def quality_report(spark, folder):
    """Counts of a table written as a report of one JSON object and read again."""
    docs = table(spark, folder, "legal_documents")
    one = docs.agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("id").alias("documents"), F.count_if(F.col("title").isNull()).alias("without_title"), F.count_if(F.length("title") > 200).alias("long_titles"))
    return spark.read.schema("rows long, documents long, without_title long, long_titles long").json(_sink(spark, one, "json"))


DOCUMENT = "id bigint, title string, document_number string, issued_date date, signer_title string, page_count int, application_info double"


def normalised_documents(spark, folder):
    """Documents in one schema, written as zstd Parquet and read again: a column nobody has is null."""
    schema = spark.createDataFrame([], DOCUMENT).schema
    rows = table(spark, folder, "legal_documents").distinct()
    return spark.read.parquet(_sink(spark, rows, "parquet", schema)).groupBy("issued_date").agg(F.count(F.lit(1)).alias("n"), F.count("page_count").alias("pages"), F.min("id").alias("first_id"))


def audit_lines(spark, folder):
    """Citations with their status, one JSON object a line, read again."""
    rows = table(spark, folder, "government_qna_citations").select("citation_id", "match_status", "document_number").distinct()
    return spark.read.schema("citation_id long, match_status string, document_number string").json(_sink(spark, rows, "json"))


def cascade_deleted(spark, folder):
    """Rows left in each table after the documents removed for good have gone with all that refers to them."""
    docs = table(spark, folder, "legal_documents")
    born = docs.groupBy("id").agg(F.max("created_at").alias("c"))
    gone = table(spark, folder, "legal_document_deletions").groupBy(F.col("document_id").alias("id")).agg(F.max("deleted_at").alias("t")).join(born, "id", "left").where("c is null or t > c").select("id")
    tables = {"legal_documents": (docs, ["id"]), "legal_document_contents": (table(spark, folder, "legal_document_contents"), ["document_id"]), "legal_document_relationships": (table(spark, folder, "legal_document_relationships"), ["document_id", "related_document_id"])}
    out = None
    for name, rows in relational.cascade(tables, gone, "id").items():
        one = rows.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n")
        out = one if out is None else out.unionByName(one)
    return out


def items_replaced(spark, folder):
    """Items crawled again replace the older ones together with their citations: items and citations of each batch of ids."""
    items = table(spark, folder, "government_qna_items").select("qna_id", "updated_at").distinct()
    cites = table(spark, folder, "government_qna_citations").select("qna_id", "citation_id").distinct()
    again = items.groupBy("qna_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("qna_id")
    kept = relational.replace_children(cites, cites.join(again, "qna_id", "left_semi"), again, "qna_id")
    per = kept.groupBy("qna_id").agg(F.count(F.lit(1)).alias("citations"))
    return _items(spark, folder).select("qna_id", "updated_at").join(per, "qna_id", "left").select("qna_id", "updated_at", F.coalesce("citations", F.lit(0)).alias("citations"))


def scanned_sources(spark, folder):
    """Documents set aside for review, as their text came from a file of pages, and all others: number of both."""
    rows = latest_texts(spark, folder).select("document_id", F.coalesce(F.lower("content_text").contains("file pdf"), F.lit(False)).alias("review"))
    return rows.groupBy("review").agg(F.count(F.lit(1)).alias("documents"))


def dead_letter_records(spark, folder):
    """Events that cannot be used as records of when, where from and what."""
    e = table(spark, folder, "events")
    bad = e.where("event_type is null or event_type not in ('view', 'click', 'purchase')")
    return bad.select("event_id", F.col("ts").alias("failed_at"), F.lit("events").alias("source"), F.to_json(F.struct("event_id", "event_type")).alias("body"))


def readiness_summary(spark, folder):
    """Citations by match status with their share."""
    rows = table(spark, folder, "government_qna_citations").select("citation_id", F.coalesce("match_status", F.lit("UNKNOWN")).alias("status")).distinct().groupBy("status").agg(F.count(F.lit(1)).alias("n"))
    return rows.select("status", "n", F.round(F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(0))), 6).alias("share"))  # one row per status


QUERIES = {
    f.__name__: f
    for f in (
        doc_search_full, doc_haystack, doc_by_id, docs_until, answered_items, match_reason_audit, allowed_urls, version_metadata, doc_versions, related_both_ways, related_json, related_unpacked, relation_totals,
        items_requeued, issue_counts, title_hint_matches, title_shares, citation_refs, legal_units, clause_texts, unit_profile, chunk_ids, chunks_replaced, article_eval, best_per_article, doc_headers, page_blocks, page_titles, html_or_text,
        paragraphs, complete_answers, split_answers, cleaned_citations, item_times, named_clauses, bad_documents_csv, seed_list, quality_report, normalised_documents, audit_lines, cascade_deleted, items_replaced,
        scanned_sources, dead_letter_records, readiness_summary,
    )
}

_LATEST = "bodies AS (SELECT document_id, content_text FROM (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY updated_at DESC NULLS LAST, content_text DESC NULLS LAST) AS nth FROM legal_document_contents) WHERE nth = 1)"
_EDGES = "e AS (SELECT DISTINCT document_id, related_document_id, trim(relationship_type) AS r FROM legal_document_relationships WHERE document_id IS NOT NULL AND related_document_id IS NOT NULL AND document_id <> related_document_id)"
_BOTH = f"""{_EDGES}, p AS (SELECT DISTINCT document_id AS a, related_document_id AS b FROM e),
sides AS (SELECT a AS id, 'out' AS side, b AS other, row_number() OVER (PARTITION BY a ORDER BY b) AS nth FROM p UNION ALL SELECT b, 'in', a, row_number() OVER (PARTITION BY b ORDER BY a) FROM p),
heads AS (SELECT id, document_number FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY updated_at DESC NULLS LAST) AS nth FROM legal_documents) WHERE nth = 1)"""
_BLOCKS = r"""h AS (SELECT document_id, content_html FROM (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY updated_at DESC NULLS LAST, content_html DESC) AS nth FROM legal_document_contents WHERE content_html <> '') WHERE nth = 1),
e AS (SELECT document_id, regexp_extract_all(content_html, '(?s)<p(?:\s[^>]*)?>(.*?)</p>', 1) AS x FROM h), u AS (SELECT document_id, unnest(x) AS t, unnest(range(len(x))) AS i FROM e),
t AS (SELECT document_id, i, trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(t, '<[^>]*>', '', 'g'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&'), '[\s\x{A0}]+', ' ', 'g')) AS text FROM u),
b AS (SELECT document_id, row_number() OVER (PARTITION BY document_id ORDER BY i) - 1 AS pos, text FROM t WHERE text <> '')"""
_UNITS = rf"""{_LATEST}, l AS (SELECT document_id, unnest(string_split(content_text, chr(10))) AS line, unnest(range(len(string_split(content_text, chr(10))))) AS i FROM bodies WHERE content_text IS NOT NULL),
h AS (SELECT *, regexp_extract(line, '^\s*[“"]?(?i:điều)\s+[0-9]+[a-zA-Z]?\.?(\s.*)?$', 1) AS rest FROM l),
g AS (SELECT *, CASE WHEN rest <> '' THEN regexp_extract(rest, '^(?:\s+[^0-9\s].*?|\s+[0-9]+[^.0-9].*?)??\s+([0-9]+\.\s.*)$', 1) ELSE '' END AS tail FROM h),
s AS (SELECT document_id, i, CASE WHEN tail <> '' THEN list_concat([left(line, length(line) - length(tail))], string_split(regexp_replace(tail, '(?i)\s+((?:[0-9]+\.|[a-zđ]\))\s)', chr(10) || '\1', 'g'), chr(10))) ELSE [line] END AS parts FROM g),
q AS (SELECT document_id, i, unnest(parts) AS b, unnest(range(len(parts))) AS j FROM s),
b AS (SELECT document_id, row_number() OVER (PARTITION BY document_id ORDER BY i, j) AS pos, b AS block FROM (SELECT document_id, i, j, trim(regexp_replace(b, '[ \t\r\f\x0B]+', ' ', 'g')) AS b FROM q) WHERE b <> ''),
m AS (SELECT *, regexp_matches(block, '^\s*(?:Phụ\s+lục|PHỤ\s+LỤC)(?:[^\p{{L}}].*)?$') AS an, nullif(regexp_extract(block, '(?i)^\s*[“"]?điều\s+([0-9]+[a-z]?)\.?(?:\s+(.*))?$', 1), '') AS a,
 upper(nullif(regexp_extract(block, '(?i)^\s*([IVXLCDM]+)\.\s+.+$', 1), '')) AS r, nullif(regexp_extract(block, '^\s*([0-9]+)\.\s+.+$', 1), '') AS c, lower(nullif(regexp_extract(block, '(?i)^\s*([a-zđ])\)\s+.+$', 1), '')) AS p FROM b),
n AS (SELECT *, sum(CASE WHEN an THEN 1 ELSE 0 END) OVER (PARTITION BY document_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS annex_no FROM m),
f AS (SELECT *, min(CASE WHEN annex_no = 0 AND r IS NOT NULL THEN pos END) OVER (PARTITION BY document_id) AS first_r, min(CASE WHEN annex_no = 0 AND a IS NOT NULL THEN pos END) OVER (PARTITION BY document_id) AS first_a FROM n),
t AS (SELECT *, CASE WHEN annex_no = 0 THEN coalesce(a, CASE WHEN first_r < coalesce(first_a, 1073741824) THEN r END) END AS art FROM f),
u AS (SELECT *, CASE WHEN annex_no = 0 THEN max(CASE WHEN art IS NOT NULL THEN pos END) OVER (PARTITION BY document_id ORDER BY pos ROWS UNBOUNDED PRECEDING) END AS article_pos FROM t),
v AS (SELECT *, article_pos IS NOT NULL AND art IS NULL AND c IS NOT NULL AS isc FROM u),
w AS (SELECT *, CASE WHEN article_pos IS NOT NULL THEN max(CASE WHEN isc THEN pos END) OVER (PARTITION BY document_id, article_pos ORDER BY pos ROWS UNBOUNDED PRECEDING) END AS clause_pos FROM v),
x AS (SELECT *, CASE WHEN an THEN 'annex' WHEN art IS NOT NULL THEN 'article' WHEN isc THEN 'clause' WHEN clause_pos IS NOT NULL AND p IS NOT NULL THEN 'point' ELSE 'text' END AS kind FROM w),
y AS (SELECT *, CASE kind WHEN 'annex' THEN CAST(annex_no AS VARCHAR) WHEN 'article' THEN art WHEN 'clause' THEN c WHEN 'point' THEN p END AS number FROM x)"""

SQL = {
    "doc_search_full": """WITH f AS (SELECT DISTINCT id, title, document_number, document_type, issuing_authority, sector, signer_title, source, validity_status, issued_date, effective_date FROM legal_documents
WHERE contains(lower(title), 'phí') AND contains(document_number, '/') AND contains(lower(issuing_authority), 'tỉnh') AND contains(lower(signer_title), 'chủ tịch') AND validity_status = 'Còn hiệu lực'
 AND issued_date BETWEEN DATE '1990-01-01' AND DATE '2024-12-31' AND effective_date BETWEEN DATE '1990-01-01' AND DATE '2025-12-31')
SELECT id, title, issued_date, (SELECT count(*) FROM f) AS total FROM f ORDER BY issued_date DESC NULLS LAST, id LIMIT 20""",
    "doc_haystack": """WITH d AS (SELECT DISTINCT id, title, document_number, document_type, issuing_authority, validity_status, CAST(effective_date AS VARCHAR) AS effective FROM legal_documents)
SELECT id, effective FROM d WHERE contains(lower(concat_ws(' ', title, document_number, document_type, issuing_authority, validity_status)), 'thông tư') ORDER BY coalesce(effective, '') DESC, coalesce(title, '') DESC, id LIMIT 30 OFFSET 30""",
    "doc_by_id": "SELECT DISTINCT document_id, length(content_text) AS n FROM legal_document_contents WHERE document_id = 1000",
    "docs_until": "SELECT DISTINCT id, issued_date FROM legal_documents WHERE document_type = 'Thông tư' AND issued_date <= DATE '2015-12-31'",
    "answered_items": "SELECT DISTINCT qna_id FROM government_qna_items WHERE length(answer_text) > 0",
    "match_reason_audit": "SELECT match_reason AS value, count(*) AS n FROM government_qna_citations WHERE match_reason LIKE 'DOCUMENT\\_NUMBER%' ESCAPE '\\' OR match_reason LIKE '%MULTIPLE%' GROUP BY 1 ORDER BY n DESC, value LIMIT 20",
    "allowed_urls": r"""SELECT DISTINCT id, coalesce(regexp_matches(source_url, '^(?i)https?://([^/?#]+\.)?(van-ban|cong-bao)\.example([/:?#]|$)'), false) AS allowed,
 nullif(regexp_replace(regexp_extract(regexp_replace(regexp_extract(source_url, '^[a-z]+://[^/?#]+([^?#]*)', 1), '/+$', ''), '([^/]*)$', 1), '--\d+.*$', ''), '') AS slug FROM legal_documents""",
    "version_metadata": """WITH d AS (SELECT DISTINCT id, updated_at, validity_status, effective_date, issued_date FROM legal_documents),
v AS (SELECT *, lag(validity_status) OVER w AS p, row_number() OVER w AS nth FROM d WINDOW w AS (PARTITION BY id ORDER BY updated_at)),
k AS (SELECT id, max(updated_at) AS version FROM v WHERE nth = 1 OR coalesce(p, '') <> coalesce(validity_status, '') GROUP BY id),
h AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY updated_at DESC NULLS LAST) AS nth FROM legal_documents) WHERE nth = 1)
SELECT k.id, version, coalesce(effective_date, issued_date) AS day FROM k JOIN h ON h.id = k.id""",
    "doc_versions": """WITH d AS (SELECT DISTINCT id, updated_at, validity_status FROM legal_documents), v AS (SELECT *, lag(validity_status) OVER w AS p, row_number() OVER w AS nth FROM d WINDOW w AS (PARTITION BY id ORDER BY updated_at))
SELECT id, updated_at, lead(updated_at) OVER w IS NULL AS is_current, lead(updated_at) OVER w AS superseded_by FROM v WHERE nth = 1 OR coalesce(p, '') <> coalesce(validity_status, '') WINDOW w AS (PARTITION BY id ORDER BY updated_at)""",
    "related_both_ways": f"WITH {_BOTH} SELECT s.id, side, nth, other, document_number FROM sides s LEFT JOIN heads h ON h.id = other WHERE nth <= 16",
    "related_json": f"WITH {_BOTH} SELECT id, '[' || string_agg(CAST(other AS VARCHAR), ',' ORDER BY nth) || ']' AS related FROM sides WHERE side = 'out' AND nth <= 16 GROUP BY id",
    "related_unpacked": f"WITH {_BOTH} SELECT id, nth - 1 AS at, other FROM sides WHERE side = 'out' AND nth <= 16",
    "relation_totals": f"WITH {_EDGES} SELECT node, sum(o) AS out_degree, sum(i) AS in_degree, sum(o) + sum(i) AS total FROM (SELECT document_id AS node, 1 AS o, 0 AS i FROM e UNION ALL SELECT related_document_id, 0, 1 FROM e) GROUP BY node",
    "items_requeued": "SELECT DISTINCT qna_id, CASE WHEN qna_id IN (SELECT qna_id FROM government_qna_citations WHERE match_status = 'MISSING' AND qna_id IS NOT NULL) THEN 'PENDING' ELSE citation_status END AS citation_status FROM government_qna_items",
    "issue_counts": f"""WITH {_LATEST}, i AS (SELECT document_id, 'empty_content' AS issue FROM bodies WHERE strlen(coalesce(content_text, '')) <= 80
UNION SELECT document_id, 'no_article' FROM bodies WHERE strlen(content_text) >= 2000 AND NOT regexp_matches(content_text, '(?m)^Điều [0-9]+') UNION SELECT id, 'long_title' FROM legal_documents WHERE length(title) > 200)
SELECT issue, count(document_id) AS documents FROM i GROUP BY issue""",
    "title_hint_matches": """WITH k AS (SELECT citation_id, lower(trim(min(document_title))) AS hint FROM government_qna_citations WHERE document_number IS NULL GROUP BY citation_id),
t AS (SELECT DISTINCT id, lower(title) AS t FROM legal_documents UNION SELECT DISTINCT id, lower(document_type) FROM legal_documents),
m AS (SELECT k.citation_id, count(DISTINCT t.id) AS n, min(t.id) AS d FROM k JOIN t ON contains(t.t, k.hint) WHERE length(k.hint) >= 8 GROUP BY k.citation_id)
SELECT k.citation_id, CASE WHEN n = 1 THEN 'MATCHED' WHEN n > 1 THEN 'AMBIGUOUS' ELSE 'UNRESOLVED' END AS status, CASE WHEN n = 1 THEN d END AS matched_id FROM k LEFT JOIN m ON m.citation_id = k.citation_id""",
    "title_shares": r"""WITH w AS (SELECT DISTINCT citation_id, list_distinct(list_filter(string_split(trim(regexp_replace(lower(replace(replace(strip_accents(coalesce(document_title, '')), 'đ', 'd'), 'Đ', 'D')), '[^a-z0-9]+', ' ', 'g')), ' '), lambda x: x <> '')) AS a,
 list_distinct(list_filter(string_split(trim(regexp_replace(lower(replace(replace(strip_accents(matched_document_title), 'đ', 'd'), 'Đ', 'D')), '[^a-z0-9]+', ' ', 'g')), ' '), lambda x: x <> '')) AS b FROM government_qna_citations WHERE matched_document_title IS NOT NULL)
SELECT DISTINCT citation_id, CASE WHEN len(a) > 0 AND len(b) > 0 THEN round(len(list_intersect(a, b)) / len(a), 6) ELSE 0.0 END AS share FROM w""",
    "citation_refs": r"""WITH r AS (SELECT DISTINCT citation_id, list_concat(regexp_extract_all(coalesce(article_refs, ''), '(?i)(?:^|[^\p{L}\p{N}_])điều\s+(\d+[a-z]?)', 1), regexp_extract_all(coalesce(raw_text, ''), '(?i)(?:^|[^\p{L}\p{N}_])điều\s+(\d+[a-z]?)', 1)) AS l FROM government_qna_citations),
u AS (SELECT citation_id, l, unnest(l) AS v, unnest(range(len(l))) AS i FROM r), d AS (SELECT citation_id, l, lower(v) AS v, min(i) AS i FROM u GROUP BY citation_id, l, lower(v)), j AS (SELECT citation_id, l, string_agg(v, ', ' ORDER BY i) AS articles FROM d GROUP BY citation_id, l)
SELECT DISTINCT r.citation_id, coalesce(j.articles, '') AS articles FROM r LEFT JOIN j ON j.citation_id = r.citation_id AND j.l = r.l""",
    "legal_units": f"""WITH {_UNITS}, o AS (SELECT *, row_number() OVER (PARTITION BY document_id, kind, CASE WHEN kind IN ('clause', 'point') THEN article_pos END, CASE WHEN kind = 'point' THEN clause_pos END, number ORDER BY pos) AS nth FROM y WHERE kind <> 'text'),
z AS (SELECT *, kind || '-' || lower(number) || CASE WHEN kind <> 'annex' AND nth > 1 THEN '.occurrence-' || nth ELSE '' END AS own FROM o),
n2 AS (SELECT *, max(CASE WHEN kind = 'article' THEN own END) OVER (PARTITION BY document_id, article_pos) AS oa, max(CASE WHEN kind = 'clause' THEN own END) OVER (PARTITION BY document_id, article_pos, clause_pos) AS oc FROM z)
SELECT document_id, pos, kind, CASE kind WHEN 'clause' THEN concat_ws('.', oa, own) WHEN 'point' THEN concat_ws('.', oa, oc, own) ELSE own END AS anchor FROM n2""",
    "clause_texts": f"WITH {_UNITS} SELECT document_id, clause_pos AS pos, arg_min(number, pos) AS number, count(*) AS blocks, sum(length(block)) + count(*) - 1 AS n FROM y WHERE clause_pos IS NOT NULL GROUP BY document_id, clause_pos",
    "unit_profile": f"""WITH {_UNITS}, k AS (SELECT document_id, count(*) AS n FROM y WHERE kind = 'article' GROUP BY document_id)
SELECT min(n) AS fewest, median(n) AS median, round(avg(n), 2) AS mean, max(n) AS most, sum(CASE WHEN n IS NULL THEN 1 ELSE 0 END) AS without FROM bodies LEFT JOIN k ON k.document_id = bodies.document_id""",
    "chunks_replaced": f"""WITH {_UNITS}, k AS (SELECT document_id, article_pos, sum(length(block)) + count(*) - 1 AS n FROM y WHERE article_pos IS NOT NULL GROUP BY document_id, article_pos)
SELECT document_id, count(*) AS chunks, sum(CASE WHEN document_id IN (SELECT id FROM legal_documents WHERE updated_at >= TIMESTAMP '2025-01-01' AND id IS NOT NULL) THEN n ELSE 0 END) AS n FROM k GROUP BY document_id""",
    "doc_headers": "SELECT DISTINCT id, updated_at, concat_ws(chr(10), " + ", ".join(f"CASE WHEN CAST({v} AS VARCHAR) <> '' THEN '{k}: ' || CAST({v} AS VARCHAR) END" for k, v in HEADER.items()) + ") AS header FROM legal_documents",
    "html_or_text": "SELECT DISTINCT document_id, length(coalesce(nullif(content_html, ''), nullif(content_text, ''), '')) AS html_length, length(coalesce(nullif(content_text, ''), nullif(content_html, ''), '')) AS text_length FROM legal_document_contents",
    "page_blocks": f"WITH {_BLOCKS} SELECT document_id, pos, 'p' AS tag, text, NULL AS caption FROM b",
    "page_titles": rf"WITH {_BLOCKS} SELECT h.document_id, arg_min(text, pos) AS title FROM h LEFT JOIN b ON b.document_id = h.document_id AND regexp_matches(text, '(?i)^(luật|bộ luật|nghị định|nghị quyết|quyết định|thông tư|pháp lệnh)([^\p{{L}}\p{{N}}_]|$)') GROUP BY h.document_id",
    "paragraphs": rf"""WITH {_LATEST}, l AS (SELECT document_id, list_filter(list_transform(string_split(content_text, chr(10)), lambda x: trim(regexp_replace(x, '[ \t\r\f\x0B]+', ' ', 'g'))), lambda x: x <> '') AS lines FROM bodies WHERE content_text IS NOT NULL)
SELECT document_id, md5(CASE WHEN len(lines) = 0 THEN '<p></p>' ELSE array_to_string(list_transform(lines, lambda x: '<p>' || replace(replace(replace(replace(replace(x, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#39;') || '</p>'), '') END) AS html_md5 FROM l""",
    "item_times": "SELECT DISTINCT qna_id, TRY_CAST(updated_at AS TIMESTAMP) AS at, TRY_CAST(regexp_extract(source_url, '([^/]*)$', 1) AS INTEGER) AS number FROM government_qna_items",
    "bad_documents_csv": f"""WITH {_LATEST}, h AS (SELECT id, title FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY updated_at DESC NULLS LAST) AS nth FROM legal_documents) WHERE nth = 1),
j AS (SELECT h.id, length(coalesce(h.title, '')) AS t, length(coalesce(b.content_text, '')) AS n FROM h LEFT JOIN bodies b ON b.document_id = h.id)
SELECT CAST(id AS VARCHAR) AS id, CASE WHEN t < 5 THEN 'short_title' ELSE 'short_text' END AS reason FROM j WHERE n < 80 OR t < 5""",
    "seed_list": r"SELECT DISTINCT trim(source_url) AS url, coalesce(nullif(regexp_extract(source_url, '(?i)[?&](?:itemid|docid|document_id)=(\d+)', 1), ''), nullif(regexp_extract(source_url, '--(\d+)(?:$|[/?#])', 1), '')) AS external_id FROM legal_documents WHERE source_url IS NOT NULL AND trim(source_url) <> '' AND NOT starts_with(trim(source_url), '#')",
    "quality_report": "SELECT count(*) AS rows, count(DISTINCT id) AS documents, count(*) - count(title) AS without_title, sum(CASE WHEN length(title) > 200 THEN 1 ELSE 0 END) AS long_titles FROM legal_documents",
    "normalised_documents": "SELECT issued_date, count(*) AS n, 0 AS pages, min(id) AS first_id FROM (SELECT DISTINCT * FROM legal_documents) GROUP BY issued_date",
    "audit_lines": "SELECT DISTINCT citation_id, match_status, document_number FROM government_qna_citations",
    "cascade_deleted": """WITH b AS (SELECT id, max(created_at) AS c FROM legal_documents GROUP BY id), g AS (SELECT d.document_id AS id FROM (SELECT document_id, max(deleted_at) AS t FROM legal_document_deletions GROUP BY document_id) d LEFT JOIN b ON b.id = d.document_id WHERE (b.c IS NULL OR d.t > b.c) AND d.document_id IS NOT NULL)
SELECT 'legal_documents' AS name, count(*) AS n FROM legal_documents WHERE id IS NULL OR id NOT IN (SELECT id FROM g) UNION ALL SELECT 'legal_document_contents', count(*) FROM legal_document_contents WHERE document_id IS NULL OR document_id NOT IN (SELECT id FROM g)
UNION ALL SELECT 'legal_document_relationships', count(*) FROM legal_document_relationships WHERE (document_id IS NULL OR document_id NOT IN (SELECT id FROM g)) AND (related_document_id IS NULL OR related_document_id NOT IN (SELECT id FROM g))""",
    "items_replaced": """SELECT i.qna_id, i.updated_at, count(DISTINCT k.citation_id) AS citations FROM (SELECT qna_id, max(updated_at) AS updated_at FROM government_qna_items GROUP BY qna_id) i LEFT JOIN government_qna_citations k ON k.qna_id = i.qna_id GROUP BY i.qna_id, i.updated_at""",
    "scanned_sources": f"WITH {_LATEST} SELECT coalesce(contains(lower(content_text), 'file pdf'), false) AS review, count(*) AS documents FROM bodies GROUP BY 1",
    "dead_letter_records": """SELECT event_id, ts AS failed_at, 'events' AS source, '{"event_id":' || event_id || coalesce(',"event_type":"' || event_type || '"', '') || '}' AS body FROM events WHERE event_type IS NULL OR event_type NOT IN ('view', 'click', 'purchase')""",
    "readiness_summary": "WITH r AS (SELECT DISTINCT citation_id, coalesce(match_status, 'UNKNOWN') AS status FROM government_qna_citations) SELECT status, count(*) AS n, round(count(*) / (SELECT count(*) FROM r), 6) AS share FROM r GROUP BY status",
}
