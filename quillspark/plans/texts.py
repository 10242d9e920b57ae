"""Queries: cleaning, dates, references, rules, chunks, citations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import columns as c
from ..functions.text import fold_accents, name_words, normalize_space
from ..operators import chunks, citations, relational
from ..sources.tables import latest_texts, table

# Labels and their codes, rules and their words.
VALIDITY = {"còn hiệu lực": "in_force", "hết hiệu lực toàn bộ": "expired", "hết hiệu lực một phần": "partly_expired", "chưa có hiệu lực": "not_yet", "ngưng hiệu lực": "suspended", "chưa xác định": "unknown"}
TOPICS = [("penalty", ["xử lý ra sao", "phạt"]), ("fee", ["bao nhiêu", "mức hiện nay", "fee"]), ("exemption", ["được miễn"]), ("procedure", ["giấy tờ", "thủ tục", "thực hiện thế nào", "renew"]), ("competence", ["thẩm quyền", "approves"]), ("contact", ["liên hệ"])]
RANKS = [("0", ["hiến pháp"]), ("1", ["luật", "quốc hội"]), ("2", ["pháp lệnh"]), ("3", ["nghị định", "chính phủ"]), ("4", ["thông tư"]), ("5", ["quyết định", "chỉ thị"])]


def validity_codes(spark, folder):
    return table(spark, folder, "legal_documents").select("id", c.code_of(F.col("validity_status"), VALIDITY, "other").alias("code")).distinct()


def question_topics(spark, folder):
    return table(spark, folder, "government_qna_items").select("qna_id", c.by_rules(F.col("question_text"), TOPICS, "other").alias("topic")).distinct()


def authority_ranks(spark, folder):
    text = F.concat_ws(" ", "document_type", "issuing_authority")
    rank = c.by_rules(text, RANKS, "6").cast("int")
    bonus = F.element_at(F.array(*[F.lit(x) for x in (3.0, 2.5, 1.75, 1.25, 0.75, 0.25, -0.5)]), rank + 1)
    ended = F.when(F.col("validity_status") == "Hết hiệu lực toàn bộ", -4.0).when(F.col("validity_status") == "Hết hiệu lực một phần", -0.25).otherwise(0.0)
    return table(spark, folder, "legal_documents").select("id", rank.alias("rank"), (bonus + ended).alias("bonus")).distinct()


def published_days(spark, folder):
    d = F.col("published_date")
    return table(spark, folder, "government_qna_items").select("qna_id", F.coalesce(c.any_day(d), c.day_in_text(d)).alias("day")).distinct()


def cited_references(spark, folder):
    t = F.col("raw_text")
    return table(spark, folder, "government_qna_citations").select("citation_id", *[F.array_join(c.references(t, k), ", ").alias(f"{k}s") for k in ("article", "clause", "point")]).distinct()


def reference_boosts(spark, folder):
    cites = table(spark, folder, "government_qna_citations").select("citation_id", "raw_text", F.col("matched_document_id").alias("id")).distinct()
    docs = table(spark, folder, "legal_documents").groupBy("id").agg(F.min("document_number").alias("document_number"))
    texts = latest_texts(spark, folder).select(F.col("document_id").alias("id"), F.col("content_text").alias("text"))
    return cites.join(docs, "id").join(texts, "id", "left").select("citation_id", "id", c.reference_boost(F.col("raw_text"), F.col("document_number"), F.col("text")).alias("boost"))


def title_names(spark, folder):
    return table(spark, folder, "legal_documents").select("id", name_words(F.col("title")).alias("name"), F.length(fold_accents(normalize_space(F.col("title")))).alias("n")).distinct()


def source_urls(spark, folder):
    u = F.col("source_url")
    return table(spark, folder, "legal_documents").select("id", c.url_host(u).alias("host"), c.safe_url(u).alias("is_safe"), c.external_id(u).alias("external_id")).distinct()


def visible_html(spark, folder):
    return table(spark, folder, "legal_document_contents").where("content_html is not null").select("document_id", c.html_text(F.col("content_html")).alias("text")).distinct()


def content_hashes(spark, folder):
    return table(spark, folder, "legal_document_contents").select("document_id", c.content_hash(F.col("content_text")).alias("hash"), F.length(c.lines_text(F.col("content_text"))).alias("n")).distinct()


def line_islands(spark, folder):
    """Paragraphs between blank lines: their number and longest length per document."""
    lines = table(spark, folder, "legal_document_contents").select("document_id", "content_text").distinct().select("document_id", F.posexplode(F.split("content_text", "\n")).alias("pos", "line"))
    blank = F.trim("line") == ""
    marked = relational.runs(lines.withColumn("_b", blank), ["document_id"], [F.col("pos")], F.col("_b"))
    per = marked.where(~F.col("_b")).groupBy("document_id", "run").agg(F.sum(F.length("line")).alias("n"))
    return per.groupBy("document_id").agg(F.count(F.lit(1)).alias("paragraphs"), F.max("n").alias("longest"))


def article_occurrences(spark, folder):
    """Headings of articles with the number of times their number came before, as stable anchors."""
    lines = table(spark, folder, "legal_document_contents").select("document_id", "content_text").distinct().select("document_id", F.posexplode(F.split("content_text", "\n")).alias("pos", "line"))
    heads = lines.select("document_id", "pos", F.regexp_extract("line", r"^Điều ([0-9]+)\.", 1).alias("article")).where("article <> ''")
    nth = F.row_number().over(Window.partitionBy("document_id", "article").orderBy("pos"))
    return heads.select("document_id", "pos", c.anchor("article", F.col("article"), nth).alias("anchor"))


def _texts(spark, folder):
    """The latest text of each document."""
    return latest_texts(spark, folder)


def structural_chunks(spark, folder):
    return chunks.chunk(_texts(spark, folder), "document_id", "content_text")


def window_chunks(spark, folder):
    return chunks.chunk(_texts(spark, folder), "document_id", "content_text", structured=False)


def hydrated_chunks(spark, folder):
    return chunks.hydrate(structural_chunks(spark, folder), "document_id").groupBy("document_id").agg(F.count(F.lit(1)).alias("chunks"), F.sum(F.length("context_text")).alias("context_chars"))


def answer_citations(spark, folder):
    return citations.extract_citations(table(spark, folder, "government_qna_items").select("qna_id", "answer_text").distinct(), "qna_id", "answer_text")


def answer_checks(spark, folder):
    """The latest answer of each item against the documents its citations are matched with."""
    items = relational.latest(table(spark, folder, "government_qna_items").select("qna_id", "answer_text", "updated_at"), ["qna_id"], [F.col("updated_at")])
    cited = table(spark, folder, "government_qna_citations").where("matched_document_id is not null").select("qna_id", F.col("matched_document_id").alias("document_id")).distinct()
    ids = cited.select("document_id").distinct()
    docs = relational.latest(table(spark, folder, "legal_documents").select(F.col("id").alias("document_id"), "title", F.col("document_type").alias("kind"), F.col("document_number").alias("number"), "updated_at"), ["document_id"], [F.col("updated_at")]).drop("updated_at")
    # the references of each text are folded before they meet the answers
    refs = lambda t: [c.references(t, k).alias(f"{k}s") for k in ("article", "clause", "point")]
    texts = table(spark, folder, "legal_document_contents").join(ids, "document_id", "left_semi").select("document_id", "updated_at", *refs(F.col("content_text")))
    texts = relational.latest(texts, ["document_id"], [F.col("updated_at")]).drop("updated_at")
    heads = docs.join(ids, "document_id", "left_semi").withColumns({f"_{k}": c.references(F.concat_ws(" ", "title", "number"), k) for k in ("article", "clause", "point")})
    held = heads.join(texts, "document_id", "full")
    held = held.select("document_id", "title", "kind", "number", *[F.array_union(F.coalesce(f"{k}s", F.array().cast("array<string>")), F.coalesce(f"_{k}", F.array().cast("array<string>"))).alias(f"{k}s") for k in ("article", "clause", "point")])
    return citations.verify_answers(items, cited, held, "qna_id", "answer_text", "document_id")


def citation_readiness(spark, folder):
    t = F.col("raw_text")
    cited = table(spark, folder, "government_qna_citations").where("matched_document_id is not null").select("citation_id", F.col("matched_document_id").alias("document_id"), c.references(t, "article").alias("articles"), c.references(t, "clause").alias("clauses")).distinct()
    return citations.readiness(cited, structural_chunks(spark, folder), "citation_id", "document_id")


def user_context(spark, folder):
    """The last ten events of each user in order, as text of at most 120 signs."""
    e = table(spark, folder, "events")
    last = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id")))
    ten = e.withColumn("_n", last).where("_n <= 10").groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct((-F.col("_n")).alias("o"), F.substring("event_type", 1, 20).alias("t")))).alias("l"))  # ten rows each
    return ten.select("user_id", F.right(F.array_join("l.t", " > "), F.lit(120)).alias("context"))


QUERIES = {f.__name__: f for f in (validity_codes, question_topics, authority_ranks, published_days, cited_references, reference_boosts, title_names, source_urls, visible_html, content_hashes, line_islands, article_occurrences, structural_chunks, window_chunks, hydrated_chunks, answer_citations, answer_checks, citation_readiness, user_context)}

_case = lambda text, rules, default: "CASE " + " ".join(f"WHEN {' OR '.join(f'contains({text}, {chr(39)}{w}{chr(39)})' for w in words)} THEN '{label}'" for label, words in rules) + f" ELSE '{default}' END"
_RANK = _case("lower(concat_ws(' ', document_type, issuing_authority))", RANKS, "6")

SQL = {
    "validity_codes": "SELECT DISTINCT id, coalesce(CASE lower(trim(regexp_replace(validity_status, '\\s+', ' ', 'g'))) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in VALIDITY.items()) + " END, 'other') AS code FROM legal_documents",
    "question_topics": f"SELECT DISTINCT qna_id, {_case('lower(coalesce(question_text, ' + chr(39) * 2 + '))', TOPICS, 'other')} AS topic FROM government_qna_items",
    "authority_ranks": f"""SELECT DISTINCT id, CAST(rank AS INTEGER) AS rank, ([3.0, 2.5, 1.75, 1.25, 0.75, 0.25, -0.5])[CAST(rank AS INTEGER) + 1]
 + CASE WHEN validity_status = 'Hết hiệu lực toàn bộ' THEN -4.0 WHEN validity_status = 'Hết hiệu lực một phần' THEN -0.25 ELSE 0.0 END AS bonus FROM (SELECT *, {_RANK} AS rank FROM legal_documents)""",
    "published_days": r"""SELECT DISTINCT qna_id, coalesce(
 CASE WHEN regexp_matches(trim(published_date), '^\d{4}-\d{2}-\d{2}') THEN try_strptime(substr(trim(published_date), 1, 10), '%Y-%m-%d')::DATE END,
 CASE WHEN regexp_matches(trim(published_date), '^\d{2}/\d{2}/\d{4}$') THEN try_strptime(trim(published_date), '%d/%m/%Y')::DATE END,
 CASE WHEN regexp_matches(trim(published_date), '^\d{1,6}$') THEN DATE '1970-01-01' + CAST(trim(published_date) AS INTEGER) END,
 try_strptime(replace(nullif(regexp_extract(published_date, '(\d{1,2}[/-]\d{1,2}[/-]\d{4})', 1), ''), '-', '/'), '%d/%m/%Y')::DATE) AS day FROM government_qna_items""",
    "source_urls": r"""SELECT DISTINCT id, nullif(lower(regexp_extract(source_url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1)), '') AS host,
 coalesce(regexp_matches(source_url, '^(?i)https?://[^/?#]+'), false) AS is_safe,
 coalesce(nullif(regexp_extract(source_url, '(?i)[?&](?:itemid|docid|document_id)=(\d+)', 1), ''), nullif(regexp_extract(source_url, '--(\d+)(?:$|[/?#])', 1), '')) AS external_id FROM legal_documents""",
    "title_names": r"""SELECT DISTINCT id, trim(regexp_replace(lower(replace(replace(strip_accents(title), 'đ', 'd'), 'Đ', 'D')), '[^a-z0-9]+', ' ', 'g')) AS name,
 length(strip_accents(trim(regexp_replace(title, '[\s\x0B\x{0085}\p{Z}]+', ' ', 'g')))) AS n FROM legal_documents""",
    "content_hashes": r"""SELECT DISTINCT document_id, sha256(coalesce(content_text, '')) AS hash, CASE WHEN content_text IS NOT NULL THEN length(array_to_string(list_filter(list_transform(string_split(content_text, chr(10)), lambda x: trim(regexp_replace(x, '[ \t\r\f\x0B]+', ' ', 'g'))), lambda x: x <> ''), chr(10))) END AS n FROM legal_document_contents""",
    "line_islands": r"""WITH t AS (SELECT DISTINCT document_id, content_text FROM legal_document_contents), l AS (SELECT document_id, unnest(string_split(content_text, chr(10))) AS line, unnest(range(len(string_split(content_text, chr(10))))) AS pos FROM t WHERE content_text IS NOT NULL),
r AS (SELECT *, trim(line) = '' AS b, sum(CASE WHEN trim(line) = '' THEN 1 ELSE 0 END) OVER (PARTITION BY document_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS run FROM l),
p AS (SELECT document_id, run, sum(length(line)) AS n FROM r WHERE NOT b GROUP BY document_id, run)
SELECT document_id, count(*) AS paragraphs, max(n) AS longest FROM p GROUP BY document_id""",
    "article_occurrences": r"""WITH t AS (SELECT DISTINCT document_id, content_text FROM legal_document_contents), l AS (SELECT document_id, unnest(string_split(content_text, chr(10))) AS line, unnest(range(len(string_split(content_text, chr(10))))) AS pos FROM t WHERE content_text IS NOT NULL),
h AS (SELECT document_id, pos, regexp_extract(line, '^Điều ([0-9]+)\.', 1) AS article FROM l), n AS (SELECT *, row_number() OVER (PARTITION BY document_id, article ORDER BY pos) AS nth FROM h WHERE article <> '')
SELECT document_id, pos, 'article-' || article || CASE WHEN nth > 1 THEN '.occurrence-' || nth ELSE '' END AS anchor FROM n""",
    "user_context": """WITH n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events)
SELECT user_id, right(string_agg(substr(event_type, 1, 20), ' > ' ORDER BY n DESC), 120) AS context FROM n WHERE n <= 10 GROUP BY user_id""",
}
