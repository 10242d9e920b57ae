"""The queries of the numbered problems over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import table
from . import boundaries, citations, containers, mixture, near_copies, pairs, scans, unify


def _scans(spark: SparkSession, folder: str) -> scans.Scans:
    return scans.Scans(table(spark, folder, "legal_document_contents"), "document_id", "content_text")


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return _scans(spark, folder).noise()


def p1_repaired(spark: SparkSession, folder: str) -> DataFrame:
    return _scans(spark, folder).repaired()


def p2_plain(spark: SparkSession, folder: str) -> DataFrame:
    """The three fields of problem 2 with their plain form."""
    docs, cites = table(spark, folder, "legal_documents"), table(spark, folder, "government_qna_citations")
    fields = [("legal_documents", docs, "id", "document_number"), ("legal_documents", docs, "id", "title"), ("government_qna_citations", cites, "citation_id", "document_number")]
    values = None
    for name, df, key, column in fields:
        part = df.select(F.lit(name).alias("in_table"), F.col(key).alias("row_id"), F.lit(column).alias("in_column"), F.col(column).alias("value"))
        values = part if values is None else values.unionByName(part)
    return unify.plain_forms(values, ["in_table", "row_id", "in_column"], "value")


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return p2_plain(spark, folder).where(F.col("plain_form") != F.col("value")).select("in_table", "row_id", "in_column").distinct()


def _copies(spark: SparkSession, folder: str) -> near_copies.NearCopies:
    texts = table(spark, folder, "legal_document_contents").select("document_id", "content_text")
    heads = table(spark, folder, "legal_documents").select(F.col("id").alias("document_id"), "title")
    return near_copies.near_copies(texts, heads, key="document_id", text="content_text", words=3, similarity=0.7, least_words=50)


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return _copies(spark, folder).pairs().distinct()


def p3_groups(spark: SparkSession, folder: str) -> DataFrame:
    return _copies(spark, folder).groups()


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    code = F.lower(F.trim("lang"))
    labelled = table(spark, folder, "documents").select("text", F.when(code.isin("vi", "vie"), "vi").when(code == "en", "en").alias("lang"))
    items = table(spark, folder, "government_qna_items")
    model = pairs.train_languages(labelled, items.select(F.explode(F.array("question_text", "answer_text")).alias("text")))
    return pairs.defects(items, model, key="qna_id", question="question_text", answer="answer_text", version="updated_at")


def p5_matches(spark: SparkSession, folder: str) -> DataFrame:
    return citations.match_citations(table(spark, folder, "government_qna_citations"), table(spark, folder, "legal_documents"))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return p5_matches(spark, folder).select("citation_id", "document_id")


def _limit(spark: SparkSession, folder: str, purpose: str) -> tuple[int, int]:
    row = table(spark, folder, "token_limits").where(F.col("purpose") == purpose).agg(F.max("max_tokens"), F.max("overlap_tokens")).first()
    return int(row[0]), int(row[1] or 0)


def p7_containers(spark: SparkSession, folder: str) -> DataFrame:
    return containers.pack(table(spark, folder, "documents"), _limit(spark, folder, "container")[0])


def p7_fill(spark: SparkSession, folder: str) -> DataFrame:
    return containers.fill_report(p7_containers(spark, folder), _limit(spark, folder, "container")[0])


def _mixed(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    docs = table(spark, folder, "documents")
    described = [F.col(c) for c in ("document_type", "document_number", "issuing_authority", "published_date", "lang")]
    return mixture.mix(docs, table(spark, folder, "mix_targets"), source=mixture.clean_source(F.col("source"), F.col("lang")), weight=mixture.quality_weight(F.octet_length("text"), described))


def p8_mixture(spark: SparkSession, folder: str) -> DataFrame:
    return _mixed(spark, folder)[0]


def p8_shares(spark: SparkSession, folder: str) -> DataFrame:
    return _mixed(spark, folder)[1]


def p9_pieces(spark: SparkSession, folder: str) -> DataFrame:
    return boundaries.split_oversized(table(spark, folder, "documents"), *_limit(spark, folder, "piece"))


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    return p9_pieces(spark, folder).select("doc_id").distinct()


QUERIES = {
    "p1_found": p1_found,
    "p1_repaired": p1_repaired,
    "p2_found": p2_found,
    "p2_plain": p2_plain,
    "p3_found": p3_found,
    "p3_groups": p3_groups,
    "p4_found": p4_found,
    "p5_found": p5_found,
    "p5_matches": p5_matches,
    "p7_containers": p7_containers,
    "p7_fill": p7_fill,
    "p8_mixture": p8_mixture,
    "p8_shares": p8_shares,
    "p9_found": p9_found,
    "p9_pieces": p9_pieces,
}

SQL = {
    "p9_found": "SELECT DISTINCT doc_id FROM documents, (SELECT max(max_tokens) AS m FROM token_limits WHERE purpose = 'piece') WHERE strlen(text) > m",
}
