"""Records against plain Python, where SQL cannot say it."""

import html
import re
import uuid
from collections import defaultdict

import pytest

from quillspark.functions import columns as c
from quillspark.operators import relational
from quillspark.plans import records
from pyspark.sql import functions as F


def test_ids_made_from_names(spark, small):
    rows = records.chunk_ids(spark, small).collect()
    assert rows and all(r.point_id == str(uuid.uuid5(uuid.NAMESPACE_URL, r.chunk_id)) and r.place == int(r.chunk_id.split(":")[1]) for r in rows)


def test_complete_answers(spark):
    texts = {"Nộp hồ sơ tại trụ sở cơ quan.": True, "Ngắn.": False, "Nộp hồ sơ tại trụ sở cơ quan": False, "Nộp hồ sơ tại trụ sở cơ quan...": False, "Nộp hồ sơ tại trụ sở gồm:": False, "Nộp hồ sơ tại trụ sở cơ quan\nhoặc": False, "Theo quy định hiện hành (nguồn)": True, "Nộp hồ sơ tại trụ sở cơ quan.\n**Tự kiểm tra**: đủ": True, None: False}
    df = spark.createDataFrame([(k,) for k in texts], "a string")
    got = {r.a: r.x for r in df.select("a", c.looks_complete(c.without_self_check(F.col("a"))).alias("x")).collect()}
    assert got == {k: v for k, v in texts.items()}


def test_pages_are_cut_where_a_body_answers(spark):
    df = spark.createDataFrame([("Tôi hỏi?  Bộ Tài chính trả lời như sau: Có.",), ("Tôi hỏi?",), (None,), ("Sở X trả lời: A",)], "p string")
    q, a = c.question_and_answer(F.col("p"))
    assert [(r.q, r.a) for r in df.select(q.alias("q"), a.alias("a")).collect()] == [("Tôi hỏi?", "Bộ Tài chính trả lời như sau: Có."), ("Tôi hỏi?", None), (None, None), (None, "Sở X trả lời: A")]


def test_cited_phrases(spark, small):
    rows = spark.createDataFrame([(" Luật &#272;&#7845;t &amp; đai;.",), (None,), (",.;",), ("a  b",)], "t string")
    assert [r[0] for r in rows.select(c.citation_text(F.col("t"))).collect()] == ["Luật Đất & đai", "", "", "a b"]
    raw = {r.citation_id: r.raw_text for r in spark.read.parquet(f"{small}/government_qna_citations.parquet").collect()}
    for r in records.cleaned_citations(spark, small).collect():
        assert r.cited == re.sub(r"^[ ,.;:]+|[ ,.;:]+$", "", " ".join(html.unescape(raw[r.citation_id] or "").replace("\xa0", " ").split()))


def test_hints_meet_titles_by_their_rarest_signs(spark):
    docs = [(1, "Luật Đất đai", "Luật"), (2, "Luật Đất đai", "Luật"), (3, "Bộ luật Dân sự", None), (4, None, "Thông tư liên tịch"), (3, "Bộ luật Dân sự", "x")]
    asked = [(10, "ĐẤT ĐAI"), (11, "luật dân"), (12, "thông tư liên"), (13, "ab"), (14, None), (15, "không có"), (16, "luật")]
    got = {r.k: (r.status, r.matched_id) for r in relational.title_hints(spark.createDataFrame(asked, "k long, h string"), spark.createDataFrame(docs, "id long, t string, kind string"), citation_key="k", hint="h", document_id="id", columns=["t", "kind"]).collect()}
    assert got == {10: ("AMBIGUOUS", None), 11: ("MATCHED", 3), 12: ("MATCHED", 4), 13: ("UNRESOLVED", None), 14: ("UNRESOLVED", None), 15: ("UNRESOLVED", None), 16: ("AMBIGUOUS", None)}


@pytest.fixture
def laws(spark, tmp_path):
    save = lambda name, rows, schema: spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    texts = [(1, "Điều 1. Biển\n1. Tàu cá neo đậu\n2. Bến\nĐiều 2. Rừng\nTrồng rừng ngập mặn"), (2, "Điều 1. Đê\nĐắp đê sông và đê biển"), (3, None)]
    save("legal_document_contents", texts, "document_id long, content_text string")
    cites = [(20, "trồng rừng ngập mặn", 1, "Điều 2", None), (40, "tàu cá neo đậu", 1, "Điều 2", None), (60, "đắp đê", 2, None, None), (80, "tàu cá", 1, "Điều 1", "khoản 2"), (100, "đê", 9, None, None), (5, "đê", 2, None, None)]
    save("government_qna_citations", cites, "citation_id long, raw_text string, matched_document_id long, article_refs string, clause_refs string")
    return str(tmp_path)


def test_evaluation_by_article(spark, laws):
    r = records.article_eval(spark, laws).first()
    # of five asked: 20 finds its article first, 40 only the document, 60 and 80 theirs, 100 names a document without text
    assert (r.n, r.recall, r.hit, r.cited_recall, r.cited_hit) == (5, 0.8, 0.8, 0.6, 0.6)
    assert r.mrr == 0.8 and r.cited_mrr == 0.6


def test_best_of_an_article(spark, small):
    rows = records.best_per_article(spark, small).collect()
    per = defaultdict(int)
    for r in rows:
        per[r.citation_id, r.document_id, r.article] += 1
    assert rows and set(per.values()) == {1}


def test_named_clauses(spark, laws):
    assert {(r.citation_id, r.chunk_id, r.clause) for r in records.named_clauses(spark, laws).collect()} == {(80, "1:1", "2"), (80, "1:4", "2")}


def test_entities(spark):
    df = spark.createDataFrame([("<p>&#7841; &agrave;&nbsp;b &lt;i&gt;</p><script>x</script>c",), (None,)], "h string")
    assert [r[0] for r in df.select(c.html_text(F.col("h"))).collect()] == ["ạ à b <i>\nc", ""]
