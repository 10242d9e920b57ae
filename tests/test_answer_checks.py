"""Answers are checked against the documents they cite, not against the question."""

import datetime as dt

import pytest

from quillspark.operators import citations
from quillspark.plans import texts

T = [dt.datetime(2024, 1, 1), dt.datetime(2025, 1, 1)]


@pytest.fixture
def folder(spark, tmp_path):
    def save(name, rows, schema):
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")

    good = "Theo Điều 35 khoản 2 văn bản 45/2019/QH14, người lao động có quyền nghỉ ngay [2]."
    items = [(1, "Hỏi?", good, "2025"), (1, "Zz?", "Zz Điều 7 [9].", "2024"), (2, "Hỏi?", "Điều 999 nêu tại 1/2020/NĐ-CP [1] và [3].", "2025"), (3, "Hỏi?", "Người lao động có quyền nghỉ ngay.", "2025"), (4, "Hỏi?", None, "2025")]
    save("government_qna_items", items, "qna_id long, question_text string, answer_text string, updated_at string")
    save("government_qna_citations", [(1, 10), (1, 11), (1, 11), (2, 10), (3, None)], "qna_id long, matched_document_id long")
    docs = [(10, "Bộ luật Lao động", "Bộ luật", "45/2019/QH14", T[0]), (11, "Nghị định về lao động", "Nghị định", "12/2020/NĐ-CP", T[0])]
    save("legal_documents", docs, "id long, title string, document_type string, document_number string, updated_at timestamp")
    contents = [(10, "Điều 35. Quyền\nkhoản 2 điểm a", T[1]), (10, "Điều 999", T[0]), (11, "Điều 1", T[1])]
    save("legal_document_contents", contents, "document_id long, content_text string, updated_at timestamp")
    return str(tmp_path)


def test_true_references_are_no_errors(spark, folder):
    got = {r.qna_id: r.errors for r in texts.answer_checks(spark, folder).collect()}
    assert got == {1: "", 2: "source:3; number:1/2020/NĐ-CP; article:999", 3: "claim:Người lao động có quyền nghỉ ngay.", 4: ""}


def test_claims_and_names():
    assert citations.uncited_claims("Thời hạn:\nThời hạn là 5 ngày [1]. Không đủ căn cứ để quy định. Phải nộp lệ phí!") == ["Phải nộp lệ phí!"]
    none = {"articles": set(), "clauses": set(), "points": set()}
    assert citations.errors_of("Xem Luật Đất đai 2013 [1].", 1, [("Luật Nhà ở", "Luật", "65/2014/QH13")], none) == ["name:Luật Đất đai 2013"]
    assert citations.errors_of("Xem Luật Đất đai 2013 [1].", 1, [("Luật Đất đai", "Luật", "45/2013/QH13")], none) == []
