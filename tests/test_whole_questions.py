"""Searches over articles ask all questions, not a share of them."""

import math
import re
from collections import Counter

import pytest

from quillspark.operators import retrieval
from quillspark.plans import records


@pytest.fixture
def asked(spark, tmp_path):
    """Citations whose ids a share by remainder would leave out."""
    save = lambda name, rows, schema: spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    save("legal_document_contents", [(1, "Điều 1. Biển\nTàu cá neo đậu\nĐiều 2. Rừng\nTrồng rừng ngập mặn"), (2, "Điều 1. Đê\nĐắp đê sông")], "document_id long, content_text string")
    cites = [(1, "trồng rừng", 1, "Điều 2", None), (7, "đắp đê", 2, None, None), (19, "tàu cá", 2, None, None), (20, "neo đậu", 1, "Điều 1", None), (23, "đê", None, None, None)]
    save("government_qna_citations", cites, "citation_id long, raw_text string, matched_document_id long, article_refs string, clause_refs string")
    return str(tmp_path)


def test_evaluation_of_all_citations(spark, asked):
    r = records.article_eval(spark, asked).first()
    # all that have a document: 1, 7 and 20 find it first, 19 is met in another one only
    assert (r.n, r.recall, r.mrr, r.cited_recall, r.cited_mrr) == (4, 0.75, 0.75, 0.75, 0.75)


WORDS = "đất nhà rừng biển đê sông cầu đường phí thuế".split()
TEXTS = {f"{i}:{i % 3}": " ".join(WORDS[(i * j) % 10] for j in range(1, 3 + i % 7)) + (f" {i}/nđ" if i % 4 == 0 else "") for i in range(400)}
QUESTIONS = {i: " ".join(WORDS[(i + j * j) % 10] for j in range(1, 2 + i % 5)) + (f" {4 * i}/nđ" if i % 3 else "") for i in range(60)} | {60: "không có", 61: None, 62: "đất " * 400 + "nhà", 63: " ".join(f"{4 * i}/nđ" for i in range(60))}


def brute(k):
    bags = {d: Counter(re.findall(retrieval.TOKEN, t.lower())) for d, t in TEXTS.items()}
    n, mean, df = len(bags), sum(sum(b.values()) for b in bags.values()) / len(bags), Counter(t for b in bags.values() for t in b)
    out = {}
    for q, text in QUESTIONS.items():
        scores = {}
        for d, b in bags.items():
            length = sum(b.values())
            scores[d] = round(sum(c * math.log1p((n - df[t] + 0.5) / (df[t] + 0.5)) * b[t] * 2.5 / (b[t] + 1.5 * (0.25 + 0.75 * length / mean)) for t, c in Counter(re.findall(retrieval.TOKEN, (text or "").lower())).items() if t in b), 5)
        out[q] = sorted(((s, d) for d, s in scores.items() if s > 0), key=lambda x: (-x[0], x[1]))[:k]
    return out


@pytest.fixture(params=[(10_000, 4096, 512), (50, 7, 512), (50, 1, 3)], ids=["one", "shared", "few columns"])
def index(spark, request, monkeypatch):
    """In one part for all questions, and in small parts and lots of questions."""
    for name, value in zip(("PART", "OWN", "COLUMNS"), request.param):
        monkeypatch.setattr(retrieval, name, value)
    monkeypatch.setattr(retrieval, "DENSE", 8)
    docs = spark.createDataFrame([(d, int(d.split(":")[0]) // 5, t) for d, t in TEXTS.items()], "d string, g long, t string").repartition(3)
    questions = spark.createDataFrame(list(QUESTIONS.items()), "q long, t string")
    return retrieval.asked_index(retrieval.postings(docs, "d", {"t": 1.0}, ("g",)), questions, "d", "q", "t")


def test_first_of_all_questions(spark, index):
    got = {}
    for r in retrieval.bm25_best(index, 9).orderBy("q", "rank").collect():
        got.setdefault(r.q, []).append(r.score)
    assert got == {q: [pytest.approx(s, abs=2e-5) for s, _ in hits] for q, hits in brute(9).items() if hits}


def test_ranks_of_wanted_groups(spark, index):
    ranked = {(r.q, r.d): (r["rank"], r.score) for r in retrieval.bm25_best(index, 9).collect()}
    wanted = {q: (q * 7) % 80 for q in QUESTIONS}
    got = {(r.q, r.d): (r["rank"], r.score) for r in retrieval.bm25_ranks(index, spark.createDataFrame(list(wanted.items()), "q long, g long"), "g", 9).collect()}
    assert got == {(q, d): x for (q, d), x in ranked.items() if int(d.split(":")[0]) // 5 == wanted[q]} and got


def test_best_of_all_citations(spark, asked):
    rows = {(r.citation_id, r.document_id, r.article) for r in records.best_per_article(spark, asked).collect()}
    assert rows == {(1, 1, "2"), (7, 2, "1"), (19, 1, "1"), (20, 1, "1"), (23, 2, "1")}
