"""What a search writes grows with the questions and the texts, not with their pairs."""

import datetime as dt

import pytest

from pyspark.sql import functions as F

from quillspark.functions.columns import reference_boost
from quillspark.operators import relational
from quillspark.operators.retrieval import named_boosts
from quillspark.plans import records, retrieval

DOCS, QUESTIONS = 1500, 150


@pytest.fixture(scope="module")
def alike(spark, tmp_path_factory):
    """Documents that all share words with all questions."""
    folder = str(tmp_path_factory.mktemp("alike"))
    save = lambda name, rows, schema: spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")
    day = dt.datetime(2024, 1, 1)
    body = "\n".join(f"Điều {a}. cấp giấy phép xây dựng" for a in (1, 2))
    save("legal_documents", [(i, f"Luật {i}", f"{i}/2020/QH14") for i in range(DOCS)], "id long, title string, document_number string")
    save("legal_document_contents", [(i, f"{body} số {i % 97}", day) for i in range(DOCS)], "document_id long, content_text string, updated_at timestamp")
    asked = [(20 * i, "Điều 2 giấy phép xây dựng" + ("" if i % 10 else f" số {i % 97} {i}/2020/QH14"), i, "Điều 2", None) for i in range(QUESTIONS)]
    save("government_qna_citations", asked, "citation_id long, raw_text string, matched_document_id long, article_refs string, clause_refs string")
    return folder


def written(spark) -> int:
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    executors = spark.sparkContext._jsc.sc().statusStore().executorList(False)
    return sum(executors.apply(i).totalShuffleWrite() for i in range(executors.size()))


@pytest.mark.parametrize("query", [records.article_eval, records.best_per_article, retrieval.bm25_topk, retrieval.hybrid_fusion, retrieval.hybrid_boosted], ids=lambda f: f.__name__)
def test_shuffle_without_pairs(spark, alike, query):
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # else small tables are put into one partition and not shuffled at all
    try:
        before = written(spark)
        assert query(spark, alike).count()
        assert written(spark) - before < 1 << 20
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_boosts_of_a_document_in_one_reading(spark):
    """Against the boost of each pair."""
    questions = spark.createDataFrame([(1, "Điều 2 khoản 1 điểm a Nghị định 12/2020/NĐ-CP"), (2, "khoản 3 Điều 9 số 7/2019/TT-BTC và 12/2020/NĐ-CP"), (3, "không"), (4, None)], "q long, t string")
    docs = [(1, "12/2020/NĐ-CP", "Điều 2\nkhoản 1", "x"), (2, None, "theo 12/2020/nđ-cp, điểm a", "Điều 9"), (3, "7/2019/TT-BTC ", None, None), (4, "", "khoản 3", None)]
    docs = spark.createDataFrame(docs, "id long, n string, body string, title string")
    pairs = questions.select("q").crossJoin(docs.select("id"))
    want = pairs.join(docs, "id").join(questions, "q").select("q", "id", reference_boost(F.col("t"), F.col("n"), F.col("body"), F.col("title")).alias("b"))
    got = named_boosts(pairs, questions, docs, key="id", query_key="q", query_text="t", number="n", texts=["body", "title"])
    assert {(r.q, r.id): r.boost for r in got.collect() if r.boost} == {(r.q, r.id): r.b for r in want.collect() if r.b}


def test_titles_are_not_sent_to_all_tasks(spark):
    """Titles of equal beginnings are small when compressed, however many there are."""
    docs = spark.range(3000).selectExpr("id", "concat(repeat('quy định về ', 20), id) AS t", "'Luật' AS kind")
    asked = spark.createDataFrame([(1, "quy định về 2999"), (2, "quy định về quy"), (3, "không có ở đâu")], "k long, h string")
    out = relational.title_hints(asked, docs, citation_key="k", hint="h", document_id="id", columns=["t", "kind"])
    assert {r.k: (r.status, r.matched_id) for r in out.collect()} == {1: ("MATCHED", 2999), 2: ("AMBIGUOUS", None), 3: ("UNRESOLVED", None)}
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("rightHint=(strategy=merge)") >= 4
