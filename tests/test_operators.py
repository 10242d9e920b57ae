"""Core operators on small cases."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from quillspark.functions import columns as c
from quillspark.operators import chunks, citations, graph, relational, retrieval, versions


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return df.select(column.alias("x")).first().x


def test_windows_cover_and_move_on():
    got = list(chunks.windows("a" * 250, 100, 20))
    assert [b - a for a, b in got] == [100, 100, 90]
    assert list(chunks.windows("ab " * 10, 10, 9))[-1][1] == 30  # a large overlap still moves on
    assert list(chunks.windows("", 10, 1)) == []


def test_structure():
    text = chunks.tidy("Lời dẫn\nChương I\nĐiều 1. Phạm vi\nNội dung\nĐiều 3. Quyền\n1. Một:\na) x\nb) y\n2. Hai")
    got = chunks.structure(text)
    kids = [(p.article, p.clause, p.point) for p in got if p.level == "child"]
    assert kids == [("3", "1", "a"), ("3", "1", "b"), ("3", "2", None)]
    assert [p.path for p in got if p.level == "section"] == ["Chương I", "Chương I > Điều 1. Phạm vi"]
    assert all(text[p.begin : p.end].strip() in p.text or p.level == "child" for p in got)


def test_chunk_edges(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "x" * 4000), (3, "x" * 4000)], "id long, text string")
    got = chunks.chunk(df, "id", "text").toPandas()
    assert set(got.id) == {3} and got.chunk_text.str.len().max() <= 1500
    with pytest.raises(ValueError):
        chunks.chunk(df, "id", "text", size=10, overlap=10)


def test_dates(spark):
    assert one(spark, c.strict_day(F.col("a")), a="31/02/2020") is None
    assert one(spark, c.any_day(F.col("a")), a="2020-05-06T10:00") == dt.date(2020, 5, 6)
    assert one(spark, c.any_day(F.col("a")), a="18262") == dt.date(2020, 1, 1)
    assert one(spark, c.day_in_text(F.col("a")), a="ngày 5-6-2020") == dt.date(2020, 6, 5)
    assert one(spark, c.event_time(F.col("a")), a="86400").day == 2


def test_references(spark):
    text = "Theo ĐIỀU 6, khoản 2, điểm a Nghị định 45/2019/QH14; Điều 6"
    assert one(spark, c.references(F.col("a"), "article"), a=text) == ["6"]
    assert one(spark, c.references(F.col("a"), "number"), a=text) == ["45/2019/QH14"]
    assert one(spark, c.references(F.col("a"), "point"), a=None) == []
    boost = c.reference_boost(F.col("q"), F.col("n"), F.col("t"))
    assert one(spark, boost, q="45/2019/QH14 Điều 127", n="45/2019/qh14", t="điều 127") == 7.0  # the number counts as one of the texts too


def test_html_and_urls(spark):
    assert one(spark, c.html_text(F.col("a")), a="<style>x</style><p>A&amp;B</p><script>y</script><div> c&nbsp; d</div>") == "A&B\nc d"
    assert one(spark, c.safe_url(F.col("a")), a="javascript:alert(1)") is False
    assert one(spark, c.external_id(F.col("a")), a="https://x.vn/a--123?y") == "123"
    assert one(spark, c.paragraphs_html(F.col("a")), a="a<b\n\nc") == "<p>a&lt;b</p><p>c</p>"


def test_answers(spark):
    df = spark.createDataFrame([("Theo [2] và Điều 999", ["Điều 1"])], "a string, s array<string>")
    assert df.select(citations.answer_errors(F.col("a"), F.col("s")).alias("e")).first().e == ["source:2", "article:999"]
    assert citations.citations_in("Nghị định 12/2020/NĐ-CP Điều 6 khoản 2, và 12/2020/NĐ-CP điểm a")[0][3:] == (["6"], ["2"], ["a"])


def test_filters():
    with pytest.raises(ValueError):
        relational.check_filters({"x": 1}, {"y"})


def test_upsert_and_replace_twice(spark):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "k long, v string, t long")
    new = spark.createDataFrame([(1, "c", 2), (1, "d", 3)], "k long, v string, t long")
    once = relational.upsert(old, new, ["k"], [F.col("t")])
    assert sorted((r.k, r.v) for r in once.collect()) == [(1, "d"), (2, "b")]
    twice = relational.upsert(once, new, ["k"], [F.col("t")])
    assert sorted(map(tuple, twice.collect())) == sorted(map(tuple, once.collect()))


def test_resolution_kinds(spark):
    docs = spark.createDataFrame([(1, "A"), (2, "B"), (3, "B")], "id long, n string")
    cites = spark.createDataFrame([(1, "A"), (2, "B"), (3, "C"), (4, None)], "c long, n string")
    got = relational.resolve(cites, docs, citation_key="c", key=F.col("n"), document_id="id", document_key=F.col("n"))
    assert {r.c: r.status for r in got.collect()} == {1: "MATCHED", 2: "AMBIGUOUS", 3: "MISSING", 4: "UNRESOLVED"}


def test_dense_blocks_equal_one_block(spark, small):
    rows = spark.read.parquet(f"{small}/embeddings.parquet").select("vec_id", "embedding").unionByName(spark.createDataFrame([(-1, None), (-2, [0.0] * 64)], "vec_id long, embedding array<float>"))
    queries = rows.where("vec_id % 20 = 0").select(F.col("vec_id").alias("q"), "embedding")
    a = retrieval.dense_top_k(rows, queries, "vec_id", "embedding", "q", 5)
    b = retrieval.dense_top_k(rows, queries, "vec_id", "embedding", "q", 5, block=3, part=40)
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


def test_min_max_of_equal_scores(spark):
    df = spark.createDataFrame([(1, 2.0), (1, 2.0), (2, 1.0), (2, 3.0)], "q long, s double")
    assert sorted(r.x for r in df.select(retrieval.min_max(F.col("s"), ["q"]).alias("x")).collect()) == [0.0, 1.0, 1.0, 1.0]


def test_graph_and_versions(spark):
    edges = spark.createDataFrame([(1, 2, " a "), (1, 2, "a"), (1, 1, "a"), (None, 2, "a"), (1, 3, "b")], "s long, t long, l string")
    clean = graph.clean_edges(edges, "s", "t", "l")
    assert clean.count() == 2
    assert graph.relation_summary(clean, "s", "l").first().summary == "a: 1; b: 1"
    v = spark.createDataFrame([(1, 1, 1, "x"), (1, 2, 2, "x"), (1, 3, 3, "y")], "r long, v long, t long, c string")
    chain = versions.version_chain(v, "r", "v", "t", "c").orderBy("v").collect()
    assert [(r.v, r.is_current, r.superseded_by) for r in chain] == [(1, False, 3), (3, True, None)]
