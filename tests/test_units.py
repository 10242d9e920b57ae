"""Articles, clauses, points and annexes; chunks; against results written out by hand."""

from quillspark.operators import chunks
from quillspark.operators import units as u

TEXT = """Căn cứ Luật
I. Phần chung
1. Ngoài điều
Điều 1. Phạm vi 1. Áp dụng a) một b) hai 2. Không
tiếp theo
Điều 2. Đối tượng
1. Một
a) x
a) y
1. Lại
Điều 1.
Phụ lục A
Điều 9. không"""


def marked(spark, rows):
    return u.units(u.blocks(spark.createDataFrame(rows, "d long, t string, kind string"), "d", "t"), "d")


def test_anchors(spark):
    got = [(r.d, r.anchor) for r in u.anchors(marked(spark, [(1, TEXT, "x"), (2, None, "x"), (3, "", "x"), (4, "Điều 5\n1. a", "x")]), "d").orderBy("d", "pos").collect()]
    one = ["article-i", "article-i.clause-1", "article-1", "article-1.clause-1", "article-1.clause-1.point-a", "article-1.clause-1.point-b", "article-1.clause-2", "article-2", "article-2.clause-1", "article-2.clause-1.point-a", "article-2.clause-1.point-a.occurrence-2", "article-2.clause-1.occurrence-2", "article-1.occurrence-2", "annex-1"]
    assert got == [(1, x) for x in one] + [(4, "article-5"), (4, "article-5.clause-1")]


def test_texts(spark):
    got = [(r.number, r.blocks, r.text) for r in u.unit_texts(marked(spark, [(1, TEXT, "x")]), "d", "clause").orderBy("pos").collect()]
    assert got == [("1", 1, "1. Ngoài điều"), ("1", 3, "1. Áp dụng\na) một\nb) hai"), ("2", 2, "2. Không\ntiếp theo"), ("1", 3, "1. Một\na) x\na) y"), ("1", 1, "1. Lại")]


def test_chunks_by_structure():
    text = "Phần I\nChương II Chung\nĐiều 1. Tên\nDẫn\n1. Một\na) x\nb) y\n2. Hai\nChương III\nĐiều 2. Khác\nNội dung\nĐiều 3\na) đơn"
    got = [(level, path, article, clause, point, body) for _, _, body, level, path, article, clause, point, _ in chunks.structure(text)]
    a1, a3 = "Phần I > Chương II Chung > Điều 1. Tên", "Phần I > Chương III > Điều 3"
    assert got == [
        ("section", "Phần I", None, None, None, "Phần I"),
        ("section", "Phần I > Chương II Chung", None, None, None, "Chương II Chung"),
        ("parent", a1, "1", None, None, "Điều 1. Tên\nDẫn\n1. Một\na) x\nb) y\n2. Hai"),
        ("child", a1, "1", "1", "a", "Điều 1. Tên\na) x"),
        ("child", a1, "1", "1", "b", "Điều 1. Tên\nb) y"),
        ("child", a1, "1", "2", None, "Điều 1. Tên\n2. Hai"),
        ("section", "Phần I > Chương III", None, None, None, "Chương III"),
        ("section", "Phần I > Chương III > Điều 2. Khác", "2", None, None, "Điều 2. Khác\nNội dung"),
        ("parent", a3, "3", None, None, "Điều 3\na) đơn"),
        ("child", a3, "3", None, "a", "Điều 3\na) đơn"),
    ]


def test_windows_cover_and_stay_within():
    text = "một hai ba. " * 400
    found = chunks.windows(text, 300, 50)
    assert found[0][0] == 0 and found[-1][1] == len(text) and all(b - a <= 300 for a, b in found)
    assert all(c == b - 50 for (_, b), (c, _) in zip(found, found[1:])) and all(text[b - 1] == "." for _, b in found[:-1])
    assert chunks.windows("", 10, 2) == [] and chunks.windows("abc", 10, 2) == [(0, 3)]


def test_chunk_table(spark, small):
    """Every text without headings is covered by its windows; rows of a document count up; parents of children are there."""
    from quillspark.plans import texts

    rows = texts.structural_chunks(spark, small).toPandas()
    for _, of in rows.groupby("document_id"):
        assert sorted(of.chunk_index) == list(range(len(of)))
        assert set(of[of.level == "child"].parent_key) <= set(of[of.level == "parent"].parent_key)
    bodies = {r.document_id: chunks.tidy(r.content_text) for r in texts._texts(spark, small).collect() if r.content_text}
    for r in rows[rows.level != "child"].itertuples():
        assert r.chunk_text in bodies[r.document_id] and bodies[r.document_id][r.begin_char : r.end_char].strip() == r.chunk_text
    whole = texts.hydrated_chunks(spark, small).toPandas().set_index("document_id")
    assert (whole.chunks.sort_index() == rows.groupby("document_id").size()).all()
    plain = texts.window_chunks(spark, small).toPandas()
    assert (plain.chunk_text.str.len() <= 1500).all() and set(plain.document_id) == {k for k, v in bodies.items() if v}
