"""Pages read into blocks, titles, captions and forms."""

from quillspark.operators import pages

LONG = "Đơn vị quản lý lưu giữ hồ sơ. " * 20
PAGES = {
    1: '<html><head><title>Trang</title><script>var p = "<p>x</p>";</script></head><body><div id="menu"><p>Trang chủ</p></div><div id="divContent"><p>QUYẾT ĐỊNH</p><p> </p><div>Căn&nbsp;cứ <i>Luật</i></div><div><p>Điều 1.</p></div><p>Bảng 2. Mức thu</p><table><tr><td>a</td><td>b</td></tr></table><table><caption>Kèm theo</caption><tr><td></td></tr></table><style>p {}</style><a href="/tep/MAU-1.doc">Tải về</a> <a href="x">Mẫu số 02</a> <a href="y">Khác</a></div></body></html>',
    2: f"<h1> Nghị định <b>A</b> </h1><div>{LONG}</div><div><p>Cuối</div>",
    3: "<p><strong>Điều 1. Phạm vi</strong><p>Thông tư này<br/>quy định</p>",
    4: None,
    5: "",
    6: "không có thẻ",
    7: '<meta property="og:title" content=" Chỉ thị "><div><b>Ghi chú</p></div>',
    8: "<form><p>Tìm</p></form><table></table>",
}


def read(spark, fn):
    return fn(spark.createDataFrame(list(PAGES.items()), "id long, html string"), "id", "html").collect()


def test_blocks(spark):
    got = {}
    for r in sorted(read(spark, pages.page_blocks)):
        got.setdefault(r.id, []).append((r.tag, r.text, r.caption))
    assert got == {
        1: [("p", "QUYẾT ĐỊNH", None), ("div", "Căn cứ Luật", None), ("p", "Điều 1.", None), ("p", "Bảng 2. Mức thu", None), ("table", "a b", "Bảng 2. Mức thu"), ("table", "Kèm theo", "Kèm theo")],
        2: [("div", LONG.strip(), None)],
        3: [("p", "Điều 1. Phạm vi", None), ("p", "Thông tư này quy định", None)],
        7: [("div", "Ghi chú", None)],
        8: [("table", "", None)],
    }


def test_forms(spark):
    assert [tuple(r) for r in sorted(read(spark, pages.page_forms))] == [(1, "form-1", "Tải về", "/tep/MAU-1.doc"), (1, "form-2", "Mẫu số 02", "x")]


def test_titles(spark):
    df = spark.createDataFrame(list(PAGES.items()), "id long, html string")
    assert {r.id: r.t for r in df.select("id", pages.page(df.html).title.alias("t")).collect()} == {1: "QUYẾT ĐỊNH", 2: "Nghị định A", 3: "Thông tư này quy định", 4: None, 5: None, 6: None, 7: "Ghi chú", 8: None}


def test_long_and_deep(spark):
    deep = "<div>" * 3000 + "<p>a</p>" * 3000
    df = spark.createDataFrame([(1, deep), (1, deep)], "id long, html string")
    assert pages.page_blocks(df, "id", "html").count() == 6000
