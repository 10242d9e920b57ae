"""Matching citations."""

import datetime as dt

from quillspark.llm import citations as c

T = "Quy định hồ sơ cải tạo kênh mương tại khu neo đậu Nà Xoan trên địa bàn tỉnh Kim Sơn Hạ"
BODY = "Ủy ban nhân dân tỉnh Kim Sơn Hạ"
D = dt.date(2007, 3, 5)
NOW = dt.datetime(2024, 1, 1)
DOCS = [(1, "12/2007/QĐ-UBND", T, BODY, D, "Quyết định", NOW), (1, "12/2007/QĐ-UBND", T, BODY, D, "Quyết định", NOW), (2, "12/2007/QĐ-UBND", "Một văn bản khác hẳn về điều phối phương tiện vận tải", "Ủy ban nhân dân tỉnh Ba Khê", D, "Quyết định", None), (3, None, None, None, None, None, None)]
DOC = "id long, document_number string, title string, issuing_authority string, issued_date date, document_type string, updated_at timestamp, cid string, _p int"
CITE = "citation_id long, raw_text string, document_number string, document_title string, matched_document_id long, words string"


def matched(spark, cites, docs=DOCS):
    a = spark.createDataFrame([(*x, "w") for x in cites], CITE)
    b = spark.createDataFrame([(*x, "c", 0) for x in docs], DOC)
    return {r.citation_id: (r.document_id, r.rule, r.confidence) for r in c.match_citations(a, b).collect()}


def test_parsing():
    p = c.parse_citation("khoản 2, Điều 3 Quyết định số 62/ 2022/ qđ -ubnd ngày 18/9/2022 của UBND tỉnh Nam Trạch về quy định hồ sơ kênh mương Ba Sao", None, None)
    assert p[:6] == (62, 2022, "qdubnd", "uy ban nhan dan tinh nam trach", "2022-09-18", "QD") and "kenh" in p[6]
    assert c.parse_citation("TT 153/2000 Bộ Lâm sản năm 2000 (x)", "153/2000", None)[:6] == (153, 2000, None, "bo lam san", None, "TT")
    assert c.parse_citation(None, None, None)[:6] == (None,) * 6


def test_cascade(spark):
    cites = [
        (1, "Quyết định số 12/2007/QĐ-UBND ngày 5/3/2007 của UBND tỉnh Kim Sơn Hạ", "12/2007/QĐ-UBND", None, None),
        (2, f"Quyết định ngày 5 tháng 3 năm 2007 của {BODY} về {T}", None, None, None),
        (3, f"Quyết định số 99/2007/QĐ-UBND năm 2007 của {BODY} về {T}", "99/2007/QĐ-UBND", None, None),
        (4, "Quyết định số 13/2007/QĐ-UBND ngày 5/3/2007 của UBND tỉnh Kim Sơn Hạ", "13/2007/QĐ-UBND", None, None),
        (5, None, None, None, None), (6, "", "", "", None), (7, "văn bản nêu trên", None, "văn bản nêu trên", None),
        (8, "Quyết định số 12/2007/QĐ-UBND của UBND tỉnh Kim Sơn Hạ", "12/2007/QĐ-UBND", None, 1), (8, "Quyết định số 12/2007/QĐ-UBND của UBND tỉnh Kim Sơn Hạ", "12/2007/QĐ-UBND", None, 1),
        (9, "x " * 50_000, None, None, None),
    ]
    got = matched(spark, cites)
    assert {k: v[0] for k, v in got.items()} == {1: 1, 2: 1, 3: 1}
    assert got[1][1] == "number, body, title" and abs(got[1][2] - 2 / 3) < 1e-9
    assert got[2][1] == "title, body, day" and got[3][1] == "title, body, year"


def test_empty(spark):
    assert matched(spark, []) == {} and matched(spark, [(1, "Quyết định số 1/2007/QĐ-UBND", None, None, None)], []) == {}


def test_title_rules_lose_nothing(spark):
    """Each title rule against all pairs of its blocks, with few words, so that many are shared, and one very long title."""
    import random

    r = random.Random(5)
    vocabulary = [f"w{i}" for i in range(18)]
    title = lambda: r.sample(vocabulary, r.randint(4, 14))
    attributes = lambda words: (None, 2000 + r.randint(0, 1), None, r.choice("ab"), r.choice(["2001-01-01", "2001-01-02"]), r.choice(["QD", "TT", None]), words)
    docs = [(i, *attributes(title())) for i in range(150)] + [(900, *attributes([f"v{i}" for i in range(800)] + vocabulary))]
    cites = [(i, *attributes(r.sample(w := r.choice(docs)[7], max(4, len(w) - r.randint(0, 3))) if i % 2 else title())) for i in range(120)]
    columns = "serial int, year int, code string, body string, day string, kind string, words array<string>"
    a, b = spark.createDataFrame(cites, "cid long, " + columns), spark.createDataFrame(docs, "did long, " + columns)
    place = {"year": 2, "body": 4, "day": 5, "kind": 6}
    found = 0
    for rule in [x for x in c.RULES if x.blocked]:
        want = {}
        for q in cites:
            met = []
            for d in docs:
                share = len(set(q[7]) & set(d[7])) / len(q[7])
                alike = all(q[place[o]] is not None and q[place[o]] == d[place[o]] for o in rule.on)
                if alike and share >= rule.title and not (rule.numbers == "no body" and q[4] and d[4]):
                    met.append((-share, -int(q[5] == d[5]), len(d[7]), d[0]))
            if met:
                want[q[0]] = min(met)[-1]
        assert {x.cid: x.did for x in c._applied(rule, a, b).collect()} == want
        found += len(want)
    assert found > 20
