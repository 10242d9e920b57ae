"""Defects of pairs."""

import pytest

from quillspark.llm import pairs

VI = "Cơ quan tiếp nhận lưu giữ hồ sơ kênh mương theo thứ tự ưu tiên nêu tại phụ lục. Đơn vị quản lý thực hiện kế hoạch hằng năm."
EN = "The receiving office shall keep the record of the water supply near the port. The applicant must update the file each year."
Q = "Tôi muốn biết thủ tục giao khoán mặt nước được thực hiện thế nào?"


@pytest.fixture(scope="module")
def model(spark, medium):
    rows = spark.read.parquet(f"{medium}/documents.parquet").where("lang in ('vi', 'en')").select("text", "lang")
    return pairs.train_languages(rows.unionByName(spark.createDataFrame([(None, "vi"), ("x", None)], "text string, lang string")), sample_rows=300)


def judged(spark, model, rows):
    df = spark.createDataFrame([(i, q, a, v, "c") for i, q, a, v in rows], "k long, q string, a string, v string, _key string")
    return {r.k: r.defect for r in pairs.defects(df, model, key="k", question="q", answer="a", version="v").collect()}


def test_kinds(spark, model):
    sound = [(100 + i, Q, VI, "1") for i in range(6)]
    rows = [
        (1, Q, None, "1"), (2, Q, " \u00a0", "1"), (3, Q, "<p>&nbsp;</p>", "1"), (4, Q, "(đang cập nhật)", "1"), (5, Q, "Có.", "1"),
        (6, Q, Q.upper(), "1"), (7, Q, "Trả lời: " + Q, "1"), (8, Q, f'Ông (bà) hỏi: "{Q}" Trả lời: {VI}', "1"),
        (9, Q, "Chúng tôi rất tiếc không thể trả lời câu hỏi này. Mong ông (bà) thông cảm.", "1"), (10, Q, VI + " Cơ quan có quyền từ chối giải đáp.", "1"),
        (11, Q, EN, "1"), (12, "What must the applicant update each year near the port?", VI, "1"), (13, Q, pairs._bare(VI), "1"), (14, None, EN, "1"),
        (15, Q, VI + " Đơn vị quản lý thực hiện kế ho", "1"), (16, Q, VI + " Gồm các bước sau:", "1"), (17, Q, VI[:-1], "1"), (18, Q, VI + "\nTrân trọng", "1"), (19, Q, VI + ' Theo (văn bản "kèm', "1"),
        (20, Q, "x", "1"), (20, Q, VI, "2"), (20, Q, VI, "2"),
    ]
    got = judged(spark, model, sound + rows)
    want = {1: "empty", 2: "empty", 3: "empty", 4: "empty", 6: "copy", 7: "copy", 9: "refusal", 11: "other_language", 12: "other_language", 15: "truncated", 16: "truncated", 19: "truncated"}
    assert got == want


def test_held_out_languages(spark, medium):
    rows = spark.read.parquet(f"{medium}/documents.parquet").where("lang in ('vi', 'en') and length(text) > 80").select("text", "lang")
    train, test = rows.where("crc32(text) % 2 = 0"), rows.where("crc32(text) % 2 = 1").collect()
    m = pairs.train_languages(train, sample_rows=200)
    right = sum(m.of(r.text) == r.lang for r in test)
    assert right > 0.95 * len(test)  # some labels are wrong
    assert m.of("Le service instructeur peut demander la révision de le permis de dragage pour une durée de douze mois.") == "other"
    assert m.of("如有异议，可以向当地办公室提出。登记簿至少保存7个月。") == "other"


def test_empty(spark, model):
    assert judged(spark, model, []) == {}
    none = pairs.train_languages(spark.createDataFrame([], "text string, lang string"))
    assert none.of(VI) == "other"


def test_long_text(spark, model):
    assert judged(spark, model, [(1, Q, VI * 2000, "1")]) == {}


def sound_answers(spark, folder, n):
    rows = spark.read.parquet(f"{folder}/government_qna_items.parquet").where("length(question_text) > 30 and length(answer_text) > 420 and question_text like '%?' and answer_text like '%.' and not answer_text rlike '(?i)contractor|office|exploitant'")
    return [(r.question_text, r.answer_text) for r in rows.select("question_text", "answer_text").distinct().orderBy("answer_text").limit(n).collect()]


# families of declining answers written for these tests; none is a phrase of the library
DECLINING = [
    ["Bộ phận tiếp dân không thể giải đáp thắc mắc của bà con qua thư.", "Bộ phận tiếp dân xã Gò Sen không thể giải đáp thắc mắc của bà con qua thư."],
    ["Rất tiếc, yêu cầu này ngoài khả năng tư vấn của chúng tôi.", "RẤT TIẾC, YÊU CẦU NÀY NGOÀI KHẢ NĂNG TƯ VẤN CỦA CHÚNG TÔI."],
    ["Câu hỏi của bạn thiếu dữ kiện, ban biên tập chưa trả lời được.", "Cau hoi cua ban thieu du kien, ban bien tap chua tra loi duoc."],
    ["Chuyên mục xin không đưa ra ý kiến đối với vụ việc đang tranh chấp.", "Chuyên mục xin không đưa ra ý kiến đối với vụ việc đang tranh chấp. Mong ông (bà) thông cảm."],
    ["Cơ quan không có thông tin nào về điều bạn hỏi.", "Cảm ơn bạn. Cơ quan không có thông tin nào về điều bạn hỏi."],
]
SHORT_SOUND = ["Có.", "Không.", "Không bắt buộc.", "45 ngày.", "Được, nếu còn hạn.", "Nộp tại UBND xã Bến Đò.", "Chưa phải nộp."]


def test_declining_families(spark, medium):
    """Families that the fit saw are found and short sound answers are not declining; of unseen families few are found."""
    content = [a for _, a in sound_answers(spark, medium, 200)]
    seen = unseen = 0
    for i in range(len(DECLINING)):
        known = [t for j, f in enumerate(DECLINING) if j != i for t in f]
        model = pairs.train_declines(spark.createDataFrame([(t,) for t in content + known + SHORT_SOUND], "a string"), "a")
        seen += sum(map(model.answers_nothing, known))
        unseen += sum(map(model.answers_nothing, DECLINING[i]))
        assert not any(map(model.answers_nothing, content + SHORT_SOUND))
    assert seen == 8 * len(DECLINING)
    assert unseen >= 1  # most families that the fit never saw are missed


def test_recall_of_each_defect(spark, model, medium):
    """Defects planted in sound answers: recall of each kind, and nothing else found."""
    rows, want = [], {}
    sound = sound_answers(spark, medium, 250)
    tongues = ["The receiving office shall keep the record of the water supply near the port. The applicant must update the file each year.", "Chaque exploitant doit transmettre le registre des entrepôts dans un délai de douze jours ouvrables.", "申请人应当在6个工作日内提交材料。主管部门负责审核并公布结果。"]
    for i, (q, a) in enumerate(sound):
        kind = ("empty", "copy", "refusal", "other_language", "truncated", None, None, None)[i % 8]
        if kind == "empty":
            a = ("", None, "...", "N/A", "<br/>")[i % 5]
        elif kind == "copy":
            a = ("Trả lời: " + q, q.upper(), pairs._bare(q))[i % 3]
        elif kind == "refusal":
            a = DECLINING[i % 5][i % 2]
        elif kind == "other_language":
            a = tongues[i % 3]
        elif kind == "truncated":
            words = a.split()
            a = " ".join(words[: -4 - i % 5]) + " " + words[-4 - i % 5][:2] + ("" if i % 2 else "…")
        rows.append((i, q, a, "1"))
        if kind:
            want[i] = kind
    got = judged(spark, model, rows)
    for kind in set(want.values()):
        mine = [i for i, k in want.items() if k == kind]
        assert sum(got.get(i) == kind for i in mine) >= 0.95 * len(mine), (kind, [(rows[i][2], got.get(i)) for i in mine if got.get(i) != kind])
    wrong = [i for i in got if i not in want]
    assert len(wrong) <= 0.02 * len(rows), [(rows[i], got[i]) for i in wrong]


def test_short_answers_in_their_language(spark, model):
    plain = ["Câu hỏi chưa rõ, mời bổ sung.", "Xin ghi nhận.", "Có.", "30 ngày.", "Nộp tại xã.", "OK"]
    assert all(model.differ(Q, a) < pairs.DIFFER for a in plain)
    assert model.differ(Q, "The applicant must update the file.") > pairs.DIFFER
    assert model.differ(Q, "主管部门负责审核并公布结果。") > pairs.DIFFER
