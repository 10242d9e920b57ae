"""Plain forms."""

from quillspark.llm import unify

VALUES = [
    (1, "09/2015/NQ－HĐND", "09/2015/NQ-HĐND"),
    (2, "91/19\u200b99/QĐ-UBN\u2060D", "91/1999/QĐ-UBND"),
    (3, "ΤT-ΒHL", "TT-BHL"),
    (4, "Quy định\u00a0đê", "Quy định đê"),
    (5, "Quy đi\u0323nh", "Quy định"),
    (6, "α – ½ m²  x", "α – ½ m²  x"),
    (7, "Москва kênh", "Москва kênh"),
    (8, "QÐ UBND", "QĐ UBND"),
    (9, None, None),
    (10, "", ""),
    (11, "TT BHL QĐ UBND Quy định đê kênh", "TT BHL QĐ UBND Quy định đê kênh"),
    (12, "ԚΗ15", "ԚΗ15"),
    (13, "kênh " * 20_000 + "\u200b", "kênh " * 20_000),
]


def test_cases(spark):
    df = spark.createDataFrame([(i, v, "t", 1) for i, v, _ in VALUES] + [(1, VALUES[0][1], "t", 1)], "token long, v string, _p string, word int")
    got = {r.token: r.plain_form for r in unify.plain_forms(df, ["token"], "v").collect()}
    assert got == {i: w for i, _, w in VALUES}
    assert unify.plain_forms(df.limit(0), ["token"], "v").count() == 0


def test_word_of_another_script_needs_the_vocabulary(spark):
    df = spark.createDataFrame([(1, "хо")], "k long, v string")
    words = lambda *w: spark.createDataFrame([(x,) for x in w], "word string")
    assert unify.plain_forms(df, ["k"], "v", words("xa")).first().plain_form == "хо"
    assert unify.plain_forms(df, ["k"], "v", words("xo")).first().plain_form == "xo"


def test_dominant_script_of_a_token():
    assert unify.repaired_token("СО") is None and unify.repaired_token("РОСА") is None and unify.repaired_token("сор") is None
    assert unify.repaired_token("СО", "LATIN") == "CO"
    assert unify.repaired_token("мaмa") == "мама" and unify.repaired_token("Мoсквa") == "Москва"
    assert unify.repaired_token("Москва", "LATIN") is None and unify.repaired_token("kênh") is None
    assert unify.repaired_token("ΤT-ΒHL") == "TT-BHL" and unify.repaired_token("ԚΗ15") == "QH15" and unify.repaired_token("QÐ") == "QĐ"


def test_repair_into_the_script_of_the_token(spark):
    rows = [(1, "мaмa kênh"), (2, "мама мыла раму"), (3, "пaпa kênh"), (4, "со мной мама"), (5, "СО kênh"), (6, "co kênh")]
    got = {r.k: r.plain_form for r in unify.plain_forms(spark.createDataFrame(rows, "k long, v string"), ["k"], "v").collect()}
    # 3 has no word to become; 4 is a word among words of its script
    assert got == {1: "мама kênh", 2: "мама мыла раму", 3: "пaпa kênh", 4: "со мной мама", 5: "CO kênh", 6: "co kênh"}
