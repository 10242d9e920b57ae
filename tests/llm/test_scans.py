"""Scan noise: automaton against brute force, furniture, reflow, proofs, odd inputs."""

import difflib
import random
from collections import Counter

import pandas as pd
from hypothesis import given, settings
from hypothesis import strategies as st

from pyspark.sql import functions as F

from quillspark.llm import scans


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@settings(max_examples=60, deadline=None)
@given(st.text("abc", max_size=7), st.lists(st.text("abc", min_size=1, max_size=7), max_size=25, unique=True), st.integers(0, 2))
def test_automaton_is_complete(word, words, most):
    assert sorted(scans.within(scans.trie_of(words), word, most)) == sorted(w for w in words if distance(word, w) <= most)


def test_explained():
    assert scans.explained("kbu", "khu") == (1, 0)
    assert scans.explained("rnôn", "môn") == (1, 0)
    assert scans.explained("loãi", "bãi") == (1, 0)
    assert scans.explained("cáp", "cấp") == (0, 1)
    assert scans.explained("xyz", "khu") is None


def page(header, number, body):
    return f"{header}  {number}\n" + "\n".join(body)


def test_furniture_and_reflow():
    rng = random.Random(1)
    words = ["khu", "vực", "kênh", "chính", "đê", "điều", "sông"]
    bodies = [[" ".join(rng.choice(words) for _ in range(12)) for _ in range(12)] for _ in range(3)]
    bodies[0][3] = bodies[0][3].rsplit(" ", 1)[0] + " trư-"
    bodies[0][4] = "ớc " + bodies[0][4]
    tidy = scans.Tidy("\n\n".join(page("CÔNG BÁO/Số 1 + 2/Ngày 01-02-2003", 7 + i, b) for i, b in enumerate(bodies)))
    assert tidy.noise == {"header", "page_no", "hyphen"}
    text = " ".join(tidy.paragraphs)
    assert "CÔNG BÁO" not in text and "trước" in text


def test_table_cells_are_no_pages():
    lines = ["Điều 1. Mức", "1", "Phí kho", "12.500", "2", "Phí kênh", "13.500", "3", "Phí đê", "14.500"]
    assert scans.pages_within(lines, {}) == set()
    assert scans.Tidy("\n".join(lines)).noise == set()


def test_nothing_lost():
    text = "Điều 1. A\n1. một hai ba\n\nbốn năm"
    assert " ".join(scans.Tidy(text).paragraphs).split() == text.split()


def test_proofs(spark, medium):
    contents = spark.read.parquet(f"{medium}/legal_document_contents.parquet")
    proofs = {r.document_id: r.proof_text for r in spark.read.parquet(f"{medium}/scan_proofs.parquet").collect()}
    got = scans.Scans(contents, "document_id", "content_text").repaired().where(f"document_id in ({','.join(map(str, proofs))})").collect()
    wrong = total = 0
    for r in got:
        a, b = r.repaired.split(), proofs[r.document_id].split()
        wrong += sum(max(i2 - i1, j2 - j1) for op, i1, i2, j1, j2 in difflib.SequenceMatcher(None, a, b, autojunk=False).get_opcodes() if op != "equal")
        total += len(b)
    assert len(got) == len(proofs) and wrong < 0.006 * total


def test_odd_inputs(spark):
    rows = [(1, None, 0), (2, "", 0), (3, "từ " * 60_000, 0), (3, "từ " * 60_000, 0), (None, "x", 0), (4, "\f\n \n", 0)]
    s = scans.Scans(spark.createDataFrame(rows, "document_id long, content_text string, _key int"), "document_id", "content_text")
    assert s.noise().count() == 0
    assert {r.document_id: len(r.repaired.split()) for r in s.repaired().collect()} == {2: 0, 3: 60_000, 4: 0}
    empty = scans.Scans(spark.createDataFrame([], "document_id long, content_text string"), "document_id", "content_text")
    assert empty.noise().count() == 0 and empty.repaired().count() == 0


def found(rows):
    return {tuple(r) for r in scans.Scans(rows, "document_id", "content_text").noise().collect()}


def test_unrelated_texts_and_copies_change_nothing(spark, medium):
    """Thresholds don't move with the collection, and a text counts once however many rows hold it."""
    rows = spark.read.parquet(f"{medium}/legal_document_contents.parquet").select("document_id", "content_text")
    before = found(rows)
    strange = spark.range(1500).select((F.col("id") + 10_000_000).alias("document_id"), F.concat_ws(" ", F.transform(F.sequence(F.lit(0), F.lit(300)), lambda i: F.concat(F.lit("q"), F.translate(F.conv(F.pmod(F.xxhash64("id", i), F.lit(4000)), 10, 16), "0123456789", "ghjklmnprs"), F.lit("w")))).alias("content_text"))
    assert found(rows.unionByName(strange)) == before
    one = sorted(k for k, noise in before if noise == "glyph")[0]
    text = rows.where(F.col("document_id") == one).first().content_text
    copies = spark.createDataFrame([(20_000_000 + i, text) for i in range(200)], "document_id long, content_text string")
    again = found(rows.unionByName(copies))
    assert {x for x in again if x[0] < 20_000_000} == before
    assert {x[1] for x in again if x[0] == 20_000_000} == {noise for k, noise in before if k == one} and len([x for x in again if x[0] > 20_000_000 - 1 and x[1] == "glyph"]) == 200


def test_known_header_that_is_misread_where_it_stands_once(spark):
    body = [f"dòng chữ thứ {'một hai ba bốn năm'.split()[i % 5]} của văn bản này" for i in range(12)]
    head = "CÔNG BÁO/Số 12 + 13/Ngày 01-02-2003"
    twice = "\n".join([head, *body, head, *body])
    rows = [(i, twice.replace("chữ", "chữ" + "abcde"[i])) for i in range(3)] + [(10, "\n".join([head.replace("BÁO", "BẢO"), *body])), (11, "\n".join(["HỘI ĐỒNG NHÂN DÂN TỈNH", *body]))]
    got = found(spark.createDataFrame(rows, "document_id long, content_text string"))
    assert {k for k, noise in got if noise == "header"} == {0, 1, 2, 10}


def test_candidates_against_brute_force(spark):
    rng = random.Random(3)
    true = ["".join(rng.choice("nhuclitmơđ") for _ in range(rng.randint(2, 9))) for _ in range(60)]
    words = {w: rng.randint(20, 4000) for w in true}
    for w in true:
        for t, r in scans.MISREAD:
            if t in w and rng.random() < 0.3:
                words.setdefault(w.replace(t, r, 1), rng.randint(1, 30))
    words["x" * 40] = 1
    got = {(r.word, r.candidate): (r.signs, r.accents) for r in scans._candidates(spark.createDataFrame(list(words.items()), "word string, n long")).collect()}
    want = {}
    for w, n in words.items():
        for c, m in words.items():
            if scans._asked(w) and m >= 20 * max(n, 1) and c.isalpha() and w != c and distance(w, c) <= (2 if len(w) > 2 else 1) and (how := scans.explained(w, c)):
                want[w, c] = how
    assert got == want and want


def test_counted_in_one_reading(monkeypatch):
    """Neighbours as plain counting has them, over several flushes; each line is looked at once."""
    rng = random.Random(5)
    texts = ["", " ... ", "a-\nb-\nc -\nd", "x ... y", "CÔNG BÁO/Số 1 + 2\nmột hai"] + ["".join(rng.choice("aĐđ-¬\n \t.…0A_²") for _ in range(rng.randint(0, 80))) for _ in range(300)]
    looked, may_head = [], scans._may_head
    monkeypatch.setattr(scans, "_may_head", lambda x: looked.append(x) or may_head(x))
    monkeypatch.setattr(scans, "_AT_ONCE", 50, raising=False)
    monkeypatch.setattr(scans, "_FLUSH", 100)
    got = pd.concat(scans._counted(iter([pd.DataFrame({"_h": range(len(texts)), "_text": texts})])))
    lines = [x for t in texts for x in scans._lines(t)]
    assert sorted(looked) == sorted(lines)
    want, once = Counter(), Counter()
    for h, t in enumerate(texts):
        seq = [*map(scans.word_of, scans.re.sub(r"([^\W\d_])[-‐‑¬\xad][ \t]*\n\s*(?=[^\W\d_A-ZĐÀ-Ỹ])", r"\1", t).split()), ""]
        want.update(zip(seq, seq[1:]))
        once.update({(h, scans.line_mask(x)) for x in scans._lines(t) if may_head(x)})
    pairs = got[got.kind == "pair"]
    assert pairs.groupby(["a", "b"]).n.sum().to_dict() == want
    assert Counter(zip(got[got.kind == "line"].h, got[got.kind == "line"].a)) == once and not (got.kind == "head").any()


def test_lines_of_no_headers_length_are_left_out(spark, monkeypatch):
    rng = random.Random(7)
    heads = ["công báo/số 0 + 0/ngày 0-0-0", "quyển số 0"]
    masks = ["dòng chữ dài hơn mọi tiêu đề của công báo/số 0 + 0/ngày 0-0-0", "x" * 16, "công", *heads]
    for h in heads * 30:
        x = list(h)
        for _ in range(rng.randint(1, 7)):
            at = rng.randrange(len(x) + 1)
            x[at : at + rng.randint(0, 1)] = rng.choice(["", "o", "ơ", "0"])
        masks.append("".join(x))
    written, cut = [], scans.cut
    monkeypatch.setattr(scans, "cut", lambda df: written.append(cut(df)) or written[-1])
    got = scans._headers_alike(spark.createDataFrame(list(enumerate(masks)), "h long, mask string"), spark.createDataFrame([(h,) for h in heads], "a string"))
    alike = lambda m, h: 2 * len(scans._pairs_of(m) & scans._pairs_of(h)) >= len(scans._pairs_of(h)) and scans._alike(m, h)
    assert {(r.h, r.mask) for r in got.collect()} == {(i, m) for i, m in enumerate(masks) if any(alike(m, h) for h in heads)}
    assert {r.mask for r in written[0].collect()} == {m for m in masks if any(abs(len(m) - len(h)) <= max(2, len(h) // 5) for h in heads)} != set(masks)


def test_places_are_weighed_once_for_noise(spark, small):
    rows = spark.read.parquet(f"{small}/legal_document_contents.parquet")
    s = scans.Scans(rows, "document_id", "content_text")
    noise = s.noise()
    assert noise._jdf.queryExecution().optimizedPlan().toString().count("Generate explode(places") == 1
    assert {r.document_id for r in noise.where("noise = 'glyph'").collect()} == {r._key for r in s.fixes().collect()}
