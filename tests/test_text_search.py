"""The index holds the texts: search against plain Python over title, number and text."""

import math
import re
from collections import Counter, defaultdict

from quillspark.operators.retrieval import TOKEN
from quillspark.plans import retrieval


def tokens(text):
    return [x.lower() for x in re.findall(TOKEN, text or "")]


def tables(spark, folder):
    read = lambda name: spark.read.parquet(f"{folder}/{name}.parquet").collect()
    least, texts = defaultdict(lambda: [None, None]), {}
    for r in read("legal_documents"):
        for i, v in enumerate((r.title, r.document_number)):
            if v is not None and (least[r.id][i] is None or v < least[r.id][i]):
                least[r.id][i] = v
        least[r.id]
    for r in read("legal_document_contents"):
        if r.content_text is not None:
            texts[r.document_id] = max(texts.get(r.document_id, ""), r.content_text)
    asked = defaultdict(list)
    for r in read("government_qna_citations"):
        if r.citation_id % 20 == 0 and r.raw_text is not None:
            asked[r.citation_id].append(r.raw_text)
    return {k: (*v, texts.get(k)) for k, v in least.items()}, {k: min(v) for k, v in asked.items()}


def test_bm25_over_texts(spark, small):
    docs, asked = tables(spark, small)
    tf = {k: Counter() for k in docs}
    for k, fields in docs.items():
        for text, w in zip(fields, (2, 4, 1)):
            for t in tokens(text):
                tf[k][t] += w
    tf = {k: v for k, v in tf.items() if v}
    df, n = Counter(t for v in tf.values() for t in v), len(tf)
    length = {k: sum(v.values()) for k, v in tf.items()}
    mean = sum(length.values()) / n
    want = {}
    for q, text in asked.items():
        qf = Counter(tokens(text))
        for k, v in tf.items():
            s = sum(f * math.log1p((n - df[t] + 0.5) / (df[t] + 0.5)) * v[t] * 2.5 / (v[t] + 1.5 * (0.25 + 0.75 * length[k] / mean)) for t, f in qf.items() if t in v)
            if s > 0:
                want.setdefault(q, []).append(s)
    got = defaultdict(list)
    for r in retrieval.bm25_topk(spark, small).collect():
        got[r.citation_id].append(r.score)
    assert set(got) == set(want)
    for q, scores in want.items():
        assert all(abs(a - b) < 2e-6 for a, b in zip(sorted(got[q], reverse=True), sorted(scores, reverse=True)[: retrieval.K], strict=True))


def test_only_documents_within_reach_are_scored(spark):
    """Against all scores, with a word in every document, ties, and queries with fewer hits than k."""
    import random

    from quillspark.operators import retrieval as r

    rng = random.Random(5)
    words = ["va"] * 40 + [f"w{i}" for i in range(30)] * 2 + [f"r{i}" for i in range(60)]
    docs = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(1, 60))) + " va") for i in range(400)] + [(900 + i, "va va w1 r1") for i in range(20)]
    asked = [(1, "va w1 r1 va"), (2, "r5 va"), (3, "va"), (4, "zz"), (5, "zz w2 r2 r3 w9"), (6, None)]
    index = r.postings(spark.createDataFrame(docs, "id long, t string"), "id", {"t": 1.0})
    got = defaultdict(list)
    for x in r.bm25_top_k(index, spark.createDataFrame(asked, "q long, t string"), "id", "q", "t", 5).collect():
        got[x.q].append((x.rank, x.id, x.score))
    tf = {i: Counter(t.split()) for i, t in docs}
    df, n = Counter(t for v in tf.values() for t in v), len(tf)
    size = {i: sum(v.values()) for i, v in tf.items()}
    mean = sum(size.values()) / n
    for q, text in asked:
        qf, scores = Counter((text or "").split()), []
        for i, v in tf.items():
            s = sum(f * math.log1p((n - df[t] + 0.5) / (df[t] + 0.5)) * v[t] * 2.5 / (v[t] + 1.5 * (0.25 + 0.75 * size[i] / mean)) for t, f in qf.items() if t in v)
            if s > 0:
                scores.append((-round(s, 6), i))
        assert [(i, s) for _, i, s in sorted(got[q])] == [(i, -s) for s, i in sorted(scores)[:5]]


def test_boost_lifts_what_is_named(spark, small):
    rows = retrieval.hybrid_boosted(spark, small).collect()
    plain = {(r.citation_id, r.id): r.score for r in retrieval.hybrid_fusion(spark, small).collect()}
    assert rows and all(1 <= r.rank <= retrieval.K for r in rows)
    shared = [(r.score, plain[r.citation_id, r.id]) for r in rows if (r.citation_id, r.id) in plain]
    assert shared and all(a >= b - 1e-6 for a, b in shared) and any(a > b + 1 for a, b in shared)


def test_words_of_the_text_alone(spark, tmp_path):
    save = lambda name, rows, schema: spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    save("legal_documents", [(1, "Nghị định", "1/2020"), (2, "Thông tư", "2/2020")], "id long, title string, document_number string")
    save("legal_document_contents", [(1, "bến phà"), (1, None), (2, "đê kè")], "document_id long, content_text string")
    save("government_qna_citations", [(20, "bến phà"), (40, "đê nghị")], "citation_id long, raw_text string")
    assert {(r.citation_id, r.id) for r in retrieval.bm25_topk(spark, str(tmp_path)).collect()} == {(20, 1), (40, 1), (40, 2)}
    assert {(r.citation_id, r.id, r.score) for r in retrieval.term_overlap_topk(spark, str(tmp_path)).collect()} == {(20, 1, 6.0), (40, 1, 1.0), (40, 2, 3.0)}
