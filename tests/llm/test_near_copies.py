"""Near copies against brute force; the code; odd inputs."""

import numpy as np

from quillspark.llm import near_copies, queries


def sets(rows, n, least):
    out = {}
    for key, head, text in rows:
        if text is not None and len(near_copies.words_of(text)) >= least:
            w = near_copies.words_of((head or "") + "\n" + text)
            out[key] = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}
    return out


def test_golay_code_covers():
    home, errors, starts, counts = near_copies.golay_tables()
    weights = np.array([bin(x).count("1") for x in home])
    assert weights.max() == 3 and len(np.unique(near_copies.syndromes(home))) == 2048
    words = np.random.default_rng(0).integers(0, 1 << 23, 500)
    s = near_copies.syndromes(words)
    assert (near_copies.syndromes(words ^ home[s]) == 0).all()
    for w, i in zip(words[:50], s[:50]):
        reach = w ^ errors[starts[i] : starts[i] + counts[i]]
        assert (near_copies.syndromes(reach) == 0).all() and max(bin(int(w ^ a)).count("1") for a in reach) <= 4


def test_against_brute_force(spark, medium):
    titles = {r.id: r.title for r in spark.read.parquet(f"{medium}/legal_documents.parquet").collect()}
    rows = [(r.document_id, titles.get(r.document_id), r.content_text) for r in spark.read.parquet(f"{medium}/legal_document_contents.parquet").collect()]
    s = sets(rows, 3, 50)
    keys = sorted(s)
    want = set()
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            if min(len(s[a]), len(s[b])) >= 0.7 * max(len(s[a]), len(s[b])):
                x = len(s[a] & s[b])
                if x >= 0.7 * (len(s[a]) + len(s[b]) - x):
                    want.add((a, b))
    got = {tuple(r) for r in queries.p3_found(spark, medium).collect()}
    assert got == want


def test_groups_copies_and_odd_inputs(spark):
    base = [f"w{i}" for i in range(200)]
    edit = base[:100] + ["x"] + base[100:]
    rows = [(1, " ".join(base)), (2, " ".join(base)), (2, " ".join(base)), (3, " ".join(edit)), (4, None), (None, "a b"), (5, ""), (6, "p q"), (7, "P  q"), (8, " ".join(f"z{i % 7919}" for i in range(100_000)))]
    df = spark.createDataFrame([(k, t, 1, "h") for k, t in rows], "k long, t string, _id int, class_id string")
    found = near_copies.near_copies(df, None, key="k", text="t")
    assert {(r.k_a, r.k_b) for r in found.pairs().collect()} == {(1, 2), (1, 3), (2, 3), (6, 7)}
    groups = {r.k: (r.class_id, r.group_id, r.links) for r in found.groups().collect()}
    assert groups[2] == (1, 1, 1) and groups[3] == (3, 1, 1) and groups[8] == (8, 8, 0) and groups[7] == (6, 6, 0)
    empty = near_copies.near_copies(df.limit(0), None, key="k", text="t")
    assert empty.pairs().count() == 0 and empty.groups().count() == 0


def test_connected(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(30)] + [(50, 51), (51, 50), (60, 60), (None, 3)], "a long, b long")
    assert {r.node: r.root for r in near_copies.connected(edges).collect()} == {**{i: 0 for i in range(31)}, 50: 50, 51: 50}
