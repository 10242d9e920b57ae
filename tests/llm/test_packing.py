"""Pieces, containers and mixtures."""

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillspark.llm import boundaries, containers, mixture, queries


@settings(max_examples=150, deadline=None)
@given(st.text(st.sampled_from("ab ệ😀.\n;, Đ"), max_size=400), st.integers(8, 60), st.integers(0, 7))
def test_pieces_join_to_the_text(text, limit, overlap):
    got = boundaries.pieces_of(text, limit, overlap) if text else []
    assert "".join(text[a:b] for a, b, _, _ in got) == text
    assert all(len(text[a - o : b].encode()) <= limit and len(text[a - o : a].encode()) <= overlap for a, b, o, _ in got)


def test_strong_boundaries_are_kept():
    text = "Điều 1. " + "a " * 20 + "\nĐiều 2. " + "b " * 20 + "\nĐiều 3. " + "c " * 20
    assert [k for *_, k in boundaries.pieces_of(text, 70, 0)] == ["start", "section", "section"]


def test_split_edges(spark):
    df = spark.createDataFrame([(1, None, 0), (2, "", 0), (3, "x" * 50, 0), (3, "x" * 50, 0), (4, "y" * 20, 0)], "doc_id long, text string, piece int")
    got = boundaries.split_oversized(df, 20, 4).toPandas()
    assert set(got.doc_id) == {3} and len(got) == 8 and got.n_bytes.max() <= 20
    assert boundaries.split_oversized(df.limit(0), 20, 4).count() == 0
    with pytest.raises(ValueError):
        boundaries.split_oversized(df, 4, 4)


def test_hilbert_neighbours_touch():
    side = np.arange(8)
    cells = np.stack(np.meshgrid(side, side, side, indexing="ij"), axis=-1).reshape(-1, 3)
    keys = containers.hilbert_keys(cells, 3)
    assert sorted(keys) == list(range(512))
    assert (np.abs(np.diff(cells[np.argsort(keys)], axis=0)).sum(axis=1) == 1).all()


def test_containers_hold_everything(spark, medium):
    docs = spark.read.parquet(f"{medium}/documents.parquet")
    got = queries.p7_containers(spark, medium).toPandas()
    assert got.groupby("container").n_bytes.sum().max() <= 8192
    sizes = {r.doc_id: r.n for r in docs.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).alias("n")).collect()}
    assert got.groupby("doc_id").n_bytes.sum().to_dict() == sizes
    assert all(sizes[d] > 8192 for d in got[got.part > 0].doc_id)
    assert (got.groupby("container").position.max() + 1 == got.groupby("container").size()).all()
    assert got.container.nunique() <= 1.01 * sum(sizes.values()) / 8192 + 1


def test_container_edges(spark):
    df = spark.createDataFrame([(1, None, 1), (2, "", 1), (3, "ệ" * 20, 1), (3, "ệ" * 20, 1), (4, "a b " * 30_000, 1)], "doc_id long, text string, position int")
    got = containers.pack(df, 16).toPandas()
    assert got.groupby("container").n_bytes.sum().max() <= 16 and set(got.doc_id) == {1, 2, 3, 4}
    assert got[got.doc_id == 3].n_bytes.sum() == 120
    assert containers.pack(df.limit(0), 16).count() == 0


TARGETS = [("a", 0.5, 1), ("b", 0.3, 3), ("c", 0.2, 2), ("none", 0.1, 2)]


def mixed(spark, rows, targets=TARGETS, **options):
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, uses int")
    goals = spark.createDataFrame(targets, "source string, target_share double, max_repeats long")
    chosen, report = mixture.mix(df, goals, source=F.col("source"), weight=F.lit(1.0), **options)
    return chosen.toPandas(), report.toPandas().set_index("source")


def test_mixture(spark):
    rows = [(i, f"text {i} " * 20, "abc"[i % 3] if i % 7 else "other", 1) for i in range(3000)] + [(9000, None, "a", 1), (9001, "", "a", 1), (9002, "x", None, 1)]
    rows += [(10_000 + i, "the same text " * 20, "b", 1) for i in range(500)]
    chosen, report = mixed(spark, rows)
    assert set(chosen.source) == {"a", "b", "c"} and report.loc["none", "actual_share"] == 0
    for s, share, most in TARGETS[:3]:
        assert abs(report.loc[s, "actual_share"] - share) < 0.01
        assert chosen[chosen.source == s].uses.max() <= most
    assert len(chosen[chosen.doc_id >= 10_000]) <= 1
    again, _ = mixed(spark, rows)
    pd.testing.assert_frame_equal(chosen.sort_values("doc_id", ignore_index=True), again.sort_values("doc_id", ignore_index=True))


def test_epochs_come_first(spark):
    rows = [(i, f"t{i:04d}" * 10, "b", 0) for i in range(100)]
    chosen, report = mixed(spark, rows, [("b", 1.0, 3)], total=int(2.5 * 100 * 50))
    assert len(chosen) == 100 and set(chosen.uses) == {2, 3} and (chosen.uses == 3).sum() == 50


def test_mixture_empty(spark):
    chosen, report = mixed(spark, [])
    assert not len(chosen) and report.chosen_bytes.sum() == 0
    chosen, report = mixed(spark, [(1, "x", "a", 1)], [])
    assert not len(chosen) and not len(report)
