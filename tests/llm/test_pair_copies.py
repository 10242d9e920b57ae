"""Copies of one broken answer are no proof that a sentence ends there."""

from quillspark.llm import pairs
from test_pairs import VI


def test_copies_count_once(spark):
    broken = VI + " Phải nộp bản sao giấy"
    rows = [(i, broken) for i in range(30)] + [(100 + i, f"{VI} Lần {'a' * i} xong hằng năm.") for i in range(1, 6)] + [(200, VI[:-1]), (None, broken)]
    got = {r.k: (r.likelihood, r.word_likelihood) for r in pairs.end_likelihood(spark.createDataFrame(rows, "k long, t string"), "k", "t").collect()}
    assert set(got) == {*range(30), 200, None}
    assert all(got[k] == (0.0, 0.0) for k in [*range(30), None])
    assert got[200][0] > pairs.END_LIKELIHOOD and got[200][1] > pairs.WORD_END_LIKELIHOOD
