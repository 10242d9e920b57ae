"""Runs of ids over all rows, across the lots that the windows see."""

import random

import pytest
from compare import by_sql, rows

from quillspark.operators import relational
from quillspark.plans import search


def runs(ids):
    out = []
    for i in sorted(set(ids)):
        if out and out[-1][1] == i - 1:
            out[-1][1:] = [i, out[-1][2] + 1]
        else:
            out.append([i, i, 1])
    return [tuple(x) for x in out]


@pytest.mark.parametrize("lot", [2, 3, 1000])
def test_id_runs(spark, lot):
    rng = random.Random(lot)
    ids = [*range(990, 3010), *range(3011, 4000), 4000, 6000, -1, 0, 1, *(rng.randrange(10_000, 10_400) for _ in range(600)), 990]
    got = relational.id_runs(spark.createDataFrame([(i,) for i in ids], "id long"), "id", lot)
    assert sorted(tuple(r) for r in got.collect()) == runs(ids)


def test_crawl_gaps(spark, medium):
    sql = """WITH i AS (SELECT DISTINCT id FROM legal_documents), b AS (SELECT id, id - row_number() OVER (ORDER BY id) AS grp FROM i)
    SELECT min(id) AS first_id, max(id) AS last_id, count(*) AS n FROM b GROUP BY grp"""
    assert rows(search.crawl_gaps(spark, medium).toPandas()) == rows(by_sql(medium, sql))
