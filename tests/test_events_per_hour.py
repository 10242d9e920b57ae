"""Hourly events over all rows, across the days that the windows see."""

import datetime as dt

from compare import by_sql, rows

from quillspark.plans import profiles


def test_events_over_midnight(spark, tmp_path, small):
    hours = {(1, 22): 2, (1, 23): 4, (2, 0): 6, (2, 5): 4, (4, 1): 9}
    at = [(dt.datetime(2024, 1, d, h, 30),) for (d, h), n in hours.items() for _ in range(n)]
    spark.createDataFrame([*at, (None,)], "ts timestamp").write.parquet(f"{tmp_path}/events.parquet")
    got = [(r.n, r.change, r.rate) for r in profiles.events_per_hour(spark, str(tmp_path)).orderBy("hour").collect()]
    assert got == [(2, None, 2.0), (4, 2, 3.0), (6, 2, 4.0), (4, -2, 4.0), (9, 5, 5.0)]
    sql = """WITH h AS (SELECT date_trunc('hour', ts) AS hour, count(*) AS n FROM events WHERE ts IS NOT NULL GROUP BY 1)
    SELECT hour, n, n - lag(n) OVER (ORDER BY hour) AS change, round(avg(n) OVER (ORDER BY hour ROWS UNBOUNDED PRECEDING), 6) AS rate FROM h"""
    assert rows(profiles.events_per_hour(spark, small).toPandas()) == rows(by_sql(small, sql))
