"""The fold against a plain loop over one dataset's snapshots."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from quarry.operators import retention

DAY = 86400


def plain(times, now, days, weeks, yearly):
    today = now // DAY * DAY
    daily = today - days * DAY if days else 0
    weekly = today - weeks * 7 * DAY if weeks else 0
    kept_day, kept_year, out = 0, 0, {}
    for i, (ts, id_) in enumerate(sorted(times, reverse=True)):
        day, year = ts // DAY * DAY, dt.datetime.fromtimestamp(ts, dt.timezone.utc).year
        gone = False
        if i >= 2 and now - ts > DAY and (not yearly or year == kept_year):
            if day == kept_day or (kept_day - day < 7 * DAY and day < daily):
                gone = True
            elif weekly < daily:
                gone = day < weekly
            else:
                gone = day < daily
        out[id_] = not gone
        if not gone:
            kept_day, kept_year = day, year
    return out


@pytest.mark.parametrize("days, weeks, yearly", [(0, 0, False), (30, 0, False), (0, 20, False), (0, 0, True), (30, 20, False), (30, 20, True), (400, 10, True), (200, 1, False)])
def test_fold(spark, days, weeks, yearly):
    rng, now = random.Random(days + weeks), 1_700_000_000
    rows = [(n, i, now - rng.randrange(0, 3 * 365 * DAY)) for n in range(12) for i in range(n * 5 if n > 3 else n)]
    states = spark.createDataFrame(rows, "dataset long, id long, ts long")
    got = {(r["dataset"], r["id"]): r["kept"] for r in retention.plan(states, now, days, weeks, yearly).collect()}
    want = {}
    for n in range(12):
        want |= {(n, k): v for k, v in plain([(ts, i) for d, i, ts in rows if d == n], now, days, weeks, yearly).items()}
    assert got == want


def test_newest_two_always_stay(spark):
    states = spark.range(6).select(F.lit(1).alias("dataset"), "id", (F.col("id") * 60).alias("ts"))
    kept = retention.plan(states, 1_700_000_000, 1, 1, False).filter("kept").collect()
    assert {r["id"] for r in kept} >= {4, 5}
