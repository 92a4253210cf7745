"""Retention plans.

Whether a snapshot goes depends on the last one that stayed, not on its neighbour, so the plan is a
fold over a dataset's snapshots from newest to oldest.  Snapshots are dealt by dataset and sorted, by Spark's
spilling sort; the fold then streams over Arrow batches and holds one snapshot's day and year, so time is
linear and no dataset has to fit in memory.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.functions.scalars import DAY
from quarry.plans.scratch import ship


class Fold:
    """The rule, with the state that it carries from one snapshot of a dataset to the next."""

    def __init__(self, now: int, days: int, weeks: int, yearly: bool):
        self.now, self.yearly = now, yearly
        today = now - now % DAY
        self.daily = today - days * DAY if days > 0 else 0
        self.weekly = today - weeks * 7 * DAY if weeks > 0 else 0
        self.last = self.weekly if self.weekly < self.daily else self.daily
        self.begin()

    def begin(self) -> None:
        self.seen, self.day, self.year = 0, 0, 0

    def keeps(self, ts: int, year: int) -> bool:
        day = ts - ts % DAY
        goes = self.seen >= 2 and self.now - ts > DAY and (not self.yearly or year == self.year)
        goes = goes and (day == self.day or self.day - day < 7 * DAY and day < self.daily or day < self.last)
        self.seen += 1
        if not goes:
            self.day, self.year = day, year
        return not goes


def plan(states: DataFrame, now: int, days: int = 0, weeks: int = 0, yearly: bool = False) -> DataFrame:
    """(dataset, id, ts, kept) for states (dataset, id, ts in seconds); the newest two always stay.

    days, weeks: 0 is unlimited.  Day arithmetic is UTC; years follow the session's time zone.  Null
    datasets are one dataset; a null time is kept and counts for nothing.
    """
    ship(states.sparkSession)
    rows = states.select("dataset", F.col("id").cast("long").alias("id"), F.col("ts").cast("long").alias("ts"))
    dealt = rows.withColumn("year", F.year(F.timestamp_seconds("ts"))).repartition("dataset")
    dealt = dealt.sortWithinPartitions("dataset", F.col("ts").desc_nulls_last(), F.desc("id"))
    schema = T.StructType([*rows.schema.fields, T.StructField("kept", T.BooleanType(), False)])

    def run(batches):
        fold, last = Fold(now, days, weeks, yearly), object()
        for batch in batches:
            kept = np.ones(len(batch), bool)
            for k, (dataset, ts, year) in enumerate(zip(*[batch.column(c).to_pylist() for c in ("dataset", "ts", "year")])):
                if dataset != last:
                    last = dataset
                    fold.begin()
                if ts is not None:
                    kept[k] = fold.keeps(ts, year)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("dataset", "id", "ts")], pa.array(kept)], names=schema.names)

    return dealt.mapInArrow(run, schema)
