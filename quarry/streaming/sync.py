"""Continuous replication of transaction logs with Structured Streaming.

The log's position lives in the query's checkpoint.  Each micro-batch decides on its transactions
against the replica's present states, then writes blocks before states, so that a state never
points to missing data.  A batch writes to folders of its own number, so that running it again after
a failure replaces what it wrote: transactions are processed at least once, with the effect of once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quarry.operators.sync import sync_decisions
from quarry.operators.txlog import STATE, live_states

_LOG = "account string, dataset string, seq long, ts_ns long, op string, state string, block string, size long, unique_size long"


class Replica:
    """A replica's folder: applied transactions and received blocks, by batch."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _read(self, name: str, schema: str, before: int | None) -> DataFrame:
        try:
            rows = self.spark.read.parquet(f"{self.path}/{name}")
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
            return self.spark.createDataFrame([], schema + ", batch long")
        return rows if before is None else rows.filter(F.col("batch") < before)

    def log(self, before: int | None = None) -> DataFrame:
        """Applied transactions; ``before`` leaves out what a repeated batch has written already."""
        return self._read("log", _LOG, before)

    def states(self, before: int | None = None) -> DataFrame:
        return live_states(self.log(before).withColumn("seq", F.struct("batch", "seq"))).drop("seq")

    def blocks(self, before: int | None = None) -> DataFrame:
        return self._read("blocks", "block string", before)

    def write(self, rows: DataFrame, name: str, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{self.path}/{name}/batch={batch}")


def apply_batch(batch: DataFrame, number: int, replica: Replica, dry_run: bool = False) -> DataFrame:
    """Decide on one batch and, unless it is a dry run, write what it changes.  Returns the decisions."""
    decided = sync_decisions(batch, replica.states(number)).persist()
    if not dry_run:
        todo = decided.filter(F.col("action").isin("add", "delete"))
        new = todo.filter("action = 'add'").select("block").distinct().join(replica.blocks(number).select("block"), "block", "left_anti")
        replica.write(new, "blocks", number)
        replica.write(todo.drop("action"), "log", number)
    return decided


def replicate(stream: DataFrame, replica: Replica, checkpoint: str, interval: str | None = None) -> StreamingQuery:
    """Start replication of a log stream; without an interval, what is there now is processed and the query ends.

    One query runs per checkpoint.  After a log has been rewritten, start with a new checkpoint.
    """

    def run(batch: DataFrame, number: int) -> None:
        apply_batch(batch, number, replica).unpersist()

    writer = stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()


def live_state_stream(stream: DataFrame) -> DataFrame:
    """Live states of a log stream as an updating aggregate; a state whose last transaction deletes it has op 'DEL'."""
    return stream.groupBy(*STATE).agg(F.max_by(F.struct("op", "block", "size", "unique_size"), "seq").alias("t")).select(*STATE, "t.*")


def transfer_statistics(query: StreamingQuery) -> dict:
    """Batches, transactions, seconds and transactions a second of a replication so far, from its progress reports."""
    seen = {p["batchId"]: p for p in query.recentProgress if p["numInputRows"]}
    rows = sum(p["numInputRows"] for p in seen.values())
    seconds = sum(p["batchDuration"] for p in seen.values()) / 1000
    return {"batches": len(seen), "rows": rows, "seconds": seconds, "rows_per_second": rows / seconds if seconds else 0.0}
