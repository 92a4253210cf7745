"""Scratch tables that cut lineage through storage every executor can reach.

The folder is the session's ``spark.checkpoint.dir``.  Only where that is unset and the master is local
(tests, notebooks) a temporary folder of this machine is used; on a cluster it is an error, as
executors and the driver would each see a folder of their own.  A written table survives the loss of
any executor.  Tables that a returned plan still reads are deleted by ``released``, by ``clear``, or when the
interpreter ends.
"""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

_REPO = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
#: Rows of a narrow table that make a file, and files of a table at least (as many as it has partitions, if fewer).
ROWS_A_FILE, LEAST_FILES = 250_000, 8
_own_base: str | None = None
_open: list["Scratch"] = []


def shared_base(spark: SparkSession) -> str:
    """The folder that the cluster names; without one, a folder of our own if the master is local."""
    global _own_base
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local"):
        raise RuntimeError(f"spark.checkpoint.dir must name a folder that all executors share (master is {master})")
    if _own_base is None:
        _own_base = "file://" + tempfile.mkdtemp(prefix="quarry-")
    return _own_base


def clear() -> None:
    """Delete all scratch tables of this process.  DataFrames that operators returned can no longer be read."""
    for scratch in list(_open):
        scratch.drop_all()


@contextmanager
def released() -> Iterator[None]:
    """Delete the scratch tables that operators write inside, once what they returned has been stored elsewhere."""
    before = list(_open)
    try:
        yield
    finally:
        for scratch in [s for s in _open if s not in before]:
            scratch.drop_all()


def ship(spark: SparkSession) -> None:
    """Let Python workers started by this session import this package, and bound their batches.

    Rows with whole texts are large: where the session has Spark's default of 10,000 rows a batch,
    1,000 are taken.
    """
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(":") if p]
    if _REPO not in paths:
        env["PYTHONPATH"] = ":".join([_REPO, *paths])


class Scratch:
    """Tables of one computation, in a folder of its own under the shared base."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_base(spark)}/quarry-{label}-{uuid.uuid4().hex}"
        self._n = 0
        _open.append(self)

    def table(self, df: DataFrame, name: str = "t", by: str | None = None, rows: int | None = None) -> DataFrame:
        """Write df once, in a folder for each value of ``by`` if given, and return a DataFrame that reads it back.

        ``rows`` is a bound of the rows of a narrow table, where it is known: such a table gets a file for
        each ``ROWS_A_FILE`` of them, so that the rounds of a loop do not write a file for each partition.
        """
        self._n += 1
        if rows is not None:
            df = df.coalesce(max(LEAST_FILES, -(-rows // ROWS_A_FILE)))
        path = f"{self.root}/{self._n:03d}-{name}"
        writer = df.write.mode("overwrite")
        (writer.partitionBy(by) if by else writer).parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._quarry_path = path
        return out

    def counted(self, df: DataFrame, name: str = "t", rows: int | None = None, which: str = "true") -> tuple[DataFrame, int]:
        """As ``table``, and of how many rows ``which`` holds, seen while writing.  Tasks that run again may be counted twice; no row is missed."""
        seen = Observation()
        out = self.table(df.observe(seen, F.count_if(F.expr(which)).alias("n")), name, rows=rows)
        found = seen.get.get("n")  # a plan that turns out to be empty may lose the observation
        return out, out.filter(which).count() if found is None else found

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables that no returned plan reads any more."""
        for t in tables:
            path = getattr(t, "_quarry_path", None)
            if path:
                self._delete(path)

    def drop_all(self) -> None:
        if self in _open:
            _open.remove(self)
        try:
            self._delete(self.root)
        except Exception:  # the session may have ended before the interpreter
            pass

    def _delete(self, path: str) -> None:
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


atexit.register(clear)
