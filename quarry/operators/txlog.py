"""Transaction logs: replay, statistics, delete notions, purge, merge and edits.

A log has the columns account, dataset, seq (append order), ts_ns, op ('ADD' or 'DEL'), state,
block, size, unique_size.  Every operator is one shuffle by (account, dataset) or finer.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.scalars import hex64

KEY = ["account", "dataset"]
STATE = [*KEY, "state"]
INVALID = 0x80


def live_states(log: DataFrame) -> DataFrame:
    """The last transaction of each state, if it adds; flags start at zero.

    max_by keeps one row per state on the map side, so no log is sorted.
    """
    last = log.groupBy(*STATE).agg(F.max_by(F.struct("op", "seq", "block", "size", "unique_size"), "seq").alias("t"))
    return last.filter("t.op = 'ADD'").select(*STATE, "t.block", "t.size", "t.unique_size", "t.seq", F.lit(0).alias("flags"))


def dataset_size(states: DataFrame) -> DataFrame:
    """Per dataset: states, latest state, and the catalogue's size: largest size (0 at least) plus unique sizes.

    Datasets without states have no row, as they are not listed.
    """
    return states.groupBy(*KEY).agg(
        F.count(F.lit(1)).alias("n_states"),
        F.max("state").alias("latest_state"),
        (F.greatest(F.lit(0), F.max("size")) + F.sum("unique_size")).cast("long").alias("size"),
    )


def list_hash(states: DataFrame) -> DataFrame:
    """Per dataset: MD5 over its states' serialised entries in order of id."""
    entry = F.concat(
        F.lower(F.lpad(F.hex("flags"), 2, "0")), F.col("state"), F.col("block"), hex64(F.col("size")), hex64(F.col("unique_size"))
    )
    ordered = F.sort_array(F.collect_list(F.struct("state", entry.alias("e"))))
    return states.groupBy(*KEY).agg(F.md5(F.unhex(F.array_join(F.transform(ordered, lambda x: x["e"]), ""))).alias("list_h"))


def with_deleted_mark(log: DataFrame) -> DataFrame:
    """Listing mark: whether the log deletes the state anywhere, before or after."""
    return log.withColumn("deleted", F.max(F.col("op") == "DEL").over(Window.partitionBy(*STATE)))


def with_later_delete(log: DataFrame) -> DataFrame:
    """Whether the state is deleted after this transaction."""
    after = Window.partitionBy(*STATE).orderBy("seq").rowsBetween(1, Window.unboundedFollowing)
    return log.withColumn("later_delete", F.coalesce(F.max(F.col("op") == "DEL").over(after), F.lit(False)))


def purge(log: DataFrame) -> DataFrame:
    """Additions without a later delete; repeated additions stay."""
    dels = log.filter("op = 'DEL'").groupBy(*STATE).agg(F.max("seq").alias("_del"))
    return log.filter("op = 'ADD'").join(dels, STATE, "left").filter("_del is null or _del < seq").drop("_del")


def merge_logs(source: DataFrame, target: DataFrame) -> DataFrame:
    """Both logs in order of time; the source comes first among equal times.  new_seq numbers each log."""
    both = source.withColumn("side", F.lit(0)).unionByName(target.withColumn("side", F.lit(1)))
    order = Window.partitionBy(*KEY).orderBy("ts_ns", "side", "seq")
    return both.withColumn("new_seq", F.row_number().over(order).cast("long"))


def move_dataset(log: DataFrame, account, source, target) -> DataFrame:
    """A dataset's log merged into another's of the same account; other logs stay."""
    mine = F.col("account") == F.lit(account)
    src = log.filter(mine & (F.col("dataset") == F.lit(source))).withColumn("dataset", F.lit(target).cast(log.schema["dataset"].dataType))
    dst = log.filter(mine & (F.col("dataset") == F.lit(target)))
    rest = log.filter(~(mine & F.col("dataset").isin(source, target)))
    merged = merge_logs(src, dst).drop("side", "seq").withColumnRenamed("new_seq", "seq")
    return merged.select(log.columns).unionByName(rest)


def clock_violations(log: DataFrame) -> DataFrame:
    """Transactions stamped before their predecessor; equal stamps are fine."""
    order = Window.partitionBy(*KEY).orderBy("seq")
    return log.withColumn("prev_ts_ns", F.lag("ts_ns").over(order)).filter(F.col("ts_ns") < F.col("prev_ts_ns"))


def assert_clock(log: DataFrame) -> DataFrame:
    """The log itself; running it fails at the first transaction stamped before its predecessor."""
    order = Window.partitionBy(*KEY).orderBy("seq")
    ok = F.coalesce(F.col("ts_ns") >= F.lag("ts_ns").over(order), F.lit(True))
    checked = log.withColumn("_ok", F.when(ok, F.lit(True)).otherwise(F.raise_error(F.lit("transaction time goes back"))))
    return checked.filter("_ok").drop("_ok")


def add_state(log: DataFrame, account, dataset, state, block, size, unique_size, ts_ns) -> DataFrame:
    """The log with an addition appended to one dataset."""
    return _append(log, account, dataset, ts_ns, "ADD", state, block, size, unique_size)


def remove_state(log: DataFrame, account, dataset, state, ts_ns) -> DataFrame:
    """The log with a deletion appended, whether or not the state is there."""
    return _append(log, account, dataset, ts_ns, "DEL", state, None, None, None)


def _append(log: DataFrame, account, dataset, ts_ns, op, state, block, size, unique_size) -> DataFrame:
    at = log.filter((F.col("account") == F.lit(account)) & (F.col("dataset") == F.lit(dataset)))
    values = {"account": account, "dataset": dataset, "ts_ns": ts_ns, "op": op, "state": state, "block": block, "size": size, "unique_size": unique_size}
    new = at.agg((F.coalesce(F.max("seq"), F.lit(-1)) + 1).alias("seq")).select(
        *[(F.col("seq") if c == "seq" else F.lit(values.get(c))).cast(log.schema[c].dataType).alias(c) for c in log.columns]
    )
    return log.unionByName(new)


def delete_states(log: DataFrame, states: DataFrame, ts_ns: int) -> DataFrame:
    """The log with a tombstone for each row of states (account, dataset, state)."""
    ends = log.groupBy(*KEY).agg(F.max("seq").alias("_end"))
    order = Window.partitionBy(*KEY).orderBy("state")
    new = states.join(ends, KEY).withColumn("seq", F.col("_end") + F.row_number().over(order))
    given = {"ts_ns": F.lit(ts_ns), "op": F.lit("DEL")}
    cols = [given.get(c, F.col(c) if c in [*STATE, "seq"] else F.lit(None)).cast(log.schema[c].dataType).alias(c) for c in log.columns]
    return log.unionByName(new.select(*cols))


def drop_dataset(log: DataFrame, account, dataset=None) -> DataFrame:
    """Logs without one dataset, or without a whole account."""
    gone = F.col("account") == F.lit(account)
    return log.filter(~(gone if dataset is None else gone & (F.col("dataset") == F.lit(dataset))))


def invalidate(states: DataFrame, bad: DataFrame) -> DataFrame:
    """The invalid flag set on the states listed in bad; the log does not learn of it."""
    marks = bad.select(*STATE).distinct().withColumn("_bad", F.lit(INVALID))
    return states.join(marks, STATE, "left").withColumn("flags", F.col("flags").bitwiseOR(F.coalesce("_bad", F.lit(0)))).drop("_bad")


def latest_state(states: DataFrame, valid_only: bool) -> DataFrame:
    """The newest state of each dataset; listing and storing skip invalid ones, restoring does not."""
    rows = states.filter(F.col("flags").bitwiseAND(F.lit(INVALID)) == 0) if valid_only else states
    pick = F.max_by(F.struct("state", "block", "size", "unique_size", "flags"), "state").alias("t")
    return rows.groupBy(*KEY).agg(pick).select(*KEY, "t.*")


def select_state(states: DataFrame, state: str) -> DataFrame:
    """A state by its id, or '.' for the newest valid one; an id matches invalid states too."""
    return latest_state(states, True) if state == "." else states.filter(F.col("state") == state)


def state_listing(states: DataFrame) -> DataFrame:
    note = F.when(F.col("flags").bitwiseAND(F.lit(INVALID)) != 0, F.lit(" (INVALID)")).otherwise(F.lit(""))
    return states.withColumn("note", note)


def account_summary(datasets: DataFrame) -> DataFrame:
    """Per account: listed datasets, states and total size."""
    return datasets.groupBy("account").agg(
        F.count(F.lit(1)).alias("n_datasets"), F.sum("n_states").alias("n_states"), F.sum("size").cast("long").alias("size")
    )


def with_name_rank(datasets: DataFrame, name: str = "dataset") -> DataFrame:
    """Place of each dataset in its account's listing, by the name's bytes."""
    return datasets.withColumn("rank", F.row_number().over(Window.partitionBy("account").orderBy(name)))


def visible(datasets: DataFrame, name: str = "dataset") -> DataFrame:
    """Datasets whose name does not begin with a control character or a space."""
    return datasets.filter(F.ascii(name) > 32)


def resolve(rows: DataFrame, given: str, name: str, hash_hex: str) -> DataFrame:
    """Rows whose name is given, or whose hash is (as hex or base64url)."""
    from quarry.functions.scalars import parse_hash

    return rows.filter((F.col(name) == given) | (F.col(hash_hex) == F.coalesce(parse_hash(F.lit(given)), F.lit(""))))


def roots(states: DataFrame, accounts: DataFrame, skip_invalid: bool = True) -> DataFrame:
    """Root blocks that protect their trees: of states whose account has a record.

    Invalid states are skipped, or fail the query if skip_invalid is false.
    """
    rows = states.join(accounts.select("account").distinct(), "account", "left_semi")
    bad = F.col("flags").bitwiseAND(F.lit(INVALID)) != 0
    if skip_invalid:
        return rows.filter(~bad)
    return rows.filter(F.when(bad, F.raise_error(F.lit("a state is invalid")).isNull()).otherwise(F.lit(True)))


def of_tenant(rows: DataFrame, account: str, by_hash: str | None = None) -> DataFrame:
    """The rows that a session of this account may see: its own, by name or by the name's hash.

    The condition is on a plain column, so that it reaches the scan and prunes partitions by account.
    """
    if by_hash:
        return rows.filter(F.col(by_hash) == hashlib.md5(account.encode("utf-8")).hexdigest())
    return rows.filter(F.col("account") == account)
