"""Maintenance and session operators: listings, counters, caches, positions."""

from __future__ import annotations

import json
import os
import shutil
import time
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.scalars import compact_human_size, compression_ratio, content_id, verify_block
from quarry.operators.snapshot import CHAIN, DIRECTORY, FILE, LINK


def show_block(blocks: DataFrame, block: str, verify: bool = False) -> DataFrame:
    """One block's size, storage and links, a row for each link; with verify, whether its content fits its id."""
    one = blocks.filter(F.col("block") == block)
    kind = F.when(F.col("data_type") == 0x01, " (zlib compressed data)").otherwise(" (raw data)")
    ok = verify_block(F.col("block"), F.col("links"), F.col("data")) if verify else F.lit(None).cast("boolean")
    head = one.withColumn("size_text", F.concat(compact_human_size(F.length("data")), kind)).withColumn("verified", ok)
    return head.select("block", "size_text", "verified", F.posexplode_outer("links").alias("ordinal", "link"))


def has_content_block(content_type: Column) -> Column:
    return content_type.isin(DIRECTORY, FILE, CHAIN)


def has_decrypt_key(content_type: Column) -> Column:
    return content_type == FILE


def has_link(content_type: Column) -> Column:
    return content_type == LINK


def session_counters(entries: DataFrame) -> DataFrame:
    """Directories, files, unchanged and different files, bytes read and stored of a run (kind, change, size, stored)."""
    file = F.col("kind") == "file"
    return entries.agg(
        F.count_if(F.col("kind") == "dir").alias("directories"), F.count_if(file).alias("files"),
        F.count_if(file & (F.col("change") == "same")).alias("unchanged"), F.count_if(file & (F.col("change") != "same")).alias("different"),
        F.coalesce(F.sum(F.when(file & (F.col("change") != "same"), F.col("size"))), F.lit(0)).alias("read_bytes"),
        F.coalesce(F.sum("stored"), F.lit(0)).alias("write_bytes"),
    ).withColumn("compression", compression_ratio(F.col("read_bytes"), F.col("write_bytes")))


def keep_unreadable(new: DataFrame, reference: DataFrame, unreadable: DataFrame) -> DataFrame:
    """New entries, with the reference entry in place of each file that could not be read (columns path, ...)."""
    gone = unreadable.select("path")
    return new.join(gone, "path", "left_anti").unionByName(reference.join(gone, "path", "left_semi").select(new.columns))


def carried_references(new: DataFrame, old: DataFrame, current: str) -> DataFrame:
    """Entries with the snapshot that last changed them: unchanged content keeps the earlier reference."""
    o = old.select("path", F.col("content").alias("_c"), F.col("reference_id").alias("_r"))
    same = F.col("content").eqNullSafe(F.col("_c")) & F.col("_r").isNotNull()
    return new.join(o, "path", "left").withColumn("reference_id", F.when(same, F.col("_r")).otherwise(F.lit(current))).drop("_c", "_r")


def newest_reference(entries: DataFrame) -> str | None:
    """The largest reference id among entries: where an interrupted run stood."""
    return entries.agg(F.max("reference_id")).first()[0]


def file_history(snapshots: DataFrame) -> DataFrame:
    """The distinct versions of each path over snapshots (path, reference_id), oldest first."""
    order = Window.partitionBy("path").orderBy("reference_id")
    return snapshots.select("path", "reference_id").distinct().withColumn("version", F.row_number().over(order))


def virtual_root(sources: Iterable[tuple[str, DataFrame]]) -> DataFrame:
    """Several trees under one root, each below its path's last segment, in order of that name."""
    out = None
    for path, tree in sorted(sources, key=lambda s: s[0].rstrip("/").rsplit("/", 1)[-1]):
        name = path.rstrip("/").rsplit("/", 1)[-1]
        moved = tree.withColumn("path", F.when(F.col("path") == "", F.lit(name)).otherwise(F.concat(F.lit(name + "/"), F.col("path"))))
        out = moved if out is None else out.unionByName(moved)
    if out is None:
        raise ValueError("no source paths")
    return out


def compact_index(slots: DataFrame) -> DataFrame:
    """Index without invalid slots, marks cleared; the file ends after its last live slot."""
    live = slots.filter(F.col("flags").bitwiseAND(F.lit(8)) == 0).withColumn("flags", F.col("flags").bitwiseAND(F.lit(~4 & 0xFFFF)))
    return live.withColumn("file_end", F.max(F.col("ix_offset") + 24).over(Window.partitionBy("ix_file")))


def invalidate_slots(slots: DataFrame, bad: DataFrame) -> DataFrame:
    marks = bad.select("block").distinct().withColumn("_bad", F.lit(8))
    return slots.join(marks, "block", "left").withColumn("flags", F.col("flags").bitwiseOR(F.coalesce("_bad", F.lit(0)))).drop("_bad")


def slot_faults(slots: DataFrame) -> DataFrame:
    """Slots that stand off the grid, or before their id's home."""
    home = F.lit(16) + F.lit(24) * F.conv(F.substring("block", -6, 6), 16, 10).cast("long")
    fault = F.when((F.col("ix_offset") - 16) % 24 != 0, "off the grid").when((F.col("ix_file") == 0) & (F.col("ix_offset") < home), "before home")
    return slots.withColumn("fault", fault).filter("fault is not null")


def newest_first(files: DataFrame) -> DataFrame:
    """Resume files by time of change, newest first: a total order, made by ranges and not in one task."""
    return files.orderBy(F.desc("mtime_ns"), "path")


def cache_name(dataset: str, root: str) -> str:
    """Name of a snapshot's local cache table; separators and colons are not kept."""
    return f"{dataset.replace('/', '_').replace(':', '_')}.{root}.cache"


def stale_caches(caches: DataFrame, dataset: str, root: str) -> DataFrame:
    """Caches (name, dataset) of a dataset that its new snapshot replaces."""
    return caches.filter((F.col("dataset") == dataset) & (F.col("name") != cache_name(dataset, root)))


class Positions:
    """Replication positions by account and dataset, as one JSON object; resetting one starts its log again."""

    def __init__(self, text: str | None = None):
        self.at: dict[str, int] = json.loads(text) if text else {}

    @staticmethod
    def key(account: str, dataset: str) -> str:
        return f"{account}.{dataset}"

    def get(self, account: str, dataset: str) -> int:
        return self.at.get(self.key(account, dataset), 0)

    def set(self, account: str, dataset: str, position: int) -> None:
        self.at[self.key(account, dataset)] = position

    def reset(self, account: str, dataset: str) -> None:
        self.at.pop(self.key(account, dataset), None)

    def dumps(self) -> str:
        return json.dumps(self.at, sort_keys=True)


def parse_host(text: str, default_port: int) -> tuple[str, int]:
    """host, host:port, [v6] or [v6]:port."""
    if text.startswith("["):
        host, _, rest = text[1:].partition("]")
        return host, int(rest[1:]) if rest.startswith(":") else default_port
    if text.count(":") == 1:
        host, port = text.split(":")
        return host, int(port)
    return text, default_port


def name_hash(name: Column) -> Column:
    return content_id(name)


# Slots of an index file, and the free bytes below which nothing is stored.
INDEX_FILE = 16 + 24 * (2**24 + 682)
LEAST_INDEX_FREE, LEAST_DATA_FREE = INDEX_FILE + INDEX_FILE // 20, 1 << 26


def has_room(index_dir: str, data_dir: str, size: int) -> bool:
    """Whether a block of this size may be stored: a new index file must fit, and the block with some room."""
    return shutil.disk_usage(index_dir).free >= LEAST_INDEX_FREE and shutil.disk_usage(data_dir).free >= size + LEAST_DATA_FREE


@contextmanager
def exclusive(path: str, wait: float = 5.0) -> Iterator[None]:
    """One runner at a time: an advisory lock on a file, or TimeoutError if another holds it for longer than ``wait`` seconds."""
    import fcntl

    fd, end = os.open(path, os.O_RDWR | os.O_CREAT), time.monotonic() + wait
    try:
        while True:
            try:
                fcntl.flock(fd, fcntl.LOCK_EX | fcntl.LOCK_NB)
                break
            except BlockingIOError:
                if time.monotonic() > end:
                    raise TimeoutError(f"{path} is locked by another runner") from None
                time.sleep(0.05)
        yield
    finally:
        os.close(fd)
