"""A block and snapshot store on Parquet tables, with the calls of a backup client and its administration.

Tables below one folder: ``log`` (transactions, partitioned by batch), ``blocks`` (by batch), ``flags``
(states marked invalid).  Writes append a batch folder and never rewrite one, so a failed write leaves
the store as it was.  One writer per store.
"""

from __future__ import annotations

import os
import sys
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import glob
from quarry.functions.scalars import block_id
from quarry.operators import blocks as blk
from quarry.operators import graph, ingest, retention, snapshot, txlog
from quarry.operators.maintenance import show_block
from quarry.plans.scratch import Scratch, released
from quarry.sources import decode
from quarry.sources import store as files

LOG = "account string, dataset string, seq long, ts_ns long, op string, state string, block string, size long, unique_size long"
BLOCKS = "block string, links array<string>, data_type int, data binary"
FLAGS = "account string, dataset string, state string"


class Store:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _read(self, name: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.schema(schema + ", batch string").parquet(f"{self.path}/{name}").drop("batch")
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], schema)

    def _append(self, name: str, rows: DataFrame) -> None:
        rows.write.mode("error").parquet(f"{self.path}/{name}/batch={time.time_ns():020d}-{uuid.uuid4().hex[:8]}")

    # blocks
    def blocks(self) -> DataFrame:
        return self._read("blocks", BLOCKS)

    def store_blocks(self, rows: DataFrame) -> int:
        """Store rows (links, data) that the store lacks, after checking that their links exist.  Returns how many."""
        new = rows.select(block_id(F.col("links"), F.col("data")).alias("block"), "links", F.lit(0xFF).alias("data_type"), F.col("data").cast("binary").alias("data"))
        new = new.dropDuplicates(["block"]).join(self.blocks().select("block"), "block", "left_anti").persist()
        known = self.blocks().select("block").unionByName(new.select("block"))
        links = new.select(F.col("block").alias("src"), F.explode("links").alias("dst"))
        bad = graph.missing_links(links, known).take(1)
        if bad:
            raise ValueError(f"block {bad[0]['src']} links to {bad[0]['dst']}, which is not stored")
        n = new.count()
        if n:
            self._append("blocks", new)
        new.unpersist()
        return n

    def has_blocks(self, ids: DataFrame) -> DataFrame:
        return ids.join(self.blocks().select("block", F.lit(True).alias("found")), "block", "left").withColumn("found", F.coalesce("found", F.lit(False)))

    def read_blocks(self, ids: DataFrame) -> DataFrame:
        return self.blocks().join(ids.select("block"), "block", "left_semi")

    def verify_blocks(self) -> DataFrame:
        """Blocks whose content does not fit their id, and all that reach them or a missing block."""
        rows = self.blocks()
        links = rows.select(F.col("block").alias("src"), F.explode("links").alias("dst"))
        return graph.invalid_blocks(links, blk.content_failures(rows).select(F.col("block").alias("node")), rows.select("block"))

    def show_block(self, block: str, verify: bool = False) -> DataFrame:
        return show_block(self.blocks(), block, verify)

    # datasets and states
    def log(self) -> DataFrame:
        return self._read("log", LOG)

    def _write_tx(self, account, dataset, op, state, block=None, size=None, unique_size=None) -> None:
        at = self.log().filter((F.col("account") == account) & (F.col("dataset") == dataset)).agg(F.max("seq"), F.max("ts_ns")).first()
        now = max(time.time_ns(), at[1] or 0)
        self._append("log", self.spark.createDataFrame([(account, dataset, -1 if at[0] is None else at[0], now, op, state, block, size, unique_size)], LOG).withColumn("seq", F.col("seq") + 1))

    def add_dataset_state(self, account: str, dataset: str, state: str, block: str, size: int, unique_size: int) -> None:
        """Record a snapshot whose root block is stored."""
        if not self.blocks().filter(F.col("block") == block).take(1):
            raise ValueError(f"root block {block} is not stored")
        self._write_tx(account, dataset, "ADD", state, block, size, unique_size)

    def remove_dataset_state(self, account: str, dataset: str, state: str) -> None:
        self._write_tx(account, dataset, "DEL", state)

    def states(self) -> DataFrame:
        return txlog.invalidate(txlog.live_states(self.log()), self._read("flags", FLAGS))

    def invalidate_dataset_state(self, account: str, dataset: str, state: str) -> None:
        """Mark a state; replaying the log with rebuild_db forgets the mark."""
        self._append("flags", self.spark.createDataFrame([(account, dataset, state)], FLAGS))

    def rebuild_db(self) -> DataFrame:
        return txlog.live_states(self.log())

    def list_dataset(self, account: str, dataset: str) -> DataFrame:
        mine = self.states().filter((F.col("account") == account) & (F.col("dataset") == dataset))
        return txlog.state_listing(mine).orderBy("state")

    def get_account_info(self, account: str) -> DataFrame:
        states = self.states().filter(F.col("account") == account)
        return txlog.visible(txlog.dataset_size(states).join(txlog.list_hash(states), txlog.KEY)).orderBy("dataset")

    def list_accounts(self) -> DataFrame:
        return txlog.account_summary(txlog.dataset_size(self.states())).orderBy("account")

    def list_states_log(self, account: str, dataset: str) -> DataFrame:
        mine = self.log().filter((F.col("account") == account) & (F.col("dataset") == dataset))
        return txlog.with_deleted_mark(mine).orderBy("seq")

    def purge_states(self) -> DataFrame:
        """What a purge would keep of the logs."""
        return txlog.purge(self.log())

    # administration that rewrites
    def _replace(self, name: str, rows: DataFrame) -> None:
        """The table's new version beside the old one, then the old one put aside as ``name.bak`` and the new one in its place."""
        fs, at = self._fs()
        rows.write.mode("overwrite").parquet(f"{self.path}/{name}.new/batch={time.time_ns():020d}-{uuid.uuid4().hex[:8]}")
        fs.delete(at(f"{name}.bak"), True)
        if fs.exists(at(name)):
            fs.rename(at(name), at(f"{name}.bak"))
        fs.rename(at(f"{name}.new"), at(name))

    def _fs(self):
        """The store's file system, and paths in it by name."""
        hadoop = self.spark.sparkContext._jvm.org.apache.hadoop.fs
        at = lambda name: hadoop.Path(f"{self.path}/{name}")
        return at("log").getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), at

    def apply_purge(self) -> int:
        """Rewrite the logs without deleted states and their deletions; the old logs stay as log.bak.  Returns how many rows went."""
        before = self.log().count()
        self._replace("log", self.purge_states())
        return before - self.log().count()

    def move_dataset(self, account: str, dataset: str, to_account: str, to_dataset: str) -> None:
        """Merge one dataset's log into another's by time, the moved one first among equals."""
        log = self.log()
        mine = (F.col("account") == account) & (F.col("dataset") == dataset)
        theirs = (F.col("account") == to_account) & (F.col("dataset") == to_dataset)
        moved = log.filter(mine).withColumn("account", F.lit(to_account)).withColumn("dataset", F.lit(to_dataset))
        merged = txlog.merge_logs(moved, log.filter(theirs)).withColumn("seq", F.col("new_seq").cast("long") - 1)
        self._replace("log", log.filter(~mine & ~theirs).unionByName(merged.select(log.columns)))

    def delete_dataset(self, account: str, dataset: str | None = None) -> None:
        """Drop one dataset's log, or all of an account's; the old logs stay as log.bak."""
        self._replace("log", txlog.drop_dataset(self.log(), account, dataset))

    def collect_garbage(self) -> int:
        """Rewrite the blocks without those that no valid state reaches; the old ones stay as blocks.bak.  Returns how many went."""
        with released():
            dead = self.garbage().select("block").persist()
            n = dead.count()
            if n:
                self._replace("blocks", self.blocks().join(dead, "block", "left_anti"))
            dead.unpersist()
        return n

    def recover(self) -> int:
        """Rewrite the blocks without copies and without those whose content does not fit their id.  Returns how many rows went."""
        rows = self.blocks()
        before = rows.count()
        good = rows.join(blk.content_failures(rows).select("block").distinct(), "block", "left_anti").dropDuplicates(["block"])
        if good.count() < before:
            self._replace("blocks", good)
        return before - self.blocks().count()

    # snapshots of folders
    def snapshot(self, account: str, dataset: str, state: str | None = None) -> DataFrame:
        """The entries of a dataset's stored tree: of a state, or of its newest one, valid or not."""
        mine = self.states().filter((F.col("account") == account) & (F.col("dataset") == dataset))
        picked = mine.filter(F.col("state") == state) if state else txlog.latest_state(mine, valid_only=False)
        row = picked.select("block").first()
        if row is None:
            raise ValueError(f"{account}/{dataset} has no such state")
        return ingest.snapshot_entries(self.blocks(), row["block"], Scratch(self.spark, "snapshot"))

    def store_folder(self, account: str, dataset: str, folder: str, ignore: list[str] = (), platform: str = sys.platform, **chunk_sizes: int) -> dict:
        """Store a folder that executors mount and record its state.  Returns the state's id, sizes and unreadable files.

        Files that the newest valid snapshot has with the same size, mode and time are not read again, and keep its
        reference.  A file that cannot be read keeps its earlier entry, or is left out if it has none.
        """
        spark, scratch = self.spark, Scratch(self.spark, "store")
        state = f"{time.time_ns():016x}{uuid.uuid4().hex[:16]}"
        ignores = glob.compile_ignores([*glob.default_ignores(platform), *ignore], dict(os.environ), glob.separator_of(platform))
        tree = files.read(spark, "tree", folder).withColumn("is_dir", F.col("kind") == "dir")
        found = glob.ignored_by(F.concat(F.lit(folder.rstrip("/") + "/"), "path"), F.col("is_dir"), ignores)
        tree = scratch.table(snapshot.storable(tree).withColumn("_out", found.isNotNull()), "tree")
        gone = tree.filter("_out and is_dir").select(F.col("path").alias("_above"))
        above = F.expr("transform(sequence(1, size(split(path, '/'))), n -> substring_index(path, '/', n))")
        hidden = tree.select("path", F.explode(above).alias("_above")).join(gone, "_above", "left_semi").select("path").distinct()
        tree = scratch.table(tree.filter("not _out").join(hidden, "path", "left_anti").drop("_out", "is_dir", "blocks"), "kept")

        mine = self.states().filter((F.col("account") == account) & (F.col("dataset") == dataset))
        newest = txlog.latest_state(mine, valid_only=True).select("block").first()
        columns = "path string, parent string, name string, kind string, size long, mode int, mtime_ns long, reference_id string, content_type int, content string, target string"
        old = ingest.snapshot_entries(self.blocks(), newest["block"], scratch) if newest else spark.createDataFrame([], columns)
        o = old.filter("kind = 'file'").select("path", F.col("content").alias("_content"), F.col("content_type").alias("_type"), F.col("reference_id").alias("_reference"), F.col("size").alias("_size"), F.col("mode").alias("_mode"), F.col("mtime_ns").alias("_mtime"))
        same = F.col("_type").isNotNull() & (F.col("size") == F.col("_size")) & (F.col("mode") == F.col("_mode")) & (F.col("mtime_ns") == F.col("_mtime"))
        judged = scratch.table(tree.join(o, "path", "left").withColumn("same", F.coalesce(same, F.lit(False))), "judged")

        todo = judged.filter("kind = 'file' and size > 0 and not same")
        chunks = scratch.table(ingest.file_chunks(todo, folder, **chunk_sizes), "chunks")
        unread = chunks.filter("error is not null").select("path", "error")
        data = ingest.data_blocks(chunks.join(unread.select("path"), "path", "left_anti"))
        contents, chains = ingest.file_contents(data)
        new = judged.filter("not same").drop("same").join(contents, "path", "left").withColumn("reference_id", F.lit(state))
        entry = ["path", "name", "kind", "size", "mode", "mtime_ns", "reference_id", "content_type", "content", "target"]
        kept = judged.filter("same").select("path", "name", "kind", "size", "mode", "mtime_ns", F.col("_reference").alias("reference_id"), F.col("_type").alias("content_type"), F.col("_content").alias("content"), "target")
        stale = judged.join(unread.select("path"), "path", "left_semi").filter("_type is not null").select(
            "path", "name", "kind", F.col("_size").alias("size"), F.col("_mode").alias("mode"), F.col("_mtime").alias("mtime_ns"), F.col("_reference").alias("reference_id"), F.col("_type").alias("content_type"), F.col("_content").alias("content"), "target"
        )
        entries = new.join(unread.select("path"), "path", "left_anti").select(*entry).unionByName(kept.select(*entry)).unionByName(stale.select(*entry))
        parent = F.when(F.instr("path", "/") > 0, F.expr("substring(path, 1, length(path) - length(name) - 1)")).otherwise(F.lit(""))
        entries = scratch.table(ingest.content_types(entries.withColumn("parent", parent)), "entries")
        directories, root = ingest.directory_blocks(entries, scratch)
        block = ["block", "links", "data_type", "data"]
        self._add(data.select(*block).unionByName(chains.select(*block)).unionByName(directories.select(*block)))
        sizes = entries.agg(F.coalesce(F.sum("size"), F.lit(0)), F.coalesce(F.sum(F.when(F.col("reference_id") == state, F.col("size"))), F.lit(0))).first()
        self.add_dataset_state(account, dataset, state, root, int(sizes[0]), int(sizes[1]))
        out = {"state": state, "root": root, "size": int(sizes[0]), "unique_size": int(sizes[1]), "unreadable": [tuple(r) for r in unread.orderBy("path").take(1000)]}
        scratch.drop_all()
        return out

    def _add(self, rows: DataFrame) -> None:
        """Store finished blocks that the store lacks."""
        self._append("blocks", rows.dropDuplicates(["block"]).join(self.blocks().select("block"), "block", "left_anti"))

    def restore_folder(self, account: str, dataset: str, folder: str, state: str | None = None, below: str = "") -> int:
        """Write a stored tree, or what is below one of its paths, to a folder that executors mount.  Returns how many entries."""
        entries, blocks = self.snapshot(account, dataset, state), self.blocks()
        if below:
            below = below.strip("/")
            entries = entries.filter((F.col("path") == below) | F.col("path").startswith(below + "/"))
        none = lambda kind: F.lit(None).cast(kind)
        plain = entries.filter("kind <> 'file'").select("path", "kind", none("binary").alias("content"), none("int").alias("mode"), none("long").alias("mtime_ns"), "target")
        os.makedirs(folder, exist_ok=True)
        decode.restore_files(plain, folder)
        parts = ingest.file_parts(blocks, entries).join(blocks.select("block", "data"), "block")
        decode.restore_parts(parts, folder)
        decode.finish_files(entries.filter("kind = 'file'"), folder)
        return entries.count()

    def diff_folder(self, account: str, dataset: str, folder: str, state: str | None = None, strict: bool = True, **chunk_sizes: int) -> DataFrame:
        """(parent, name, status) of a folder against a stored tree; contents are compared by their chunks' ids."""
        stored = self.snapshot(account, dataset, state)
        tree = files.read(self.spark, "tree", folder)
        data = ingest.data_blocks(ingest.file_chunks(tree.filter("kind = 'file' and size > 0"), folder, **chunk_sizes).filter("error is null"))
        contents, _ = ingest.file_contents(data)
        parent = F.when(F.instr("path", "/") > 0, F.expr("substring(path, 1, length(path) - length(name) - 1)")).otherwise(F.lit(""))
        local = tree.join(contents, "path", "left").withColumn("parent", parent)
        return snapshot.diff(local, stored, strict=strict)

    def retention_plan(self, account: str, dataset: str, now: int, days: int = 0, weeks: int = 0, yearly: bool = False) -> DataFrame:
        """(state, kept) of a dataset whose state ids begin with their time."""
        states = self.states().filter((F.col("account") == account) & (F.col("dataset") == dataset))
        ns = F.conv(F.substring("state", 1, 16), 16, -10).cast("long")
        rows = states.select("dataset", ns.alias("id"), F.floor(ns / 1_000_000_000).cast("long").alias("ts"), "state")
        return retention.plan(rows, now, days, weeks, yearly).join(rows.select("id", "state"), "id").select("state", "kept")

    # garbage
    def garbage(self) -> DataFrame:
        """Stored blocks that no valid state reaches."""
        rows = self.blocks()
        links = rows.select(F.col("block").alias("src"), F.explode("links").alias("dst"))
        live = self.states().filter(F.col("flags").bitwiseAND(F.lit(txlog.INVALID)) == 0)
        marked = graph.reachable(links, live.select(F.col("block").alias("node")))
        return graph.garbage(rows.select("block", F.length("data").alias("size")), marked)
