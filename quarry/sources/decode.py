"""Nested decoding of directory and chain blocks, and the restore sink."""

from __future__ import annotations

import os

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.plans.scratch import ship
from quarry.sources import formats

_FIELDS = [("name", T.StringType()), ("size", T.LongType()), ("mode", T.LongType()), ("mtime_ns", T.LongType()), ("reference_id", T.StringType())]
_FIELDS += [("content_type", T.IntegerType()), ("content", T.StringType()), ("decrypt_key", T.StringType()), ("target", T.StringType())]
ENTRY = T.ArrayType(T.StructType([T.StructField(n, t) for n, t in _FIELDS]))
LINK = T.ArrayType(T.StructType([T.StructField("block", T.StringType()), T.StructField("key", T.StringType())]))


@F.pandas_udf(ENTRY)
def directory_entries(data: pd.Series) -> pd.Series:
    return data.map(lambda b: None if b is None else formats.read_directory(bytes(b)))


@F.pandas_udf(LINK)
def chain_links(data: pd.Series) -> pd.Series:
    return data.map(lambda b: None if b is None else [{"block": x, "key": k} for x, k in formats.read_chain(bytes(b))])


def exploded_directories(blocks: DataFrame) -> DataFrame:
    """(dir_block, ordinal, entry fields) from directory blocks (block, data)."""
    ship(blocks.sparkSession)
    rows = blocks.select(F.col("block").alias("dir_block"), F.posexplode(directory_entries("data")).alias("ordinal", "e"))
    return rows.select("dir_block", "ordinal", "e.*")


def exploded_chains(blocks: DataFrame) -> DataFrame:
    ship(blocks.sparkSession)
    rows = blocks.select(F.col("block").alias("chain_block"), F.posexplode(chain_links("data")).alias("ordinal", "e"))
    return rows.select("chain_block", "ordinal", F.col("e.block").alias("block"), F.col("e.key").alias("key"))


def restore_files(files: DataFrame, folder: str) -> None:
    """Write files (path, kind, content, mode, mtime_ns, target) below a folder that all executors mount.

    Directories are made where files need them; each file gets its mode and time after its content.
    """

    def write(rows) -> None:
        for r in rows:
            path = os.path.join(folder, r["path"])
            os.makedirs(path if r["kind"] == "dir" else os.path.dirname(path) or folder, exist_ok=True)
            if r["kind"] == "link":
                if os.path.lexists(path):
                    os.unlink(path)
                os.symlink(r["target"], path)
                continue
            if r["kind"] == "file":
                with open(path, "wb") as f:
                    f.write(bytes(r["content"] or b""))
            if r["mode"] is not None:
                os.chmod(path, r["mode"] & 0o7777)
            if r["mtime_ns"] is not None:
                os.utime(path, ns=(r["mtime_ns"], r["mtime_ns"]))

    files.select("path", "kind", F.col("content").cast("binary").alias("content"), "mode", "mtime_ns", "target").foreachPartition(write)


def restore_parts(parts: DataFrame, folder: str) -> None:
    """Write the parts (path, offset, data) of files below a folder that all executors mount, each at its place.

    Parts of one file may be written by several tasks and again after a failure.
    """

    def write(rows) -> None:
        for r in rows:
            path = os.path.join(folder, r["path"])
            os.makedirs(os.path.dirname(path) or folder, exist_ok=True)
            fd = os.open(path, os.O_RDWR | os.O_CREAT)
            try:
                os.pwrite(fd, bytes(r["data"]), r["offset"])
            finally:
                os.close(fd)

    parts.select("path", "offset", "data").foreachPartition(write)


def finish_files(files: DataFrame, folder: str) -> None:
    """Give written files (path, size, mode, mtime_ns) their size, mode and time; an older, longer file is cut."""

    def write(rows) -> None:
        for r in rows:
            path = os.path.join(folder, r["path"])
            os.makedirs(os.path.dirname(path) or folder, exist_ok=True)
            with open(path, "ab") as f:
                f.truncate(r["size"])
            os.chmod(path, r["mode"] & 0o7777)
            os.utime(path, ns=(r["mtime_ns"], r["mtime_ns"]))

    files.select("path", "size", "mode", "mtime_ns").foreachPartition(write)
