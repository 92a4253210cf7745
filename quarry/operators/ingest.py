"""Trees to blocks and back: the chunks of files, chain and directory blocks from the leaves up, and their decoding.

Blocks are (block, links, data_type, data).  A file is stored as its chunks; one of several chunks has a
chain block over them.  A directory block lists its entries in order of name and links to their contents,
so a tree's root id names all of it.  A level of directories is one DataFrame step.
"""

from __future__ import annotations

import os

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions.codecs import RAW
from quarry.functions.scalars import block_id
from quarry.operators import chunking
from quarry.operators.snapshot import CHAIN, DIRECTORY, EMPTY, FILE, LINK
from quarry.plans.scratch import Scratch, ship
from quarry.sources import decode, formats

#: Fixed value: the key of contents that are not encrypted.
NO_KEY = "0" * 32


def file_chunks(files: DataFrame, folder: str, least: int = chunking.MIN_BLOCK, most: int = chunking.MAX_BLOCK) -> DataFrame:
    """(path, ordinal, data, error) of the files (path) below a folder that executors mount.

    Files are streamed.  One that cannot be read has a row with the error and no data.
    """
    ship(files.sparkSession)

    def run(batches):
        for batch in batches:
            for path in batch.column("path").to_pylist():
                n = 0
                try:
                    with open(os.path.join(folder, path), "rb") as f:
                        for n, data in enumerate(chunking.stream_chunks(f, least, most)):
                            yield pa.RecordBatch.from_pydict({"path": [path], "ordinal": [n], "data": [data], "error": [None]}, schema=schema)
                except OSError as e:
                    yield pa.RecordBatch.from_pydict({"path": [path], "ordinal": [-1], "data": [None], "error": [e.strerror]}, schema=schema)

    schema = pa.schema([("path", pa.string()), ("ordinal", pa.int32()), ("data", pa.binary()), ("error", pa.string())])
    return files.select("path").mapInArrow(run, "path string, ordinal int, data binary, error string")


def data_blocks(chunks: DataFrame) -> DataFrame:
    """(path, ordinal, block, links, data_type, data): chunks as blocks without links."""
    none = F.array().cast("array<string>")
    return chunks.select("path", "ordinal", block_id(none, F.col("data")).alias("block"), none.alias("links"), F.lit(RAW).alias("data_type"), "data")


def _packed(rows: DataFrame, field: str, pack) -> DataFrame:
    """rows with data: the binary that pack makes of a nested field."""
    ship(rows.sparkSession)
    names = [c for c in rows.columns if c != field]

    def run(batches):
        for batch in batches:
            data = pa.array([pack(x) for x in batch.column(field).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], data], names=[*names, "data"])

    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in names)
    return rows.mapInArrow(run, f"{kinds}, data binary")


def _identified(rows: DataFrame) -> DataFrame:
    """rows (links, data, ...) with block and data_type."""
    return rows.withColumn("block", block_id(F.col("links"), F.col("data"))).withColumn("data_type", F.lit(RAW))


def file_contents(blocks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(path, content_type, content) of files by their data blocks, and the chain blocks that are needed."""
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("ordinal", "block"))), lambda x: x["block"])
    per = blocks.groupBy("path").agg(ordered.alias("links"))
    keyed = F.transform("links", lambda b: F.struct(b.alias("block"), F.lit(NO_KEY).alias("key")))
    chains = per.filter(F.size("links") > 1).withColumn("chain", keyed)
    chains = _identified(_packed(chains, "chain", lambda ls: formats.pack_chain([(x["block"], x["key"]) for x in ls])))
    single = per.filter(F.size("links") == 1).select("path", F.lit(FILE).alias("content_type"), F.col("links")[0].alias("content"))
    return single.unionByName(chains.select("path", F.lit(CHAIN).alias("content_type"), F.col("block").alias("content"))), chains.drop("path")


def directory_blocks(entries: DataFrame, scratch: Scratch) -> tuple[DataFrame, str]:
    """Blocks (block, links, data_type, data) of all directories, and the root's id.

    entries: path, parent, name, kind, size, mode, mtime_ns, reference_id, content_type, content, target; a
    directory's content is filled in here.  The root, with path '', is no entry.
    """
    depth = F.when(F.col("path") == "", 0).otherwise(F.size(F.split("path", "/")))
    rows = scratch.table(entries.withColumn("depth", depth), "entries", by="depth")
    deepest = rows.agg(F.max("depth")).first()[0] or 0
    done, below = None, None
    for d in range(deepest, -1, -1):
        inside = rows.filter(F.col("depth") == d + 1)
        if below is not None:
            inside = inside.join(below.select(F.col("path").alias("_path"), F.col("block").alias("_dir")), F.col("path") == F.col("_path"), "left").withColumn("content", F.coalesce("_dir", "content"))
        key = F.when(F.col("content_type") == FILE, F.lit(NO_KEY)).alias("decrypt_key")
        entry = F.struct("name", "size", "mode", "mtime_ns", "reference_id", "content_type", "content", key, "target")
        lists = inside.groupBy(F.col("parent").alias("path")).agg(F.sort_array(F.collect_list(entry)).alias("entries"))
        here = rows.filter((F.col("depth") == d) & (F.col("kind") == "dir")).select("path") if d else rows.sparkSession.createDataFrame([("",)], "path string")
        lists = here.join(lists, "path", "left")
        links = F.coalesce(F.transform(F.filter("entries", lambda e: e["content"].isNotNull()), lambda e: e["content"]), F.array().cast("array<string>"))
        level = _packed(lists.withColumn("links", links), "entries", lambda es: formats.pack_directory(es or []))
        below = scratch.table(_identified(level), "directories")
        done = below if done is None else done.unionByName(below)
    root = below.first()["block"]
    return done.select("block", "links", "data_type", "data"), root


def snapshot_entries(blocks: DataFrame, root: str, scratch: Scratch) -> DataFrame:
    """(path, parent, name, kind, size, mode, mtime_ns, reference_id, content_type, content, target) of a stored tree.

    A level of directories is read a round; a directory that stands in several places is listed in each.
    """
    level = blocks.sparkSession.createDataFrame([("", root)], "_at string, dir_block string")
    kind = F.when(F.col("content_type") == DIRECTORY, "dir").when(F.col("content_type") == LINK, "link").otherwise("file")
    path = F.when(F.col("_at") == "", F.col("name")).otherwise(F.concat_ws("/", "_at", "name"))
    out = None
    while True:
        found = decode.exploded_directories(blocks.join(level.select(F.col("dir_block").alias("block")).distinct(), "block", "left_semi"))
        rows = found.join(level, "dir_block").select(
            path.alias("path"), F.col("_at").alias("parent"), "name", kind.alias("kind"), "size", F.col("mode").cast("int").alias("mode"), "mtime_ns", "reference_id", "content_type", "content", "target"
        )
        rows = scratch.table(rows, "entries")
        out = rows if out is None else out.unionByName(rows)
        level = rows.filter("kind = 'dir'").select(F.col("path").alias("_at"), F.col("content").alias("dir_block"))
        if level.isEmpty():
            return out


def file_parts(blocks: DataFrame, entries: DataFrame) -> DataFrame:
    """(path, ordinal, offset, block) of the data blocks of stored files."""
    from quarry.operators.snapshot import chain_offsets

    whole = entries.filter(F.col("content_type") == FILE).select("path", F.lit(0).alias("ordinal"), F.col("content").alias("block"))
    chained = entries.filter(F.col("content_type") == CHAIN).select("path", F.col("content").alias("chain_block"))
    links = decode.exploded_chains(blocks.join(chained.select(F.col("chain_block").alias("block")).distinct(), "block", "left_semi"))
    parts = whole.unionByName(links.join(chained, "chain_block").select("path", "ordinal", "block"))
    sized = parts.join(blocks.select("block", F.length("data").cast("long").alias("length")), "block")
    return chain_offsets(sized, "path", "ordinal", "length").select("path", "ordinal", "offset", "block")


def content_types(entries: DataFrame) -> DataFrame:
    """Entries with the content type of those that have none yet: directories, links and empty files."""
    kind = F.when(F.col("kind") == "dir", DIRECTORY).when(F.col("kind") == "link", LINK).otherwise(F.coalesce("content_type", F.lit(EMPTY)))
    return entries.withColumn("content_type", kind)
