"""Content-addressed blocks: distinct content, existence probes, integrity and recovery.

Probes are semi- and anti-joins on the id alone, so payloads are never shuffled for them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.scalars import compression_ratio, verify_block


def distinct_blocks(blocks: DataFrame, order: str) -> DataFrame:
    """One row per id: the first writer's (least ``order``), and how many wrote it."""
    rest = [c for c in blocks.columns if c not in ("block", order)]
    picked = blocks.groupBy("block").agg(F.min_by(F.struct(order, *rest), order).alias("t"), F.count(F.lit(1)).alias("copies"))
    return picked.select("block", "t.*", "copies")


def to_upload(candidates: DataFrame, store: DataFrame) -> DataFrame:
    """Distinct candidate ids that the store lacks."""
    return candidates.dropDuplicates(["block"]).join(store.select("block"), "block", "left_anti")


def already_stored(candidates: DataFrame, store: DataFrame) -> DataFrame:
    return candidates.dropDuplicates(["block"]).join(store.select("block"), "block", "left_semi")


def insert_if_absent(store: DataFrame, new: DataFrame, order: str) -> DataFrame:
    """The store with the new ids' first rows; blocks that it has stay as they are."""
    return store.unionByName(distinct_blocks(new, order).join(store.select("block"), "block", "left_anti").select(store.columns))


def dedup_ratio(blocks: DataFrame, by: str) -> DataFrame:
    """Per group: written and distinct blocks and bytes, and the share saved.

    Sizes are combined per (group, id) before the second aggregation, which is exact and small.
    """
    once = blocks.groupBy(by, "block").agg(F.count(F.lit(1)).alias("n"), F.max("size").alias("size"))
    return once.groupBy(by).agg(
        F.sum("n").alias("n_blocks"), F.count(F.lit(1)).alias("n_unique"),
        F.sum(F.col("n") * F.col("size")).alias("raw_bytes"), F.sum("size").alias("unique_bytes"),
    ).withColumn("saved", compression_ratio(F.col("raw_bytes"), F.col("unique_bytes")))


def lookup(index: DataFrame, meta: DataFrame, data: DataFrame) -> DataFrame:
    """Index to metadata to payload by id and location."""
    return index.join(meta, ["block", "meta_file", "meta_offset"]).join(data, ["block", "file", "offset"])


def current_copies(copies: DataFrame, index: DataFrame) -> DataFrame:
    """Each stored copy with whether it is the one that the index points to."""
    at = index.select("block", "file", "offset", F.lit(True).alias("_at"))
    return copies.join(at, ["block", "file", "offset"], "left").withColumn("is_current", F.coalesce("_at", F.lit(False))).drop("_at")


def compacted(copies: DataFrame, index: DataFrame) -> DataFrame:
    """The copies that survive compaction: those the index points to."""
    return copies.join(index.select("block", "file", "offset"), ["block", "file", "offset"], "left_semi")


def recovered(copies: DataFrame) -> DataFrame:
    """The index rebuilt from stored copies: of one id the last copy by (file, offset) wins."""
    return copies.groupBy("block").agg(F.max(F.struct("file", "offset", "size")).alias("t"), F.count(F.lit(1)).alias("copies")).select(
        "block", "t.*", "copies"
    )


def repairs(rebuilt: DataFrame, index: DataFrame) -> DataFrame:
    """What recovery changes: ids that are new, moved, or orphaned in the old index."""
    old = index.select("block", F.col("file").alias("old_file"), F.col("offset").alias("old_offset"))
    both = rebuilt.select("block", "file", "offset").join(old, "block", "full_outer")
    change = (
        F.when(F.col("old_file").isNull(), "added").when(F.col("file").isNull(), "lost")
        .when((F.col("file") != F.col("old_file")) | (F.col("offset") != F.col("old_offset")), "moved")
    )
    return both.withColumn("change", change).filter("change is not null").select("block", "change")


def mismatches(meta: DataFrame, data: DataFrame) -> DataFrame:
    """Metadata that disagrees with the stored block: its links (count and order) or its size, or it is missing."""
    d = data.select("block", F.col("links").alias("d_links"), F.col("size").alias("d_size"))
    both = meta.join(d, "block", "left")
    reason = (
        F.when(F.col("d_size").isNull(), "missing").when(F.size("links") != F.size("d_links"), "link count")
        .when(~F.col("links").eqNullSafe(F.col("d_links")), "link order").when(F.col("size") != F.col("d_size"), "size")
    )
    return both.withColumn("reason", reason).filter("reason is not null").select("block", "reason")


def content_failures(blocks: DataFrame) -> DataFrame:
    """Blocks (block, links, data) whose content does not hash to their id."""
    return blocks.filter(~verify_block(F.col("block"), F.col("links"), F.col("data"))).select("block")


def bad_headers(files: DataFrame, version: int = 1) -> DataFrame:
    """Files with a wrong type or version in the header."""
    return files.filter((F.col("file_type") != F.col("expected_type")) | (F.col("version") != version))


def home_slots(blocks: DataFrame) -> DataFrame:
    """Home slot of each id in a hashed index, and how far it stands from it when slots are taken in order of id."""
    slot = F.conv(F.substring("block", -6, 6), 16, 10).cast("long")
    order = Window.partitionBy("home").orderBy("block")
    return blocks.select("block").distinct().withColumn("home", slot).withColumn("place", F.row_number().over(order) - 1)


def relocated(records: DataFrame, moves: DataFrame) -> DataFrame:
    """Records (block, file, offset, ...) that point to where moves (block, file, offset) put their block.

    A move says from where, too (old_file, old_offset); a record that has been changed meanwhile and
    points elsewhere stays as it is.
    """
    to = moves.select("block", "old_file", "old_offset", F.col("file").alias("_file"), F.col("offset").alias("_offset"))
    hit = (F.col("old_file") == F.col("file")) & (F.col("old_offset") == F.col("offset"))
    both = records.join(to, "block", "left").withColumn("_hit", F.coalesce(hit, F.lit(False)))
    moved = {"file": F.when(F.col("_hit"), F.col("_file")).otherwise(F.col("file")), "offset": F.when(F.col("_hit"), F.col("_offset")).otherwise(F.col("offset"))}
    return both.select(*[moved[c].alias(c) if c in moved else F.col(c) for c in records.columns])
