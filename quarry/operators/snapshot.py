"""Snapshots of file trees: paths, listing, change detection, diff, restore.

Entries have path, name, kind ('dir', 'file', 'link'), size, mode, mtime_ns, content, target.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.glob import Ignore, glob_regex, ignored_by
from quarry.functions.scalars import path_order

# Content types of entries, and mode bits of files that are never stored.
EMPTY, DIRECTORY, FILE, CHAIN, LINK = 0, 1, 2, 3, 4
TEMPORARY, DEVICE, PIPE, SOCKET = 1 << 28, 1 << 26, 1 << 25, 1 << 24
SPECIAL = TEMPORARY | DEVICE | PIPE | SOCKET
SECOND = 1_000_000_000


def with_directories(files: DataFrame) -> DataFrame:
    """Files (path, size, content) and every directory above them: path, parent, name, is_dir, depth, size, content."""
    parts = F.split("path", "/")
    up = files.select(F.explode(F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), "/"))).alias("path"))
    dirs = up.distinct().select("path", F.lit(True).alias("is_dir"), F.lit(0).cast("long").alias("size"), F.lit(None).cast("string").alias("content"))
    root = files.sparkSession.createDataFrame([("", True, 0, None)], dirs.schema)
    every = files.select("path", F.lit(False).alias("is_dir"), "size", "content").unionByName(dirs).unionByName(root)
    p = F.split("path", "/")
    top = F.col("path") == ""
    return every.select(
        "path",
        F.when(top, F.lit(None)).otherwise(F.array_join(F.slice(p, 1, F.size(p) - 1), "/")).alias("parent"),
        F.element_at(p, -1).alias("name"),
        "is_dir",
        F.when(top, 0).otherwise(F.size(p)).alias("depth"),
        "size",
        "content",
    )


def storable(entries: DataFrame) -> DataFrame:
    """Entries other than temporary files, devices, pipes and sockets."""
    return entries.filter(F.col("mode").bitwiseAND(F.lit(SPECIAL)) == 0)


def with_ignores(entries: DataFrame, ignores: list[Ignore]) -> DataFrame:
    return entries.withColumn("ignored_by", ignored_by(F.col("path"), F.col("is_dir"), ignores))


def children(nodes: DataFrame, path: str) -> DataFrame:
    """Entries of a directory, or the files of its parent that the last segment matches as a pattern.

    Descent needs no walk, as entries carry their parent; the filters reach the scan.
    """
    path = "/".join(s for s in path.split("/") if s not in ("", "."))
    parent, _, last = path.rpartition("/")
    if nodes.filter((F.col("path") == path) & F.col("is_dir")).isEmpty():
        return nodes.filter((F.col("parent") == parent) & F.col("name").rlike(glob_regex(last)))
    return nodes.filter(F.col("parent") == path)


def glob_list(nodes: DataFrame, pattern: str) -> DataFrame:
    """Entries whose full path matches the pattern."""
    return nodes.filter(F.col("path").rlike(glob_regex(pattern)))


def ranked_by_path(nodes: DataFrame) -> DataFrame:
    """Place in a walk that lists a directory's content before its later siblings, within each top directory."""
    top = F.element_at(F.split("path", "/"), 1)
    return nodes.withColumn("top", top).withColumn("rank", F.row_number().over(Window.partitionBy("top").orderBy(path_order(F.col("path")))))


def unchanged(new: str, old: str, offline: Column | None = None) -> Column:
    """Whether two entries are the same file: name, size, mode and time; offline files only to the second, whatever the mode."""
    same = lambda c: F.col(f"{new}.{c}").eqNullSafe(F.col(f"{old}.{c}"))
    exact = same("name") & same("size") & same("mode") & same("mtime_ns")
    if offline is None:
        return exact
    second = lambda t: F.floor(F.col(f"{t}.mtime_ns") / SECOND)
    loose = same("name") & same("size") & (second(new) == second(old))
    return F.when(offline, loose).otherwise(exact)


def is_offline(size: Column, blocks: Column) -> Column:
    return (size > 0) & (blocks == 0)


def changes(new: DataFrame, old: DataFrame, offline: str | None = None) -> DataFrame:
    """New entries with the reference entry of their path: change is added, changed or same."""
    joined = new.alias("n").join(old.alias("o"), F.col("n.path") == F.col("o.path"), "left")
    same = unchanged("n", "o", F.col(f"n.{offline}") if offline else None)
    change = F.when(F.col("o.path").isNull(), "added").when(same, "same").otherwise("changed")
    return joined.select("n.*", change.alias("change"), F.col("o.content").alias("old_content"))


def snapshot_sizes(changed: DataFrame, by: str, reference_loaded: bool = True) -> DataFrame:
    """Per group: total size, and the size of whole files that are new or changed (all, without a reference)."""
    own = F.col("change") != "same" if reference_loaded else F.lit(True)
    return changed.groupBy(by).agg(
        F.sum("size").alias("size"), F.coalesce(F.sum(F.when(own, F.col("size"))), F.lit(0)).alias("unique_size"),
        F.count(F.lit(1)).alias("n_files"), F.count_if(F.col("change") == "same").alias("n_unchanged"),
        F.count_if(F.col("change") == "changed").alias("n_different"),
    )


def content_type(n_blocks: Column, size: Column) -> Column:
    return F.when(size == 0, EMPTY).when(n_blocks == 1, FILE).otherwise(CHAIN)


def diff(local: DataFrame, remote: DataFrame, by: str = "parent", strict: bool = False) -> DataFrame:
    """Entries by directory and name: same, different, missing locally or extra locally.

    A merge of both lists that ends when either does never reports names beyond the smaller of the two
    last names; strict=True reports all.  Directories are the same as directories, whatever they hold;
    contents decide for files with data, so a difference in mode alone counts for empty ones only.
    """
    l, r = local.alias("l"), remote.alias("r")
    both = l.join(r, (F.col(f"l.{by}") == F.col(f"r.{by}")) & (F.col("l.name") == F.col("r.name")), "full_outer")
    same = lambda c: F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}"))
    mode = F.col("l.mode").bitwiseAND(F.lit(0o777)) == F.col("r.mode").bitwiseAND(F.lit(0o777))
    second = lambda t: F.floor(F.col(f"{t}.mtime_ns") / SECOND)
    alike = (
        F.when(~same("kind"), F.lit(False)).when(F.col("l.kind") == "dir", F.lit(True)).when(F.col("l.kind") == "link", same("target"))
        .when(F.col("r.size") == 0, same("size") & mode & (second("l") == second("r"))).otherwise(same("size") & same("content"))
    )
    status = F.when(F.col("r.name").isNull(), "extra").when(F.col("l.name").isNull(), "missing").when(alike, "same").otherwise("different")
    out = both.select(
        F.coalesce(f"l.{by}", f"r.{by}").alias(by), F.coalesce("l.name", "r.name").alias("name"), status.alias("status"),
        F.col("l.name").alias("_l"), F.col("r.name").alias("_r"),
    )
    if not strict:
        ends = out.groupBy(by).agg(F.max("_l").alias("_le"), F.max("_r").alias("_re"))
        out = out.join(ends, by).filter((F.col("name") <= F.col("_le")) & (F.col("name") <= F.col("_re")))
    return out.select(by, "name", "status")


def first_mismatch(a: Column, b: Column, step: int = 16) -> Column:
    """Offset of the first row of ``step`` bytes in which two contents differ, or null.

    The contents are bound to a variable once; lambdas would evaluate the casts for every row anew.
    """

    def of(p: Column) -> Column:
        n = F.greatest(F.length(p["a"]), F.length(p["b"]))
        starts = F.when(n > 0, F.sequence(F.lit(0), n - 1, F.lit(step)))
        differs = lambda s: F.substring(p["a"], s + 1, F.lit(step)) != F.substring(p["b"], s + 1, F.lit(step))
        return F.array_min(F.filter(starts, differs))

    bound = F.array(F.struct(a.cast("binary").alias("a"), b.cast("binary").alias("b")))
    return F.element_at(F.transform(bound, of), 1)


def chain_offsets(chunks: DataFrame, file: str, ordinal: str, length: str) -> DataFrame:
    """Byte offset of each chunk in its file."""
    before = Window.partitionBy(file).orderBy(ordinal).rowsBetween(Window.unboundedPreceding, -1)
    return chunks.withColumn("offset", F.coalesce(F.sum(length).over(before), F.lit(0)))


def restored(chunks: DataFrame, file: str, ordinal: str, data: str) -> DataFrame:
    """Each file's content from its chunks in order; a file must fit in one row."""
    ordered = F.sort_array(F.collect_list(F.struct(ordinal, data)))
    return chunks.groupBy(file).agg(F.array_join(F.transform(ordered, lambda c: c[data]), "").alias("content"), F.count(F.lit(1)).alias("n_chunks"))


def resumed(entries: DataFrame, store: DataFrame) -> DataFrame:
    """Entries of an interrupted run that may be kept: below a directory that the store has, or stored themselves.

    entries: path, is_dir, content.  Trusted directories are found among each entry's ancestors.
    """
    have = entries.join(store.select(F.col("block").alias("content")), "content", "left_semi")
    trusted = have.filter("is_dir").select(F.col("path").alias("_dir"))
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda n: F.when(n == 0, F.lit("")).otherwise(F.array_join(F.slice(parts, 1, n), "/")))
    below = entries.select("path", F.explode(above).alias("_dir")).join(trusted, "_dir", "left_semi").select("path").distinct()
    return entries.join(below.unionByName(have.select("path")).distinct(), "path", "left_semi")


def first_per_path(*sources: DataFrame) -> DataFrame:
    """Union of entry lists in order of priority; the first that has a path wins."""
    rows = None
    for i, s in enumerate(sources):
        s = s.withColumn("_from", F.lit(i))
        rows = s if rows is None else rows.unionByName(s)
    rest = [c for c in sources[0].columns if c != "path"]
    return rows.groupBy("path").agg(F.min_by(F.struct(*rest), "_from").alias("t")).select("path", "t.*")


def depth_of_stream(entries: DataFrame, stream: str, ordinal: str, opens: Column, closes: Column) -> DataFrame:
    """Nesting depth at each entry of a stream in which directories open and end marks close."""
    until = Window.partitionBy(stream).orderBy(ordinal).rowsBetween(Window.unboundedPreceding, 0)
    step = F.when(opens, 1).when(closes, -1).otherwise(0)
    return entries.withColumn("depth", F.sum(step).over(until))
