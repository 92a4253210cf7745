"""Mixing sources to target weights, in fixed-length blocks of words.

Each source's words, in order of document, form one stream that is cut into blocks of ``block``
words.  Weights give every source a target in words; a source may be taken twice at most, and what
it cannot give goes to the others by weight (water-filling, in closed form).  A source's target is a
number of slots, of which the last may be a partial block.

Output shards have ``shard_slots`` slots each.  Every shard draws how many of its slots each source gets: a
multinomial draw, conditioned on the sources' slot totals, so that a source's words equal its
rounded target.  Draws halve the range of shards again and again (what the left half gets of the
counts, then what its left half gets of these), each seeded by its range, so that any shard finds its
counts and its sources' running numbers alone, in as many draws as the number of shards has bits.  A
running number goes through the source's pseudorandom permutation (a Feistel network with cycle
walking, keyed by seed, source and pass) to a block index, blocks are joined to documents by (source,
index), and a shard's own permutation says in which of its slots a block lands.  Seeds, not partitions,
decide everything, so reruns agree.

Streams need the words before each document in its source.  Rows are range-partitioned by (source,
id) and written; per-partition sums (one row per partition and source) give each partition's start,
and a window within a partition does the rest, so a source with a third of all rows is spread.

Defined results: null text has size 0 and nothing is taken from it; null source is a source, ranked
last; rows repeated with one id are separate rows; ids may be null (first in their source); an empty
table gives an empty result.  A row's ``taken`` never exceeds twice its size.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.words import SPACE, text_slices
from quarry.plans.columns import fresh, map_in_arrow, named
from quarry.plans.scratch import Scratch, ship

#: The contract's weights, repeating over the sources in code point order.
WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2
#: Sources that draw together, at most; more make further groups with shards of their own.
GROUP_SOURCES = 10_000
#: Output shards that are drawn at a time, and slots that one task makes.
BUNDLE, TASK_SLOTS = 8, 262_144


def word_counts(docs: DataFrame, text_col: str) -> DataFrame:
    """docs' columns and _size: the number of words, counted in the JVM."""
    text = F.coalesce(docs[text_col], F.lit(""))
    # a word begins where a word character follows a separator or the start
    marks = F.regexp_replace(text, r"[^\x20\x09-\x0D]+", "x")
    words = F.length(F.translate(marks, " \t\n\x0b\x0c\r", ""))
    return docs.withColumn("_size", words.cast("long"))


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """(source, source_size, rank, target): one row per source; ranks and sums are over sources only.

    With sources in order of cap / weight, target = min(cap, level * weight), and the level is the
    largest of (total - caps before) / (weights from here on).
    """
    per = sizes.groupBy("_source").agg(F.sum("_size").alias("source_size"))
    order = Window.orderBy(F.col("_source").asc_nulls_last())
    ranked = per.withColumn("rank", F.row_number().over(order) - 1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    ranked = ranked.withColumn("w", weight).withColumn("cap", F.col("source_size") * float(most))
    by_ratio = Window.orderBy(F.col("cap") / F.col("w"), "rank")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy(F.lit(0))
    level = (F.sum("source_size").over(everything) * share - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (
        F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0.0))
    )
    filled = ranked.withColumn("level", level).withColumn("level", F.max("level").over(everything))
    return filled.select("_source", "rank", "source_size", F.least("cap", F.col("level") * F.col("w")).alias("target"))


class Permutation:
    """A keyed bijection of range(n): a four-round Feistel network, walked until it falls below n."""

    def __init__(self, n: int, key: int):
        self.n = max(1, n)
        self.half = max(1, ((self.n - 1).bit_length() + 1) // 2)
        self.keys = np.random.default_rng(key).integers(0, 2**63, 4, dtype=np.uint64)

    def _round(self, x: np.ndarray, k: np.uint64) -> np.ndarray:
        x = (x + k) * np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(29)
        x = x * np.uint64(0xBF58476D1CE4E5B9)
        return (x >> np.uint64(32)) & np.uint64((1 << self.half) - 1)

    def _pass(self, x: np.ndarray, keys) -> np.ndarray:
        low = np.uint64((1 << self.half) - 1)
        a, b = x >> np.uint64(self.half), x & low
        for k in keys:
            a, b = b, a ^ self._round(b, k)
        return (b << np.uint64(self.half)) | a  # halves swapped back: with keys reversed it is the inverse

    def _walk(self, at: np.ndarray, keys) -> np.ndarray:
        out = np.asarray(at).astype(np.uint64)
        todo = np.arange(len(out))
        while len(todo):
            out[todo] = self._pass(out[todo], keys)
            todo = todo[out[todo] >= self.n]
        return out.astype(np.int64)

    def of(self, at) -> np.ndarray:
        return self._walk(at, self.keys)

    def inverse(self, at) -> np.ndarray:
        return self._walk(at, self.keys[::-1])


def _key(seed: int, source: str | None, turn: int) -> int:
    name = b"\0null" if source is None else source.encode("utf-8")
    return zlib.crc32(name) + (turn << 33) + (seed << 36) + (len(name) << 52)


def slot_plan(size: int, target: float, block: int, seed: int, source: str | None) -> list[tuple[int, int, int]]:
    """(pass, whole slots, words of one more slot) so that the words taken are round(target)."""
    blocks, want, plan = -(-size // block), round(target), []
    for turn in range(MOST):
        if want >= size:
            plan.append((turn, blocks, 0))
            want -= size
            continue
        short = int(Permutation(blocks, _key(seed, source, turn)).inverse(np.array([blocks - 1]))[0]) if blocks else 0
        missing = blocks * block - size
        whole = want // block
        if whole > short:  # the short last block is among them
            whole = (want + missing) // block
            words = whole * block - missing
        else:
            words = whole * block
            if whole == short and want - words >= block - missing:  # the short block is used up by the rest
                whole, words = whole + 1, words + block - missing
        plan.append((turn, whole, want - words))
        break
    return plan


def split_counts(counts: np.ndarray, take: int, key: int) -> np.ndarray:
    """How many of each kind are among ``take`` of all slots, drawn without replacement."""
    rng = np.random.default_rng(key)
    if counts.sum() < 10**9:
        return rng.multivariate_hypergeometric(counts, take, method="marginals")
    out, left = np.zeros_like(counts), int(counts.sum())  # beyond what numpy draws: normal, within the possible range
    for k, c in enumerate(counts.tolist()):
        p = c / max(1, left)
        x = round(rng.normal(take * p, (take * p * (1 - p) * (left - take) / max(1, left - 1)) ** 0.5))
        out[k] = min(max(x, 0, take - (left - c)), c, take)
        take, left = take - int(out[k]), left - c
    return out


def shard_counts(totals: np.ndarray, shard: int, shard_slots: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """For each source its first running number and number of slots in this output shard."""
    counts, first = totals.astype(np.int64), np.zeros(len(totals), np.int64)
    a, b = 0, max(1, -(-int(totals.sum()) // shard_slots))
    while b - a > 1:
        middle = (a + b) // 2
        left = split_counts(counts, (middle - a) * shard_slots, (seed << 96) + (a << 48) + b)
        if shard < middle:
            counts, b = left, middle
        else:
            counts, first, a = counts - left, first + left, middle
    return first, counts


def _slots(sources: DataFrame, block: int, seed: int, shard_slots: int, tasks: int) -> DataFrame:
    """(shard, slot, source, turn, blk, words): the blocks to take, by output shard and slot; words is how many of the block's first words.

    Shards are numbered from 0 in each group of sources (g), and one group is the rule.
    """
    names = ["rank", "_source", "source_size", "target"]
    grouped = sources.groupBy(F.floor(F.col("rank") / GROUP_SOURCES).alias("g")).agg(F.sort_array(F.collect_list(F.struct(*names))).alias("sources"))

    def planned(group):
        plans = [slot_plan(r["source_size"], r["target"], block, seed, r["_source"]) for r in group]
        return plans, np.array([sum(whole + (rest > 0) for _, whole, rest in p) for p in plans], np.int64)

    def bundles(batches):
        for batch in batches:
            for k, group in enumerate(batch.column("sources").to_pylist()):
                n = -(-int(planned(group)[1].sum()) // shard_slots)
                for a in range(0, n, BUNDLE * 1000):
                    begin = list(range(a, min(n, a + BUNDLE * 1000), BUNDLE))
                    one = batch.slice(k, 1)
                    cols = [pa.array([one.column("g")[0].as_py()] * len(begin), pa.int64()), one.column("sources").take(pa.array([0] * len(begin)))]
                    yield pa.RecordBatch.from_arrays([*cols, pa.array(begin, pa.int64()), pa.array([min(n, x + BUNDLE) for x in begin], pa.int64())], names=["g", "sources", "a", "b"])

    def blocks(batches):
        for batch in batches:
            for k in range(len(batch)):
                group, g = batch.column("sources")[k].as_py(), batch.column("g")[k].as_py()
                plans, totals = planned(group)
                for shard in range(batch.column("a")[k].as_py(), batch.column("b")[k].as_py()):
                    first, counts = shard_counts(totals, shard, shard_slots, seed + g)
                    place = Permutation(int(counts.sum()), _key(seed, f"slots {g}", 0) + shard).of(np.arange(int(counts.sum())))
                    done = 0
                    for r, plan, at, n in zip(group, plans, first.tolist(), counts.tolist()):
                        start = 0
                        for turn, whole, rest in plan:
                            size = whole + (rest > 0)
                            index = np.arange(max(at, start), min(at + n, start + size)) - start
                            start += size
                            if not len(index):
                                continue
                            blk = Permutation(-(-r["source_size"] // block), _key(seed, r["_source"], turn)).of(index)
                            words = np.where(index < whole, block, rest)
                            same = lambda v: np.full(len(index), v)
                            cols = [same(g), same(shard), place[done : done + len(index)], same(turn), blk, words]
                            done += len(index)
                            yield pa.RecordBatch.from_arrays([pa.array([r["_source"]] * len(index), pa.string()), *[pa.array(c, pa.int64()) for c in cols]], names=out)

    out = ["source", "g", "shard", "slot", "turn", "blk", "words"]
    element = grouped.schema["sources"].dataType.simpleString()
    dealt = grouped.mapInArrow(bundles, f"g long, sources {element}, a long, b long").repartition(tasks, "g", "a")
    return dealt.mapInArrow(blocks, "source string, g long, shard long, slot long, turn long, blk long, words long")


@dataclass
class Mix:
    """rows: _id, _size, source_size, target, taken, shards and, if asked, docs' columns as c_0, c_1 and so on;
    pieces (_pid, _row, turn, g, shard, slot, a, b): the words a to b of a row that a slot takes; slots as ``_slots`` has them."""

    rows: DataFrame
    pieces: DataFrame
    slots: DataFrame


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    block: int = 64,
    seed: int = 7,
    shard_slots: int = 16_384,
    carry: bool = False,
) -> Mix:
    """See the module docstring."""
    ship(docs.sparkSession)
    scratch = Scratch(docs.sparkSession, "mix")
    cols = docs.columns if carry else []
    sized = word_counts(docs.select(named(docs, id_col).alias("_id"), named(docs, source_col).cast("string").alias("_source"), named(docs, text_col).alias("_text"), *[named(docs, c).alias(f"c_{i}") for i, c in enumerate(cols)]), "_text").drop("_text")
    if not carry:
        sized = scratch.table(sized, "sized")  # ranges are found by a pass of their own; texts are not written for it
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = sized.repartitionByRange(parts, "_source", "_id", "_size")
    rows = scratch.table(ranged.withColumn("_pid", F.spark_partition_id()).withColumn("_row", F.monotonically_increasing_id()), "rows")
    scratch.drop(sized)
    sums = rows.groupBy("_pid", "_source").agg(F.sum("_size").alias("s"))
    ahead = Window.partitionBy("_source").orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("_pid", F.col("_source").alias("_src"), F.coalesce(F.sum("s").over(ahead), F.lit(0)).alias("_base"))
    targets = scratch.table(source_targets(sums.withColumnRenamed("s", "_size")), "targets")
    within = Window.partitionBy("_pid", "_source").orderBy(F.col("_id").asc_nulls_first(), "_size", "_row").rowsBetween(Window.unboundedPreceding, -1)
    keys = rows.select("_pid", "_row", "_id", "_source", "_size")
    placed = keys.withColumn("_in", F.coalesce(F.sum("_size").over(within), F.lit(0)))
    placed = placed.join(starts, (placed["_pid"] == starts["_pid"]) & placed["_source"].eqNullSafe(starts["_src"])).select(
        placed["_pid"], "_row", "_id", "_source", "_size", (F.col("_in") + F.col("_base")).alias("_from")
    )
    placed = scratch.table(placed, "placed")
    words = targets.agg(F.sum("target")).first()[0] or 0
    slots = _slots(targets, block, seed, shard_slots, int(words / block / TASK_SLOTS) + 1)
    chunks = placed.filter("_size > 0").select(
        "_pid", "_row", "_source", "_size", "_from",
        F.explode(F.sequence((F.col("_from") / block).cast("long"), ((F.col("_from") + F.col("_size") - 1) / block).cast("long"))).alias("blk"),
    )
    # the planner takes slots for as small as the table of sources that they are made from
    joined = chunks.hint("merge").join(slots, (chunks["blk"] == slots["blk"]) & chunks["_source"].eqNullSafe(slots["source"]))
    begin = F.greatest(F.col("_from"), chunks["blk"] * block)
    end = F.least(F.col("_from") + F.col("_size"), chunks["blk"] * block + F.col("words"))
    pieces = joined.select("_pid", "_row", "turn", "g", "shard", "slot", (begin - F.col("_from")).alias("a"), (end - F.col("_from")).alias("b"))
    pieces = scratch.table(pieces.filter("b > a"), "pieces")
    taken = pieces.groupBy("_pid", "_row").agg(F.sum(F.col("b") - F.col("a")).alias("taken"), F.sort_array(F.collect_set("shard")).alias("shards"))
    tgt = targets.select(F.col("_source").alias("_ts"), "source_size", "target")
    base = placed if not carry else rows
    out = base.join(taken, ["_pid", "_row"], "left")
    out = out.join(F.broadcast(tgt) if _few(tgt) else tgt, out["_source"].eqNullSafe(tgt["_ts"])).drop("_ts")
    return Mix(out.withColumns({"taken": F.coalesce("taken", F.lit(0)), "shards": F.coalesce("shards", F.array().cast("array<bigint>"))}), pieces, slots)


def _few(targets: DataFrame, most: int = 10_000) -> bool:
    """Whether the table of sources is small enough to broadcast; it is counted, not assumed."""
    return targets.limit(most + 1).count() <= most


def mixture(docs: DataFrame, **kw) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken, and the output shards that hold words of it."""
    return mix(docs, **kw).rows.select(
        F.col("_id").alias(kw.get("id_col", "doc_id")), F.col("_size").alias("size"), "source_size", "target", "taken", "shards"
    )


def mixed_blocks(docs: DataFrame, **kw) -> DataFrame:
    """The mix as output shards: (group, shard, slot, id, turn, first, last): the words first to last (exclusive) of a document."""
    got = mix(docs, **kw)
    ids = got.rows.select("_pid", "_row", F.col("_id").alias(kw.get("id_col", "doc_id")))
    out = got.pieces.join(ids, ["_pid", "_row"])
    return out.select(F.col("g").alias("group"), "shard", "slot", kw.get("id_col", "doc_id"), "turn", F.col("a").alias("first"), F.col("b").alias("last"))


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length_col: str = "n_chars", **kw) -> DataFrame:
    """The mix as documents: for each pass, a row of each document with the words that the pass takes.

    A document taken whole keeps its text; of others the taken stretches of the text are joined by
    line ends.  ``length_col``, if docs has it, becomes the new text's code points.
    """
    got = mix(docs, id_col, text_col, carry=True, **kw)
    rows = got.rows
    runs = got.pieces.groupBy("_pid", "_row", "turn").agg(F.sort_array(F.collect_list(F.struct("a", "b"))).alias("_runs"))
    names = docs.columns
    run_col, size_col = fresh("_runs", names), fresh("_size", names)
    picked = rows.join(runs, ["_pid", "_row"]).select(*[F.col(f"c_{i}").alias(c) for i, c in enumerate(names)], F.col("_runs").alias(run_col), F.col("_size").alias(size_col))
    schema = docs.schema

    def cut(batches):
        for batch in batches:
            texts = []
            column = batch.column(text_col)
            for k, (runs_, size) in enumerate(zip(batch.column(run_col).to_pylist(), batch.column(size_col).to_pylist())):
                merged: list[list[int]] = []
                for r in runs_:
                    if merged and merged[-1][1] == r["a"]:
                        merged[-1][1] = r["b"]
                    else:
                        merged.append([r["a"], r["b"]])
                if merged == [[0, size]]:
                    texts.append(column[k].as_py())
                    continue
                (_, _, data, _), = text_slices(column.slice(k, 1))
                gap = SPACE[data]
                start = np.flatnonzero(~gap & np.concatenate([[True], gap[:-1]]))
                stop = np.flatnonzero(~gap & np.concatenate([gap[1:], [True]])) + 1
                raw = data.tobytes()
                texts.append(b"\n".join(raw[start[a] : stop[b - 1]] for a, b in merged).decode("utf-8"))
            new = {text_col: pa.array(texts, pa.string())}
            yield pa.RecordBatch.from_arrays([new.get(c, batch.column(c)) for c in names], names=names)

    out = map_in_arrow(picked, cut, schema)
    return out.withColumn(length_col, F.length(text_col).cast(schema[length_col].dataType)) if length_col in names else out
