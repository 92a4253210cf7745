"""Removal of long word passages that an earlier document also has.

A window is ``window`` consecutive words.  A word goes if it is covered by a window whose words also
start in a document of a smaller id; windows are judged on the input.

Suffix automata of reference shards decide every window.  Sending every shard past every document
costs shards x documents, so documents meet only the shards that can match them:

1. In each window the gram of ``gram`` words with the smallest hash is its anchor (the leftmost, on
   ties).  Equal windows have equal anchors.  Windows in a row with one anchor form a stretch.
2. Stretches of an anchor that occurs in one document only have no match.  Of the others, each
   distinct one (by a 128-bit hash of its words) is taken once, from the document of the smallest id.
3. Distinct stretches are dealt by anchor to reference shards.  A shard builds, for one anchor after
   the other, the suffix automaton of the stretches' words, in which every state knows the first
   document that holds its strings, and streams the stretches through it.  The matching
   statistic at each word (the state of the longest match, cut to the window's length) names the
   first owner of the window that ends there.
4. Anchors with over ``crowd`` distinct stretches, such as the inside of a line that many documents
   surround differently, would gather in one shard.  Their stretches are cut once more, into single
   windows anchored by all of their words, and those that several documents share go the same way.
5. Documents drop the windows that have an earlier owner.

Hashes only bring windows together; automata compare words.  The one exception is the 128-bit hash
by which equal stretches are taken once.

Defined results: null text has no words; texts shorter than a window keep all words; rows of one id
do not match each other; null ids count as larger than all others; repeated rows get equal results;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.llm.words import Words, joined, split_words, text_slices, window_hashes
from quarry.plans.columns import named
from quarry.plans.scratch import Scratch, ship

_LAST = (1 << 63) - 1
#: What a stretch's words are known by.
_CONTENT = ["c1", "c2"]


def stretches(words: Words, window: int, gram: int) -> tuple[np.ndarray, ...]:
    """(text, first window, windows, anchor) of each stretch in these texts."""
    n = len(words.hash)
    span = window - gram + 1  # grams of a window
    none = np.zeros(0, np.int64)
    if n < window:
        return none, none, none, none
    grams = window_hashes(words.hash, gram)
    least = np.lib.stride_tricks.sliding_window_view(grams, span).argmin(axis=1) + np.arange(n - window + 1)
    text = np.searchsorted(words.first, np.arange(n - window + 1), "right") - 1
    whole = np.arange(n - window + 1) + window <= words.first[text + 1]
    cut = np.ones(n - window + 2, bool)
    cut[1:-1] = (least[1:] != least[:-1]) | (text[1:] != text[:-1]) | (whole[1:] != whole[:-1])
    edges = np.flatnonzero(cut)
    start, stop = edges[:-1], edges[1:]
    ok = whole[start]
    start, stop = start[ok], stop[ok]
    owner = text[start]
    return owner, start - words.first[owner], stop - start, grams[least[start]].view(np.int64)


def contents(raw: bytes, begin: np.ndarray, first: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """128-bit hashes (two columns) of the words first to stop of joined words."""
    view, digest = memoryview(raw), xxhash.xxh3_128_digest
    spans = zip(begin[first].tolist(), (begin[stop] - 1).tolist())
    return np.frombuffer(b"".join([digest(view[a:b]) for a, b in spans]), np.int64).reshape(-1, 2)


class SuffixAutomaton:
    """Generalised suffix automaton over sequences of hashable items; states know their first owner."""

    def __init__(self):
        self.next, self.link, self.length, self.owner = [{}], [-1], [0], [_LAST]

    def _state(self, length: int, link: int, moves: dict, owner: int) -> int:
        self.next.append(moves)
        self.link.append(link)
        self.length.append(length)
        self.owner.append(owner)
        return len(self.length) - 1

    def _split(self, p: int, item) -> int:
        """The state for p's strings followed by item, cloned if the present one has longer ones."""
        q = self.next[p][item]
        if self.length[q] == self.length[p] + 1:
            return q
        clone = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]), _LAST)
        while p >= 0 and self.next[p].get(item) == q:
            self.next[p][item] = clone
            p = self.link[p]
        self.link[q] = clone
        return clone

    def add(self, items, owner: int) -> None:
        last = 0
        for item in items:
            if item in self.next[last]:
                last = self._split(last, item)
            else:
                new = self._state(self.length[last] + 1, 0, {}, _LAST)
                p = last
                while p >= 0 and item not in self.next[p]:
                    self.next[p][item] = new
                    p = self.link[p]
                if p >= 0:
                    self.link[new] = self._split(p, item)
                last = new
            if owner < self.owner[last]:
                self.owner[last] = owner

    def settle(self) -> None:
        """Hand owners to shorter suffixes, longest states first."""
        for s in sorted(range(1, len(self.length)), key=self.length.__getitem__, reverse=True):
            up = self.link[s]
            if self.owner[s] < self.owner[up]:
                self.owner[up] = self.owner[s]

    def first_owners(self, items, window: int) -> list[int]:
        """For each window of items its first owner; _LAST if the automaton lacks it."""
        at, length, out = 0, 0, []
        for k, item in enumerate(items):
            while at and item not in self.next[at]:
                at = self.link[at]
                length = self.length[at]
            if item in self.next[at]:
                at = self.next[at][item]
                length += 1
            while self.link[at] > 0 and self.length[self.link[at]] >= window:
                at = self.link[at]
                length = min(length, self.length[at])
            if k + 1 >= window:
                out.append(self.owner[at] if length >= window else _LAST)
        return out


def _stretch_table(docs: DataFrame, window: int, gram: int) -> DataFrame:
    """(o, th, start, wins, anchor, c1, c2) of every stretch."""
    names = ["o", "th", "start", "wins", "anchor", *_CONTENT]

    def run(batches):
        for batch in batches:
            for a, b, data, offsets in text_slices(batch.column("text")):
                words = split_words(data, offsets, False)
                owner, start, wins, anchor = stretches(words, window, gram)
                at = words.first[owner] + start
                content = contents(*joined(words), at, at + wins + window - 1)
                rows = pa.array(owner + a)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("o").take(rows), batch.column("th").take(rows), pa.array(start, pa.int32()), pa.array(wins, pa.int32()),
                        pa.array(anchor, pa.int64()), pa.array(content[:, 0], pa.int64()), pa.array(content[:, 1], pa.int64()),
                    ],
                    names=names,
                )

    schema = "o long, th long, start int, wins int, anchor long, c1 long, c2 long"
    return docs.select("o", "th", "text").mapInArrow(run, schema)


def _parts(docs: DataFrame, wanted: DataFrame, fields: list[str]) -> DataFrame:
    """(text, parts) of the texts that wanted (o, th, fields) names, each text once with all its parts."""
    lists = wanted.groupBy("o", "th").agg(F.collect_list(F.struct(*fields)).alias("parts"))
    return docs.select("o", "th", "text").join(lists, ["o", "th"]).dropDuplicates(["o", "th"]).select("o", "th", "text", "parts")


def _window_table(docs: DataFrame, wanted: DataFrame, window: int) -> DataFrame:
    """wanted (o, th, start, wins, anchor, c1, c2) as single windows (o, th, start, i, w1, w2 and their stretch)."""
    names = ["o", "th", "start", "i", "w1", "w2", "anchor", *_CONTENT]

    def run(batches):
        for batch in batches:
            for a, b, data, offsets in text_slices(batch.column("text")):
                words = split_words(data, offsets, False)
                parts = [(a + k, p) for k, ps in enumerate(batch.column("parts").slice(a, b - a).to_pylist()) for p in ps]
                wins = np.array([p["wins"] for _, p in parts], np.int64)
                i = np.arange(wins.sum()) - np.repeat(np.cumsum(wins) - wins, wins)
                each = np.repeat(np.arange(len(parts)), wins)
                start = np.array([p["start"] for _, p in parts], np.int64)[each] + i
                row = np.array([k for k, _ in parts], np.int64)[each]
                at = words.first[row - a] + start
                content = contents(*joined(words), at, at + window)
                own = [pa.array(np.array([p[c] for _, p in parts], np.int64)[each]) for c in ("anchor", *_CONTENT)]
                cols = [batch.column(c).take(pa.array(row)) for c in ("o", "th")]
                cols += [pa.array(start, pa.int32()), pa.array(i, pa.int32()), pa.array(content[:, 0]), pa.array(content[:, 1]), *own]
                yield pa.RecordBatch.from_arrays(cols, names=names)

    schema = "o long, th long, start int, i int, w1 long, w2 long, anchor long, c1 long, c2 long"
    return _parts(docs, wanted, ["start", "wins", "anchor", *_CONTENT]).mapInArrow(run, schema)


def _strings(docs: DataFrame, wanted: DataFrame, window: int) -> DataFrame:
    """wanted (o, th, start, wins, anchor, c1, c2) with the stretch's words, joined by a space."""
    names = ["anchor", *_CONTENT, "o", "words"]

    def run(batches):
        for batch in batches:
            for a, b, data, offsets in text_slices(batch.column("text")):
                words = split_words(data, offsets, False)
                raw, begin = joined(words)
                rows = []
                for k, parts in enumerate(batch.column("parts").slice(a, b - a).to_pylist()):
                    o = batch.column("o")[a + k].as_py()
                    for p in parts:
                        s = int(words.first[k]) + p["start"]
                        rows.append((p["anchor"], p["c1"], p["c2"], o, raw[begin[s] : begin[s + p["wins"] + window - 1] - 1]))
                cols = list(zip(*rows)) or [()] * 5
                yield pa.RecordBatch.from_arrays([*[pa.array(c, pa.int64()) for c in cols[:4]], pa.array(cols[4], pa.binary())], names=names)

    return _parts(docs, wanted, ["start", "wins", "anchor", *_CONTENT]).mapInArrow(run, "anchor long, c1 long, c2 long, o long, words binary")


def _automata(strings: DataFrame, window: int) -> DataFrame:
    """(anchor, c1, c2, firsts): the first owner of every window of each distinct stretch."""
    dealt = strings.repartition("anchor").sortWithinPartitions("anchor")
    names = ["anchor", *_CONTENT, "firsts"]

    def answer(group):
        sam = SuffixAutomaton()
        split = [(row, row[4].split(b" ")) for row in group]
        for row, items in split:
            sam.add(items, row[3])
        sam.settle()
        for row, items in split:
            yield *row[:3], sam.first_owners(items, window)

    def flush(rows):
        cuts = np.concatenate([[0], np.cumsum([len(r[3]) for r in rows])]).astype(np.int32)
        flat = pa.array([x for r in rows for x in r[3]], pa.int64())
        return pa.RecordBatch.from_arrays([*[pa.array([r[c] for r in rows], pa.int64()) for c in range(3)], pa.ListArray.from_arrays(pa.array(cuts), flat)], names=names)

    def run(batches):
        group, out = [], []
        for batch in batches:
            for a in range(0, len(batch), 500):
                part = batch.slice(a, 500)
                for row in zip(*[part.column(c).to_pylist() for c in ("anchor", *_CONTENT, "o", "words")]):
                    if group and group[0][0] != row[0]:
                        out.extend(answer(group))
                        group = []
                    group.append(row)
                if len(out) > 2000:
                    yield flush(out)
                    out = []
        if group:
            out.extend(answer(group))
        if out:
            yield flush(out)

    return dealt.select("anchor", *_CONTENT, "o", "words").mapInArrow(run, "anchor long, c1 long, c2 long, firsts array<long>")


def _shared(rows: DataFrame, key: list[str]) -> DataFrame:
    """The keys under which rows of several documents stand."""
    return rows.groupBy(*key).agg(F.min("o").alias("o0"), F.max("o").alias("o1")).filter("o0 < o1").select(*key)


def mark_repeats(docs: DataFrame, scratch: Scratch, window: int, gram: int, crowd: int) -> DataFrame:
    """(o, th, start, wins, mask): windows with an earlier owner; a null mask stands for all of them."""
    full = ["anchor", *_CONTENT]
    at = ["o", "th", "start", "wins"]
    rows = scratch.table(_stretch_table(docs, window, gram), "stretches")
    shared = scratch.table(_shared(rows, ["anchor"]), "shared")
    met = scratch.table(rows.join(shared, "anchor", "left_semi"), "met")
    scratch.drop(rows, shared)
    first = F.min(F.struct(*at)).alias("at")
    distinct = scratch.table(met.groupBy(*full).agg(first).select("at.*", *full), "distinct")
    many = distinct.groupBy("anchor").agg(F.count(F.lit(1)).alias("c")).filter(F.col("c") > crowd)
    crowded = scratch.table(many.select("anchor"), "crowded")
    if crowded.isEmpty():
        firsts = scratch.table(_automata(_strings(docs, distinct, window), window), "firsts")
    else:
        few = distinct.join(crowded, "anchor", "left_anti")
        loose = scratch.table(_window_table(docs, distinct.join(crowded, "anchor", "left_semi"), window), "windows")
        single = loose.withColumn("wins", F.lit(1)).groupBy("w1", "w2").agg(first, F.max("o").alias("o1")).filter("at.o < o1")
        single = single.select("at.*", F.col("w1").alias("anchor"), F.col("w1").alias("c1"), F.col("w2").alias("c2"))
        wanted = scratch.table(few.unionByName(single), "wanted")
        found = scratch.table(_automata(_strings(docs, wanted, window), window), "found")
        owners = found.join(single.select(*full), full, "left_semi").select(F.col("c1").alias("w1"), F.col("c2").alias("w2"), F.col("firsts")[0].alias("first"))
        each = loose.select("o", "i", "w1", "w2", *full).join(scratch.table(owners, "owners"), ["w1", "w2"], "left").withColumn("first", F.coalesce("first", "o"))
        lists = each.groupBy(*full).agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "first"))), lambda e: e["first"]).alias("firsts"))
        firsts = scratch.table(found.join(few.select(*full), full, "left_semi").unionByName(lists), "firsts")
        scratch.drop(loose, wanted, found)
    scratch.drop(distinct, crowded)
    judged = met.join(firsts, full).select(*at, F.transform("firsts", lambda f: f < F.col("o")).alias("mask"))
    judged = judged.filter(F.exists("mask", lambda x: x))
    return judged.withColumn("mask", F.when(~F.forall("mask", lambda x: x), F.col("mask")))


def remove_repeats(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    window: int = 50,
    gram: int = 25,
    crowd: int = 400,
) -> DataFrame:
    """One row per document: id, n_words, n_removed, kept_text (kept words joined by one space)."""
    spark = docs.sparkSession
    ship(spark)
    scratch = Scratch(spark, "passages")
    text, key = F.coalesce(named(docs, text_col), F.lit("")), named(docs, id_col)
    base = docs.select(key.alias("id"), F.coalesce(key.cast("long"), F.lit(_LAST)).alias("o"), F.xxhash64(text).alias("th"), text.alias("text"))
    found = mark_repeats(base, scratch, window, gram, crowd)
    lists = found.distinct().groupBy("o", "th").agg(F.collect_list(F.struct("start", "wins", "mask")).alias("parts"))
    schema = T.StructType(
        [
            T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("n_words", T.LongType()),
            T.StructField("n_removed", T.LongType()), T.StructField("kept_text", T.StringType()),
        ]
    )

    def run(batches):
        for batch in batches:
            for a, b, data, offsets in text_slices(batch.column("text")):
                w = split_words(data, offsets, False)
                gone = np.zeros(len(w.hash) + 1, np.int64)  # +1 where a covered span begins, -1 behind it
                for k, parts in enumerate(batch.column("parts").slice(a, b - a).to_pylist()):
                    for p in parts or ():
                        s = int(w.first[k]) + p["start"]
                        if p["mask"] is None:
                            gone[s] += 1
                            gone[s + p["wins"] + window - 1] -= 1
                        else:
                            for i in np.flatnonzero(p["mask"]):
                                gone[s + i] += 1
                                gone[s + i + window] -= 1
                keep = np.cumsum(gone[:-1]) == 0
                raw, texts, n, r = data.tobytes(), [], [], []
                for k in range(b - a):
                    x, y = w.first[k], w.first[k + 1]
                    at = np.flatnonzero(keep[x:y]) + x
                    texts.append(b" ".join([raw[i:j] for i, j in zip(w.start[at].tolist(), w.stop[at].tolist())]).decode("utf-8"))
                    n.append(int(y - x))
                    r.append(int(y - x) - len(at))
                cols = [batch.column("id").slice(a, b - a), pa.array(n, pa.int64()), pa.array(r, pa.int64()), pa.array(texts, pa.string())]
                yield pa.RecordBatch.from_arrays(cols, names=schema.names)

    return base.join(lists, ["o", "th"], "left").select("id", "text", "parts").mapInArrow(run, schema)
