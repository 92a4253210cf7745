import hashlib
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quarry.operators import blocks as blk
from quarry.operators import chunking, graph, snapshot
from quarry.plans.components import contract
from quarry.plans.fixpoint import closure
from quarry.plans.scratch import Scratch


def edges(spark, pairs):
    return spark.createDataFrame(pairs, "src string, dst string")


def nodes(spark, names):
    return spark.createDataFrame([(n,) for n in names], "node string")


def test_diamond_chain_and_depth(spark):
    pairs = [("r", "a"), ("r", "b"), ("a", "c"), ("b", "c"), ("x", "y")] + [(f"d{i}", f"d{i + 1}") for i in range(6)] + [("c", "d0")]
    got = {r["node"]: r["level"] for r in closure(edges(spark, pairs), nodes(spark, ["r"])).collect()}
    assert got["c"] == 2 and got["d6"] == 9 and "x" not in got and len(got) == 11


def test_invalidity_reaches_both_roots(spark):
    e = edges(spark, [("r1", "a"), ("r2", "b"), ("a", "leaf"), ("b", "leaf"), ("r3", "c")])
    assert {r["node"] for r in graph.invalid_blocks(e, nodes(spark, ["leaf"])).collect()} == {"leaf", "a", "b", "r1", "r2"}
    have = spark.createDataFrame([(n,) for n in ["r1", "r2", "r3", "a", "b", "leaf"]], "block string")
    assert {r["node"] for r in graph.invalid_blocks(e, nodes(spark, []), have).collect()} == {"r3"}


def test_subtrees_of_known_blocks_are_not_sent(spark):
    e = edges(spark, [("r", "a"), ("a", "b"), ("r", "c")])
    assert {r["node"] for r in graph.blocks_to_send(e, nodes(spark, ["r"]), nodes(spark, ["a"])).collect()} == {"r", "c"}
    assert graph.blocks_to_send(e, nodes(spark, ["r"]), nodes(spark, ["r"])).count() == 0


def test_compaction_limits(spark):
    big = graph.MAX_FILE
    files = spark.createDataFrame([(1, big, big * 499 // 10000), (2, big, big // 20 + 1), (3, big // 100 - 1, 0), (4, big // 100, 0)], "file int, file_size long, dead long")
    assert {r["file"] for r in graph.compact_candidates(files).collect()} == {2, 3}


def test_components_against_union_find(spark):
    rng = random.Random(3)
    pairs = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(0, i) for i in range(300, 400)] + [(i, i + 1) for i in range(500, 900)] + [(i, i - 2) for i in range(2000, 1500, -2)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = {r["node"]: r["root"] for r in contract(spark.createDataFrame(pairs, "a long, b long"), Scratch(spark, "t")).collect()}
    linked = {x for a, b in pairs if a != b for x in (a, b)}
    assert got == {x: find(x) for x in linked}
    assert contract(spark.createDataFrame([], "a long, b long"), Scratch(spark, "t")).count() == 0


def test_dedup_and_recovery(spark):
    b = spark.createDataFrame([("x", 2, "late"), ("x", 1, "first"), ("y", 3, "only")], "block string, ord long, note string")
    assert {(r["block"], r["note"], r["copies"]) for r in blk.distinct_blocks(b, "ord").collect()} == {("x", "first", 2), ("y", "only", 1)}
    copies = spark.createDataFrame([("x", 0, 16, 5), ("x", 1, 16, 5), ("y", 0, 99, 7)], "block string, file int, offset long, size long")
    index = spark.createDataFrame([("x", 0, 16), ("z", 5, 5)], "block string, file int, offset long")
    assert {(r["block"], r["change"]) for r in blk.repairs(blk.recovered(copies), index).collect()} == {("x", "moved"), ("y", "added"), ("z", "lost")}


def entry(spark, rows):
    cols = "parent string, name string, kind string, size long, mode int, mtime_ns long, content string, target string"
    return spark.createDataFrame(rows, cols)


def test_diff_modes(spark):
    f = lambda n, content="c", mode=0o644, size=1: ("d", n, "file", size, mode, 0, content, None)
    local = entry(spark, [f("a"), f("b", "x"), f("e"), f("m", mode=0o600), f("n", size=0, mode=0o600), f("z")])
    remote = entry(spark, [f("b", "y"), f("c"), f("e"), f("m"), f("n", size=0)])
    strict = {r["name"]: r["status"] for r in snapshot.diff(local, remote, strict=True).collect()}
    assert strict == {"a": "extra", "b": "different", "c": "missing", "e": "same", "m": "same", "n": "different", "z": "extra"}
    loose = {r["name"] for r in snapshot.diff(local, remote).collect()}
    assert loose == set("abcemn")  # the merge ends with the remote list
    assert snapshot.diff(local, entry(spark, [])).count() == 0


def test_change_rules(spark):
    cols = "path string, name string, size long, mode int, mtime_ns long, content string, off boolean"
    old = spark.createDataFrame([(p, p, 1, 1, 1_000_000_500, "c", False) for p in "abc"], cols)
    new = spark.createDataFrame([("a", "a", 1, 1, 1_000_000_500, "n", False), ("b", "b", 1, 2, 1_000_000_900, "n", True), ("c", "c", 1, 1, 1_000_000_900, "n", False), ("d", "d", 1, 1, 1, "n", False)], cols)
    assert {r["path"]: r["change"] for r in snapshot.changes(new, old, "off").collect()} == {"a": "same", "b": "same", "c": "changed", "d": "added"}


def test_merkle_changes_with_any_leaf(spark):
    def root(files):
        df = spark.createDataFrame(files, "path string, size long, content string")
        return {r["path"]: r["id"] for r in graph.tree_hashes(snapshot.with_directories(df)).collect()}

    one = root([("a/x", 1, "c1"), ("a/b/y", 2, "c2"), ("z", 3, "c3")])
    two = root([("a/x", 1, "c1"), ("a/b/y", 2, "CHANGED"), ("z", 3, "c3")])
    assert one["a"] != two["a"] and one[""] != two[""] and one["a/x"] == two["a/x"]
    assert root([("z", 3, "c3"), ("a/b/y", 2, "c2"), ("a/x", 1, "c1")]) == one


def test_first_mismatch(spark):
    df = spark.createDataFrame([("a" * 40, "a" * 33 + "b" * 7), ("same", "same"), ("", ""), ("x" * 20, "x" * 10)], "a string, b string")
    assert [r[0] for r in df.select(snapshot.first_mismatch(F.col("a"), F.col("b"))).collect()] == [32, None, None, 0]


def test_resume_trusts_descendants(spark):
    e = spark.createDataFrame([("d", True, "D"), ("d/x", False, "gone"), ("f", False, "F"), ("g", False, "G")], "path string, is_dir boolean, content string")
    store = spark.createDataFrame([("D",), ("F",)], "block string")
    assert {r["path"] for r in snapshot.resumed(e, store).collect()} == {"d", "d/x", "f"}


def plain_digest(data, window):
    """Two 16-bit sums over a ring of bytes, one byte in and one out at a time."""
    out, s1, s2, ring = [], 0, 0, []
    for c in data:
        if len(ring) == window:
            old = ring.pop(0)
            s1 -= old + 31
            s2 -= window * (old + 31)
        ring.append(c)
        s1 += c + 31
        s2 += s1
        if len(ring) == window:
            out.append((s2 & 0xFFFF) << 16 | s1 & 0xFFFF)
    return out


@settings(max_examples=60, deadline=None)
@given(st.binary(min_size=0, max_size=600), st.integers(4, 40), st.integers(1, 6))
def test_chunking_properties(data, least, times):
    import numpy as np

    most = least * 2 + least * times
    cuts = chunking.cut_points(data, least, most)
    sizes = [b - a for a, b in zip([0, *cuts], cuts)]
    assert sum(sizes) == len(data) and all(0 < x <= most for x in sizes) and all(x >= least for x in sizes[:-1])
    if len(data) >= least:
        assert list(chunking.window_digests(np.frombuffer(data, np.uint8), least)) == plain_digest(data, least)


@pytest.mark.parametrize("size, count", [(0, 0), (1, 1), (128, 1), (129, 1), (1024, 1), (1025, 2)])
def test_chunk_sizes(size, count):
    assert len(chunking.cut_points(b"\0" * size, 64, 1024)) == count  # all digests tie: the last place wins


def test_chunks_hash_as_blocks_without_links(spark):
    df = spark.createDataFrame([(1, b"hello"), (2, b""), (3, None)], "id long, data binary")
    rows = chunking.chunk_files(df, "id", "data").collect()
    want = hashlib.md5(b"\0\0\0\0" + b"\0\0\0\5hello").hexdigest()
    assert [(r["id"], r["length"], r["block"]) for r in rows] == [(1, 5, want)]
