import hashlib
import os
import random
import socket
import struct

import pytest
from pyspark.sql import functions as F

from quarry.__main__ import main
from quarry.api import Store
from quarry.operators import maintenance as mt


def block_of(data, links=()):
    return hashlib.md5(struct.pack(">I", len(links)) + b"".join(map(bytes.fromhex, links)) + struct.pack(">I", len(data)) + data).hexdigest()


def test_store(spark, tmp_path, capsys):
    s = Store(spark, str(tmp_path / "s"))
    leaf, other = block_of(b"leaf"), block_of(b"other")
    rows = lambda *r: spark.createDataFrame(list(r), "links array<string>, data binary")
    assert s.store_blocks(rows(([], b"leaf"), ([], b"leaf"), ([], b"other"))) == 2
    assert s.store_blocks(rows(([], b"leaf"))) == 0
    with pytest.raises(ValueError):
        s.store_blocks(rows((["0" * 32], b"x")))
    root = block_of(b"root", [leaf])
    assert s.store_blocks(rows(([leaf], b"root"))) == 1
    with pytest.raises(ValueError):
        s.add_dataset_state("a", "d", "01" * 16, "f" * 32, 1, 1)
    s.add_dataset_state("a", "d", "01" * 16, root, 10, 4)
    s.add_dataset_state("a", "d", "02" * 16, other, 20, 8)
    s.remove_dataset_state("a", "d", "02" * 16)
    assert [r["state"] for r in s.list_dataset("a", "d").collect()] == ["01" * 16]
    info = s.get_account_info("a").first()
    assert info["size"] == 14 and s.list_accounts().first()["n_states"] == 1
    assert [r["deleted"] for r in s.list_states_log("a", "d").collect()] == [False, True, True]
    assert [r["block"] for r in s.garbage().collect()] == [other]
    assert s.verify_blocks().count() == 0
    s.invalidate_dataset_state("a", "d", "01" * 16)
    assert s.list_dataset("a", "d").first()["note"] == " (INVALID)" and s.garbage().count() == 3
    assert s.rebuild_db().first()["flags"] == 0
    shown = s.show_block(root, verify=True).first()
    assert (shown["size_text"], shown["verified"], shown["link"]) == ("4B (raw data)", True, leaf)
    assert main([str(tmp_path / "s"), "list-states", "a", "d", "--log"], spark) == 0 and "DEL" in capsys.readouterr().out
    assert main([str(tmp_path / "s"), "verify"], spark) == 0
    assert {r["block"]: r["found"] for r in s.has_blocks(spark.createDataFrame([(leaf,), ("x",)], "block string")).collect()} == {leaf: True, "x": False}
    assert s.purge_states().count() == 1 and s.retention_plan("a", "d", 10**9).count() == 1


def test_counters_and_references(spark):
    e = spark.createDataFrame([("dir", "same", 0, 0), ("file", "same", 5, 0), ("file", "added", 100, 25)], "kind string, change string, size long, stored long")
    r = mt.session_counters(e).first()
    assert (r["directories"], r["files"], r["unchanged"], r["different"], r["read_bytes"], r["write_bytes"], r["compression"]) == (1, 2, 1, 1, 100, 25, 75.0)
    new = spark.createDataFrame([("a", "x"), ("b", "y"), ("c", "z")], "path string, content string")
    old = spark.createDataFrame([("a", "x", "r1"), ("b", "w", "r1")], "path string, content string, reference_id string")
    got = mt.carried_references(new, old, "r2")
    assert {r["path"]: r["reference_id"] for r in got.collect()} == {"a": "r1", "b": "r2", "c": "r2"}
    assert mt.newest_reference(got) == "r2"
    kept = mt.keep_unreadable(new, old.select("path", "content"), spark.createDataFrame([("b",)], "path string"))
    assert {r["path"]: r["content"] for r in kept.collect()} == {"a": "x", "b": "w", "c": "z"}
    assert mt.file_history(got.unionByName(got.withColumn("reference_id", F.lit("r3")))).count() == 6


def test_roots_slots_and_names(spark):
    tree = spark.createDataFrame([("",), ("f",)], "path string")
    assert [r["path"] for r in mt.virtual_root([("/z/b", tree), ("/y/a/", tree)]).collect()] == ["a", "a/f", "b", "b/f"]
    slots = spark.createDataFrame([(1 | 4, "00" * 15 + "01", 0, 40), (1 | 8, "00" * 16, 0, 16), (1, "00" * 15 + "05", 0, 16), (1, "00" * 16, 1, 17)], "flags int, block string, ix_file int, ix_offset long")
    assert {(r["flags"], r["file_end"]) for r in mt.compact_index(slots).collect()} == {(1, 64), (1, 41)}
    assert {r["fault"] for r in mt.slot_faults(slots).collect()} == {"before home", "off the grid"}
    assert mt.invalidate_slots(slots, slots.limit(1)).filter("flags & 8 <> 0").count() == 2
    p = mt.Positions('{"a.d": 7}')
    p.set("a", "e", 9)
    p.reset("a", "d")
    assert p.get("a", "d") == 0 and mt.Positions(p.dumps()).get("a", "e") == 9
    assert mt.parse_host("h", 1) == ("h", 1) and mt.parse_host("h:5", 1) == ("h", 5) and mt.parse_host("[::1]:5", 1) == ("::1", 5) and mt.parse_host("[::1]", 1) == ("::1", 1)
    kinds = spark.createDataFrame([(i,) for i in range(5)], "t int")
    row = kinds.select("t", mt.has_content_block(F.col("t")), mt.has_decrypt_key(F.col("t")), mt.has_link(F.col("t"))).collect()
    assert [tuple(r)[1:] for r in row] == [(False, False, False), (True, False, False), (True, True, False), (True, False, False), (False, False, True)]


def tree_of(folder):
    """{path: content, link target or None for a directory} of a folder."""
    out = {}
    for at, dirs, names in os.walk(folder):
        for name in dirs + names:
            path = os.path.join(at, name)
            key = os.path.relpath(path, folder)
            if not os.path.isfile(path) and not os.path.isdir(path) and not os.path.islink(path):
                continue  # reading a pipe would wait for ever
            out[key] = os.readlink(path) if os.path.islink(path) else None if os.path.isdir(path) else open(path, "rb").read()
    return out


def make_tree(folder):
    rng = random.Random(5)
    (folder / "sub" / "deep").mkdir(parents=True)
    (folder / "none").mkdir()
    (folder / "file1.txt").write_text("hello world\n")
    (folder / "empty").write_bytes(b"")
    (folder / "sub" / "large").write_bytes(bytes(rng.randrange(256) for _ in range(5000)))
    (folder / "sub" / "deep" / "copy").write_bytes((folder / "sub" / "large").read_bytes())
    (folder / "sub" / "notes.tmp").write_text("ignored")
    (folder / "sub" / "näme").write_text("é")
    os.symlink("../file1.txt", folder / "sub" / "link")
    os.mkfifo(folder / "pipe")
    os.chmod(folder / "file1.txt", 0o640)


def test_folders_are_stored_restored_and_compared(spark, tmp_path, capsys):
    src, dst, path = tmp_path / "src", tmp_path / "dst", str(tmp_path / "s")
    src.mkdir()
    make_tree(src)
    s = Store(spark, path)
    sizes = {"least": 64, "most": 1024}
    one = s.store_folder("a", "d", str(src), ["*.tmp"], **sizes)
    assert one["unreadable"] == [] and one["size"] == one["unique_size"] == 12 + 2 * 5000 + 2
    assert s.verify_blocks().isEmpty() and s.garbage().isEmpty()
    entries = {r["path"]: r for r in s.snapshot("a", "d").collect()}
    assert set(entries) == set(tree_of(src)) - {"sub/notes.tmp"}
    assert {p: r["content_type"] for p, r in entries.items()} == {
        "file1.txt": 2, "empty": 0, "none": 1, "sub": 1, "sub/deep": 1, "sub/deep/copy": 3, "sub/large": 3, "sub/link": 4, "sub/näme": 2,
    }
    assert s.restore_folder("a", "d", str(dst)) == len(entries)
    want = {p: x for p, x in tree_of(src).items() if p in entries}
    assert tree_of(dst) == want
    for p in ("file1.txt", "sub/large", "empty"):
        a, b = os.stat(src / p), os.stat(dst / p)
        assert (a.st_mode, a.st_mtime_ns, a.st_size) == (b.st_mode, b.st_mtime_ns, b.st_size)
    assert s.diff_folder("a", "d", str(dst), **sizes).filter("status <> 'same'").isEmpty()
    # a second run reads only what has changed, and unchanged files keep their reference
    (src / "file1.txt").write_text("changed")
    os.remove(src / "sub" / "näme")
    before = s.blocks().count()
    two = s.store_folder("a", "d", str(src), ["*.tmp"], **sizes)
    assert two["unique_size"] == 7 and two["size"] == 7 + 2 * 5000
    assert s.blocks().count() == before + 3  # the file, and the directories above both changes
    reference = {r["path"]: r["reference_id"] for r in s.snapshot("a", "d").collect()}
    assert reference["sub/large"] == one["state"] and reference["file1.txt"] == two["state"]
    status = {(r["parent"], r["name"]): r["status"] for r in s.diff_folder("a", "d", str(dst), **sizes).collect()}
    assert {k for k, v in status.items() if v != "same"} == {("", "file1.txt"), ("sub", "näme")} and status["sub", "näme"] == "extra"
    # the first state is still there, also through the shell
    again = tmp_path / "again"
    assert main([path, "restore", "a", "d", str(again), "--state", one["state"], "--path", "sub"], spark) == 0
    assert tree_of(again) == {p: x for p, x in want.items() if p.startswith("sub")}
    assert main([path, "list", "a", "d", "/sub/*a*"], spark) == 0 and "sub/large" in capsys.readouterr().out
    assert main([path, "diff", "a", "d", str(src)], spark) == 1
    # deleting a state leaves its own blocks to the collector
    s.remove_dataset_state("a", "d", one["state"])
    dead = s.garbage().count()
    assert dead == 4 and main([path, "gc", "--apply"], spark) == 0 and s.garbage().isEmpty() and s.verify_blocks().isEmpty()
    assert main([path, "purge-states", "--apply"], spark) == 0 and s.log().count() == 1


def test_unreadable_files_keep_their_entry(spark, tmp_path, monkeypatch):
    src = tmp_path / "src"
    src.mkdir()
    (src / "a").write_text("one")
    (src / "b").write_text("two")
    s = Store(spark, str(tmp_path / "s"))
    s.store_folder("a", "d", str(src))
    (src / "a").write_text("changed")
    (src / "c").write_text("new")
    from quarry.operators import ingest

    real = ingest.file_chunks

    def failing(files, folder, **kw):
        lost = files.select("path", F.lit(-1).alias("ordinal"), F.lit(None).cast("binary").alias("data"), F.lit("Permission denied").alias("error"))
        return real(files.limit(0), folder, **kw).unionByName(lost)

    monkeypatch.setattr(ingest, "file_chunks", failing)
    got = s.store_folder("a", "d", str(src))
    assert got["unreadable"] == [("a", "Permission denied"), ("c", "Permission denied")]
    assert {r["path"]: r["size"] for r in s.snapshot("a", "d").collect()} == {"a": 3, "b": 3}


def test_administration_rewrites(spark, tmp_path):
    path = str(tmp_path / "s")
    s = Store(spark, path)
    leaf = block_of(b"leaf")
    s.store_blocks(spark.createDataFrame([([], b"leaf")], "links array<string>, data binary"))
    for state in ("01", "02"):
        s.add_dataset_state("a", "d", state * 16, leaf, 1, 1)
    s.add_dataset_state("a", "e", "03" * 16, leaf, 1, 1)
    s.add_dataset_state("b", "d", "04" * 16, leaf, 1, 1)
    s.remove_dataset_state("a", "d", "01" * 16)
    assert s.apply_purge() == 2 and [r["state"] for r in s.list_dataset("a", "d").collect()] == ["02" * 16]
    assert spark.read.parquet(path + "/log.bak").count() == 5
    assert main([path, "move-dataset", "a", "d", "a", "e"], spark) == 0
    assert [(r["seq"], r["state"][:2]) for r in s.list_states_log("a", "e").collect()] == [(0, "02"), (1, "03")]
    assert s.list_dataset("a", "d").isEmpty()
    assert main([path, "delete-dataset", "a", "e"], spark) == 0 and {r["account"] for r in s.list_accounts().collect()} == {"b"}
    assert main([path, "delete-account", "b"], spark) == 0 and s.list_accounts().isEmpty()
    bad = spark.createDataFrame([("f" * 32, [], 255, b"other")], "block string, links array<string>, data_type int, data binary")
    s._append("blocks", bad)
    s._append("blocks", s.blocks().filter(F.col("block") == leaf))
    assert main([path, "verify"], spark) == 2 and s.recover() == 2 and s.recover() == 0
    assert [r["block"] for r in s.blocks().collect()] == [leaf] and s.collect_garbage() == 1


def test_special_files_are_not_storable(spark, tmp_path):
    from quarry.operators import snapshot
    from quarry.sources import store

    (tmp_path / "file").write_text("x")
    (tmp_path / "dir").mkdir()
    os.mkfifo(tmp_path / "pipe")
    with socket.socket(socket.AF_UNIX) as sock:
        sock.bind(str(tmp_path / "sock"))
        tree = store.read(spark, "tree", str(tmp_path))
        assert {r["name"] for r in snapshot.storable(tree).collect()} == {"file", "dir"} and tree.count() == 4
    assert store.entry_mode(0o060644) == 1 << 26 | 0o644 and store.entry_mode(0o100755) == 0o755


def test_caches_and_resume_files(spark):
    caches = spark.createDataFrame([(mt.cache_name("a/b:c", "r1"), "a/b:c"), (mt.cache_name("a/b:c", "r2"), "a/b:c"), ("other", "x")], "name string, dataset string")
    assert [r["name"] for r in mt.stale_caches(caches, "a/b:c", "r2").collect()] == ["a_b_c.r1.cache"]
    files = spark.createDataFrame([("b", 5), ("a", 5), ("c", 9)], "path string, mtime_ns long")
    assert [r["path"] for r in mt.newest_first(files).collect()] == ["c", "a", "b"]
    assert spark.range(1).select(mt.name_hash(F.lit("abc"))).first()[0] == hashlib.md5(b"abc").hexdigest()


def test_room_and_locks(tmp_path, monkeypatch):
    from collections import namedtuple

    free = {"ix": mt.LEAST_INDEX_FREE, "dat": (1 << 26) + 100}
    monkeypatch.setattr(mt.shutil, "disk_usage", lambda p: namedtuple("Usage", "free")(free[p]))
    assert mt.has_room("ix", "dat", 100) and not mt.has_room("ix", "dat", 101)
    free["ix"] -= 1
    assert not mt.has_room("ix", "dat", 1)
    path = str(tmp_path / "lock")
    with mt.exclusive(path):
        with pytest.raises(TimeoutError):
            with mt.exclusive(path, wait=0.2):
                pass
    with mt.exclusive(path):
        pass
