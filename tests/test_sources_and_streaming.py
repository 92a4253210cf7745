import hashlib
import io
import os
import random
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quarry.operators import snapshot, txlog
from quarry.sources import decode, formats, store
from quarry.streaming import sync as stream_sync

ID = st.binary(min_size=16, max_size=16).map(bytes.hex)
I64 = st.integers(0, 2**63 - 1)


def md5(x):
    return hashlib.md5(x.encode()).hexdigest()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(ID, st.lists(ID, max_size=3), st.binary(max_size=50)), max_size=6))
def test_data_files_round_trip(blocks):
    raw = formats.file_header(formats.DATA_TYPE) + b"".join(formats.pack_data(b, ls, formats.RAW, d) for b, ls, d in blocks)
    got = list(formats.read_data(io.BytesIO(raw), 3))
    assert [(r[0], r[1], r[3]) for r in got] == blocks and not any(r[8] for r in got)
    assert sum(r[7] for r in got) + formats.HEADER == len(raw)
    assert [r[3] for r in formats.read_data(io.BytesIO(raw), payload=False)] == [None] * len(blocks)


def test_gaps_and_corruption():
    one, two = formats.pack_data(md5("a"), [], formats.RAW, b"one"), formats.pack_data(md5("b"), [md5("a")], formats.RAW, b"two")
    gap = formats.pack_gap(40) + b"\7" * 28
    raw = formats.file_header(formats.DATA_TYPE) + one + gap + b"junk" + two + one[:20]
    got = list(formats.read_data(io.BytesIO(raw)))
    assert [(r[3], r[8]) for r in got] == [(b"one", False), (None, True), (b"two", False), (None, True)]
    assert got[1][4] == 4 and got[3][4] == 20


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(ID, st.integers(0, 2**14 - 1), st.integers(0, 2**34 - 1), st.integers(0, 2**32 - 1), st.lists(ID, max_size=3)), max_size=5))
def test_meta_and_index_round_trip(rows):
    raw = formats.file_header(formats.META_TYPE) + b"".join(formats.pack_meta(*r) for r in rows)
    assert [r[:5] for r in formats.read_meta(io.BytesIO(raw))] == rows
    assert len(raw) == 16 + sum(34 + 16 * len(r[4]) for r in rows)
    ix = formats.file_header(formats.INDEX_TYPE) + bytes(24) + b"".join(formats.pack_index(1, *r[:3]) for r in rows)
    assert [r[1:4] for r in formats.read_index(io.BytesIO(ix))] == [r[:3] for r in rows]


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=20), st.lists(st.tuples(I64, st.one_of(st.tuples(st.just("DEL"), ID), st.tuples(st.just("ADD"), ID, ID, I64, I64))), max_size=6), st.integers(0, 40))
def test_logs_end_cleanly_when_torn(name, txs, cut):
    raw = formats.name_header(formats.LOG_TYPE, name) + b"".join(formats.pack_tx(ts, *t) for ts, t in txs)
    whole = list(formats.read_log(io.BytesIO(raw)))
    assert [(r[4], *r[5:]) for r in whole] == [(ts, *t, *([None] * (5 - len(t)))) for ts, t in txs]
    head = len(formats.name_header(formats.LOG_TYPE, name))
    torn = list(formats.read_log(io.BytesIO(raw[: max(head, len(raw) - cut)])))
    assert torn == [r for r in whole if r[3] <= max(head, len(raw) - cut)]


def test_versions_are_checked():
    raw = formats.file_header(formats.DATA_TYPE)
    with pytest.raises(ValueError):
        list(formats.read_data(io.BytesIO(raw[:7] + b"\2" + raw[8:])))
    with pytest.raises(ValueError):
        list(formats.read_meta(io.BytesIO(raw)))


def entries():
    base = {"size": 7, "mode": 0o644, "mtime_ns": 123, "reference_id": md5("r"), "content": None, "decrypt_key": None, "target": None}
    return [
        {**base, "name": "empty", "content_type": 0}, {**base, "name": "dir", "content_type": 1, "content": md5("d")},
        {**base, "name": "data", "content_type": 2, "content": md5("x"), "decrypt_key": "0" * 32},
        {**base, "name": "chain", "content_type": 3, "content": md5("c")}, {**base, "name": "lïnk", "content_type": 4, "target": "../a"},
    ]


def test_directory_and_chain_blocks(spark):
    assert formats.read_directory(formats.pack_directory(entries())) == entries()
    links = [(md5("a"), md5("k")), (md5("b"), md5("l"))]
    assert formats.read_chain(formats.pack_chain(links)) == links
    with pytest.raises(ValueError):
        formats.read_chain(formats.pack_directory([]))
    rows = decode.exploded_directories(spark.createDataFrame([("b", formats.pack_directory(entries()))], "block string, data binary")).collect()
    assert [(r["ordinal"], r["name"], r["target"]) for r in rows][4] == (4, "lïnk", "../a")
    rows = decode.exploded_chains(spark.createDataFrame([("b", formats.pack_chain(links))], "block string, data binary")).collect()
    assert [(r["ordinal"], r["block"]) for r in rows] == [(0, md5("a")), (1, md5("b"))]


def test_store_source(spark, tmp_path):
    data = [(md5(f"n{i}"), [md5(f"n{i - 1}")] if i else [], formats.ZLIB, zlib.compress(b"x" * i)) for i in range(5)]
    for no in range(2):
        (tmp_path / f"{no:08X}.dat").write_bytes(formats.file_header(formats.DATA_TYPE, 7) + b"".join(formats.pack_data(*d) for d in data))
    (tmp_path / "00000000.meta").write_bytes(formats.file_header(formats.META_TYPE) + b"".join(formats.pack_meta(d[0], 0, 16, 5, d[1]) for d in data))
    (tmp_path / "00000000.idx").write_bytes(formats.file_header(formats.INDEX_TYPE) + formats.pack_index(1, data[0][0], 0, 16))
    (tmp_path / "a.info").write_bytes(formats.pack_account("acc", "0" * 32, [("ds", 5, md5("l"))]))
    path = str(tmp_path)
    blocks = store.read(spark, "data", path)
    assert blocks.count() == 10 and blocks.filter("file = 1").count() == 5
    assert store.read(spark, "data", path, **{"from": "1", "to": "1", "payload": "false"}).filter("data is null").count() == 5
    assert store.read(spark, "meta", path).count() == 5 and store.read(spark, "index", path).first()["meta_offset"] == 16
    assert {(r["deadspace"], r["file_type"] == r["expected_type"]) for r in store.read(spark, "headers", path).collect()} == {(7, True), (0, True)}
    assert store.read(spark, "accounts", path).first()["dataset"] == "ds"
    assert store.read(spark, "log", path).count() == 0


def write_dataset(folder, name, rows, append=False):
    store.write_log(os.path.join(folder, store.log_file_name("acc", name)), name, rows, append)


def test_log_source_and_cache(spark, tmp_path):
    rows = [(1, "ADD", md5("one"), md5("b1"), 10, 4), (2, "ADD", md5("two"), md5("b2"), 20, 8), (3, "DEL", md5("one"))]
    write_dataset(tmp_path, "photos", rows)
    write_dataset(tmp_path, "docs", rows[:1])
    log = store.read(spark, "log", str(tmp_path)).withColumnRenamed("account_h", "account")
    live = {(r["dataset"], r["state"]) for r in txlog.live_states(log).collect()}
    assert live == {("photos", md5("two")), ("docs", md5("one"))}
    assert store.read(spark, "log", str(tmp_path), dataset="docs").count() == 1
    path = os.path.join(tmp_path, store.log_file_name("acc", "docs"))
    assert store.dataset_of_log(path) == "docs"
    os.rename(path, path.replace(store.log_file_name("acc", "docs"), store.log_file_name("acc", "else")))
    with pytest.raises(ValueError):
        store.dataset_of_log(os.path.join(tmp_path, store.log_file_name("acc", "else")))
    os.rename(os.path.join(tmp_path, store.log_file_name("acc", "else")), path)
    (tmp_path / "x.y.db").write_bytes(formats.pack_cache("photos", [(0x80, md5("s"), md5("b"), 1, -2)]))
    assert store.read(spark, "cache", str(tmp_path)).first()["unique_size"] == -2


def test_log_stream_waits_for_whole_records(spark, tmp_path):
    logs, out, check = tmp_path / "logs", str(tmp_path / "replica"), str(tmp_path / "check")
    logs.mkdir()
    add = lambda ts, name, size=1: (ts, "ADD", md5(name), md5("b" + name), size, size)
    write_dataset(logs, "ds", [add(1, "one"), add(2, "two")])
    path = next(logs.glob("*.trn"))
    whole = path.read_bytes() + formats.pack_tx(3, "DEL", md5("one"))
    path.write_bytes(whole[:-4])  # the last record is torn
    replica = stream_sync.Replica(spark, out)

    def run():
        stream = store.read_log_stream(spark, str(logs)).withColumnRenamed("account_h", "account").drop("pos", "end_pos")
        q = stream_sync.replicate(stream, replica, check, interval="1 second")
        q.processAllAvailable()
        q.stop()

    run()
    assert {r["state"] for r in replica.states().collect()} == {md5("one"), md5("two")}
    path.write_bytes(whole)
    run()
    assert {r["state"] for r in replica.states().collect()} == {md5("two")}
    assert replica.blocks().count() == 2 and replica.log().count() == 3


def log_rows(n, name):
    return [(i, "ADD", md5(f"{name}{i}"), md5(f"b{name}{i}"), i, i) if i % 3 else (i, "DEL", md5(f"{name}{i - 1}")) for i in range(1, n + 1)]


def test_log_positions_are_those_of_whole_records():
    raw = formats.name_header(formats.LOG_TYPE, "x") + b"".join(formats.pack_tx(*r) for r in log_rows(9, "x"))
    ends = [r[3] for r in formats.read_log(io.BytesIO(raw))]
    for cut in range(14, len(raw) + 1):
        at, n = formats.log_end(io.BytesIO(raw[:cut]))
        assert n == sum(e <= cut for e in ends) and at == ([13] + ends)[n]
    assert formats.log_end(io.BytesIO(raw), ends[2], 3, most=4) == (ends[6], 7)


def reader(path, **options):
    return store.LogStream({"path": str(path), **options})


def test_two_datasets_of_an_account_are_read_again_alike(tmp_path):
    """What a batch had before a failure it has again, whatever other logs of its account there are."""
    write_dataset(tmp_path, "photos", log_rows(5, "p"))
    write_dataset(tmp_path, "docs", log_rows(2, "d"))
    one = reader(tmp_path)
    start, end = one.initialOffset(), one.latestOffset()
    rows = lambda r, a, b: sorted(x for p in r.partitions(a, b) for x in r.read(p))
    first = rows(one, start, end)
    assert len(first) == 7 and len(one.partitions(start, end)) == 2
    write_dataset(tmp_path, "photos", log_rows(9, "p")[5:], append=True)
    write_dataset(tmp_path, "new", log_rows(4, "n"))
    two = reader(tmp_path)  # after a restart
    assert rows(two, start, end) == first
    assert len(rows(two, end, two.latestOffset())) == 4 + 4 and two.partitions(end, end) == []
    with pytest.raises(ValueError):
        two.partitions(two.latestOffset(), end)


def test_batches_have_a_limit(tmp_path):
    write_dataset(tmp_path, "long", log_rows(40, "l"))
    write_dataset(tmp_path, "short", log_rows(3, "s"))
    options = {"maxRecordsPerBatch": "10", "positions": str(tmp_path / "positions.json")}
    r = reader(tmp_path, **options)
    at, seen, batches = r.initialOffset(), [], []
    while True:
        if len(batches) == 2:
            r = reader(tmp_path, **options)  # a restart goes on where it stood
        end = r.latestOffset()
        if end == at:
            break
        got = [x for p in r.partitions(at, end) for x in r.read(p)]
        batches.append(len(got))
        seen += got
        at = end
    assert max(batches) <= 10 and len(seen) == 43 == len(set(seen)) and len(batches) >= 5
    assert {x[1] for x in seen[:10]} == {"long", "short"}  # no log waits for another
    with pytest.raises(ValueError):
        reader(tmp_path, maxRecordsPerBatch="5")


@pytest.mark.parametrize("limit", [None, "4"])
def test_replication_survives_a_failed_batch(spark, tmp_path, limit):
    """A batch fails after it was planned; a new query on the same checkpoint applies every transaction."""
    logs = tmp_path / "logs"
    logs.mkdir()
    write_dataset(logs, "photos", log_rows(11, "p"))
    write_dataset(logs, "docs", log_rows(5, "d"))
    options = {} if limit is None else {"maxRecordsPerBatch": limit, "positions": str(tmp_path / "positions.json")}
    out, check = str(tmp_path / "replica"), str(tmp_path / "check")
    stream = lambda: store.read_log_stream(spark, str(logs), **options).withColumnRenamed("account_h", "account").drop("pos", "end_pos")

    class Failing(stream_sync.Replica):
        def write(self, rows, name, batch):
            if name == "log":
                raise RuntimeError("killed")
            super().write(rows, name, batch)

    q = stream_sync.replicate(stream(), Failing(spark, out), check, interval="1 second")
    with pytest.raises(Exception):
        q.processAllAvailable()
    q.stop()
    path = next(p for p in logs.glob("*.trn") if store.dataset_of_log(str(p)) == "docs")
    whole = path.read_bytes() + formats.pack_tx(6, "ADD", md5("late"), md5("blate"), 1, 1)
    path.write_bytes(whole[:-7])  # the log has grown meanwhile, and its end is torn
    replica = stream_sync.Replica(spark, out)
    q = stream_sync.replicate(stream(), replica, check, interval="1 second")
    q.processAllAvailable()
    path.write_bytes(whole)
    q.processAllAvailable()
    done = stream_sync.transfer_statistics(q)
    q.stop()
    assert done["rows"] >= 1 and done["batches"] >= 1 and done["rows_per_second"] > 0
    log = store.read(spark, "log", str(logs)).withColumnRenamed("account_h", "account")
    want = {(r["dataset"], r["state"]) for r in txlog.live_states(log).collect()}
    assert {(r["dataset"], r["state"]) for r in replica.states().collect()} == want and ("docs", md5("late")) in want


def test_batches_are_idempotent_and_dry_runs_write_nothing(spark, tmp_path):
    replica = stream_sync.Replica(spark, str(tmp_path / "r"))
    rows = [("a", "d", 0, 1, "ADD", "s1", "b1", 5, 5), ("a", "d", 1, 2, "ADD", "s2", "b1", 5, 5), ("a", "d", 2, 3, "DEL", "s1", None, None, None)]
    batch = spark.createDataFrame(rows, "account string, dataset string, seq long, ts_ns long, op string, state string, block string, size long, unique_size long")
    dry = stream_sync.apply_batch(batch, 0, replica, dry_run=True)
    assert {(r["seq"], r["action"]) for r in dry.collect()} == {(0, "skip: deleted later"), (1, "add"), (2, "skip: not there")}
    assert replica.log().count() == 0
    for _ in range(2):
        stream_sync.apply_batch(batch, 0, replica)
    assert replica.log().count() == 1 and replica.blocks().count() == 1
    again = stream_sync.apply_batch(batch, 1, replica)
    assert {r["action"] for r in again.collect()} == {"skip: deleted later", "skip: already there", "skip: not there"}


def test_tree_source_and_restore(spark, tmp_path):
    src, dst = tmp_path / "src", tmp_path / "dst"
    (src / "sub").mkdir(parents=True)
    (src / "file1.txt").write_text("hello world\n")
    (src / "sub" / "file2.txt").write_text("subfile\n")
    os.symlink("../file1.txt", src / "sub" / "link-to-file1")
    tree = store.read(spark, "tree", str(src))
    rows = {r["path"]: r for r in tree.collect()}
    assert {p: r["kind"] for p, r in rows.items()} == {"file1.txt": "file", "sub": "dir", "sub/file2.txt": "file", "sub/link-to-file1": "link"}
    contents = {"file1.txt": b"hello world\n", "sub/file2.txt": b"subfile\n"}
    full = [(p, r["kind"], contents.get(p), r["mode"] if r["kind"] != "link" else None, r["mtime_ns"] if r["kind"] == "file" else None, r["target"]) for p, r in rows.items()]
    decode.restore_files(spark.createDataFrame(full, "path string, kind string, content binary, mode int, mtime_ns long, target string"), str(dst))
    back = {r["path"]: (r["kind"], r["size"], r["target"]) for r in store.read(spark, "tree", str(dst)).collect()}
    assert back == {p: (r["kind"], r["size"], r["target"]) for p, r in rows.items()}
    assert os.stat(dst / "file1.txt").st_mtime_ns == os.stat(src / "file1.txt").st_mtime_ns


def test_chunks_restore_in_order(spark):
    rng = random.Random(1)
    parts = [("f", i, "".join(rng.choice("ab") for _ in range(rng.randrange(5)))) for i in range(20)]
    df = spark.createDataFrame(parts, "file string, n int, data string").repartition(4)
    assert snapshot.restored(df, "file", "n", "data").first()["content"] == "".join(p[2] for p in parts)


def test_records_are_written_in_order(spark, tmp_path):
    rows = [(f"f{i % 3}", i, bytes([i])) for i in range(60)]
    store.write_records(spark.createDataFrame(rows, "file string, ordinal long, record binary").repartition(7), str(tmp_path / "out"))
    assert {p.name: p.read_bytes() for p in (tmp_path / "out").iterdir()} == {f"f{k}": bytes(range(k, 60, 3)) for k in range(3)}


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=3000), st.integers(4, 40), st.integers(2, 12))
def test_streamed_chunks_are_the_files_chunks(data, least, times):
    from quarry.operators import chunking

    ends, most = chunking.cut_points(data, least, least * times), least * times
    pieces = list(chunking.stream_chunks(io.BytesIO(data), least, most))
    assert pieces == [data[a:b] for a, b in zip([0, *ends], ends)]


def test_lookup_goes_beyond_16_gib_of_positions(spark, tmp_path):
    """Ids whose positions do not fit the 34 bits of a location, in sources of any number."""
    from quarry import source_queries as q
    from tests.oracle import connect, same_rows

    rows = [(0, "a", "src3"), (262_143, "b", "src3"), (262_144, "c", "src3"), (262_145, "a", "src4"), (1 << 40, "d", "src16390"), (300_000, "d", "src3")]
    spark.createDataFrame(rows, "doc_id long, text string, source string").coalesce(1).write.parquet(str(tmp_path / "w"))
    next((tmp_path / "w").glob("*.parquet")).rename(tmp_path / "documents.parquet")
    assert same_rows(q.QUERIES["source_lookup"](spark, str(tmp_path)), connect(tmp_path), q.SQL["source_lookup"]) == 4
