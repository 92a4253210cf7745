import hashlib
import struct

import pytest
from pyspark.errors import PySparkException

from quarry.operators import txlog

SCHEMA = "account string, dataset string, seq long, ts_ns long, op string, state string, block string, size long, unique_size long"


def h(prefix, label):
    return hashlib.md5(f"{prefix}-{label}".encode()).hexdigest()


def log(spark, rows, dataset="photos"):
    full = [
        ("a", dataset, i, ts, op, h("state", label), h("block", label) if op == "ADD" else None, *(sizes or (None, None)))
        for i, (ts, op, label, *sizes) in enumerate(rows)
    ]
    return spark.createDataFrame(full, SCHEMA)


def test_replay_keeps_states_that_are_not_deleted(spark):
    rows = txlog.live_states(log(spark, [(1, "ADD", "one", 10, 4), (2, "ADD", "two", 20, 8), (3, "DEL", "one")])).collect()
    assert [(r["state"], r["size"], r["flags"]) for r in rows] == [(h("state", "two"), 20, 0)]


def test_three_notions_of_deleted(spark):
    again = log(spark, [(1, "ADD", "x", 1, 1), (2, "DEL", "x"), (3, "ADD", "x", 5, 5)])
    assert [r["size"] for r in txlog.live_states(again).collect()] == [5]
    assert [r["deleted"] for r in txlog.with_deleted_mark(again).collect()] == [True] * 3
    assert [r["seq"] for r in txlog.purge(again).collect()] == [2]
    later = {r["seq"]: r["later_delete"] for r in txlog.with_later_delete(again).collect()}
    assert later == {0: True, 1: False, 2: False}


def test_double_add_keeps_the_last_when_replayed_and_both_when_purged(spark):
    twice = log(spark, [(1, "ADD", "x", 10, 1), (2, "ADD", "x", 20, 1)])
    assert [r["size"] for r in txlog.live_states(twice).collect()] == [20]
    assert txlog.purge(twice).count() == 2


@pytest.mark.parametrize("states, size", [([("c", 5, 42), ("d", 125, 33342)], 33509), ([("a", 10, 5), ("b", 20, 8)], 33), ([("n", -7, 0)], 0)])
def test_size_formula(spark, states, size):
    rows = log(spark, [(i, "ADD", *s) for i, s in enumerate(states)])
    (r,) = txlog.dataset_size(txlog.live_states(rows)).collect()
    assert (r["n_states"], r["size"]) == (len(states), size)


def test_list_hash_is_md5_over_serialised_entries(spark):
    rows = log(spark, [(1, "ADD", "c", 5, 42), (2, "ADD", "d", 125, -1)])
    want = hashlib.md5()
    for label, size, unique in sorted([("c", 5, 42), ("d", 125, -1)], key=lambda x: h("state", x[0])):
        want.update(b"\0" + bytes.fromhex(h("state", label)) + bytes.fromhex(h("block", label)) + struct.pack(">qq", size, unique))
    assert txlog.list_hash(txlog.live_states(rows)).first()["list_h"] == want.hexdigest()


def test_empty_datasets_are_not_listed(spark):
    gone = log(spark, [(1, "ADD", "x", 1, 1), (2, "DEL", "x")])
    assert txlog.dataset_size(txlog.live_states(gone)).count() == 0


def test_clock(spark):
    bad = log(spark, [(5, "ADD", "x", 1, 1), (5, "ADD", "y", 1, 1), (4, "ADD", "z", 1, 1)])
    assert [r["seq"] for r in txlog.clock_violations(bad).collect()] == [2]
    with pytest.raises(PySparkException):
        txlog.assert_clock(bad).collect()
    assert txlog.assert_clock(bad.filter("seq < 2")).count() == 2


def test_merge_puts_the_source_first_among_equal_times(spark):
    src, dst = log(spark, [(1, "ADD", "s", 1, 1), (3, "ADD", "s2", 1, 1)]), log(spark, [(1, "ADD", "d", 1, 1), (2, "ADD", "d2", 1, 1)])
    rows = txlog.merge_logs(src, dst).orderBy("new_seq").collect()
    assert [r["state"] for r in rows] == [h("state", x) for x in ("s", "d", "d2", "s2")]


def test_move_add_remove_drop(spark):
    both = log(spark, [(1, "ADD", "s", 1, 1)], "from").unionByName(log(spark, [(0, "ADD", "d", 1, 1)], "to"))
    moved = txlog.move_dataset(both, "a", "from", "to")
    assert [(r["dataset"], r["state"]) for r in moved.orderBy("seq").collect()] == [("to", h("state", "d")), ("to", h("state", "s"))]
    more = txlog.add_state(both, "a", "to", h("state", "n"), h("block", "n"), 3, 2, 9)
    assert txlog.live_states(more).filter("dataset = 'to'").count() == 2
    less = txlog.remove_state(more, "a", "to", h("state", "n"), 10)
    assert less.count() == 4 and txlog.live_states(less).filter("dataset = 'to'").count() == 1
    assert txlog.drop_dataset(both, "a", "from").count() == 1 and txlog.drop_dataset(both, "a").count() == 0


def test_latest_valid_and_latest_any(spark):
    states = spark.createDataFrame(
        [("a", "d", "01", "b1", 1, 1, 0), ("a", "d", "7f", "b2", 1, 1, 0), ("a", "d", "80", "b3", 1, 1, 0x80)],
        "account string, dataset string, state string, block string, size long, unique_size long, flags int",
    )
    assert txlog.latest_state(states, True).first()["state"] == "7f"
    assert txlog.latest_state(states, False).first()["state"] == "80"
    assert txlog.select_state(states, "80").count() == 1 and txlog.select_state(states, ".").first()["state"] == "7f"


def test_roots_need_an_account_record(spark):
    states = spark.createDataFrame([("a", "d", "01", "b1", 0), ("x", "d", "02", "b2", 0), ("a", "d", "03", "b3", 128)], "account string, dataset string, state string, block string, flags int")
    accounts = spark.createDataFrame([("a",)], "account string")
    assert [r["block"] for r in txlog.roots(states, accounts).collect()] == ["b1"]
    with pytest.raises(PySparkException):
        txlog.roots(states, accounts, skip_invalid=False).collect()


def test_resolve_by_name_or_hash(spark):
    rows = spark.createDataFrame([("one", "00112233445566778899aabbccddeeff"), ("two", "ff" * 16)], "name string, h string")
    for given in ("one", "00112233445566778899aabbccddeeff", "ABEiM0RVZneImaq7zN3u_w"):
        assert [r["name"] for r in txlog.resolve(rows, given, "name", "h").collect()] == ["one"]
