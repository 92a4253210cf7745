"""python -m quarry STORE COMMAND [ARGUMENT ...]: administration of a store from the shell."""

from __future__ import annotations

import argparse


#: Command, arguments, options.
COMMANDS = [
    ("list-accounts", (), ()), ("list-datasets", ("account",), ()), ("list-states", ("account", "dataset"), ("--log",)), ("list", ("account", "dataset", "path"), ("--state=",)),
    ("delete-state", ("account", "dataset", "state"), ()), ("delete-dataset", ("account", "dataset"), ()), ("delete-account", ("account",), ()),
    ("move-dataset", ("account", "dataset", "to_account", "to_dataset"), ()), ("purge-states", (), ("--apply",)), ("block-info", ("block",), ("--verify",)), ("rebuild-db", (), ()),
    ("verify", (), ()), ("recover", (), ()), ("gc", (), ("--apply",)), ("retention", ("account", "dataset", "now"), ("--days=", "--weeks=", "--yearly", "--apply")),
    ("store", ("account", "dataset", "folder"), ("--ignore*",)), ("restore", ("account", "dataset", "folder"), ("--state=", "--path=")), ("diff", ("account", "dataset", "folder"), ("--state=",)),
    ("sync", ("logs", "replica", "checkpoint"), ("--dry-run",)),
]


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="quarry")
    p.add_argument("store")
    sub = p.add_subparsers(dest="command", required=True)
    for name, args, options in COMMANDS:
        c = sub.add_parser(name)
        for a in args:
            c.add_argument(a)
        for o in options:
            if o.endswith("*"):
                c.add_argument(o[:-1], action="append", default=[])
            elif o.endswith("="):
                c.add_argument(o[:-1])
            else:
                c.add_argument(o, action="store_true")
    return p


def main(argv: list[str] | None = None, spark=None) -> int:
    a = parser().parse_args(argv)
    if spark is None:
        from pyspark.sql import SparkSession

        spark = SparkSession.builder.appName("quarry").getOrCreate()
    from quarry.api import Store
    from quarry.operators import snapshot

    s = Store(spark, a.store)

    def retention():
        plan = s.retention_plan(a.account, a.dataset, int(a.now), int(a.days or 0), int(a.weeks or 0), a.yearly)
        if a.apply:
            for r in plan.filter("not kept").select("state").collect():  # one dataset's states, written one by one
                s.remove_dataset_state(a.account, a.dataset, r["state"])
        return plan

    def sync():
        from quarry.sources import store as files
        from quarry.streaming import sync as streaming

        replica = streaming.Replica(spark, a.replica)
        if a.dry_run:
            log = files.read(spark, "log", a.logs).withColumnRenamed("account_h", "account").drop("pos", "end_pos")
            return streaming.apply_batch(log, 0, replica, dry_run=True)
        stream = files.read_log_stream(spark, a.logs).withColumnRenamed("account_h", "account").drop("pos", "end_pos")
        streaming.replicate(stream, replica, a.checkpoint).awaitTermination()
        return replica.states()

    out = {
        "list-accounts": lambda: s.list_accounts(),
        "list-datasets": lambda: s.get_account_info(a.account),
        "list-states": lambda: s.list_states_log(a.account, a.dataset) if a.log else s.list_dataset(a.account, a.dataset),
        "list": lambda: snapshot.children(s.snapshot(a.account, a.dataset, a.state).withColumn("is_dir", snapshot.F.col("kind") == "dir"), a.path),
        "delete-state": lambda: s.remove_dataset_state(a.account, a.dataset, a.state),
        "delete-dataset": lambda: s.delete_dataset(a.account, a.dataset),
        "delete-account": lambda: s.delete_dataset(a.account),
        "move-dataset": lambda: s.move_dataset(a.account, a.dataset, a.to_account, a.to_dataset),
        "purge-states": lambda: s.apply_purge() if a.apply else s.purge_states(),
        "block-info": lambda: s.show_block(a.block, a.verify),
        "rebuild-db": lambda: s.rebuild_db(),
        "verify": lambda: s.verify_blocks(),
        "recover": lambda: s.recover(),
        "gc": lambda: s.collect_garbage() if a.apply else s.garbage(),
        "retention": retention,
        "store": lambda: s.store_folder(a.account, a.dataset, a.folder, a.ignore),
        "restore": lambda: s.restore_folder(a.account, a.dataset, a.folder, a.state, a.path or ""),
        "diff": lambda: s.diff_folder(a.account, a.dataset, a.folder, a.state),
        "sync": sync,
    }[a.command]()
    if hasattr(out, "show"):
        out.show(1000, truncate=False)
    elif out is not None:
        print(out)
    if a.command == "verify":
        return 2 if not out.isEmpty() else 0
    if a.command == "diff":
        return 0 if out.filter("status <> 'same'").isEmpty() else 1
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
