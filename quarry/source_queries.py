"""Queries of the file sources: store files are written from the driver's tables and read back.

Each query packs rows into records, writes them with the sink (``store.write_records``) to a folder of
its own that every executor mounts, and reads them with the ``quarry_store`` source.  The SQL twin computes the rows that the
formats' rules ask for, positions included, from the tables themselves.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.functions.codecs import ZLIB, deflate, payload
from quarry.operators import blocks as blk
from quarry.operators import snapshot, txlog
from quarry.plans import mapping as m
from quarry.plans.mapping import with_
from quarry.plans.scratch import Scratch, ship
from quarry.plans.tables import table
from quarry.sources import decode, formats, store

_Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, _Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str) -> Callable[[_Query], _Query]:
    def add(f: _Query) -> _Query:
        QUERIES[name], SQL[name] = f, sql
        return f

    return add


def _folder(spark: SparkSession, label: str) -> str:
    """A mounted folder: sources and sinks open files by path."""
    root = Scratch(spark, label).root
    if not root.startswith(("/", "file:")):
        raise ValueError(f"{root} is not a folder that executors mount")
    return root.removeprefix("file://").removeprefix("file:")


def _packed(rows: DataFrame, pack) -> DataFrame:
    """(file, ordinal, record) of rows (file, ordinal, and the fields that pack takes by name)."""
    ship(rows.sparkSession)
    fields = [c for c in rows.columns if c not in ("file", "ordinal")]

    def run(batches):
        for batch in batches:
            records = [pack(*r) for r in zip(*[batch.column(c).to_pylist() for c in fields])]
            yield pa.RecordBatch.from_arrays([batch.column("file"), batch.column("ordinal"), pa.array(records, pa.binary())], names=["file", "ordinal", "record"])

    return rows.select(F.col("file"), F.col("ordinal").cast("long").alias("ordinal"), *fields).mapInArrow(run, "file string, ordinal long, record binary")


def _headed(records: DataFrame, header: Column) -> DataFrame:
    """Records with a first one for each file."""
    heads = records.select("file").distinct().select("file", F.lit(-1).cast("long").alias("ordinal"), header.alias("record"))
    return records.unionByName(heads)


def _name(number: Column, ext: str) -> Column:
    return F.concat(F.upper(F.lpad(F.hex(number), 8, "0")), F.lit("." + ext))


def _number(source: str = "source") -> Column:
    return F.substring(source, 4, 9).cast("long")


# --- blocks -----------------------------------------------------------------------------------------

_JUNK = b"junkbytes"


def _data_record(doc_id: int, block: str, links: list[str], raw: bytes, stored: bytes) -> bytes:
    record = formats.pack_data(block, links, formats.RAW if doc_id % 2 else formats.ZLIB, raw if doc_id % 2 else stored)
    return (_JUNK if doc_id % 17 == 0 else b"") + record + (formats.pack_gap(40) + bytes(28) if doc_id % 10 == 0 else b"")


def _data_files(spark: SparkSession, d: str, path: str) -> None:
    docs = table(spark, d, "documents").withColumn("raw", F.col("text").cast("binary"))
    rows = docs.select(_name(_number(), "dat").alias("file"), F.col("doc_id").alias("ordinal"), "doc_id", F.md5("text").alias("block"), F.array(F.md5("lang"), F.md5("source")).alias("links"), "raw", deflate("raw").alias("stored"))
    store.write_records(_headed(_packed(rows, _data_record), F.lit(formats.file_header(formats.DATA_TYPE))), path)


@query(
    "source_data",
    """SELECT CAST(substr(source, 4) AS INTEGER) AS file, md5(text) AS block, md5(lang) || md5(source) AS links, CASE WHEN doc_id % 2 = 0 THEN 1 ELSE 255 END AS data_type, md5(text) AS content, false AS corrupt, 0 AS junk FROM documents
    UNION ALL SELECT CAST(substr(source, 4) AS INTEGER), NULL, '', NULL, NULL, true, 9 FROM documents WHERE doc_id % 17 = 0""",
)
def _(spark, d):
    """Blocks, some compressed, with gaps between them and bytes that are no record."""
    path = _folder(spark, "data")
    _data_files(spark, d, path)
    rows = store.read(spark, "data", path)
    content = F.md5(payload("data", F.coalesce("data_type", F.lit(ZLIB))))
    return rows.select("file", "block", F.array_join("links", "").alias("links"), "data_type", content.alias("content"), "corrupt", F.when(F.col("corrupt"), F.col("entry_size")).otherwise(0).cast("int").alias("junk"))


@query(
    "source_data_places",
    """WITH sized AS (SELECT *, CAST(substr(source, 4) AS INTEGER) AS file, CASE WHEN doc_id % 17 = 0 THEN 9 ELSE 0 END AS junk, 61 + strlen(text) AS size, CASE WHEN doc_id % 10 = 0 THEN 40 ELSE 0 END AS gap FROM documents WHERE lang = 'en')
    SELECT file, md5(text) AS block, CAST(16 + junk + coalesce(sum(junk + size + gap) OVER (PARTITION BY file ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset", size AS entry_size
    FROM sized QUALIFY file BETWEEN 2 AND 9""",
)
def _(spark, d):
    """Places of uncompressed records in a range of files, read without payloads."""
    path = _folder(spark, "places")
    docs = table(spark, d, "documents").filter("lang = 'en'").withColumn("raw", F.col("text").cast("binary"))
    raw = lambda i, b, ls, x, _: (_JUNK if i % 17 == 0 else b"") + formats.pack_data(b, ls, formats.RAW, x) + (formats.pack_gap(40) + bytes(28) if i % 10 == 0 else b"")
    rows = docs.select(_name(_number(), "dat").alias("file"), F.col("doc_id").alias("ordinal"), "doc_id", F.md5("text").alias("block"), F.array(F.md5("lang"), F.md5("source")).alias("links"), "raw", F.lit(b"").alias("none"))
    store.write_records(_headed(_packed(rows, raw), F.lit(formats.file_header(formats.DATA_TYPE))), path)
    got = store.read(spark, "data", path, **{"from": "2", "to": "9", "payload": "false"})
    return got.filter("not corrupt and data is null").select("file", "block", "offset", "entry_size")


@query(
    "source_headers",
    """SELECT CAST(substr(source, 4) AS INTEGER) AS file, CAST(substr(source, 4) AS BIGINT) * 7 AS deadspace, CASE WHEN source = 'src5' THEN 2 ELSE 1 END AS version, source = 'src3' AS other_type
    FROM (SELECT DISTINCT source FROM documents) WHERE source IN ('src3', 'src5')""",
)
def _(spark, d):
    """Of files that are all headers, one has another type and one another version: these are found."""
    path = _folder(spark, "headers")
    rows = table(spark, d, "documents").select(_number().alias("n")).distinct().select(_name(F.col("n"), "dat").alias("file"), F.lit(0).alias("ordinal"), "n")

    def header(n: int) -> bytes:
        raw = formats.file_header(formats.META_TYPE if n == 3 else formats.DATA_TYPE, 7 * n)
        return raw[:7] + b"\2" + raw[8:] if n == 5 else raw

    store.write_records(_packed(rows, header), path)
    bad = blk.bad_headers(store.read(spark, "headers", path))
    return bad.select("file", "deadspace", F.col("version").cast("int").alias("version"), (F.col("file_type") != F.col("expected_type")).alias("other_type"))


@query("source_lookup", "SELECT md5(text) AS block, arg_min(CAST(substr(source, 4) AS INTEGER), doc_id) AS file, min(doc_id) * 65536 AS \"offset\", strlen(any_value(text)) AS size, count(*) AS n_links FROM documents GROUP BY md5(text)")
def _(spark, d):
    """Index slots lead to metadata by their location; metadata says where a block's payload is.

    A location has 14 bits for the file and 34 for the offset, so a source's positions beyond 16 GiB go on in
    further files, and the files that are needed are numbered one after the other.
    """
    path, scratch = _folder(spark, "lookup"), Scratch(spark, "lookup-volumes")
    at = F.col("first") * 65536
    per = table(spark, d, "documents").groupBy(F.md5("text").alias("block")).agg(
        F.min_by(_number(), "doc_id").alias("source"), F.min("doc_id").alias("first"), F.max(F.octet_length("text")).alias("size"), F.count(F.lit(1)).cast("int").alias("n")
    )
    per = scratch.table(per.withColumns({"volume": F.shiftright(at, formats.OFFSET_BITS), "offset": at.bitwiseAND(F.lit((1 << formats.OFFSET_BITS) - 1))}), "blocks")
    number = F.row_number().over(Window.orderBy("source", "volume")) - 1
    volumes = scratch.table(per.select("source", "volume").distinct().withColumn("file_no", number), "volumes")
    links = F.transform(F.sequence(F.lit(1), F.col("n")), lambda i: F.md5(i.cast("string")))
    placed = per.join(volumes, ["source", "volume"])
    metas = placed.select(_name(F.col("file_no"), "meta").alias("file"), F.col("offset").alias("ordinal"), "block", F.col("file_no").alias("at"), "offset", "size", links.alias("links"))
    store.write_records(_headed(_packed(metas, formats.pack_meta), F.lit(formats.file_header(formats.META_TYPE))), path)
    meta = store.read(spark, "meta", path)
    slots = meta.select(_name(F.lit(0), "idx").alias("file"), F.col("offset").alias("ordinal"), F.lit(formats.EXISTS).alias("flags"), "block", "meta_file", "meta_offset")
    store.write_records(_headed(_packed(slots, formats.pack_index), F.lit(formats.file_header(formats.INDEX_TYPE) + bytes(2 * formats.SLOT))), path)
    index = store.read(spark, "index", path)
    stored = meta.select("block", "file", "offset")
    got = blk.lookup(index.select("block", "meta_file", "meta_offset"), meta, stored).join(volumes, F.col("file") == F.col("file_no"))
    offset = F.shiftleft("volume", formats.OFFSET_BITS).bitwiseOR(F.col("offset"))
    return got.select("block", F.col("source").cast("int").alias("file"), offset.alias("offset"), "size", F.size("links").cast("long").alias("n_links"))


# --- logs, caches and accounts ----------------------------------------------------------------------

_FEW = "log AS (SELECT account % 4 AS account, dataset, seq, ts_ns, op, state, block, size, unique_size FROM tx)"


def _log(spark: SparkSession, d: str) -> DataFrame:
    return m.tx(spark, d).withColumn("account", F.col("account") % 4)


def _pair(ext: str) -> Column:
    """Names of a dataset's files: both names' hashes."""
    part = lambda c: F.rtrim(F.translate(F.base64(F.unhex(F.md5(c))), "+/", "-_"), F.lit("="))
    return F.concat(part(F.col("account").cast("string")), F.lit("."), part(F.concat(F.lit("set"), F.col("dataset").cast("string"))), F.lit("." + ext))


def _header(kind: int) -> Callable[[str], bytes]:
    return lambda name: formats.name_header(kind, name)


def _write_named(rows: DataFrame, pack, kind: int, path: str, ext: str) -> None:
    """Files by account and dataset, each with its dataset's name in the header."""
    rows = rows.withColumn("file", _pair(ext))
    heads = rows.select("file", F.lit(-1).alias("ordinal"), F.concat(F.lit("set"), F.col("dataset").cast("string")).alias("name")).distinct()
    store.write_records(_packed(rows.drop("account", "dataset"), pack).unionByName(_packed(heads, _header(kind))), path)


@query(
    "source_log",
    with_("tx") + ", " + _FEW + """, placed AS (SELECT *, CASE WHEN op = 'ADD' THEN 60 ELSE 28 END AS n, row_number() OVER w - 1 AS no FROM log WINDOW w AS (PARTITION BY account, dataset ORDER BY seq))
    SELECT md5(CAST(account AS VARCHAR)) AS account_h, 'set' || dataset AS dataset, no AS seq, CAST(16 + coalesce(sum(n) OVER (PARTITION BY account, dataset ORDER BY no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS pos,
    ts_ns, op, state, CASE WHEN op = 'ADD' THEN block END AS block, CASE WHEN op = 'ADD' THEN size END AS size, CASE WHEN op = 'ADD' THEN unique_size END AS unique_size FROM placed""",
)
def _(spark, d):
    path = _folder(spark, "log")
    rows = _log(spark, d).select("account", "dataset", F.col("seq").alias("ordinal"), "ts_ns", "op", "state", "block", "size", "unique_size")
    _write_named(rows, formats.pack_tx, formats.LOG_TYPE, path, "trn")
    return store.read(spark, "log", path).drop("end_pos")


@query(
    "source_log_live",
    with_("tx") + ", " + _FEW + """, one AS (SELECT * FROM log WHERE dataset = 1)
    SELECT md5(CAST(account AS VARCHAR)) AS account, state, block, size FROM one QUALIFY row_number() OVER (PARTITION BY account, state ORDER BY seq DESC) = 1 AND op = 'ADD'""",
)
def _(spark, d):
    """The live states of one dataset, from the logs that bear its name."""
    path = _folder(spark, "live")
    rows = _log(spark, d).select("account", "dataset", F.col("seq").alias("ordinal"), "ts_ns", "op", "state", "block", "size", "unique_size")
    _write_named(rows, formats.pack_tx, formats.LOG_TYPE, path, "trn")
    log = store.read(spark, "log", path, dataset="set1").withColumnRenamed("account_h", "account")
    return txlog.live_states(log).select("account", "state", "block", "size")


@query(
    "source_cache",
    with_("tx") + ", " + _FEW + """ SELECT md5(CAST(account AS VARCHAR)) AS account_h, 'set' || dataset AS dataset, CASE WHEN size % 4 = 0 THEN 128 ELSE 0 END AS flags, state, block, size, unique_size
    FROM log QUALIFY row_number() OVER (PARTITION BY account, dataset, state ORDER BY seq DESC) = 1 AND op = 'ADD'""",
)
def _(spark, d):
    path = _folder(spark, "cache")
    live = m.flagged(txlog.live_states(_log(spark, d)))
    counts = live.groupBy("account", "dataset").agg(F.count(F.lit(1)).cast("int").alias("n"))
    rows = live.select(_pair("db").alias("file"), F.row_number().over(_by_state()).alias("ordinal"), "flags", "state", "block", "size", "unique_size")
    heads = counts.select(_pair("db").alias("file"), F.lit(-1).alias("ordinal"), F.concat(F.lit("set"), F.col("dataset").cast("string")).alias("name"), "n")
    count = lambda name, n: formats.name_header(formats.CACHE_TYPE, name) + n.to_bytes(4, "big")
    store.write_records(_packed(rows, formats.pack_state).unionByName(_packed(heads, count)), path)
    return store.read(spark, "cache", path)


def _by_state():
    from pyspark.sql import Window

    return Window.partitionBy("account", "dataset").orderBy("state")


@query(
    "source_accounts",
    """SELECT n_name AS account, md5(n_name) AS account_h, md5('key-' || n_name) AS access_key, CASE WHEN c_custkey IS NOT NULL THEN 'set' || c_custkey END AS dataset, CAST(round(c_acctbal * 100) AS BIGINT) AS size,
    CASE WHEN c_custkey IS NOT NULL THEN md5(CAST(c_custkey AS VARCHAR)) END AS list_h FROM nation LEFT JOIN (SELECT * FROM customer WHERE c_nationkey <> 7) ON c_nationkey = n_nationkey""",
)
def _(spark, d):
    """Nations as accounts and customers as their datasets; one account has none."""
    path = _folder(spark, "accounts")
    own = table(spark, d, "customer").filter("c_nationkey <> 7").select("c_nationkey", F.struct(F.concat(F.lit("set"), F.col("c_custkey").cast("string")).alias("name"), F.round(F.col("c_acctbal") * 100).cast("long").alias("size"), F.md5(F.col("c_custkey").cast("string")).alias("h")).alias("s"))
    per = own.groupBy("c_nationkey").agg(F.sort_array(F.collect_list("s")).alias("sets"))
    rows = table(spark, d, "nation").join(per, F.col("n_nationkey") == F.col("c_nationkey"), "left")
    rows = rows.select(F.concat(F.md5("n_name"), F.lit(".info")).alias("file"), F.lit(0).alias("ordinal"), "n_name", F.md5(F.concat(F.lit("key-"), "n_name")).alias("key"), "sets")
    pack = lambda name, key, sets: formats.pack_account(name, key, [(x["name"], x["size"], x["h"]) for x in sets or ()])
    store.write_records(_packed(rows, pack), path)
    return store.read(spark, "accounts", path)


# --- directories, chains and trees ------------------------------------------------------------------

_KIND = "CASE kind WHEN 'dir' THEN 1 WHEN 'link' THEN 4 ELSE CASE WHEN size = 0 THEN 0 WHEN size % 2 = 0 THEN 2 ELSE 3 END END"


@query(
    "source_directories",
    with_("entries") + f""", typed AS (SELECT *, {_KIND} AS content_type FROM entries)
    SELECT md5(parent) AS dir_block, row_number() OVER (PARTITION BY parent ORDER BY name) - 1 AS ordinal, name, size, CAST(mode AS BIGINT) AS mode, mtime_ns, md5(lang) AS reference_id, content_type,
    CASE WHEN content_type IN (1, 2, 3) THEN md5(text) END AS content, CASE WHEN content_type = 2 THEN md5(source) END AS decrypt_key, target FROM typed""",
)
def _(spark, d):
    """Directory blocks packed from the entries of each directory, and decoded again."""
    e = m.entries(spark, d)
    kind = F.when(F.col("kind") == "dir", snapshot.DIRECTORY).when(F.col("kind") == "link", snapshot.LINK)
    kind = kind.when(F.col("size") == 0, snapshot.EMPTY).when(F.col("size") % 2 == 0, snapshot.FILE).otherwise(snapshot.CHAIN)
    fields = [F.col("name"), F.col("size"), F.col("mode"), F.col("mtime_ns"), F.md5("lang").alias("reference_id"), kind.alias("content_type"), F.md5("text").alias("content"), F.md5("source").alias("decrypt_key"), F.col("target")]
    rows = e.groupBy("parent").agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("entries"))
    packed = _packed(rows.select(F.md5("parent").alias("file"), F.lit(0).alias("ordinal"), "entries"), formats.pack_directory)
    got = decode.exploded_directories(packed.select(F.col("file").alias("block"), F.col("record").alias("data")))
    return got.withColumn("ordinal", F.col("ordinal").cast("long"))


@query("source_chains", "SELECT md5(CAST(conv_id AS VARCHAR)) AS chain_block, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS ordinal, md5(text) AS block, md5(role) AS key FROM conversations")
def _(spark, d):
    links = F.transform(F.sort_array(F.collect_list(F.struct("turn", F.md5("text").alias("b"), F.md5("role").alias("k")))), lambda x: F.struct(x["b"], x["k"]))
    rows = table(spark, d, "conversations").groupBy("conv_id").agg(links.alias("links"))
    pack = lambda ls: formats.pack_chain([tuple(x.values()) for x in ls])
    packed = _packed(rows.select(F.md5(F.col("conv_id").cast("string")).alias("file"), F.lit(0).alias("ordinal"), "links"), pack)
    got = decode.exploded_chains(packed.select(F.col("file").alias("block"), F.col("record").alias("data")))
    return got.withColumn("ordinal", F.col("ordinal").cast("long"))


@query(
    "restore_tree",
    with_("entries") + """ SELECT path, kind, size, mode, target FROM (SELECT path, kind, size, CASE WHEN kind = 'link' THEN NULL ELSE mode END AS mode, target FROM entries WHERE kind <> 'dir')
    UNION ALL SELECT DISTINCT path, 'dir', 0, 420 + 73, NULL FROM (SELECT path FROM entries WHERE kind = 'dir' UNION SELECT parent FROM entries UNION SELECT source FROM entries)""",
)
def _(spark, d):
    """Entries are restored to a folder, with directories, links and empty files, and the folder is read as a tree."""
    path = _folder(spark, "tree")
    e = m.entries(spark, d)
    content = F.when(F.col("size") > 0, F.col("text").cast("binary"))
    mode = F.when(F.col("kind") == "dir", 493).when(F.col("kind") == "file", F.col("mode"))
    decode.restore_files(e.select("path", "kind", content.alias("content"), mode.alias("mode"), "mtime_ns", "target"), path)
    tree = store.read(spark, "tree", path)
    mode = F.when(F.col("kind") == "dir", 493).when(F.col("kind") != "link", F.col("mode"))
    return tree.select("path", "kind", "size", mode.alias("mode"), "target")
