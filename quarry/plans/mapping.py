"""Driver tables seen as the engine's entities.  Each function has its SQL twin in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.scalars import simple_upper
from quarry.plans.tables import table

#: Common table expressions with the same rows as the functions below.
SQL = {
    "tx": """tx AS (SELECT user_id AS account, event_id % 3 AS dataset, event_id AS seq, epoch_us(ts) * 1000 AS ts_ns,
        CASE WHEN event_type = 'error' THEN 'DEL' ELSE 'ADD' END AS op, md5('state-' || CAST(event_id % 7 AS VARCHAR)) AS state,
        md5('block-' || CAST(event_id AS VARCHAR)) AS block, CAST(round(value * 100) AS BIGINT) AS size,
        CAST(round(value * 10) AS BIGINT) AS unique_size FROM events)""",
    "live": """live AS (SELECT account, dataset, state, block, size, unique_size, seq, 0 AS flags FROM tx
        QUALIFY row_number() OVER (PARTITION BY account, dataset, state ORDER BY seq DESC) = 1 AND op = 'ADD')""",
    "flagged": """flagged AS (SELECT * EXCLUDE (flags), CASE WHEN size % 4 = 0 THEN 128 ELSE 0 END AS flags FROM live)""",
    "blocks": """blocks AS (SELECT doc_id AS ord, md5(text) AS block, strlen(text) AS size, source, lang FROM documents)""",
    "line": """line AS (SELECT DISTINCT 'L:' || l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS node,
        'O:' || l_orderkey AS o, 'P:' || l_partkey AS p, 'S:' || l_suppkey AS s FROM lineitem)""",
    "edges": """edges AS (SELECT o AS src, node AS dst FROM line UNION ALL SELECT node, p FROM line UNION ALL SELECT node, s FROM line
        UNION ALL SELECT 'S:' || s_suppkey, 'N:' || s_nationkey FROM supplier UNION ALL SELECT 'N:' || n_nationkey, 'R:' || n_regionkey FROM nation)""",
    "nodes": """nodes AS (SELECT 'O:' || o_orderkey AS block, CAST(round(o_totalprice * 100) AS BIGINT) AS size, o_orderkey % 16 AS file FROM orders
        UNION ALL SELECT 'L:' || l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey, max(CAST(round(l_extendedprice * 100) AS BIGINT)), l_orderkey % 16
          FROM lineitem GROUP BY l_orderkey, l_linenumber, l_partkey, l_suppkey
        UNION ALL SELECT 'P:' || p_partkey, CAST(p_size AS BIGINT), p_partkey % 16 FROM part
        UNION ALL SELECT 'S:' || s_suppkey, CAST(round(abs(s_acctbal) * 100) AS BIGINT), s_suppkey % 16 FROM supplier
        UNION ALL SELECT 'N:' || n_nationkey, CAST(strlen(n_name) AS BIGINT), CAST(n_nationkey % 16 AS BIGINT) FROM nation
        UNION ALL SELECT 'R:' || r_regionkey, CAST(strlen(r_name) AS BIGINT), 16 FROM region)""",
    "marked": """marked AS (SELECT 'O:' || o_orderkey AS node, 0 AS level FROM orders WHERE o_orderstatus = 'F'
        UNION SELECT e.dst, level + 1 FROM edges e JOIN marked m ON e.src = m.node)""",
    "files": r"""files AS (SELECT path, max(size) AS size, max(content) AS content FROM (
        SELECT regexp_replace(regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', ''), '/+$', '') || '/index' AS path,
        strlen(html) AS size, md5(html) AS content FROM pages) GROUP BY path)""",
    "tree": """tree AS (
        SELECT path, array_to_string(string_split(path, '/')[:-2], '/') AS parent, string_split(path, '/')[-1] AS name, is_dir, len(string_split(path, '/')) AS depth, size, content
        FROM (SELECT path, false AS is_dir, size, content FROM files
              UNION ALL SELECT DISTINCT array_to_string(string_split(path, '/')[1:n], '/'), true, 0, NULL
                FROM files, unnest(range(1, len(string_split(path, '/')))) AS t(n))
        UNION ALL SELECT '', NULL, '', true, 0, 0, NULL)""",
    "entries": """entries AS (SELECT * REPLACE (CASE WHEN size > 0 THEN content END AS content) FROM (
        SELECT doc_id, source || '/' || lang AS parent, source || '/' || lang || '/' || lpad(CAST(doc_id AS VARCHAR), 9, '0') AS path,
        lpad(CAST(doc_id AS VARCHAR), 9, '0') AS name, CASE doc_id % 11 WHEN 0 THEN 'dir' WHEN 1 THEN 'link' ELSE 'file' END AS kind,
        CASE WHEN doc_id % 11 > 2 THEN strlen(text) ELSE 0 END AS size, 420 AS mode, 1700000000000000000 + n_chars * 1000000007 AS mtime_ns,
        md5(text) AS content, CASE WHEN doc_id % 11 = 1 THEN 'to-' || source END AS target, lang, source, text FROM documents))""",
    "olds": """olds AS (SELECT * REPLACE (CASE WHEN source = 'src7' THEN 384 ELSE mode END AS mode,
        CASE WHEN lang = 'es' AND size > 0 THEN md5(upper(text)) ELSE content END AS content, CASE WHEN doc_id % 33 = 0 THEN 'file' ELSE kind END AS kind,
        CASE WHEN doc_id % 22 = 1 THEN target || '-old' ELSE target END AS target,
        CASE WHEN lang = 'es' THEN mtime_ns - 1000000000 ELSE mtime_ns END AS mtime_ns) FROM entries WHERE lang <> 'fr')""",
    "news": """news AS (SELECT * FROM entries WHERE lang <> 'de')""",
    "copies": """copies AS (SELECT md5(text) AS block, CAST(substr(source, 4) AS BIGINT) AS file, doc_id * 65536 AS "offset", strlen(text) AS size FROM documents)""",
    "ix": """ix AS (SELECT block, file, "offset" FROM copies QUALIFY row_number() OVER (PARTITION BY block ORDER BY file, "offset") = 1)""",
}


def with_(*names: str, recursive: bool = False) -> str:
    return ("WITH RECURSIVE " if recursive else "WITH ") + ",\n".join(SQL[n] for n in names) + "\n"


def tx(spark: SparkSession, d: str) -> DataFrame:
    """A transaction log from events: errors delete, the rest adds."""
    e = table(spark, d, "events")
    text = lambda prefix, c: F.md5(F.concat(F.lit(prefix), c.cast("string")))
    return e.select(
        F.col("user_id").alias("account"), (F.col("event_id") % 3).alias("dataset"), F.col("event_id").alias("seq"),
        (F.unix_micros(F.col("ts").cast("timestamp")) * 1000).alias("ts_ns"),
        F.when(F.col("event_type") == "error", "DEL").otherwise("ADD").alias("op"),
        text("state-", F.col("event_id") % 7).alias("state"), text("block-", F.col("event_id")).alias("block"),
        F.round(F.col("value") * 100).cast("long").alias("size"), F.round(F.col("value") * 10).cast("long").alias("unique_size"),
    )


def flagged(states: DataFrame) -> DataFrame:
    """States some of which are marked invalid."""
    return states.withColumn("flags", F.when(F.col("size") % 4 == 0, 128).otherwise(0))


def blocks(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select(
        F.col("doc_id").alias("ord"), F.md5("text").alias("block"), F.octet_length("text").cast("long").alias("size"), "source", "lang"
    )


def _node(prefix: str, *cols: str):
    return F.concat(F.lit(prefix + ":"), F.concat_ws("-", *[F.col(c).cast("string") for c in cols]))


_LINE = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


def edges(spark: SparkSession, d: str) -> DataFrame:
    """Orders link to their lines, lines to part and supplier, suppliers to nations, nations to regions."""
    line = table(spark, d, "lineitem").select(*_LINE).distinct()
    one = lambda df, a, b: df.select(a.alias("src"), b.alias("dst"))
    out = one(line, _node("O", "l_orderkey"), _node("L", *_LINE))
    out = out.unionByName(one(line, _node("L", *_LINE), _node("P", "l_partkey"))).unionByName(one(line, _node("L", *_LINE), _node("S", "l_suppkey")))
    out = out.unionByName(one(table(spark, d, "supplier"), _node("S", "s_suppkey"), _node("N", "s_nationkey")))
    return out.unionByName(one(table(spark, d, "nation"), _node("N", "n_nationkey"), _node("R", "n_regionkey")))


def nodes(spark: SparkSession, d: str) -> DataFrame:
    """(block, size, file) of every node."""
    cents = lambda c: F.round(F.col(c) * 100).cast("long")
    file = lambda c: (F.col(c) % 16).cast("long").alias("file")
    line = table(spark, d, "lineitem").groupBy(*_LINE).agg(F.max(cents("l_extendedprice")).alias("size"))
    parts = [
        table(spark, d, "orders").select(_node("O", "o_orderkey").alias("block"), cents("o_totalprice").alias("size"), file("o_orderkey")),
        line.select(_node("L", *_LINE).alias("block"), "size", file("l_orderkey")),
        table(spark, d, "part").select(_node("P", "p_partkey").alias("block"), F.col("p_size").cast("long").alias("size"), file("p_partkey")),
        table(spark, d, "supplier").select(_node("S", "s_suppkey").alias("block"), F.round(F.abs("s_acctbal") * 100).cast("long").alias("size"), file("s_suppkey")),
        table(spark, d, "nation").select(_node("N", "n_nationkey").alias("block"), F.octet_length("n_name").cast("long").alias("size"), file("n_nationkey")),
        table(spark, d, "region").select(_node("R", "r_regionkey").alias("block"), F.octet_length("r_name").cast("long").alias("size"), F.lit(16).cast("long").alias("file")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def root_nodes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").filter("o_orderstatus = 'F'").select(_node("O", "o_orderkey").alias("node"))


def files(spark: SparkSession, d: str) -> DataFrame:
    """A file tree from pages: host and path segments, an index file in each; the greatest of equal paths."""
    path = F.regexp_replace(F.regexp_replace(F.regexp_replace("url", r"^[a-z]+://", ""), r"[?#].*$", ""), r"/+$", "")
    rows = table(spark, d, "pages").select(F.concat(path, F.lit("/index")).alias("path"), F.octet_length("html").cast("long").alias("size"), F.md5("html").alias("content"))
    return rows.groupBy("path").agg(F.max("size").alias("size"), F.max("content").alias("content"))


def entries(spark: SparkSession, d: str) -> DataFrame:
    """Documents as files of a snapshot; of each eleven one is a directory, one a link and one an empty file."""
    name = F.lpad(F.col("doc_id").cast("string"), 9, "0")
    turn = F.col("doc_id") % 11
    full = turn > 2
    return table(spark, d, "documents").select(
        "doc_id", F.concat_ws("/", "source", "lang").alias("parent"), F.concat_ws("/", "source", "lang", name).alias("path"), name.alias("name"),
        F.when(turn == 0, "dir").when(turn == 1, "link").otherwise("file").alias("kind"),
        F.when(full, F.octet_length("text")).otherwise(0).cast("long").alias("size"), F.lit(420).alias("mode"),
        (F.lit(1700000000000000000) + F.col("n_chars") * 1000000007).alias("mtime_ns"), F.when(full & (F.octet_length("text") > 0), F.md5("text")).alias("content"),
        F.when(turn == 1, F.concat(F.lit("to-"), "source")).alias("target"), "lang", "source", "text",
    )


def old_entries(spark: SparkSession, d: str) -> DataFrame:
    """An earlier snapshot: no French files, other Spanish contents, other modes in one source, some other kinds and targets."""
    spanish = F.col("lang") == "es"
    return entries(spark, d).filter("lang <> 'fr'").withColumns(
        {
            "mode": F.when(F.col("source") == "src7", 384).otherwise(F.col("mode")),
            "content": F.when(spanish & (F.col("size") > 0), F.md5(simple_upper(F.col("text")))).otherwise(F.col("content")),
            "kind": F.when(F.col("doc_id") % 33 == 0, "file").otherwise(F.col("kind")),
            "target": F.when(F.col("doc_id") % 22 == 1, F.concat("target", F.lit("-old"))).otherwise(F.col("target")),
            "mtime_ns": F.when(spanish, F.col("mtime_ns") - 1000000000).otherwise(F.col("mtime_ns")),
        }
    )


def new_entries(spark: SparkSession, d: str) -> DataFrame:
    return entries(spark, d).filter("lang <> 'de'")


def copies(spark: SparkSession, d: str) -> DataFrame:
    """Stored copies of blocks: file from the source, offset from the id."""
    return table(spark, d, "documents").select(
        F.md5("text").alias("block"), F.substring("source", 4, 20).cast("long").alias("file"), (F.col("doc_id") * 65536).alias("offset"),
        F.octet_length("text").cast("long").alias("size"),
    )


def index(spark: SparkSession, d: str) -> DataFrame:
    """An index that points to each id's first copy."""
    return copies(spark, d).groupBy("block").agg(F.min(F.struct("file", "offset")).alias("t")).select("block", "t.*")
