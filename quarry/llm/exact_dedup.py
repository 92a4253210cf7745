"""Exact duplicate removal by a tree of grouped digest runs (DataFrame operators only).

Rows are dealt evenly into numbered runs, whatever their ids or texts.  Each run holds, in
no order, one record per distinct text with its smallest identifier.  In every round, the records of
``fan_in`` neighbouring runs (log2(fan_in) binomial rounds in one exchange) are shuffled by run, digest
and verification hash and grouped: equal ones become one that retains the smallest identifier and the
summed count.  No run is kept sorted or merged as a stream, since the last would be one task's.  After log(runs)/log(fan_in) rounds one run is left, spread over all tasks by
digest.  The outcome is handed back down the same tree, so that a text holding a third of all rows
is looked up by (run, digest) and never gathers in one task.

Defined results: null text counts as empty; null ids come after all other ids; rows repeated with
one id and text form a group, of which one row stays; an empty table gives an empty result; extra
columns are ignored unless ``carry`` asks for them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.plans.columns import named
from quarry.plans.scratch import Scratch

_KEY = ["_sha", "_check"]


def normalised(text: Column) -> Column:
    """Each run of ASCII white space becomes one space; null becomes empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


@dataclass
class DedupResult:
    """rows: one per input row (_uid, id, _sha, keep_id, group_size, kept); source: the carried table."""

    rows: DataFrame
    source: DataFrame


def _run_count(df: DataFrame, runs: int | None) -> int:
    if runs is None:
        runs = max(64, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")))
    return 1 << (runs - 1).bit_length()


def tree_merge(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    runs: int | None = None,
    fan_in: int = 8,
    carry: bool = False,
) -> DedupResult:
    """Group equal texts; see the module docstring for the method and the defined results."""
    scratch = Scratch(docs.sparkSession, "dedup")
    n_runs = _run_count(docs, runs)
    uid = F.monotonically_increasing_id()
    cols = docs.columns if carry else [id_col]
    norm = normalised(named(docs, text_col))
    source = scratch.table(
        docs.select(
            *[named(docs, c).alias(f"c_{i}") for i, c in enumerate(cols)],
            uid.alias("_uid"),
            F.unhex(F.sha2(norm, 256)).alias("_sha"),
            F.xxhash64(norm, F.length(norm)).alias("_check"),
        ),
        "digests",
    )
    rows = source.select(
        F.col(f"c_{cols.index(id_col)}").alias("_id"),
        "_uid",
        *_KEY,
        F.pmod(F.xxhash64("_uid"), F.lit(n_runs)).cast("int").alias("_run"),
    )
    least = F.struct(F.col("_id").isNull().alias("nul"), F.col("_id").alias("id"), F.col("_uid").alias("uid"))
    level = scratch.table(
        rows.groupBy("_run", *_KEY).agg(F.min(least).alias("_keep"), F.count(F.lit(1)).alias("_n")), "run"
    )
    levels = [level]
    while n_runs > 1:
        n_runs = -(-n_runs // fan_in)
        level = scratch.table(
            level.groupBy((F.col("_run") / fan_in).cast("int").alias("_run"), *_KEY).agg(
                F.min("_keep").alias("_keep"), F.sum("_n").alias("_n")
            ),
            "run",
        )
        levels.append(level)
    answer = levels.pop()
    while levels:
        parent = answer.select(F.col("_run").alias("_up"), *_KEY, "_keep", "_n")
        child = levels.pop().select("_run", (F.col("_run") / fan_in).cast("int").alias("_up"), *_KEY)
        answer = child.join(parent, ["_up", *_KEY]).select("_run", *_KEY, "_keep", "_n")
    out = rows.join(answer, ["_run", *_KEY]).select(
        "_uid",
        F.col("_id").alias(id_col),
        "_sha",
        F.col("_keep.id").alias("keep_id"),
        F.col("_n").alias("group_size"),
        (F.col("_keep.uid") == F.col("_uid")).alias("kept"),
    )
    return DedupResult(out, source)


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **kw) -> DataFrame:
    """One row per document: id, keep_id, group_size, kept, text_sha256."""
    rows = tree_merge(docs, id_col, text_col, **kw).rows
    return rows.select(id_col, "keep_id", "group_size", "kept", F.lower(F.hex("_sha")).alias("text_sha256"))


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **kw) -> DataFrame:
    """The documents that stay, with their own columns and texts unchanged."""
    got = tree_merge(docs, id_col, text_col, carry=True, **kw)
    gone = got.rows.filter(~F.col("kept")).select("_uid")
    return got.source.join(gone, "_uid", "left_anti").select(*[F.col(f"c_{i}").alias(c) for i, c in enumerate(docs.columns)])
