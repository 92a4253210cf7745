"""Replication: which datasets take part, and what each transaction asks of the replica."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.operators.txlog import STATE, with_later_delete


def parse_patterns(spec: str) -> list[str]:
    """Comma-separated account or account:dataset patterns; blanks drop out."""
    return [p for p in (s.strip() for s in spec.split(",")) if p]


def should_include(account: Column, dataset: Column, include: list[str], exclude: list[str]) -> Column:
    """Excludes first; an account pattern covers its datasets; for the account itself (dataset empty) any include of it counts."""

    def hits(pattern: str, account_level: bool) -> Column:
        name, colon, rest = pattern.partition(":")
        fits = F.lit(True) if not colon else (dataset == rest) | ((dataset == "") if account_level else F.lit(False))
        return (account == name) & fits

    out = F.lit(not include)
    for p in include:
        out = out | hits(p, True)
    for p in exclude:
        out = out & ~hits(p, False)
    return out


def sync_decisions(log: DataFrame, remote: DataFrame) -> DataFrame:
    """Each transaction with its action: delete, add, or skip with the reason.

    An addition that the log deletes later is not sent, nor one that the replica has; a deletion is
    sent only if the replica has the state.  Whatever the action, the position advances.
    """
    has = remote.select(*STATE).distinct().withColumn("_has", F.lit(True))
    rows = with_later_delete(log).join(has, STATE, "left").withColumn("_has", F.coalesce("_has", F.lit(False)))
    action = (
        F.when((F.col("op") == "DEL") & F.col("_has"), "delete").when(F.col("op") == "DEL", "skip: not there")
        .when(F.col("later_delete"), "skip: deleted later").when(F.col("_has"), "skip: already there").otherwise("add")
    )
    return rows.withColumn("action", action).drop("_has", "later_delete")


def sync_totals(decisions: DataFrame) -> DataFrame:
    return decisions.groupBy("account", "dataset").agg(
        F.count_if(F.col("action") == "add").alias("n_added"), F.count_if(F.col("action") == "delete").alias("n_deleted"),
        F.count_if(F.col("action").startswith("skip")).alias("n_skipped"),
        F.coalesce(F.sum(F.when(F.col("action") == "add", F.col("size"))), F.lit(0)).alias("bytes"), F.max("seq").alias("position"),
    )
