"""Columns by their exact names, whatever characters they hold or names they clash with."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql.types import StructField, StructType


def named(df: DataFrame, name: str) -> Column:
    """The column of this name, also if it holds dots or backticks."""
    return df["`" + name.replace("`", "``") + "`"]


def fresh(base: str, taken: Iterable[str]) -> str:
    """A name like base that none of the taken ones equals, in any case."""
    used = {t.lower() for t in taken}
    while base.lower() in used:
        base += "_"
    return base


def map_in_arrow(df: DataFrame, run, schema: StructType) -> DataFrame:
    """df.mapInArrow for columns of any name: Spark's own takes a name with a dot for a nested field."""
    names, out = df.columns, schema.names

    def positional(batches):
        for batch in run(b.rename_columns(names) for b in batches):
            yield batch.rename_columns([f"c{i}" for i in range(len(out))])

    plain = StructType([StructField(f"c{i}", f.dataType, f.nullable) for i, f in enumerate(schema)])
    return df.toDF(*[f"c{i}" for i in range(len(names))]).mapInArrow(positional, plain).toDF(*out)
