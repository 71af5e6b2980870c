"""Expansions that add rows, and the reductions that take just these away."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evenbag.plans.barriers import checkpointed

from .base import KEY, aggregatable, groupable, keyed

TAG = "tag"
KEEP = 1


def tag_explode(df: DataFrame, copies: int = 2) -> DataFrame:
    """Each row once with the tag to keep and copies - 1 times without."""
    return checkpointed(df.withColumn(TAG, F.explode(F.sequence(F.lit(1), F.lit(copies)))).withColumn(TAG, F.when(F.col(TAG) == 1, KEEP).otherwise(0)))


def tag_insert_extras(tagged: DataFrame) -> DataFrame:
    """More rows without the tag, copied from those with it."""
    return checkpointed(tagged.unionByName(tagged.filter(F.col(TAG) == KEEP).withColumn(TAG, F.lit(0))))


def tag_prune_filter(tagged: DataFrame) -> DataFrame:
    return tagged.filter(F.col(TAG) == KEEP).drop(TAG)


def tag_prune_delete(tagged: DataFrame) -> DataFrame:
    """DELETE WHERE tag <> KEEP by copy on write: the rows where it is not TRUE."""
    return checkpointed(tagged.filter(~(F.col(TAG) != KEEP).eqNullSafe(True))).drop(TAG)


def key_explode(df: DataFrame, copies: int = 2) -> DataFrame:
    """Rows with a written key, each `copies` times."""
    return checkpointed(keyed(df).withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(copies)))).drop("copy"))


def key_insert_extras(rows: DataFrame) -> DataFrame:
    return checkpointed(rows.unionByName(rows))


def key_distinct(rows: DataFrame) -> DataFrame:
    if not all(groupable(f.dataType) for f in rows.schema):
        raise ValueError("a column cannot be grouped")
    return rows.distinct().drop(KEY)


def key_group(rows: DataFrame) -> DataFrame:
    """Any value of each column per key: all are the same."""
    names = [c for c in rows.columns if c != KEY]
    return rows.groupBy(KEY).agg(*(F.any_value(c).alias(c) for c in names)).select(*names)


def key_window(rows: DataFrame) -> DataFrame:
    names = [f.name for f in rows.schema if f.name != KEY]
    w = Window.partitionBy(KEY)
    value = {f.name: F.max(f.name).over(w) if aggregatable(f.dataType) and not isinstance(f.dataType, T.DoubleType) else F.any_value(f.name).over(w) for f in rows.schema if f.name != KEY}
    return rows.select(KEY, *(value[c].alias(c) for c in names)).distinct().drop(KEY)


def key_first(rows: DataFrame) -> DataFrame:
    """The first of each key's rows."""
    n = F.row_number().over(Window.partitionBy(KEY).orderBy(KEY))
    return rows.withColumn("n", n).filter("n = 1").drop("n", KEY)
