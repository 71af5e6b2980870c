"""Joins that keep every row once, and the joins Spark has no syntax for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evenbag.plans.barriers import checkpointed

from .base import KEY, empty_of, keyed

#: The most rows whose keys a broadcast hint is put on; more are joined without it.
MAX_BROADCAST = 1_000_000


def left_join_empty(df: DataFrame) -> DataFrame:
    """Every left row once. The right side is written, so that the optimizer does not
    see that it is empty; adaptive execution does, so the join is left only where that
    is off (see plans.arms)."""
    right = checkpointed(empty_of(df)).select(F.col(df.columns[0]).alias("right_side"))
    return df.join(right, F.lit(True), "left").select(*df.columns)


def anti_join_empty(df: DataFrame) -> DataFrame:
    return df.join(checkpointed(empty_of(df)).select(F.col(df.columns[0]).alias("right_side")), F.lit(True), "left_anti")


def semi_join_keys(df: DataFrame) -> DataFrame:
    """Semi join with the complete table of keys."""
    left = keyed(df)
    return left.join(left.select(KEY), KEY, "left_semi").select(*df.columns)


def flag_join(df: DataFrame, how: str = "inner", hint: str | None = None) -> DataFrame:
    """Rows with a key join (key, flag = 1), of which all have flag = 1. The hint is
    left off where too many keys would be broadcast: Spark chooses the join then."""
    left = keyed(df)
    if hint == "broadcast" and left.count() > MAX_BROADCAST:
        hint = None
    right = left.select(F.col(KEY).alias("flag_key"), F.lit(1).alias("flag"))
    right = right.hint(hint) if hint else right
    return left.join(right, F.col(KEY) == F.col("flag_key"), how).filter("flag = 1").select(*df.columns)


def split_join(df: DataFrame, how: str = "full") -> DataFrame:
    """The columns in two halves, joined on the row's key."""
    if len(df.columns) < 2:
        return df
    whole, half = keyed(df), len(df.columns) // 2
    left, right = whole.select(KEY, *df.columns[:half]), whole.select(KEY, *df.columns[half:])
    return left.join(right, KEY, how).select(*df.columns)


def cross_join_filter(df: DataFrame) -> DataFrame:
    """A cross join under an equality: Spark makes it an equi join."""
    left = keyed(df)
    right = left.select(F.col(KEY).alias("other_key"))
    return left.crossJoin(right).filter(F.col(KEY) == F.col("other_key")).select(*df.columns)


def positional_join(df: DataFrame) -> DataFrame:
    """The columns in two halves, written apart and joined by position alone: a row's
    place is its partition and its place in there, which both halves number for
    themselves, as neither has a column of the other."""
    if len(df.columns) < 2:
        return df
    whole, half = checkpointed(df), len(df.columns) // 2
    left, right = (checkpointed(whole.select(*some)).withColumn(KEY, F.monotonically_increasing_id()) for some in (df.columns[:half], df.columns[half:]))
    return left.join(right, KEY).select(*df.columns)


def asof_join(left: DataFrame, right: DataFrame, left_on: str, right_on: str, by: list[str] | None = None, values: list[str] | None = None) -> DataFrame:
    """left with `values` of the latest right row, of the same `by`, that is not
    after it; NULL if none. Both sides go through one window as one stream of
    events, so each group is sorted once and nothing is joined. Of right rows with
    one time any may win; a null time matches nothing."""
    by, values = by or [], values or [c for c in right.columns if c not in (right_on, *(by or []))]
    named = [f"asof_{v}" for v in values]
    row = F.struct(*(F.col(v) for v in values)).alias("asof_row")
    a = left.withColumns({"asof_time": F.col(left_on), "asof_left": F.lit(1), "asof_row": F.lit(None).cast(right.select(row).schema[0].dataType)})
    b = right.filter(F.col(right_on).isNotNull()).select(*by, F.col(right_on).alias("asof_time"), F.lit(0).alias("asof_left"), row)
    for f in left.schema:
        if f.name not in by:
            b = b.withColumn(f.name, F.lit(None).cast(f.dataType))
    w = Window.partitionBy(*by).orderBy(F.col("asof_time").asc_nulls_first(), "asof_left").rowsBetween(Window.unboundedPreceding, 0)
    both = a.unionByName(b).withColumn("asof_last", F.last("asof_row", True).over(w)).filter("asof_left = 1")
    return both.select(*left.columns, *(F.col(f"asof_last.{v}").alias(n) for v, n in zip(values, named)))


def asof_join_empty(df: DataFrame, on: str, by: list[str]) -> DataFrame:
    """As-of join with an empty table: every row once, with nothing found."""
    right = checkpointed(empty_of(df)).select(*by, F.col(on).alias("at"), F.lit(1).alias("v"))
    return asof_join(checkpointed(df), right, on, "at", by, ["v"]).filter("asof_v IS NULL").select(*df.columns)


def distinct_on(df: DataFrame, key: str, order: Column | None = None) -> DataFrame:
    """One row for each value of key, the first by order."""
    w = Window.partitionBy(key).orderBy(order if order is not None else F.col(key))
    return df.withColumn("n", F.row_number().over(w)).filter("n = 1").drop("n")
