"""DELETE, INSERT, UPDATE and MERGE by copy on write: Spark's file tables know INSERT only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evenbag.plans.barriers import written

from .base import fallback_predicate, parity_key, unique


def default_predicate(df: DataFrame) -> Column:
    key = parity_key(df.schema)
    return F.col(key) % 2 == 1 if key else fallback_predicate(df.schema)


def delete_where(df: DataFrame, p: Column) -> DataFrame:
    """Rows where p is TRUE go; those where it is NULL stay, so NOT p would not do."""
    return df.filter(~p.eqNullSafe(True))


def delete_reinsert(df: DataFrame, predicate: Column | None = None) -> DataFrame:
    """What one predicate deletes is inserted again from the base."""
    p = predicate if predicate is not None else default_predicate(df)
    return written(delete_where(written(df), p)).unionByName(df.filter(p))


def noop_update(df: DataFrame, predicate: Column | None = None) -> DataFrame:
    """SET c = c WHERE p, on a written table."""
    p = predicate if predicate is not None else default_predicate(df)
    return written(written(df).withColumns({c: F.when(p, F.col(c)).otherwise(F.col(c)) for c in df.columns}))


def merge_upsert(df: DataFrame, key: str) -> DataFrame:
    """MERGE of a table into itself on a unique key: what matches is updated, a null
    key matches nothing and is not inserted again. A key that stands twice is an error,
    as a row would be updated by two."""
    target = unique(written(df), key, nulls=True)
    source = df.select(F.col(key).alias("source_key"), F.struct(*df.columns).alias("source_row"))
    joined = target.join(source, F.col(key) == F.col("source_key"), "left")
    return joined.select(*(F.when(F.col("source_key").isNotNull(), F.col(f"source_row.{c}")).otherwise(F.col(c)).alias(c) for c in df.columns))
