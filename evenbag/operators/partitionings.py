"""Splits that a union puts together again, and bag set operations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evenbag.plans.barriers import checkpointed

from .base import KEY, empty_of, fallback_predicate, keyed, parity_key


def partition_union(df: DataFrame, key: str | None = None) -> DataFrame:
    """Even and not even. MOD of a negative odd number is -1, and of NULL is NULL, so
    the second arm is <> 0 OR IS NULL."""
    k = F.col(key or parity_key(df.schema))
    return df.filter(k % 2 == 0).unionByName(df.filter((k % 2 != 0) | k.isNull()))


def tlp_union(df: DataFrame, predicate: Column | None = None) -> DataFrame:
    """Where p is TRUE, FALSE, NULL."""
    p = predicate if predicate is not None else fallback_predicate(df.schema)
    return df.filter(p).unionByName(df.filter(~p)).unionByName(df.filter(p.isNull()))


def rank_mod_union(df: DataFrame, parts: int = 3) -> DataFrame:
    """By the remainder of one written row key."""
    rows = keyed(df)
    return reduce(DataFrame.unionByName, (rows.filter(F.col(KEY) % parts == i) for i in range(parts))).select(*df.columns)


def union_empty(df: DataFrame) -> DataFrame:
    return df.unionByName(checkpointed(empty_of(df)))


def except_empty(df: DataFrame) -> DataFrame:
    return df.exceptAll(empty_of(df))


def except_written_empty(df: DataFrame) -> DataFrame:
    return df.exceptAll(checkpointed(empty_of(df)))


def intersect_self(df: DataFrame) -> DataFrame:
    return df.intersectAll(df)


def distinct_union_duplicate(df: DataFrame) -> DataFrame:
    """Rows with a key, doubled and written, then made distinct."""
    rows = keyed(df)
    return checkpointed(rows.unionByName(rows)).distinct().select(*df.columns)
