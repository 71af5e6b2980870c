"""What rewrites share: types' properties, row keys, default predicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evenbag.plans.barriers import checkpointed

KEY = "row_key"
_NOT_ORDERABLE = (T.MapType, T.VariantType)


def orderable(t: T.DataType) -> bool:
    return not isinstance(t, _NOT_ORDERABLE)


def groupable(t: T.DataType) -> bool:
    return not isinstance(t, _NOT_ORDERABLE)


def aggregatable(t: T.DataType) -> bool:
    return not isinstance(t, (*_NOT_ORDERABLE, T.ArrayType))


def parity_key(schema: T.StructType) -> str | None:
    """A column of whole numbers."""
    return next((f.name for f in schema if isinstance(f.dataType, (T.LongType, T.IntegerType, T.ShortType)) or isinstance(f.dataType, T.DecimalType) and f.dataType.scale == 0), None)


def fallback_predicate(schema: T.StructType) -> Column:
    """A predicate of the first column, TRUE, FALSE or NULL by its value."""
    f = schema[0]
    return F.col(f.name) >= F.col(f.name) if orderable(f.dataType) else F.col(f.name).isNull()


def keyed(df: DataFrame, key: str = KEY) -> DataFrame:
    """df with a unique row key, written once: read again, it stays the same. The
    key needs no order, so no window and no shuffle."""
    return checkpointed(df.withColumn(key, F.monotonically_increasing_id()))


def like(df: DataFrame, schema: T.StructType) -> DataFrame:
    """df's columns in the order and types of schema."""
    return df.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in schema))


def empty_of(df: DataFrame) -> DataFrame:
    return df.filter(F.lit(1) == F.lit(0))


def unique(df: DataFrame, key: str, nulls: bool = False) -> DataFrame:
    """df, if no value of key stands twice; nulls are allowed only if asked for."""
    twice = F.col("count") > 1
    bad = df.groupBy(key).count().filter(twice & F.col(key).isNotNull() if nulls else twice | F.col(key).isNull())
    if bad.limit(1).count():
        raise ValueError(f"{key} is not unique")
    return df


def ranked(df: DataFrame, name: str, *order: Column) -> DataFrame:
    """df with a long column `name`: 0, 1, 2 ... by the given order, ties as they come.
    Rows are dealt by range and written, then numbered within each partition; only the
    partitions' counts meet in one window."""
    dealt = checkpointed(df.repartitionByRange(*order).withColumn("dealt_to", F.spark_partition_id()))
    counts = dealt.groupBy("dealt_to").agg(F.count("*").alias("rows_before"))
    before = Window.orderBy("dealt_to").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("dealt_to", F.coalesce(F.sum("rows_before").over(before), F.lit(0)).alias("rows_before"))
    inside = Window.partitionBy("dealt_to").orderBy(*order)
    numbered = dealt.withColumn("row_inside", F.row_number().over(inside) - 1)
    return numbered.join(F.broadcast(offsets), "dealt_to").withColumn(name, F.col("rows_before") + F.col("row_inside")).drop("dealt_to", "rows_before", "row_inside")
