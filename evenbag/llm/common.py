"""What the operators share: checkpoints, ranks, fresh names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evenbag.plans.barriers import shared_dir

#: A word, in Java's, DuckDB's and Python's regular expressions alike.
WORD = r"[^\x20\x09-\x0D]+"


def cut(df: DataFrame) -> DataFrame:
    """df, computed once and kept by checkpoint() in the shared folder, which the
    session must name unless it is local."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names for helper columns that no column of df has."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def col(df: DataFrame, name: str) -> Column:
    """The column of exactly this name, also where it holds dots."""
    return F.col(f"`{name}`")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def word_count(text: Column) -> Column:
    """Number of words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def ranked(df: DataFrame, name: str, *order: Column) -> DataFrame:
    """df with a long column `name`: 0, 1, 2 ... by the given order, which must be
    total. Rows are dealt by range and numbered within each partition; only the
    partitions' counts meet in one window."""
    part, row, first = fresh(df, "part", "row", "first")
    dealt = cut(df.repartitionByRange(*order).withColumn(part, F.spark_partition_id()))
    counts = dealt.groupBy(part).agg(F.count("*").alias(row))
    before = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(part, F.coalesce(F.sum(row).over(before), F.lit(0)).alias(first))
    inside = Window.partitionBy(part).orderBy(*order)
    numbered = dealt.withColumn(row, F.row_number().over(inside) - 1)
    return numbered.join(offsets, part).withColumn(name, F.col(first) + F.col(row)).drop(part, row, first)
