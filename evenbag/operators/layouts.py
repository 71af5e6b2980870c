"""The same rows in another physical layout, or read in another way."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evenbag.plans.barriers import bucketed, checkpointed, fresh_name, fresh_path, named, saved, written

from .base import empty_of, parity_key, unique


def view(df: DataFrame) -> DataFrame:
    name = named("VIEW", fresh_name("v"))
    df.createOrReplaceTempView(name)
    return df.sparkSession.table(name)


def global_view(df: DataFrame) -> DataFrame:
    name = named("GLOBAL VIEW", fresh_name("g"))
    df.createOrReplaceGlobalTempView(name)
    return df.sparkSession.table(f"global_temp.{name}")


def table(df: DataFrame) -> DataFrame:
    return df.sparkSession.table(saved(df))


def temporary_table(df: DataFrame) -> DataFrame:
    return view(checkpointed(df))


def materialized_view(df: DataFrame) -> DataFrame:
    """A table of the rows, and a view kept over it."""
    return view(table(df))


def barrier_view(df: DataFrame) -> DataFrame:
    """A view that no filter is pushed through: its rows are written first."""
    return view(checkpointed(df))


def table_function(df: DataFrame) -> DataFrame:
    """The rows of a SQL table function over them."""
    spark, name, source = df.sparkSession, named("TEMPORARY FUNCTION", fresh_name("f")), named("VIEW", fresh_name("v"))
    df.createOrReplaceTempView(source)
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    spark.sql(f"CREATE TEMPORARY FUNCTION {name}() RETURNS TABLE({columns}) RETURN SELECT * FROM {source}")
    return spark.sql(f"SELECT * FROM {name}()")


def sorted_buckets(df: DataFrame, by: str | None = None) -> DataFrame:
    by = by or df.columns[0]
    return bucketed(df, by, sort=by)


def hash_buckets(df: DataFrame, by: str | None = None) -> DataFrame:
    by = by or df.columns[0]
    return bucketed(df.repartition(F.col(by)), by)


def unseen_buckets(df: DataFrame) -> DataFrame:
    """Bucketed files read as plain ones."""
    spark, name = df.sparkSession, named("TABLE", fresh_name("plain"))
    path = fresh_path(spark, name)
    df.write.format("parquet").option("path", path).bucketBy(8, df.columns[0]).sortBy(df.columns[0]).saveAsTable(name)
    return spark.read.schema(df.schema).parquet(path)


def unique_buckets(df: DataFrame, key: str) -> DataFrame:
    """Bucketed by a key that must be unique and not null."""
    return bucketed(unique(df, key), key)


def derived_buckets(df: DataFrame, expression: str) -> DataFrame:
    """Bucketed by an expression that readers do not see."""
    return bucketed(df.withColumn("derived", F.expr(expression)), "derived").select(*df.columns)


def prefix_buckets(df: DataFrame, text: str, length: int = 10) -> DataFrame:
    return derived_buckets(df, f"substr(`{text}`, 1, {length})")


def null_partitions(df: DataFrame, column: str) -> DataFrame:
    """Partitioned by whether a column is NULL."""
    return written(df.withColumn("is_null", F.col(column).isNull()), partition_by=("is_null",)).select(*df.columns)


def truth_partitions(df: DataFrame, column: str) -> DataFrame:
    """Partitioned by truth: 1, 0, and -1 for NULL."""
    truth = F.when(F.col(column), 1).when(~F.col(column), 0).otherwise(-1)
    return written(df.withColumn("truth", truth), partition_by=("truth",)).select(*df.columns)


def mod_partitions(df: DataFrame, parts: int = 4) -> DataFrame:
    key = parity_key(df.schema) or df.columns[0]
    return written(df.withColumn("part", F.coalesce(F.col(key), F.lit(0)) % parts), partition_by=("part",)).select(*df.columns)


def range_partitions(df: DataFrame, split: int = 0) -> DataFrame:
    """Two partitions, below and from a split of the first column."""
    return written(df.withColumn("upper", F.coalesce(F.col(df.columns[0]) >= split, F.lit(False))), partition_by=("upper",)).select(*df.columns)


def range_sorted(df: DataFrame) -> DataFrame:
    """Dealt by range and sorted, so that a file's minima and maxima are narrow."""
    c = df.columns[0]
    return written(df.repartitionByRange(F.col(c)).sortWithinPartitions(c))


def sorted_descending(df: DataFrame) -> DataFrame:
    return written(df.sortWithinPartitions(F.col(df.columns[0]).desc()))


def covering(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Some columns in a bucketed table of their own, the others joined on the key,
    which must be unique and not null."""
    narrow = bucketed(unique(df, key).select(key, *columns), key)
    rest = bucketed(df.drop(*columns), key)
    return rest.join(narrow, key).select(*df.columns)


def partial_covering(df: DataFrame, key: str, columns: list[str], where: Column) -> DataFrame:
    """As covering(), for the rows where `where` is TRUE; the others stay whole."""
    inside = where.eqNullSafe(True)
    return covering(df.filter(inside), key, columns).unionByName(written(df.filter(~inside)))


def constant_partitions(df: DataFrame) -> DataFrame:
    """Partitioned by a predicate that all rows meet: one partition has them all, and
    readers filter by it."""
    return written(df.withColumn("all_rows", F.lit(1)), partition_by=("all_rows",)).select(*df.columns)


def bloom_filter(df: DataFrame, columns: list[str]) -> DataFrame:
    return written(df, **{f"parquet.bloom.filter.enabled#{c}": "true" for c in columns})


def dictionary_files(df: DataFrame) -> DataFrame:
    """Dictionaries that no column outgrows."""
    return written(df.sortWithinPartitions(df.columns[0]), **{"parquet.dictionary.page.size": str(16 << 20)})


def fine_files(df: DataFrame, rows: int = 2_000) -> DataFrame:
    return written(df, maxRecordsPerFile=rows, **{"parquet.block.size": str(1 << 16)})


def zstd_files(df: DataFrame) -> DataFrame:
    return written(df, compression="zstd")


def delta_files(df: DataFrame) -> DataFrame:
    return written(df, **{"parquet.writer.version": "PARQUET_2_0", "parquet.enable.dictionary": "false"})


def orc_files(df: DataFrame) -> DataFrame:
    return written(df, format="orc")


def row_files(df: DataFrame) -> DataFrame:
    """Rows in a row format. What JSON would lose goes as text: decimals, doubles and
    timestamps."""
    plain = (T.StringType, T.LongType, T.IntegerType, T.BooleanType)
    text = df.select(*(F.col(f.name) if isinstance(f.dataType, plain) else F.col(f.name).cast("string").alias(f.name) for f in df.schema))
    back = written(text, format="json", ignoreNullFields="false")
    return back.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in df.schema))


def four_shards(df: DataFrame, by: str | None = None) -> DataFrame:
    return written(df.repartition(4, F.col(by)) if by else df.repartition(4))


def cached(df: DataFrame) -> DataFrame:
    """A copy of the rows, kept in memory until release(). It is a copy, so Spark does
    not put it into the plans of other queries over df."""
    return checkpointed(df).select("*").persist()


def release(df: DataFrame) -> None:
    df.unpersist()


def analyzed(df: DataFrame) -> DataFrame:
    """A table with statistics of all its columns."""
    name = saved(df)
    df.sparkSession.sql(f"ANALYZE TABLE {name} COMPUTE STATISTICS FOR ALL COLUMNS")
    return df.sparkSession.table(name)


def other_schema(df: DataFrame) -> DataFrame:
    """A table in a schema of its own."""
    spark, schema = df.sparkSession, named("SCHEMA", fresh_name("s"))
    spark.sql(f"CREATE SCHEMA {schema} LOCATION '{fresh_path(spark, schema)}'")
    return spark.table(saved(df, f"{schema}.mirror"))


def mirrored_back(df: DataFrame) -> DataFrame:
    """Out to another schema, back, and the other dropped."""
    spark, schema = df.sparkSession, named("SCHEMA", fresh_name("s"))
    spark.sql(f"CREATE SCHEMA {schema} LOCATION '{fresh_path(spark, schema)}'")
    back = written(spark.table(saved(df, f"{schema}.mirror")))
    spark.sql(f"DROP SCHEMA {schema} CASCADE")
    return back


def inherited(df: DataFrame) -> DataFrame:
    """An empty parent's rows and those of its child."""
    return written(empty_of(df)).unionByName(written(df))


def second_copy(df: DataFrame) -> DataFrame:
    """A copy of the rows sorted by another column."""
    return written(written(df).sortWithinPartitions(df.columns[-1]))


def checkpoint(df: DataFrame) -> DataFrame:
    return checkpointed(df)
