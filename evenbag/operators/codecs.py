"""Values packed into something else and back, bit for bit."""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evenbag.plans.barriers import checkpointed, fresh_name, fresh_path, named, written

from .base import like, unique


def _each(df: DataFrame, fn, kinds: tuple | None = None) -> DataFrame:
    """fn over each column (of the kinds given); types and names as before."""
    return df.select(*(fn(F.col(f.name)).cast(f.dataType).alias(f.name) if kinds is None or isinstance(f.dataType, kinds) else F.col(f.name) for f in df.schema))


def _guard(c: Column, value: Column) -> Column:
    return F.when(c.isNotNull(), value)


def hex_value(c: Column) -> Column:
    return _guard(c, F.decode(F.unhex(F.hex(c)), "UTF-8"))


def base64_value(c: Column) -> Column:
    return _guard(c, F.decode(F.unbase64(F.base64(c)), "UTF-8"))


def json_value(c: Column) -> Column:
    return _guard(c, F.get_json_object(F.to_json(F.struct(c.alias("v"))), "$.v"))


def hex_codec(df: DataFrame) -> DataFrame:
    return _each(df, hex_value, (T.StringType,))


def base64_codec(df: DataFrame) -> DataFrame:
    return _each(df, base64_value, (T.StringType,))


def json_codec(df: DataFrame) -> DataFrame:
    return _each(df, json_value, (T.StringType,))


def mixed_codec(df: DataFrame, seed: int = 0) -> DataFrame:
    """Hexadecimal or JSON, drawn for each text column."""
    rng = random.Random(seed)
    return _each(df, lambda c: rng.choice((hex_value, json_value))(c), (T.StringType,))


def _packed(df: DataFrame, pack, unpack) -> DataFrame:
    """Each column packed and written, read and unpacked: between the two there is a
    barrier, as the optimizer would undo one by the other."""
    stored = checkpointed(df.select(*(pack(F.col(c)).alias(c) for c in df.columns)))
    return stored.select(*(unpack(F.col(f.name)).cast(f.dataType).alias(f.name) for f in df.schema))


def array_pack(df: DataFrame) -> DataFrame:
    return _packed(df, F.array, lambda a: a[0])


def array_element(df: DataFrame) -> DataFrame:
    return _packed(df, lambda c: F.array(c, c), lambda a: F.element_at(a, -1))


def array_transform(df: DataFrame) -> DataFrame:
    return _each(df, lambda c: F.transform(F.array(c), lambda x: x)[0])


def array_filter(df: DataFrame) -> DataFrame:
    return _each(df, lambda c: F.filter(F.array(c), lambda x: F.lit(1) == F.lit(1))[0])


def map_pack(df: DataFrame) -> DataFrame:
    return _packed(df, lambda c: F.create_map(F.lit("k"), c), lambda m: m["k"])


def tuple_element(df: DataFrame) -> DataFrame:
    return _packed(df, lambda c: F.struct(F.lit(0).alias("a"), c.alias("b")), lambda t: t["b"])


def coalesce_self(df: DataFrame) -> DataFrame:
    return _each(df, lambda c: F.coalesce(c, c))


def struct_pack(df: DataFrame) -> DataFrame:
    """The whole row as a struct, written, and out again."""
    return checkpointed(df.select(F.struct(*df.columns).alias("s"))).select("s.*")


def object_column(df: DataFrame) -> DataFrame:
    """Each column written as a struct of one field."""
    packed = written(df.select(*(F.struct(F.col(c).alias("o")).alias(c) for c in df.columns)))
    return packed.select(*(F.col(f"{c}.o").alias(c) for c in df.columns))


def row_json(df: DataFrame, written_out: bool = False) -> DataFrame:
    """Whole numbers, decimals, texts, dates and booleans of a row as one JSON object;
    doubles and timestamps, which lose digits or depend on the session, stay out."""
    exact = (T.IntegralType, T.DecimalType, T.StringType, T.BooleanType, T.DateType)
    names = [f.name for f in df.schema if isinstance(f.dataType, exact)]
    schema = T.StructType([f for f in df.schema if f.name in names])
    packed = df.select(F.to_json(F.struct(*names), {"ignoreNullFields": "false"}).alias("row_object"), *(c for c in df.columns if c not in names))
    packed = written(packed) if written_out else packed
    return packed.withColumn("row_object", F.from_json("row_object", schema)).select(*(F.col(f"row_object.{c}").alias(c) if c in names else F.col(c) for c in df.columns))


def pivot_struct(df: DataFrame, key: str) -> DataFrame:
    """All but the key packed in a struct, pivoted on a constant, and unpacked. The
    key must be unique and not null."""
    rest = [c for c in df.columns if c != key]
    packed = unique(df, key).select(key, F.struct(*rest).alias("v"), F.lit("x").alias("k"))
    wide = packed.groupBy(key).pivot("k", ["x"]).agg(F.first("v"))
    return wide.select(*(F.col(c) if c == key else F.col(f"x.{c}").alias(c) for c in df.columns))


def dictionary(df: DataFrame) -> DataFrame:
    """Texts as numbers of a dictionary of their distinct values, and back by left
    joins on the number. Null stays out of the dictionary."""
    out = df
    for f in [f for f in df.schema if isinstance(f.dataType, T.StringType)]:
        words = checkpointed(df.select(f.name).distinct().filter(F.col(f.name).isNotNull()).select(F.col(f.name).alias("word"), F.monotonically_increasing_id().alias("code")))
        coded = out.join(words, F.col(f.name) == F.col("word"), "left").drop("word", f.name)
        out = coded.join(words, "code", "left").drop("code").withColumnRenamed("word", f.name)
    return out.select(*df.columns)


def domain_cast(df: DataFrame) -> DataFrame:
    """Whole numbers through DECIMAL(38,0) and back."""
    return _each(df, lambda c: c.cast("decimal(38,0)"), (T.LongType, T.IntegerType))


def generated_column(df: DataFrame, stored: bool = True) -> DataFrame:
    """A twin of the first column, written or not, shown under its name."""
    first = df.columns[0]
    twin = df.withColumn("twin", F.col(first)).drop(first)
    twin = written(twin) if stored else twin
    return twin.withColumnRenamed("twin", first).select(*df.columns)


def written_extra_column(df: DataFrame) -> DataFrame:
    """A column with a default is added and written, dropped and written."""
    return written(written(df.withColumn("extra", F.lit(42))).drop("extra"))


def typed_insert(df: DataFrame) -> DataFrame:
    """A table of declared types, filled by INSERT ... SELECT."""
    spark, name = df.sparkSession, named("TABLE", fresh_name("typed"))
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet LOCATION '{fresh_path(spark, name)}'")
    spark.sql(f"INSERT INTO {name} SELECT * FROM {{t}}", t=df)
    return like(spark.table(name), df.schema)
