"""Tables, and an overlay of `orders` with the values that rewrites stumble over."""

from __future__ import annotations

import datetime as dt
import random
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

NAMES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")

#: NULLs, negative keys, decimals, booleans, dates, infinities and duplicate
#: payloads over a unique key c_pk. Runs unchanged on Spark and on DuckDB.
HAZARDS = """
SELECT c_pk,
  CASE WHEN h % 13 = 0 OR h % 7 = 1 THEN NULL ELSE CAST(h % 101 - 50 AS BIGINT) END AS c_int,
  CASE WHEN h % 13 = 0 OR h % 5 = 1 THEN NULL ELSE CAST(h * 1000003 - 7000000 AS DECIMAL(38,0)) END AS c_big,
  CASE WHEN h % 13 = 0 OR h % 11 = 2 THEN NULL ELSE CAST(CAST(h % 2000 AS DECIMAL(10,2)) - CAST(500.25 AS DECIMAL(10,2)) AS DECIMAL(10,2)) END AS c_dec,
  CASE WHEN h % 13 = 0 OR h % 9 = 4 THEN NULL WHEN h % 97 = 5 THEN CAST('Infinity' AS DOUBLE) WHEN h % 97 = 6 THEN CAST('-Infinity' AS DOUBLE) ELSE CAST(h % 1000 AS DOUBLE) / 8 - 25 END AS c_dbl,
  CASE WHEN h % 13 = 0 THEN NULL WHEN h % 7 = 0 THEN '' WHEN h % 7 = 1 THEN 'a' WHEN h % 7 = 2 THEN 'abc' WHEN h % 7 = 3 THEN 'Zed' WHEN h % 7 = 4 THEN 'o''brien' WHEN h % 7 = 5 THEN 'trailing ' ELSE NULL END AS c_txt,
  CASE WHEN h % 13 = 0 OR h % 3 = 2 THEN NULL ELSE h % 3 = 0 END AS c_flag,
  CASE WHEN h % 13 = 0 OR h % 17 = 3 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS c_date,
  CASE WHEN h % 13 = 0 OR h % 19 = 3 THEN NULL ELSE o_orderdate END AS c_ts
FROM (SELECT o_orderkey AS c_pk, o_orderkey - o_orderkey % 2 AS h, MIN(o_orderdate) OVER (PARTITION BY o_orderkey - o_orderkey % 2) AS o_orderdate FROM {orders}) s
"""
HAZARDS_SQL = HAZARDS.format(orders="orders")

#: The pools from which seed rows are drawn, by type.
POOLS = {
    "boolean": [True, False, None],
    "double": [0.0, 1.5, -1.5, 1000.125, None],
    "bigint": [0, 1, 2, -1, -7, 42, None],
    "decimal(38,0)": [Decimal("0"), Decimal("1"), Decimal("-1"), Decimal("99999999999999999999"), None],
    "decimal(10,2)": [Decimal("0"), Decimal("12.34"), Decimal("-5.50"), Decimal("999.99"), None],
    "date": [dt.date(2024, 1, 15), dt.date(1999, 12, 31), dt.date(2030, 6, 1), None],
    "timestamp_ntz": [dt.datetime(2024, 1, 15, 12, 34, 56), dt.datetime(1999, 12, 31, 23, 59, 59), None],
    "string": ["", "a", "abc", "Zed", "o'brien", "trailing ", None],
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def hazards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(HAZARDS, orders=table(spark, sf_dir, "orders"))


def sample_schema(seed: int, least: int = 1, most: int = 8) -> T.StructType:
    """c_pk and one to eight columns, their types drawn with replacement."""
    rng = random.Random(seed)
    out = T.StructType([T.StructField("c_pk", T.LongType(), False)])
    for k in range(rng.randint(least, most)):
        out.add(f"c_{k}", rng.choice(list(POOLS)))
    return out


def seed_rows(spark: SparkSession, schema: T.StructType, count: int = 8, seed: int = 0) -> DataFrame:
    """Awkward rows: the first all NULL but for its key, infinities in the first
    double column, the last a copy of the second but for its key."""
    rng = random.Random(seed)
    names = [f.name for f in schema]
    rows = [[k + 1, *(None if k == 0 else rng.choice(POOLS[f.dataType.simpleString()]) for f in schema[1:])] for k in range(count)]
    doubles = [k for k, f in enumerate(schema) if isinstance(f.dataType, T.DoubleType)]
    for k, value in ((1, float("inf")), (2, float("-inf"))):
        if doubles and count > k + 1:
            rows[k][doubles[0]] = value
    if count > 2:
        rows[-1][1:] = rows[1][1:]
    return spark.createDataFrame([tuple(r) for r in rows], schema).select(*names)
