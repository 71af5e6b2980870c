"""Projections, filters, CTEs, tautologies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evenbag.plans.barriers import checkpointed

from .base import KEY, fallback_predicate, keyed, ranked


def select_star(df: DataFrame, where: Column | None = None) -> DataFrame:
    """All rows, or those where `where` is TRUE."""
    return df if where is None else df.filter(where)


def explicit_projection(df: DataFrame) -> DataFrame:
    return df.select(*df.columns)


def projection(df: DataFrame, *items: Column) -> DataFrame:
    """Exactly the list of columns asked for."""
    return df.select(*items)


def cte(df: DataFrame) -> DataFrame:
    return df.sparkSession.sql("WITH c AS (SELECT * FROM {t}) SELECT * FROM c", t=df)


def materialized_cte(df: DataFrame) -> DataFrame:
    """A CTE computed once; both of its readers see the written rows."""
    c = checkpointed(df)
    return c.sparkSession.sql("WITH c AS (SELECT * FROM {t}) SELECT * FROM c", t=c)


def nested_materialized_cte(df: DataFrame) -> DataFrame:
    return materialized_cte(materialized_cte(df))


def lateral_reproject(df: DataFrame) -> DataFrame:
    inner = ", ".join(f"s.`{c}` AS `{c}`" for c in df.columns)
    return df.sparkSession.sql(f"SELECT l.* FROM {{t}} s, LATERAL (SELECT {inner}) l", t=df)


def add_drop_column(df: DataFrame) -> DataFrame:
    """A NULL column comes, is written, and goes."""
    return checkpointed(df.withColumn("extra", F.lit(None).cast("int"))).drop("extra")


def number_all(df: DataFrame) -> DataFrame:
    """Rows numbered in the order of their first column, of which all are kept."""
    return ranked(df, "n", F.col(df.columns[0])).filter("n >= 0").drop("n")


def ordered_scan(df: DataFrame) -> DataFrame:
    return df.orderBy(df.columns[0]).select("*")


def distinct_as_group_by(df: DataFrame) -> DataFrame:
    """Rows with a key, grouped by key and all columns."""
    return keyed(df).groupBy(*df.columns, KEY).agg(F.count("*").alias("n")).select(*df.columns)


def tautology(p: Column) -> Column:
    """TRUE for each of the three truth values of p."""
    return p | ~p | p.isNull()


def case_columns(df: DataFrame, predicate: Column | None = None) -> DataFrame:
    """Each column under a CASE that always takes its first arm."""
    p = tautology(predicate if predicate is not None else fallback_predicate(df.schema))
    return df.select(*(F.when(p, F.col(f.name)).otherwise(F.lit(None).cast(f.dataType)).alias(f.name) for f in df.schema))


def determined_filter(df: DataFrame, predicate: Column | None = None, where: Column | None = None) -> DataFrame:
    """A tautology as filter, together with the filter asked for."""
    p = tautology(predicate if predicate is not None else fallback_predicate(df.schema))
    return df.filter(p if where is None else where & p)


def recursive_cte(df: DataFrame) -> DataFrame:
    """A recursive CTE whose recursive arm finds nothing. LIMIT ALL lifts the limit of
    spark.sql.cteRecursionRowLimit rows, past which Spark fails."""
    return df.sparkSession.sql("WITH RECURSIVE r AS (SELECT * FROM {t} UNION ALL SELECT * FROM r WHERE 1 = 0) SELECT * FROM r LIMIT ALL", t=df)


def replace_columns(df: DataFrame) -> DataFrame:
    """Each column replaced by itself."""
    return df.withColumns({c: F.col(c) for c in df.columns})


def numbered_bound(df: DataFrame, bound: int | None = None) -> DataFrame:
    """The first `bound` rows by the order of the first column, the bound being at least
    the number of rows."""
    bound = bound if bound is not None else df.count()
    return ranked(df, "n", F.col(df.columns[0])).filter(F.col("n") < bound).drop("n")
