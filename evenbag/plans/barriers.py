"""Where a plan is cut, where what is written goes, and how it goes away again."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

#: (kind, name) of the tables, views and folders made since the process began.
_made: list[tuple[str, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir as the session
    names it. Where it is unset a new local one is made and set, if all of Spark runs
    on this machine; on a cluster executors would not see each other's, so it raises."""
    context = spark.sparkContext
    known = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not known:
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        known = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    if not context.getCheckpointDir():
        context.setCheckpointDir(known)
    return known.rstrip("/")


def fresh_name(prefix: str) -> str:
    return f"{prefix}_{uuid.uuid4().hex[:12]}"


def fresh_path(spark: SparkSession, prefix: str) -> str:
    """A new folder's path in the shared folder; scope() deletes it."""
    path = f"{shared_dir(spark)}/{fresh_name(prefix)}"
    _made.append(("folder", path))
    return path


def named(kind: str, name: str) -> str:
    """name, noted as a TABLE, VIEW or SCHEMA that scope() drops."""
    _made.append((kind, name))
    return name


@contextlib.contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """Whatever rewrites make inside is dropped at the end: views, tables, schemas and
    folders. What still reads them must be collected or written by then."""
    first = len(_made)
    try:
        yield
    finally:
        for kind, name in reversed(_made[first:]):
            if kind == "folder":
                path = spark._jvm.org.apache.hadoop.fs.Path(name)
                path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
            elif kind == "GLOBAL VIEW":
                spark.catalog.dropGlobalTempView(name)
            elif kind == "TEMPORARY FUNCTION":
                spark.sql(f"DROP TEMPORARY FUNCTION IF EXISTS {name}")
            else:
                spark.sql(f"DROP {kind} IF EXISTS {name}{' CASCADE' if kind == 'SCHEMA' else ''}")
        del _made[first:]


def checkpointed(df: DataFrame) -> DataFrame:
    """Rows kept in the shared folder; lost executors lose nothing."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame, format: str = "parquet", partition_by: tuple[str, ...] = (), **options) -> DataFrame:
    """Rows written to a new folder and read back with the schema they had."""
    spark, path = df.sparkSession, fresh_path(df.sparkSession, "rows")
    df.write.format(format).options(**options).partitionBy(*partition_by).save(path)
    return spark.read.format(format).schema(df.schema).load(path).select(*df.columns)


def bucketed(df: DataFrame, by: str, buckets: int = 8, sort: str | None = None, **options) -> DataFrame:
    """Rows as an external table, hashed into buckets by a column and sorted in them:
    a join or aggregation on it needs no shuffle."""
    spark, name = df.sparkSession, named("TABLE", fresh_name("bucketed"))
    writer = df.write.format("parquet").options(**options).option("path", fresh_path(spark, name))
    writer.bucketBy(buckets, by).sortBy(sort or by).saveAsTable(name)
    return spark.table(name)


def saved(df: DataFrame, name: str | None = None) -> str:
    """The name of an external table of these rows."""
    spark, name = df.sparkSession, named("TABLE", name or fresh_name("saved"))
    df.write.format("parquet").option("path", fresh_path(spark, name.replace(".", "_"))).saveAsTable(name)
    return name
