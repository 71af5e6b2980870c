"""A bag read as a stream and written again: one more way the rows must survive."""

from __future__ import annotations

from pyspark.sql import DataFrame

from evenbag.plans.barriers import fresh_path


def through_stream(df: DataFrame, files_per_trigger: int = 2) -> DataFrame:
    """df written, streamed file by file to a second folder with exactly-once file
    sinks, and read back when all that was there has gone through."""
    spark = df.sparkSession
    root = fresh_path(spark, "stream")
    df.write.parquet(f"{root}/in")
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", files_per_trigger).parquet(f"{root}/in")
    query = stream.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/log").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{root}/out")
