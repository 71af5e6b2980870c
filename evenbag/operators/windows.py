"""Window functions that give each row its own value back."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

FUNCTIONS = ("min", "max", "first_value", "last_value")
FRAMES = ("none", "rows", "range")


def window_rewrite(df: DataFrame, function: str = "max", frame: str = "rows") -> DataFrame:
    """fn(c) OVER (PARTITION BY c, dealt_to ...) for each column. dealt_to is the number
    of the input partition, so that a frequent value has many window partitions, none
    larger than an input partition; rows are shuffled once, by it alone, and only
    sorted for each column. DOUBLE is left as it is: -0.0 and 0.0 share a partition.
    So is BOOLEAN under min and max."""
    fn = {"min": F.min, "max": F.max, "first_value": F.first_value, "last_value": F.last_value}[function]
    rows = df.withColumn("dealt_to", F.spark_partition_id()).repartition("dealt_to")
    out = []
    for f in df.schema:
        c = F.col(f.name)
        if isinstance(f.dataType, (T.DoubleType, T.FloatType, T.MapType, T.VariantType)) or isinstance(f.dataType, T.BooleanType) and function in ("min", "max"):
            out.append(c)
            continue
        w = Window.partitionBy("dealt_to", f.name)
        if frame != "none":
            w = w.orderBy(f.name)
            ends = Window.unboundedPreceding, Window.unboundedFollowing
            w = w.rowsBetween(*ends) if frame == "rows" else w.rangeBetween(*ends)
        out.append(fn(c).over(w).alias(f.name))
    return rows.select(*out)
