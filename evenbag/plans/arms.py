"""Session arms: the same rewrite planned under other settings. Each keeps all rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from . import shape
from .barriers import fresh_path

_RULES = "org.apache.spark.sql.catalyst.optimizer."
#: Settings of a session of its own; the caller's stays as it is.
ARMS = {
    "adaptive_off": {"spark.sql.adaptive.enabled": "false"},
    "codegen_off": {"spark.sql.codegen.wholeStage": "false", "spark.sql.codegen.factoryMode": "NO_CODEGEN"},
    "broadcast_off": {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1"},
    "hash_joins": {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold": "1g"},
    "few_partitions": {"spark.sql.adaptive.enabled": "false", "spark.sql.shuffle.partitions": "3"},
    "many_partitions": {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "61"},
    "costs_on": {"spark.sql.cbo.enabled": "true", "spark.sql.cbo.joinReorder.enabled": "true", "spark.sql.cbo.planStats.enabled": "true"},
    "rules_off": {"spark.sql.adaptive.enabled": "false", "spark.sql.optimizer.excludedRules": f"{_RULES}PropagateEmptyRelation,{_RULES}CollapseProject,{_RULES}SimplifyExtractValueOps"},
    "row_reader": {"spark.sql.parquet.enableVectorizedReader": "false", "spark.sql.inMemoryColumnarStorage.enableVectorizedReader": "false"},
}


def under(arm: str, df: DataFrame, rewrite: Callable[[DataFrame], DataFrame], plan: list[str] | None = None) -> DataFrame:
    """rewrite(df), planned and run in a session with the arm's settings, and read back
    in df's own. The operators of the plan that ran are added to `plan`."""
    spark, given, made = df.sparkSession, fresh_path(df.sparkSession, "arm_in"), fresh_path(df.sparkSession, "arm_out")
    df.write.parquet(given)
    other = spark.newSession()
    for key, value in {**{k: spark.conf.get(k, None) for k in ("spark.sql.session.timeZone", "spark.sql.shuffle.partitions")}, **ARMS[arm]}.items():
        if value is not None:
            other.conf.set(key, value)
    out = rewrite(other.read.schema(df.schema).parquet(given))
    if plan is not None:
        plan.extend(shape.ran(out))
    out.write.parquet(made)
    return spark.read.schema(out.schema).parquet(made)
