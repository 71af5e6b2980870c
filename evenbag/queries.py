"""One query per rewrite, with SQL for DuckDB.

A rewrite keeps the bag of rows, so most are held against the base they started
from; where DuckDB can say the rewrite itself, it says that."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evenbag.functions.predicates import FUNCTIONS, family, for_duckdb, predicate
from evenbag.operators import codecs, dml, expansions, joins, layouts, partitionings, projections, windows
from evenbag.plans import arms, generator, workload
from evenbag.plans.barriers import checkpointed
from evenbag.plans.compare import residual
from evenbag.sources.tables import HAZARDS_SQL, hazards, table
from evenbag.streaming import through_stream

BASE = f"SELECT * FROM ({HAZARDS_SQL}) hz"
COLUMNS = ("c_pk", "c_int", "c_big", "c_dec", "c_dbl", "c_txt", "c_flag", "c_date", "c_ts")
_PRED = "c_int > 3"
_HZ = f"WITH hz AS ({HAZARDS_SQL}) "

#: name -> (rewrite of a DataFrame, DuckDB SQL of the same rewrite or None).
REWRITES = {
    # projections and filters
    "select_star": (projections.select_star, None),
    "select_star_filtered": (lambda d: projections.select_star(d, F.expr(_PRED)), _HZ + f"SELECT * FROM hz WHERE {_PRED}"),
    "explicit_projection": (projections.explicit_projection, None),
    "exact_projection": (lambda d: projections.projection(d, F.col("c_txt"), F.col("c_pk"), F.col("c_int").alias("i")), _HZ + "SELECT c_txt, c_pk, c_int AS i FROM hz"),
    "cte": (projections.cte, _HZ + ", c AS (SELECT * FROM hz) SELECT * FROM c"),
    "materialized_cte": (projections.materialized_cte, _HZ + ", c AS MATERIALIZED (SELECT * FROM hz) SELECT * FROM c"),
    "not_materialized_cte": (projections.cte, _HZ + ", c AS NOT MATERIALIZED (SELECT * FROM hz) SELECT * FROM c"),
    "nested_materialized_cte": (projections.nested_materialized_cte, _HZ + ", a AS MATERIALIZED (SELECT * FROM hz), b AS MATERIALIZED (SELECT * FROM a) SELECT * FROM b"),
    "lateral_reproject": (projections.lateral_reproject, _HZ + "SELECT l.* FROM hz s, LATERAL (SELECT " + ", ".join(f"s.{c} AS {c}" for c in COLUMNS) + ") l"),
    "add_drop_column": (projections.add_drop_column, _HZ + "SELECT * EXCLUDE (extra) FROM (SELECT *, CAST(NULL AS INTEGER) AS extra FROM hz)"),
    "number_all": (projections.number_all, _HZ + "SELECT * FROM hz QUALIFY ROW_NUMBER() OVER (ORDER BY c_pk) >= 1"),
    "ordered_scan": (projections.ordered_scan, _HZ + "SELECT * FROM (SELECT * FROM hz ORDER BY c_pk)"),
    "distinct_as_group_by": (projections.distinct_as_group_by, None),
    "case_columns": (lambda d: projections.case_columns(d, F.expr(_PRED)), _HZ + "SELECT " + ", ".join(f"CASE WHEN {_PRED} OR NOT ({_PRED}) OR ({_PRED}) IS NULL THEN {c} ELSE NULL END AS {c}" for c in COLUMNS) + " FROM hz"),
    "determined_filter": (lambda d: projections.determined_filter(d, F.expr(_PRED), F.expr("c_flag")), _HZ + f"SELECT * FROM hz WHERE c_flag AND ({_PRED} OR NOT ({_PRED}) OR ({_PRED}) IS NULL)"),
    "recursive_cte": (projections.recursive_cte, _HZ.replace("WITH", "WITH RECURSIVE", 1) + ", r AS (SELECT * FROM hz UNION ALL SELECT * FROM r WHERE 1 = 0) SELECT * FROM r"),
    "replace_columns": (projections.replace_columns, _HZ + "SELECT * REPLACE (c_int AS c_int) FROM hz"),
    "numbered_bound": (projections.numbered_bound, _HZ + "SELECT * FROM hz QUALIFY ROW_NUMBER() OVER (ORDER BY c_pk) <= (SELECT COUNT(*) FROM hz)"),
    # joins
    "left_join_empty": (lambda d: arms.under("adaptive_off", d, joins.left_join_empty), _HZ + "SELECT hz.* FROM hz LEFT JOIN (SELECT 1 AS x FROM hz WHERE 1 = 0) e ON TRUE"),
    "anti_join_empty": (lambda d: arms.under("adaptive_off", d, joins.anti_join_empty), _HZ + "SELECT * FROM hz ANTI JOIN (SELECT 1 AS x FROM hz WHERE 1 = 0) e ON TRUE"),
    "semi_join_keys": (joins.semi_join_keys, _HZ + "SELECT * FROM hz SEMI JOIN (SELECT c_pk AS k FROM hz) e ON c_pk = k"),
    "flag_join_inner": (joins.flag_join, _HZ + "SELECT hz.* FROM hz JOIN (SELECT c_pk AS k, 1 AS f FROM hz) r ON c_pk = k WHERE f = 1"),
    "flag_join_left": (lambda d: joins.flag_join(d, "left"), _HZ + "SELECT hz.* FROM hz LEFT JOIN (SELECT c_pk AS k, 1 AS f FROM hz) r ON c_pk = k WHERE f = 1"),
    "flag_join_right": (lambda d: joins.flag_join(d, "right"), _HZ + "SELECT hz.* FROM hz RIGHT JOIN (SELECT c_pk AS k, 1 AS f FROM hz) r ON c_pk = k WHERE f = 1"),
    "flag_join_full": (lambda d: joins.flag_join(d, "full"), _HZ + "SELECT hz.* FROM hz FULL JOIN (SELECT c_pk AS k, 1 AS f FROM hz) r ON c_pk = k WHERE f = 1"),
    "flag_join_merge": (lambda d: joins.flag_join(d, hint="merge"), None),
    "flag_join_shuffle_hash": (lambda d: joins.flag_join(d, hint="shuffle_hash"), None),
    "flag_join_broadcast": (lambda d: joins.flag_join(d, hint="broadcast"), None),
    "split_join": (joins.split_join, None),
    "cross_join_filter": (joins.cross_join_filter, _HZ + "SELECT hz.* FROM hz CROSS JOIN (SELECT c_pk AS k FROM hz) r WHERE c_pk = k"),
    "positional_join": (joins.positional_join, _HZ + "SELECT * FROM (SELECT c_pk, c_int, c_big, c_dec FROM hz ORDER BY c_pk) POSITIONAL JOIN (SELECT c_dbl, c_txt, c_flag, c_date, c_ts FROM hz ORDER BY c_pk)"),
    "asof_join_empty": (lambda d: arms.under("rules_off", d, lambda x: joins.asof_join_empty(x, "c_ts", ["c_pk"])), None),
    "distinct_on": (lambda d: joins.distinct_on(d, "c_pk"), _HZ + "SELECT DISTINCT ON (c_pk) * FROM hz ORDER BY c_pk"),
    # partitionings and bag set operations
    "partition_union": (partitionings.partition_union, _HZ + "SELECT * FROM hz WHERE MOD(c_pk, 2) = 0 UNION ALL SELECT * FROM hz WHERE MOD(c_pk, 2) <> 0 OR c_pk IS NULL"),
    "partition_union_signed": (lambda d: partitionings.partition_union(d, "c_int"), _HZ + "SELECT * FROM hz WHERE MOD(c_int, 2) = 0 UNION ALL SELECT * FROM hz WHERE MOD(c_int, 2) <> 0 OR c_int IS NULL"),
    "tlp_union": (lambda d: partitionings.tlp_union(d, F.expr(_PRED)), _HZ + f"SELECT * FROM hz WHERE {_PRED} UNION ALL SELECT * FROM hz WHERE NOT ({_PRED}) UNION ALL SELECT * FROM hz WHERE ({_PRED}) IS NULL"),
    "rank_mod_union_2": (lambda d: partitionings.rank_mod_union(d, 2), None),
    "rank_mod_union_3": (partitionings.rank_mod_union, None),
    "rank_mod_union_4": (lambda d: partitionings.rank_mod_union(d, 4), None),
    "union_empty": (partitionings.union_empty, _HZ + "SELECT * FROM hz UNION ALL SELECT * FROM hz WHERE 1 = 0"),
    "except_empty": (partitionings.except_empty, _HZ + "SELECT * FROM hz EXCEPT ALL SELECT * FROM hz WHERE 1 = 0"),
    "except_written_empty": (partitionings.except_written_empty, None),
    "intersect_self": (partitionings.intersect_self, _HZ + "SELECT * FROM hz INTERSECT ALL SELECT * FROM hz"),
    "distinct_union_duplicate": (partitionings.distinct_union_duplicate, _HZ + "SELECT DISTINCT * FROM (SELECT * FROM hz UNION ALL SELECT * FROM hz)"),
    # expansions and reductions
    "tag_explode_filter": (lambda d: expansions.tag_prune_filter(expansions.tag_explode(d)), None),
    "tag_explode_delete": (lambda d: expansions.tag_prune_delete(expansions.tag_explode(d)), None),
    "tag_insert_filter": (lambda d: expansions.tag_prune_filter(expansions.tag_insert_extras(expansions.tag_explode(d))), None),
    "tag_insert_delete": (lambda d: expansions.tag_prune_delete(expansions.tag_insert_extras(expansions.tag_explode(d, 3))), None),
    "key_explode_distinct": (lambda d: expansions.key_distinct(expansions.key_explode(d)), None),
    "key_insert_distinct": (lambda d: expansions.key_distinct(expansions.key_insert_extras(expansions.key_explode(d, 1))), None),
    "key_explode_group": (lambda d: expansions.key_group(expansions.key_explode(d, 3)), None),
    "key_explode_window": (lambda d: expansions.key_window(expansions.key_explode(d)), None),
    "key_explode_first": (lambda d: expansions.key_first(expansions.key_explode(d)), None),
    # values
    "hex_codec": (codecs.hex_codec, None),
    "base64_codec": (codecs.base64_codec, None),
    "json_codec": (codecs.json_codec, None),
    "mixed_codec": (codecs.mixed_codec, None),
    "array_pack": (codecs.array_pack, _HZ + "SELECT " + ", ".join(f"[{c}][1] AS {c}" for c in COLUMNS) + " FROM hz"),
    "array_element": (codecs.array_element, None),
    "array_transform": (codecs.array_transform, _HZ + "SELECT " + ", ".join(f"list_transform([{c}], lambda x: x)[1] AS {c}" for c in COLUMNS) + " FROM hz"),
    "array_filter": (codecs.array_filter, _HZ + "SELECT " + ", ".join(f"list_filter([{c}], lambda x: 1 = 1)[1] AS {c}" for c in COLUMNS) + " FROM hz"),
    "map_pack": (codecs.map_pack, _HZ + "SELECT " + ", ".join(f"map(['k'], [{c}])['k'] AS {c}" for c in COLUMNS) + " FROM hz"),
    "tuple_element": (codecs.tuple_element, None),
    "coalesce_self": (codecs.coalesce_self, _HZ + "SELECT " + ", ".join(f"coalesce({c}, {c}) AS {c}" for c in COLUMNS) + " FROM hz"),
    "struct_pack": (codecs.struct_pack, _HZ + "SELECT UNNEST(s) FROM (SELECT struct_pack(" + ", ".join(f"{c} := {c}" for c in COLUMNS) + ") AS s FROM hz)"),
    "object_column": (codecs.object_column, None),
    "row_json": (codecs.row_json, None),
    "row_json_written": (lambda d: codecs.row_json(d, True), None),
    "pivot_struct": (lambda d: codecs.pivot_struct(d, "c_pk"), None),
    "dictionary": (codecs.dictionary, None),
    "domain_cast": (codecs.domain_cast, _HZ + "SELECT * REPLACE (CAST(CAST(c_int AS DECIMAL(38,0)) AS BIGINT) AS c_int) FROM hz"),
    "generated_column_stored": (codecs.generated_column, None),
    "generated_column_virtual": (lambda d: codecs.generated_column(d, False), None),
    "written_extra_column": (codecs.written_extra_column, None),
    "typed_insert": (codecs.typed_insert, None),
    # data manipulation
    "delete_reinsert": (lambda d: dml.delete_reinsert(d, F.expr(_PRED)), None),
    "delete_reinsert_parity": (dml.delete_reinsert, None),
    "delete_where": (lambda d: dml.delete_where(d, F.expr(_PRED)), _HZ + f"SELECT * FROM hz WHERE ({_PRED}) IS NOT TRUE"),
    "noop_update": (lambda d: dml.noop_update(d, F.expr(_PRED)), None),
    "merge_upsert": (lambda d: dml.merge_upsert(d, "c_pk"), None),
    # layouts
    "view": (layouts.view, None),
    "global_view": (layouts.global_view, None),
    "table": (layouts.table, None),
    "temporary_table": (layouts.temporary_table, None),
    "materialized_view": (layouts.materialized_view, None),
    "barrier_view": (layouts.barrier_view, None),
    "table_function": (layouts.table_function, None),
    "sorted_buckets": (layouts.sorted_buckets, None),
    "hash_buckets": (layouts.hash_buckets, None),
    "unseen_buckets": (layouts.unseen_buckets, None),
    "unique_buckets": (lambda d: layouts.unique_buckets(d, "c_pk"), None),
    "derived_buckets": (lambda d: layouts.derived_buckets(d, "lower(c_txt)"), None),
    "prefix_buckets": (lambda d: layouts.prefix_buckets(d, "c_txt"), None),
    "null_partitions": (lambda d: layouts.null_partitions(d, "c_txt"), None),
    "truth_partitions": (lambda d: layouts.truth_partitions(d, "c_flag"), None),
    "mod_partitions": (layouts.mod_partitions, None),
    "range_partitions": (lambda d: layouts.range_partitions(d, 5_000), None),
    "range_sorted": (layouts.range_sorted, None),
    "sorted_descending": (layouts.sorted_descending, None),
    "covering": (lambda d: layouts.covering(d, "c_pk", ["c_int", "c_txt"]), None),
    "partial_covering": (lambda d: layouts.partial_covering(d, "c_pk", ["c_int", "c_txt"], F.expr("c_flag")), None),
    "constant_partitions": (layouts.constant_partitions, None),
    "bloom_filter": (lambda d: layouts.bloom_filter(d, ["c_int", "c_txt"]), None),
    "dictionary_files": (layouts.dictionary_files, None),
    "fine_files": (layouts.fine_files, None),
    "zstd_files": (layouts.zstd_files, None),
    "delta_files": (layouts.delta_files, None),
    "orc_files": (layouts.orc_files, None),
    "row_files": (layouts.row_files, None),
    "four_shards": (layouts.four_shards, None),
    "four_shards_by": (lambda d: layouts.four_shards(d, "c_int"), None),
    "cached": (layouts.cached, None),
    "analyzed": (layouts.analyzed, None),
    "other_schema": (layouts.other_schema, None),
    "mirrored_back": (layouts.mirrored_back, None),
    "inherited": (layouts.inherited, None),
    "second_copy": (layouts.second_copy, None),
    "checkpoint": (layouts.checkpoint, None),
    "through_stream": (through_stream, None),
}
for _fn in windows.FUNCTIONS:
    for _frame in windows.FRAMES:
        REWRITES[f"window_{_fn}_{_frame}"] = (lambda d, fn=_fn, frame=_frame: windows.window_rewrite(d, fn, frame), None)
for _arm in arms.ARMS:
    REWRITES[f"arm_{_arm}"] = (lambda d, arm=_arm: arms.under(arm, d, lambda x: joins.flag_join(joins.split_join(x), "full")), None)

#: Rewrites of which Spark's final plan keeps nothing: what they say in SQL is the whole
#: of them. All others leave an operator, or rows that were written.
FOLDS = {
    "select_star", "explicit_projection", "exact_projection", "cte", "not_materialized_cte", "lateral_reproject", "replace_columns",
    "view", "global_view", "table_function", "generated_column_virtual",
}


def _rewritten(rewrite):
    return lambda spark, sf_dir: rewrite(hazards(spark, sf_dir))


def flagship(orders: DataFrame) -> DataFrame:
    split = partitionings.partition_union(checkpointed(orders), "o_custkey")
    n = F.count("*").cast("long")
    return split.groupBy("o_orderpriority").agg(n.alias("n"), F.min("o_orderkey").alias("lo"), F.max("o_orderkey").alias("hi"))


def parity_flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flagship(table(spark, sf_dir, "orders"))


FLAGSHIP_SQL = "SELECT o_orderpriority, CAST(COUNT(*) AS BIGINT) AS n, MIN(o_orderkey) AS lo, MAX(o_orderkey) AS hi FROM orders GROUP BY 1"


def asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event with the value of the user's latest purchase up to then."""
    events = table(spark, sf_dir, "events")
    bought = events.filter("event_type = 'purchase'").select("user_id", F.col("ts").alias("at"), F.col("value").alias("paid"))
    return joins.asof_join(events.select("event_id", "ts", "user_id"), bought, "ts", "at", ["user_id"], ["paid"]).select("event_id", "user_id", F.col("asof_paid").alias("paid"))


ASOF_SQL = """SELECT e.event_id, e.user_id, b.value AS paid FROM events e ASOF LEFT JOIN (SELECT user_id, ts, value FROM events WHERE event_type = 'purchase') b
ON e.user_id = b.user_id AND e.ts >= b.ts"""


def bag_residual(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a split that forgets NULL keys loses, as the comparison sees it."""
    d = checkpointed(hazards(spark, sf_dir))
    lossy = d.filter("c_int % 2 = 0").unionByName(d.filter("c_int % 2 <> 0"))
    return residual(d, lossy).withColumn("surplus", F.col("surplus").cast("long"))


RESIDUAL_SQL = _HZ + "SELECT *, CAST(COUNT(*) AS BIGINT) AS surplus FROM hz WHERE c_int IS NULL GROUP BY ALL"

#: Shapes of queries beside those that plans.workload draws, over the same table.
SHAPES = {
    "in_subquery": "SELECT c_pk, c_int FROM hz WHERE c_int IN (SELECT CAST(c_big % 50 AS BIGINT) FROM hz WHERE c_flag)",
    "not_exists": "SELECT a.c_pk AS c_pk FROM hz a WHERE NOT EXISTS (SELECT 1 FROM hz b WHERE b.c_pk = a.c_pk + 1 AND b.c_flag)",
    "scalar_subquery": "SELECT c_pk, (SELECT MAX(c_dec) FROM hz) - c_dec AS below FROM hz WHERE c_int = (SELECT MIN(c_int) FROM hz)",
    "any_of": "SELECT c_txt, CAST(COUNT(*) AS BIGINT) AS n FROM hz GROUP BY c_txt HAVING bool_or(c_flag) AND NOT bool_and(c_flag)",
    "ranks": "SELECT c_pk, CAST(RANK() OVER (PARTITION BY c_int ORDER BY c_pk) AS BIGINT) AS r, CAST(DENSE_RANK() OVER (PARTITION BY c_int ORDER BY c_txt NULLS FIRST) AS BIGINT) AS d, CAST(NTILE(3) OVER (PARTITION BY c_int ORDER BY c_pk) AS BIGINT) AS t FROM hz WHERE c_int IS NOT NULL",
    "neighbours": "SELECT c_pk, LAG(c_dec) OVER (PARTITION BY c_int ORDER BY c_pk) AS before, LEAD(c_txt, 2) OVER (PARTITION BY c_int ORDER BY c_pk) AS after FROM hz WHERE c_int IS NOT NULL",
    "top_rows": "SELECT c_pk, c_dec FROM hz WHERE c_dec IS NOT NULL ORDER BY c_dec DESC, c_pk LIMIT 50 OFFSET 10",
    "bits": "SELECT c_flag, bit_and(c_pk) AS a, bit_or(c_pk) AS o, bit_xor(c_pk) AS x FROM hz GROUP BY c_flag",
    "spread": "SELECT c_txt, CAST(ROUND(stddev_pop(c_int), 6) AS DOUBLE) AS s, CAST(ROUND(var_samp(c_int), 6) AS DOUBLE) AS v, CAST(median(c_int) AS DOUBLE) AS m FROM hz GROUP BY c_txt",
    "grouping_sets": "SELECT c_txt, c_flag, CAST(COUNT(*) AS BIGINT) AS n, CAST(SUM(c_big) AS DECIMAL(38,0)) AS s FROM hz GROUP BY GROUPING SETS ((c_txt, c_flag), (c_txt), ())",
    "counted_if": "SELECT CAST(COUNT(DISTINCT c_int) AS BIGINT) AS d, CAST(COUNT(*) FILTER (WHERE c_flag) AS BIGINT) AS f FROM hz",
    "union_of_sets": "SELECT c_int FROM hz WHERE c_flag UNION SELECT c_int FROM hz WHERE NOT c_flag EXCEPT SELECT c_pk FROM hz",
}

#: Seeds whose random predicates and queries are registered.
PREDICATE_SEEDS, WORKLOAD_SEEDS, DERIVED_SEEDS = range(12), range(12), range(6)


def _schema():
    kinds = (T.LongType(), T.LongType(), T.DecimalType(38, 0), T.DecimalType(10, 2), T.DoubleType(), T.StringType(), T.BooleanType(), T.DateType(), T.TimestampNTZType())
    return T.StructType([T.StructField(c, t) for c, t in zip(COLUMNS, kinds)])


def _scalars(kind: str) -> str:
    """Every function of a family, on columns of that family."""
    columns = [f.name for f in _schema() if family(f.dataType) == kind]
    calls = (text.format(a=columns[0], b=columns[-1]) for text, _ in FUNCTIONS[kind])
    return f"SELECT c_pk, {', '.join(f'{c} AS f{k}' for k, c in enumerate(calls))} FROM hz"


def _workload(text: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return spark.sql(text.replace(" hz", " {hz}"), hz=hazards(spark, sf_dir))

    return run


def registered() -> tuple[dict, dict]:
    queries = {name: _rewritten(rewrite) for name, (rewrite, _) in REWRITES.items()}
    oracle = {name: sql or BASE for name, (_, sql) in REWRITES.items()}
    queries |= {"parity_flagship": parity_flagship, "asof_join": asof, "bag_residual": bag_residual}
    oracle |= {"parity_flagship": FLAGSHIP_SQL, "asof_join": ASOF_SQL, "bag_residual": RESIDUAL_SQL}
    schema = _schema()
    texts = {f"predicate_{k}": f"SELECT * FROM hz WHERE {predicate(schema, k)}" for k in PREDICATE_SEEDS}
    texts |= {f"workload_{k}": workload.query(["hz"], schema, k) for k in WORKLOAD_SEEDS}
    texts |= {f"shape_{name}": text for name, text in SHAPES.items()}
    texts |= {f"scalars_{kind}": _scalars(kind) for kind in FUNCTIONS}
    texts |= {f"fork_join_{k}" if k else "fork_join": workload.query(["hz", "hz"], schema, k, "joined") for k in range(3)}
    for k in range(2):
        for part, text in zip(("whole", "split"), workload.tlp_pair("hz", schema, k)):
            texts[f"tlp_{part}_{k}"] = text
        for part, text in zip(("filter", "sum"), workload.norec_pair("hz", schema, k)):
            texts[f"norec_{part}_{k}"] = text
    for name, text in texts.items():
        queries[name], oracle[name] = _workload(text), _HZ + for_duckdb(text)
    for k in DERIVED_SEEDS:
        queries[f"derived_{k}"] = lambda spark, sf_dir, k=k: generator.derive(hazards(spark, sf_dir), k).df
        oracle[f"derived_{k}"] = BASE
    for k in range(3):
        queries[f"derived_filtered_{k}"] = lambda spark, sf_dir, k=k: generator.derive(hazards(spark, sf_dir), 100 + k, wanted=_wanted()).df
        oracle[f"derived_filtered_{k}"] = _HZ + f"SELECT c_txt, c_pk, c_dbl FROM hz WHERE {_PRED} AND c_flag"
        queries[f"derived_forks_{k}"] = lambda spark, sf_dir, k=k: _forked(spark, sf_dir, k)
        oracle[f"derived_forks_{k}"] = oracle[f"fork_join_{k}" if k else "fork_join"]
    return queries, oracle


def _wanted() -> generator.Wanted:
    return generator.Wanted(where=F.expr(_PRED), columns=("c_txt", "c_pk", "c_dbl")).merged(generator.Wanted(where=F.expr("c_flag"), stored=True))


def _forked(spark: SparkSession, sf_dir: str, seed: int) -> DataFrame:
    """A join of two forks, each derived for itself."""
    made = generator.forks(hazards(spark, sf_dir), 200 + 10 * seed, ["t0", "t1"], 3)
    text = workload.query(["{t0}", "{t1}"], _schema(), seed, "joined")
    return spark.sql(text, **{n: d.df for n, d in made.items()})
