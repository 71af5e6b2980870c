"""Rewrites against their base and DuckDB, and the checks that they are checks."""

import random
import re
from collections import Counter
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evenbag import queries as registry
from evenbag.functions.predicates import for_duckdb, predicate
from evenbag.operators import base, codecs, dml, expansions, joins, layouts, partitionings, projections, windows
from evenbag.plans import arms, compare, generator, harness, shape, workload
from evenbag.plans.barriers import checkpointed, scope, shared_dir
from evenbag.sources import tables

SF = "/root/testdata/sf0.001"
QUERIES, ORACLE = registry.registered()


@pytest.fixture(scope="module")
def hz(spark):
    return checkpointed(tables.hazards(spark, SF))


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in tables.NAMES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def bag(rows, columns):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return Counter(tuple(r[k] for k in order) for r in rows)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_its_sql(spark, duck, name):
    df, sql = QUERIES[name](spark, SF), duck.sql(ORACLE[name])
    assert sorted(df.columns) == sorted(sql.columns)
    assert bag([tuple(r) for r in df.collect()], df.columns) == bag(sql.fetchall(), sql.columns)


@pytest.mark.parametrize("name", sorted(registry.REWRITES))
def test_rewrites_keep_awkward_rows_and_types(spark, name):
    rewrite, sql = registry.REWRITES[name]
    columns = [f"{c}" for c in registry.COLUMNS]
    rows = tables.seed_rows(spark, registry._schema(), 9, seed=len(name))
    made = rewrite(rows)
    if sql is None or name not in ("select_star_filtered", "determined_filter", "exact_projection", "delete_where"):
        assert compare.compare(rows.select(*columns), made).equal


@pytest.mark.parametrize("name", ["partition_union", "case_columns", "split_join", "except_empty", "key_explode_group", "hex_codec", "table", "merge_upsert"])
def test_rewrites_of_an_empty_table(spark, name):
    rows = tables.seed_rows(spark, registry._schema(), 3).filter("1 = 0")
    made = registry.REWRITES[name][0](rows)
    assert made.count() == 0 and not compare.same_types(rows, made)


def test_mutants_are_caught(hz):
    odd = hz.filter("c_int % 2 = 0").unionByName(hz.filter("c_int % 2 = 1 OR c_int IS NULL"))
    no_null = hz.filter("c_int > 3").unionByName(hz.filter("NOT c_int > 3"))
    doubled = hz.unionByName(hz.limit(1))
    not_p = dml.delete_where(hz, F.expr("c_int > 3")).filter("NOT c_int > 3")
    for mutant in (odd, no_null, doubled, not_p.unionByName(hz.filter("c_int > 3"))):
        assert not compare.compare(hz, mutant).equal


def test_comparison_tolerates_and_counts_noise_only(spark):
    a = spark.createDataFrame([(1, 1.0), (2, float("nan")), (3, -0.0)], "k long, d double")
    b = spark.createDataFrame([(1, 1.00001), (2, float("nan")), (3, 0.0)], "k long, d double")
    found = compare.compare(a, b)
    assert found.equal and found.reconciled == 1
    assert not compare.compare(a, b.withColumn("d", F.col("d") + 1)).equal
    assert compare.compare(a, a.withColumn("k", F.col("k").cast("int"))).types


def test_asof_join_against_brute_force(spark):
    rng = random.Random(3)
    left = [(k, rng.randint(0, 20) if rng.random() > 0.1 else None, rng.choice("ab")) for k in range(60)]
    right = [(t, g, f"{g}{t}") for g in "ab" for t in rng.sample(range(20), 8)] + [(None, "a", "x")]
    a = spark.createDataFrame(left, "id long, t long, g string")
    b = spark.createDataFrame(right, "at long, g string, v string")
    got = {r["id"]: r["asof_v"] for r in joins.asof_join(a, b, "t", "at", ["g"], ["v"]).collect()}
    for k, t, g in left:
        best = max(((u, v) for u, h, v in right if h == g and u is not None and t is not None and u <= t), default=(None, None))
        assert got[k] == best[1]


def test_generator_repeats_itself_and_keeps_rows(spark, hz):
    small = checkpointed(hz.filter("c_pk < 300"))
    drawn = set()
    for seed in range(14):
        one = generator.derive(small, seed, 4)
        assert compare.compare(small, one.df).equal, one.steps
        drawn |= set(one.steps)
        if seed < 3:
            assert one.steps == generator.derive(small, seed, 4).steps
    assert len(drawn) > 20
    assert all(compare.compare(small, d.df).equal for d in generator.forks(small, 1, ["t0", "t1"], 2).values())


@pytest.mark.parametrize("name", sorted(generator.REWRITES))
def test_every_rewrite_of_the_generator(spark, name):
    """Each as the root, if it can be, over rows with nulls and repeats; else below a
    node that asks for it."""
    rows = checkpointed(tables.seed_rows(spark, registry._schema(), 9, seed=2))
    must = generator.REWRITES[name].must
    channel = next(iter(must & {"tag", "key"}), None)
    wanted = generator.Wanted(where=F.expr("c_int IS NULL OR c_int > 0") if "where" in must else None, columns=("c_txt", "c_pk") if "columns" in must else None, stored="stored" in must, channel=channel)
    made = generator.derive(rows, 5, 2, {n: 1000 if n == name else 0.01 for n in generator.REWRITES}, wanted=wanted)
    assert name in made.steps
    want, got = rows, made.df
    if "where" in must:
        want = rows.filter("c_int IS NULL OR c_int > 0")
    if "columns" in must:
        want = rows.select("c_txt", "c_pk")
    if channel == "tag":
        got = got.filter("tag = 1").drop("tag")
    if channel == "key":
        got = got.distinct().drop(base.KEY)
    assert compare.compare(want, got).equal, made.steps


def test_what_is_asked_of_a_tree(spark, hz):
    small = checkpointed(hz.filter("c_pk < 200"))
    wanted = generator.Wanted(where=F.expr("c_int > 3")).merged(generator.Wanted(where=F.expr("c_flag"), columns=("c_txt", "c_pk")))
    want = small.filter("c_int > 3 AND c_flag").select("c_txt", "c_pk")
    for seed in range(5):
        got = generator.derive(small, seed, 3, wanted=wanted, name="derived_here")
        assert compare.compare(want, got.df).equal, got.steps
        assert spark.table("derived_here").columns == ["c_txt", "c_pk"]
    with pytest.raises(ValueError):
        wanted.merged(generator.Wanted(columns=("c_pk",)))
    # None can give it: the plain leaf does.
    none = generator.derive(small, 1, 3, dict.fromkeys(generator.REWRITES, 0))
    assert none.steps == [] and compare.compare(small, none.df).equal
    # One that declines leaves no step, and the next is taken.
    only = {n: {"halves": 1e6, "cte": 1}.get(n, 0) for n in generator.REWRITES}
    assert generator.derive(small.select("c_pk"), 1, 1, only).steps == ["cte"]
    maps = spark.createDataFrame([(1, {"a": 1}), (2, None)], "c_pk long, m map<string,int>")
    for seed in range(4):
        got = generator.derive(maps, seed, 3, {"intersect_self": 0, "except_empty": 0, "distinct_as_group_by": 0, "distinct_union_duplicate": 0, "store": 0, "store_only": 0})
        assert compare.compare(maps, got.df).equal, got.steps


def test_rounds_journal_and_sweep(spark, hz, tmp_path):
    small = hz.filter("c_pk < 60")
    journal, plans = harness.Journal(tmp_path / "journal.sql"), shape.PlanLog(tmp_path / "plans.csv")
    report = harness.Report()
    for done in (harness.run_round(small, 5, 2, 3, journal=journal, plans=plans), harness.run_round(small, 6, 2, 3, copies=2, journal=journal)):
        assert done.equal and len(done.verdicts) == 3 and not done.findings
        report.add(done)
    journal.add("SELECT cut off")
    read = harness.read_journal((tmp_path / "journal.sql").read_text())
    assert [v for _, v in read] == ["pass"] * 6 and all("{t" in q for q, _ in read)
    assert report.queries == 6 and report.verdicts == {"pass": 6} and len(report.lines()) == 4
    assert len(plans.known) == len(shape.PlanLog(tmp_path / "plans.csv").known) > 0 and not plans.see(next(iter(plans.known)), 1, "q")
    assert harness.judge(small, small.filter("c_pk > 3"), "SELECT COUNT(*) AS n FROM {table}").verdict == "mismatch"
    assert harness.judge(small, small.drop("c_txt"), "SELECT c_txt FROM {t}").verdict == "error"
    assert harness.judge(small, small.drop("c_txt"), "SELECT c_txt FROM {t}", known=["UNRESOLVED_COLUMN"]).verdict == "known issue"
    assert harness.judge(small, small, "SELECT nothing FROM {t}").verdict == "uncomparable"
    # The base fails only when it runs: that says nothing of the other side.
    assert harness.judge(small, small.withColumn("c_txt", F.lit("1")), "SELECT CAST(c_txt AS INT) AS i FROM {t}").verdict == "uncomparable"
    assert harness.judge(small.withColumn("c_txt", F.lit("1")), small, "SELECT CAST(c_txt AS INT) AS i FROM {t}").verdict == "error"
    assert harness.accepted(spark, "SELECT c_pk FROM {t}", t=small) and not harness.accepted(spark, "SELECT zz FROM {t}", t=small)
    assert not harness.run_round(small, 5, 2, 1000, seconds=0).verdicts
    assert all(harness.sweep(small, lambda d, s: partitionings.rank_mod_union(d, 2 + s), range(2)).values())


def test_corpus_of_queries(spark, hz):
    text = "SELECT ';' AS a FROM {t};\n-- a remark; with a mark\nSELECT c_pk FROM {t}\n;;  ; SELECT COUNT(*) AS n FROM {t}"
    found = harness.corpus(text)
    assert len(found) == 3 and found[0] == "SELECT ';' AS a FROM {t}"
    assert sorted(harness.corpus(text, 3)) == sorted(found) and harness.corpus(text, 3) == harness.corpus(text, 3)
    done = harness.run_round(hz.filter("c_pk < 40"), 1, 1, found)
    assert [v.verdict for v in done.verdicts] == ["pass"] * 3


def test_findings_can_be_run_again(spark, tmp_path):
    """A rewrite that forgets NULLs is found, and the script it leaves finds it again."""
    rows = tables.seed_rows(spark, registry._schema(), 9)
    lossy = lambda df, seed, depth: generator.Derived(df.withColumn("c_int", F.coalesce("c_int", F.lit(7))), ["lossy"])
    done = harness.run_round(rows, 3, 2, ["SELECT c_int FROM {t}"], derived=lossy)
    assert not done.equal and not done.verdicts
    v = harness.judge(rows, lossy(rows, 0, 0).df, "SELECT c_int FROM {t}")
    done.verdicts, done.steps = [v], {"t": ["lossy"]}
    path, = harness.write_findings(tmp_path, rows, done)
    assert "mismatch" in (tmp_path / "index.txt").read_text() and "# only base" in path.read_text()
    # Run as it stands, it derives what the seed says: that keeps the rows.
    told = {}
    text = path.read_text().replace("print(found.verdict, found.error, found.difference)", "told['v'] = found.verdict")
    exec(compile(text, str(path), "exec"), {"told": told})  # noqa: S102
    assert told["v"] == "pass"
    with pytest.raises(ValueError):
        harness.repro(spark.range(500), done, v)


def test_comparison_of_nested_values_and_much_noise(spark, monkeypatch):
    a = spark.createDataFrame([(1, {"x": 1, "y": 2}, [1, None], (1, {"k": [1.0]})), (2, None, None, None)], "k long, m map<string,int>, a array<int>, s struct<i:int,m:map<string,array<double>>>")
    b = spark.createDataFrame([(2, None, None, None), (1, {"y": 2, "x": 1}, [1, None], (1, {"k": [1.0]}))], a.schema)
    assert compare.compare(a, b).equal and not compare.compare(a, a.filter("k = 1").union(a.filter("k = 1"))).equal
    c = spark.createDataFrame([("1.5", True), ("x", False)], "t string, f boolean")
    assert compare.compare(c, c.withColumn("t", F.when(F.col("t") == "x", "x").otherwise("1.50001"))).equal
    assert not compare.compare(c, c.withColumn("f", ~F.col("f"))).equal
    monkeypatch.setattr(compare, "MAX_RESIDUAL", 100)
    many = spark.range(4000).select(F.col("id"), (F.col("id") * 1.7 - 900).alias("d"), F.when(F.col("id") % 5 > 0, F.col("id") % 7).alias("g"))
    noisy = many.withColumn("d", F.col("d") * (1 + (F.col("id") % 3 - 1) * 1e-6))
    found = compare.compare(many, noisy)
    assert found.equal and found.reconciled > 2000
    lost = compare.compare(many, noisy.filter("id <> 17"))
    assert [r[0] for r in lost.only_in_base] == [17] and not lost.only_in_other
    far = compare.compare(many, noisy.withColumn("d", F.when(F.col("id") == 5, 3.0).otherwise(F.col("d"))))
    assert len(far.only_in_base) == len(far.only_in_other) == 1


@pytest.mark.parametrize("name", sorted(registry.REWRITES))
def test_no_rewrite_folds_unless_listed(spark, name):
    """Its final plan has an operator more than the base's, or it has written rows."""
    rows = spark.read.parquet(f"{SF}/orders.parquet").select(F.col("o_orderkey").alias("c_pk"), F.col("o_custkey").alias("c_int"), F.col("o_orderkey").cast("decimal(38,0)").alias("c_big"), F.lit("1.5").cast("decimal(10,2)").alias("c_dec"), F.col("o_totalprice").cast("double").alias("c_dbl"), F.col("o_orderpriority").alias("c_txt"), (F.col("o_custkey") % 2 == 0).alias("c_flag"), F.col("o_orderdate").cast("date").alias("c_date"), F.col("o_orderdate").cast("timestamp_ntz").alias("c_ts"))
    context = spark.sparkContext
    context.setJobGroup(f"fold {name}", name)
    made = registry.REWRITES[name][0](rows)
    wrote = len(context.statusTracker().getJobIdsForGroup(f"fold {name}"))
    context.setJobGroup("", "")
    plain = {"Project", "FileScan", "Scan", "ColumnarToRow", "Filter", "WholeStageCodegen", "InputAdapter", "AdaptiveSparkPlan"}
    extra = [x for x in shape.ran(made) if x not in plain]
    kept = bool(extra or wrote or "CASE" in made._jdf.queryExecution().executedPlan().toString())
    folded = shape.ran(made) == shape.ran(rows) and not wrote and made._jdf.queryExecution().optimizedPlan().sameResult(rows._jdf.queryExecution().optimizedPlan())
    if name in registry.FOLDS:
        assert not wrote
    else:
        assert kept or not folded, (name, shape.ran(made))


def test_arms_keep_the_join_and_the_callers_session(spark, hz):
    small = hz.filter("c_pk < 100")
    before = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions")}
    wanted = {joins.left_join_empty: "BroadcastNestedLoopJoin", joins.anti_join_empty: "BroadcastNestedLoopJoin"}
    for rewrite, operator in wanted.items():
        plan = []
        assert compare.compare(small, arms.under("adaptive_off", small, rewrite, plan)).equal
        assert operator in plan, plan
    plan = []
    made = arms.under("rules_off", small, lambda d: joins.asof_join_empty(d, "c_ts", ["c_pk"]), plan)
    assert compare.compare(small, made).equal and {"Window", "Union"} <= set(plan)
    kinds = {"broadcast_off": "SortMergeJoin", "hash_joins": "ShuffledHashJoin", "codegen_off": "Join", "few_partitions": "Join"}
    for arm, kind in kinds.items():
        plan = []
        arms.under(arm, small, joins.split_join, plan)
        assert any(kind in x for x in plan), (arm, plan)
    assert {k: spark.conf.get(k) for k in before} == before


def test_scope_drops_what_was_made(spark, hz):
    names = lambda: {t.name for t in spark.catalog.listTables()}
    before, folders = names(), set(Path(shared_dir(spark).removeprefix("file://")).glob("*_*"))
    with scope(spark):
        for name in ("table", "sorted_buckets", "typed_insert", "view", "global_view", "table_function", "other_schema", "mirrored_back", "unseen_buckets"):
            registry.REWRITES[name][0](hz.filter("c_pk < 20")).count()
        assert len(names()) > len(before)
    assert names() == before and set(Path(shared_dir(spark).removeprefix("file://")).glob("*_*")) == folders


def test_a_cluster_needs_a_shared_folder(spark):
    class Context:
        master = "spark://far:7077"

        def getConf(self):
            return {}

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

    with pytest.raises(ValueError):
        shared_dir(Session())


def test_a_cached_copy_leaves_other_plans_alone(spark):
    rows = spark.read.parquet(f"{SF}/orders.parquet")
    kept = layouts.cached(rows)
    assert kept.count() == rows.count()
    assert "InMemoryTableScan" not in shape.ran(rows.filter("o_orderkey > 3")) and "InMemoryTableScan" in shape.ran(kept)
    layouts.release(kept)
    assert not kept.is_cached


def test_positions_and_numbers(spark):
    rows = spark.range(1000).repartition(7).select((F.col("id") * 37 % 1000).alias("a"), F.col("id").alias("b"), F.col("id").cast("string").alias("c"))
    rows = checkpointed(rows)
    made = joins.positional_join(rows)
    assert compare.compare(rows, made).equal and base.KEY not in made.columns
    got = base.ranked(rows, "n", F.col("a")).collect()
    assert [r["a"] for r in sorted(got, key=lambda r: r["n"])] == list(range(1000)) and {r["n"] for r in got} == set(range(1000))
    # One value in a third of all rows has more than one window partition.
    hot = rows.withColumn("a", F.when(F.col("b") % 3 == 0, F.lit(1)).otherwise(F.col("a")))
    assert compare.compare(hot, windows.window_rewrite(hot)).equal
    assert shape.operators(windows.window_rewrite(hot)).count("Exchange") == 1


def test_predicates_of_any_type(spark):
    schema = T.StructType([T.StructField("k", T.LongType()), T.StructField("m", T.MapType(T.StringType(), T.LongType())), T.StructField("a", T.ArrayType(T.LongType()))])
    rows = spark.createDataFrame([(1, {"x": 1}, [1]), (None, None, None)], schema)
    texts = {predicate(schema, seed) for seed in range(60)}
    assert any("m IS" in t for t in texts) and not any(re.search("[am] [<>=]", t) for t in texts)
    for t in texts:
        rows.filter(t).collect()


def test_predicates_run_on_both_engines(spark, duck, hz):
    hz.createOrReplaceTempView("hz_all")
    duck.sql(f"CREATE OR REPLACE TABLE hz_all AS {tables.HAZARDS_SQL}")
    for seed in range(40):
        text = f"SELECT COUNT(*) FROM hz_all WHERE {predicate(hz.schema, seed)}"
        assert spark.sql(text).first()[0] == duck.sql(for_duckdb(text)).fetchall()[0][0], text
    for seed in range(8):
        whole, split = workload.tlp_pair("hz_all", hz.schema, seed)
        assert compare.compare(spark.sql(whole), spark.sql(split)).equal
        a, b = workload.norec_pair("hz_all", hz.schema, seed)
        assert spark.sql(a).first() == spark.sql(b).first()


def test_plans_survive_where_they_should(spark, hz):
    assert "SortMergeJoin" in shape.ran(joins.flag_join(hz, "inner", "merge"))
    assert "BroadcastHashJoin" in shape.ran(joins.flag_join(hz, "inner", "broadcast"))
    # What adaptive execution made of a plan counts, not what it began with.
    late = hz.join(hz.filter("c_pk = 1").select(F.col("c_pk").alias("k")).distinct(), F.col("c_pk") == F.col("k"))
    assert shape.operators(late) and shape.ran(late) == shape.operators(late)
    scan = spark.read.parquet(f"{SF}/orders.parquet").select("o_orderkey", "o_orderpriority").filter("o_orderkey > 10")
    text = scan._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(o_orderkey), GreaterThan(o_orderkey,10)]" in text and "o_totalprice" not in text
    assert shape.fingerprint(hz.filter("c_int > 1")) == shape.fingerprint(hz.filter("c_int > 2"))


def test_guards(spark):
    assert base.parity_key(registry._schema()) == "c_pk"
    with pytest.raises(ValueError):
        layouts.unique_buckets(spark.createDataFrame([(1,), (1,)], "k long"), "k")
    twice = spark.createDataFrame([(1, 2), (1, 3), (None, 4)], "k long, v long")
    for make in (lambda: dml.merge_upsert(twice, "k"), lambda: layouts.covering(twice, "k", ["v"]), lambda: codecs.pivot_struct(twice, "k")):
        with pytest.raises(ValueError):
            make()
    assert dml.merge_upsert(twice.filter("v > 2"), "k").count() == 2
    with pytest.raises(ValueError):
        expansions.key_distinct(spark.createDataFrame([(1, {"a": 1})], f"{base.KEY} long, m map<string,int>"))
    one = spark.createDataFrame([(1,)], "k long")
    assert joins.split_join(one).count() == 1
    assert codecs.hex_codec(spark.createDataFrame([("é\x00",)], "s string")).first()[0] == "é\x00"
    assert projections.recursive_cte(one).collect() == one.collect()
    schema = tables.sample_schema(4)
    assert schema == tables.sample_schema(4) and tables.seed_rows(spark, schema).count() == 8


def test_too_many_keys_for_a_broadcast_are_joined_without_it(spark, hz, monkeypatch):
    monkeypatch.setattr(joins, "MAX_BROADCAST", 100)
    for how in ("inner", "left", "right", "full"):
        assert compare.compare(hz, joins.flag_join(hz, how, "broadcast")).equal
    hinted = joins.flag_join(hz, "inner", "broadcast")._jdf.queryExecution().analyzed().toString()
    assert "ResolvedHint" not in hinted


def test_a_recursive_cte_has_no_limit_of_rows(spark, hz):
    spark.conf.set("spark.sql.cteRecursionRowLimit", "100")
    try:
        assert compare.compare(hz, projections.recursive_cte(hz)).equal
    finally:
        spark.conf.unset("spark.sql.cteRecursionRowLimit")
