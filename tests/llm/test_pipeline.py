"""The pipeline stage by stage, against brute force, and as one run."""

import os
import subprocess
import sys
import tempfile
from collections import Counter
from pathlib import Path

from pyspark.sql import functions as F

import corpus_pipeline
from evenbag.llm import mixing, toxicity
from tests.llm.test_operators import PRIVATE, check_packing, find, shingles, words

SF = "/root/testdata/sf0.001"


def rows(df):
    return Counter(tuple(r) for r in df.collect())


def test_stages_and_run(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    extra = spark.createDataFrame([(900_001, f"write to {PRIVATE} soon", "en", "src0", 10), (900_002, None, None, None, None), (900_002, None, None, None, None)], docs.schema)
    docs = docs.unionByName(extra)
    given, kept = docs, {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, given, SF).write.parquet(f"{tmp_path}/{k}")
        kept[name] = spark.read.parquet(f"{tmp_path}/{k}")
        if name != "pack":
            assert kept[name].columns == docs.columns
        given = kept[name]
    model = toxicity.train(*toxicity.sample(docs, spark.read.parquet(f"{SF}/labels.parquet")))
    clean = [r for r, s in ((r, r["score"]) for r in toxicity.score_documents(docs, model).collect()) if s < toxicity.THRESHOLD]
    assert rows(kept["toxicity"]) == Counter(tuple(r)[:-1] for r in clean) and len(clean) <= docs.count()

    # Of each group of copies and near texts, by all pairs, the first stays.
    texts = {r["doc_id"]: r["text"] for r in clean}
    stays = {r["doc_id"] for r in kept["simhash"].collect()}
    assert len(stays) == kept["simhash"].count()
    grams = {i: shingles(t) for i, t in texts.items()}
    likeness = {(i, j): len(grams[i] & grams[j]) / len(grams[i] | grams[j]) if grams[i] | grams[j] else 1.0 for i in texts for j in texts if i < j}
    groups = find(texts, [p for p, x in likeness.items() if x >= 0.85])
    assert Counter(groups[i] for i in stays).most_common(1)[0][1] == 1
    loose = find(texts, [p for p, x in likeness.items() if x >= 0.7])
    assert {min(i for i in texts if loose[i] == g) for g in set(loose.values())} <= stays

    before = {r["doc_id"]: r["text"] for r in kept["simhash"].collect()}
    after = {r["doc_id"]: r["text"] for r in kept["pii"].collect()}
    assert before.keys() == after.keys() and all((a is None) == (b is None) and len(a or "") - len(b or "") < 60 for a, b in zip(before.values(), (after[k] for k in before)))
    if 900_001 in after:
        assert "4418452524842581" not in after[900_001] and after[900_001].startswith("write to ") and after[900_001].endswith(" soon")

    want = Counter()
    for r in mixing.mix(kept["pii"]).collect():
        want[r["doc_id"]] += r["taken"]
    got = Counter()
    for r in kept["mix"].collect():
        assert r["text"] is None or r["n_chars"] == len(r["text"])
        got[r["doc_id"]] += len(words(r["text"]))
    assert +want == +got

    check_packing(kept["pack"].collect(), [r["text"] for r in kept["mix"].select("text").collect()])


def test_run_is_the_stages(spark):
    made = corpus_pipeline.run(spark, SF)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "simhash", "pii", "mix", "pack"]
    again = corpus_pipeline.run(spark, SF)
    total = F.sum("length")
    assert made.agg(total).first() == again.agg(total).first()
    assert rows(made.groupBy("doc_id").agg(total)) == rows(again.groupBy("doc_id").agg(total))


def test_no_rows(spark, tmp_path):
    given = spark.read.parquet(f"{SF}/documents.parquet").filter("doc_id < 0")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, given, SF).write.parquet(f"{tmp_path}/{k}")
        given = spark.read.parquet(f"{tmp_path}/{k}")
    assert given.count() == 0


def test_registered():
    import __spark_entry__

    names = __spark_entry__.queries()
    assert "pipeline" in names and [sum(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)] == [1] * 10
    assert set(__spark_entry__.oracle_sql()) <= set(names)


def test_executors_need_no_copy_of_the_package():
    """All queries, in a session started elsewhere with no PYTHONPATH: only the driver
    knows where the package is."""
    script = f"""
import sys, tempfile
sys.path.insert(0, {str(Path(__file__).resolve().parents[2])!r})
from pyspark.sql import SparkSession
work = tempfile.mkdtemp()
s = SparkSession.builder.master("local[4]").config(map={{"spark.checkpoint.dir": "file://" + work + "/c", "spark.sql.warehouse.dir": work + "/w", "spark.ui.enabled": "false", "spark.sql.shuffle.partitions": "4", "spark.ui.showConsoleProgress": "false"}}).getOrCreate()
s.sparkContext.setLogLevel("OFF")
import __spark_entry__
queries = __spark_entry__.queries()
for name in sorted(n for n in queries if n.startswith("op") or n == "pipeline"):
    print(name, queries[name](s, {SF!r}).count(), flush=True)
"""
    done = subprocess.run([sys.executable, "-c", script], capture_output=True, text=True, timeout=1200, cwd=tempfile.mkdtemp(), env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})
    found = dict(line.split() for line in done.stdout.splitlines())
    assert len(found) == 11 and all(int(n) > 0 for k, n in found.items()), done.stderr[-3000:]
