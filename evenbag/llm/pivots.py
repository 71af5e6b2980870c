"""Embedding near-dedup by a pivot-permutation index."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import col, cut
from .components import components

MIN_COSINE = 0.93
#: Nearest pivots that describe a vector, and the fewest that two must share to be
#: compared. A vector is expected to meet at most STRANGERS in pairs that are rows, for
#: which up to MAX_SHARED would have to be shared; where that is more than SHARED, all
#: that share a pivot are compared inside tasks instead.
NEAREST, SHARED, MAX_SHARED, STRANGERS = 10, 2, 4, 256
#: Number of pivots: PER_ROOT times the root of the number of different vectors,
#: so that a list's length grows with the root only; within these bounds.
PER_ROOT, MIN_PIVOTS, MAX_PIVOTS = 4.0, 64, 4096
#: No two pivots have this cosine.
APART = 0.8
#: Vectors compared with each other at once, where pivots are too few for an index.
BLOCK = 4096
SEED = 5
_LAST = 2**63 - 1


def _unit(column) -> np.ndarray:
    """Unit vectors in doubles, (rows, dim)."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    scale = np.abs(flat).max(axis=1, keepdims=True)
    flat = flat / scale
    return flat / np.linalg.norm(flat, axis=1, keepdims=True)


def choose_pivots(classes: DataFrame, pivots: int | None, seed: int) -> tuple[dict[int, np.ndarray], dict[int, int]]:
    """By dimension, the pivots and the number of vectors. Pivots are, of a bounded sample of the different vectors (twice
    MAX_PIVOTS at most, the lowest by a seeded hash) those that no earlier one is
    close to. Else a dense group would hold many pivots, all about as near to each
    of its members, and their order would say nothing."""
    out, counts = {}, {r["dim"]: r["n"] for r in classes.groupBy("dim").agg(F.count("*").alias("n")).collect()}
    for dim, rows in sorted(counts.items()):
        want = pivots or min(MAX_PIVOTS, max(MIN_PIVOTS, math.ceil(PER_ROOT * math.sqrt(rows))))
        some = classes.filter(F.col("dim") == dim).orderBy(F.xxhash64(F.lit(seed), "vector"), "id").limit(2 * want)
        found = np.array([r["vector"] for r in some.select("vector").collect()], np.float64)
        found /= np.abs(found).max(axis=1, keepdims=True)
        found /= np.linalg.norm(found, axis=1, keepdims=True)
        kept: list[int] = []
        for k, v in enumerate(found):
            if len(kept) < want and (not kept or (found[kept] @ v).max() < APART):
                kept.append(k)
        out[dim] = found[kept]
    return out, counts


def permutations(classes: DataFrame, pivots: dict[int, np.ndarray], nearest: int) -> DataFrame:
    """(id, label, dim, pivots): the numbers of the nearest pivots, nearest first."""

    def run(batches):
        for b in batches:
            dims = b.column(2).to_numpy()
            for dim in np.unique(dims):
                part = b.filter(pa.array(dims == dim))
                score = _unit(part.column(3)) @ pivots[int(dim)].T
                k = min(nearest, score.shape[1])
                top = np.argpartition(-score, k - 1, axis=1)[:, :k]
                top = np.take_along_axis(top, np.argsort(-np.take_along_axis(score, top, 1), axis=1, kind="stable"), 1)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(part) + 1) * k, pa.int32()), pa.array(top.ravel().astype(np.int32)))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(2), lists], ["id", "label", "dim", "pivots"])

    return classes.select("id", "label", "dim", "vector").mapInArrow(run, "id long, label string, dim int, pivots array<int>")


def enough_shared(vectors: int, pivots: int, nearest: int, least: int) -> int:
    """How many pivots two of so many vectors would have to share, for a vector to meet
    STRANGERS at most. Of two strangers' `nearest` random pivots, s given ones are the
    same with odds of about s! / pivots ** s."""
    for s in range(least, MAX_SHARED):
        if vectors * math.comb(nearest, s) ** 2 * math.factorial(s) / pivots**s <= STRANGERS:
            return s
    return max(least, MAX_SHARED)


def candidates(lists: DataFrame, shared: int, nearest: int) -> DataFrame:
    """Pairs (u, v) of one label and dimension that share `shared` pivots at least,
    each once. Vectors are listed under each choice of so many of their pivots, in
    rising order; a pair meets wherever it shares one, and counts at the first."""
    packed = lambda some: reduce(lambda acc, x: F.shiftleft(acc, 12).bitwiseOR(x), [x.cast("long") for x in some])
    keys = F.array(*(packed([F.col("pivots")[i] for i in some]) for some in combinations(range(nearest), shared)))
    listed = lists.select("id", "label", "dim", F.sort_array("pivots").alias("pivots"))
    listed = listed.select("id", "label", "dim", "pivots", F.explode(keys).alias("key"))
    left, right = (listed.withColumnsRenamed({"id": name, "pivots": f"of_{name}"}) for name in "uv")
    both = F.array_intersect("of_u", "of_v")
    return left.join(right, ["label", "dim", "key"]).filter("u < v").filter(packed([both[i] for i in range(shared)]) == F.col("key")).select("u", "v")


def verified(pairs: DataFrame, least: float) -> DataFrame:
    """The pairs (u, v, x, y: their vectors) whose cosine is at least this."""

    def run(batches):
        for b in batches:
            if b.num_rows:
                n = b.column(2).value_lengths().to_numpy()
                for dim in np.unique(n):
                    part = b.filter(pa.array(n == dim))
                    good = pa.array((_unit(part.column(2)) * _unit(part.column(3))).sum(axis=1) >= least)
                    yield part.select(["u", "v"]).filter(good)

    return pairs.select("u", "v", "x", "y").mapInArrow(run, "u long, v long")


def compared_in_full(classes: DataFrame, least: float) -> DataFrame:
    """Links (u, v) of all pairs of one label and dimension: exact, by products of
    blocks. Only links leave a task, and pairs are never rows."""
    listed = classes.select("label", "dim", F.lit(-1).alias("pivot"), F.array().cast("array<int>").alias("pivots"), "id", "vector")
    return _compared(listed, listed, least)


def compared_by_pivot(classes: DataFrame, lists: DataFrame, least: float) -> DataFrame:
    """Links (u, v) of all pairs of one label and dimension that share a pivot, each
    once, by products of blocks of each pivot's vectors."""
    listed = lists.select("label", "dim", F.explode("pivots").alias("pivot"), "pivots", "id")
    return _compared(listed.join(classes.select("id", "vector"), "id"), listed, least)


def _compared(vectors: DataFrame, listed: DataFrame, least: float) -> DataFrame:
    """Links within each (label, dim, pivot), whose rows `listed` counts; a pair counts
    at the first pivot it shares."""
    by = ["label", "dim", "pivot"]
    sizes = listed.groupBy(*by).agg(F.count("*").alias("size")).filter("size > 1").select(*by, F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks"))
    x = vectors.join(sizes, by).withColumn("own", F.pmod(F.xxhash64("vector"), "blocks").cast("int"))
    x = x.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    x = x.select(*by, F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "own", "pivots", "id", "vector")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(batches)
        low, high, pivot, own = t["low"][0].as_py(), t["high"][0].as_py(), t["pivot"][0].as_py(), t["own"].to_numpy()
        ids, all_units = t["id"].to_numpy(), _unit(t["vector"].combine_chunks())
        lists = t["pivots"].combine_chunks().flatten().to_numpy().reshape(len(t), -1)
        a, b = np.flatnonzero(own == low), np.flatnonzero(own == high)
        right, names = all_units[b], ids[b]
        for at in range(0, len(a), 256):
            some = a[at : at + 256]
            i, j = np.nonzero(all_units[some] @ right.T >= least)
            u, v = ids[some][i], names[j]
            # Within a block each pair comes up from both ends, between two from one.
            good = u < v if low == high else u != v
            i, j, u, v = some[i[good]], b[j[good]], u[good], v[good]
            for k in range(0, len(u), BLOCK):
                x, y = lists[i[k : k + BLOCK]], lists[j[k : k + BLOCK]]
                first = ~((x[:, :, None] == y[:, None, :]).any(axis=2) & (x < pivot)).any(axis=1)
                some_u, some_v = u[k : k + BLOCK][first], v[k : k + BLOCK][first]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(some_u, some_v)), pa.array(np.maximum(some_u, some_v))], ["u", "v"])

    return x.groupBy(*by, "low", "high").applyInArrow(run, "u long, v long")


def near_links(vectors: DataFrame, id_col="vec_id", vector_col="embedding", label_col="label", least=MIN_COSINE, nearest=NEAREST, shared=SHARED, pivots=None, seed=SEED) -> tuple[DataFrame, DataFrame]:
    """(classes, links). classes (id, label, dim, vector, n): each different vector of
    a label with its smallest id and its count; links (u, v) of classes, u < v.

    The index: classes are listed under their nearest pivots; those of one label
    that share `shared` pivots at least are compared in full, however many there are.
    Where that is too many pairs to be rows (large tables, see enough_shared()), all
    that share a pivot are compared inside tasks. Of a dimension with fewer than
    MIN_PIVOTS pivots (few vectors, or all of them close together) lists say little or
    nothing: there all pairs of a label are compared."""
    x = plain(vectors, id_col, vector_col, label_col).filter(can_link())
    classes = cut(x.groupBy("label", "vector").agg(F.min(F.coalesce("id", F.lit(_LAST))).alias("id"), F.count("*").alias("n")).withColumn("dim", F.size("vector")))
    chosen, rows = choose_pivots(classes, pivots, seed)
    dense = [dim for dim, some in chosen.items() if len(some) < MIN_PIVOTS]
    if len(dense) == len(chosen):
        return classes, cut(compared_in_full(classes, least))
    lists = cut(permutations(classes.filter(~F.col("dim").isin(dense)), chosen, nearest))
    crowded = [dim for dim in chosen.keys() - dense if enough_shared(rows[dim], len(chosen[dim]), nearest, shared) > shared]
    parts = []
    if len(crowded) < len(chosen) - len(dense):
        pairs = candidates(lists.filter(~F.col("dim").isin(crowded)), shared, nearest)
        by = classes.select("id", "vector")
        pairs = pairs.join(by.withColumnsRenamed({"id": "u", "vector": "x"}), "u").join(by.withColumnsRenamed({"id": "v", "vector": "y"}), "v")
        parts.append(verified(pairs, least))
    if crowded:
        parts.append(compared_by_pivot(classes, lists.filter(F.col("dim").isin(crowded)), least))
    if dense:
        parts.append(compared_in_full(classes.filter(F.col("dim").isin(dense)), least))
    return classes, cut(reduce(DataFrame.unionByName, parts))


def can_link() -> Column:
    finite = F.forall("vector", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return F.coalesce(F.col("label").isNotNull() & finite & F.exists("vector", lambda v: v != 0), F.lit(False))


def plain(vectors: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """(id, label, vector) of all rows."""
    vector, label = col(vectors, vector_col).cast("array<double>"), col(vectors, label_col).cast("string")
    return vectors.select(col(vectors, id_col).cast("long").alias("id"), label.alias("label"), vector.alias("vector"))


def near_duplicates(vectors: DataFrame, id_col="vec_id", vector_col="embedding", label_col="label", **how) -> DataFrame:
    """One row per row of vectors: id, n_links, component_id, kept.

    Vectors of equal labels and lengths link at a cosine of at least `least`, in
    doubles. Copies are one class: links run between classes, and each vector
    counts all members of the classes linked to its own, and its own copies.
    Vectors that are null, empty, zero or hold null or non-finite components, and
    those with a null label, link with nothing and stay. A null id keeps its row;
    its component_id is the smallest id it can reach, or null. Repeated rows
    count as copies. Other columns are not read; no rows give none."""
    classes, links = near_links(vectors, id_col, vector_col, label_col, **how)
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    counts = both.join(classes.select(F.col("id").alias("v"), "n"), "v").groupBy(F.col("u").alias("id")).agg(F.sum("n").alias("others"))
    named = components(links).withColumnsRenamed({"node": "id"})
    facts = classes.join(counts, "id", "left").join(named, "id", "left")
    facts = cut(facts.select("label", "vector", (F.coalesce("others", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "id").alias("component_id")))
    rows = plain(vectors, id_col, vector_col, label_col)
    linked = rows.filter(can_link()).join(facts, ["label", "vector"]).select("id", "n_links", F.nullif("component_id", F.lit(_LAST)).alias("component_id"))
    rest = rows.filter(~can_link()).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return linked.unionByName(rest).withColumn("kept", F.col("id").eqNullSafe(F.col("component_id")))
