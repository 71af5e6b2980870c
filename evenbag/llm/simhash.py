"""SimHash near-dedup by pigeonhole blocks.

Two widths: 64-bit fingerprints of which two link at 2 differing bits (near_duplicates),
and wide ones, from which a similarity of 0.8 can be told (near_texts, keep_one)."""

from __future__ import annotations

import math
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import col, cut, fresh
from .components import components

BITS = 64
SEED = 42
#: The most large buckets that are broadcast; more are joined by shuffle.
MAX_BROADCAST = 100_000
#: Stands for a null doc_id among the nodes, so that it is never the smallest.
_LAST = 2**63 - 1


def fingerprint(text: bytes | None, width: int = 3, seed: int = SEED) -> int:
    """The fingerprint of a whole text, unsigned. bytes.lower() and bytes.split()
    know ASCII only: A-Z, and the white space 0x20 and 0x09-0x0D."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    flat = b" ".join(words)
    ends = list(accumulate(len(w) + 1 for w in words))
    starts = [0, *ends[:-1]]
    last = ends[width - 1 :] or ends[-1:]
    digest, n, ones = xxhash.xxh64_intdigest, len(last), np.zeros(BITS, np.int64)
    for at in range(0, n, 1 << 16):
        some = [digest(flat[a : b - 1], seed) for a, b in zip(starts[at : at + (1 << 16)], last[at : at + (1 << 16)])]
        bits = np.unpackbits(np.array(some, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, seed: int = SEED) -> DataFrame:
    """(id, fp long) for every row: fp holds the 64 bits as a signed long. A null
    or wordless text has the fingerprint 0."""

    def run(batches):
        for b in batches:
            found = [fingerprint(t.as_py(), width, seed) for t in b.column(1).cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.array(found, np.uint64).view(np.int64))], ["id", "fp"])

    return docs.select(col(docs, id_col).cast("long").alias("id"), col(docs, text_col).alias("text")).mapInArrow(run, "id long, fp long")


def _masks(bits: int, blocks: int) -> list[int]:
    """One mask for each choice of blocks that two fingerprints which differ in at
    most `bits` bits may have in common: of `blocks` blocks at least
    blocks - bits are equal."""
    edge = [BITS * k // blocks for k in range(blocks + 1)]
    block = [(1 << b) - (1 << a) for a, b in zip(edge, edge[1:])]
    masks = [sum(block[k] for k in some) for some in combinations(range(blocks), blocks - bits)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def link(prints: DataFrame, bits: int = 2, blocks: int = 4, most: int = 64) -> DataFrame:
    """Edges (u, v) of structs (id, fp) that join all distinct fingerprints at
    `bits` (1 or 2) or fewer differing bits into their components.

    Distinct fingerprints are keyed by each choice of blocks. Within a bucket of
    at most `most` fingerprints, pairs are joined on the key and verified. The
    fingerprints of larger buckets, where pairs would grow with the square, go an
    exact linear way: each is listed under itself and its 64 neighbours at one
    bit. Two differ in at most 2 bits just if they meet in such a list, and all
    in a list differ by at most 2; so each list's members hang on its smallest.
    A list has 65 members at most. (For 1 bit, pairs are verified as well.)"""
    if bits not in (1, 2):
        raise ValueError("bits must be 1 or 2")
    nodes = cut(prints.groupBy("fp").agg(F.min(F.coalesce("id", F.lit(_LAST))).alias("id")))
    keys = F.array(*(F.struct(F.lit(k).alias("b"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for k, m in enumerate(_masks(bits, blocks))))
    keyed = nodes.select("fp", "id", F.explode(keys).alias("k")).select("fp", "id", "k.b", "k.key")
    sizes = cut(keyed.groupBy("b", "key").agg(F.count("*").alias("n")).filter("n > 1"))
    near = cut(keyed.join(sizes, ["b", "key"]))
    few = near.filter(F.col("n") <= most)
    node = F.struct("id", "fp").alias("u")
    left = few.select("b", "key", node)
    right = few.select("b", "key", node.alias("v"))
    close = F.bit_count(F.col("u.fp").bitwiseXOR(F.col("v.fp"))) <= bits
    pairs = left.join(right, ["b", "key"]).filter((F.col("u.fp") < F.col("v.fp")) & close).select("u", "v")
    many = near.filter(F.col("n") > most).select("id", "fp").distinct()
    flips = F.array(F.col("fp"), *(F.col("fp").bitwiseXOR(F.lit(1 << k if k < 63 else -(1 << 63))) for k in range(BITS)))
    listed = cut(many.select(node, F.explode(flips).alias("at")))
    heads = cut(listed.groupBy("at").agg(F.min("u").alias("v"), F.count("*").alias("n")).filter("n > 1").drop("n"))
    stars = listed.join(heads, "at").filter("u.fp <> v.fp").select("u", "v")
    if bits == 1:
        back = listed.join(listed.select("at", F.col("u").alias("v")), "at").filter("u.fp < v.fp")
        stars = back.filter(close).select("u", "v")
    return pairs.unionByName(stars).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = 2, width: int = 3, seed: int = SEED) -> DataFrame:
    """(id, fingerprint 16 hex digits, component_id) for every row of docs.

    component_id is the smallest id whose fingerprint is reachable by links of at
    most `bits` differing bits, copies included. Null and empty texts have
    fingerprint 0 and link like any other. Rows with a null id keep it; they get
    the smallest known id of their component, or null. Repeated rows stay. An
    empty table gives none. Other columns are not read."""
    prints = cut(fingerprints(docs, id_col, text_col, width, seed))
    return labelled(prints, bits)


def labelled(prints: DataFrame, bits: int = 2) -> DataFrame:
    """near_duplicates() of fingerprints that are there already: (id, fp)."""
    found = components(link(prints, bits)).select("node.fp", F.col("component.id").alias("first"))
    own = prints.groupBy("fp").agg(F.min("id").alias("own"))
    names = cut(own.join(found, "fp", "left").select("fp", F.nullif(F.coalesce("first", "own"), F.lit(_LAST)).alias("component_id")))
    return prints.join(names, "fp").select("id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


#: Of wide fingerprints: words of a shingle, the similarity (Jaccard, of shingles) from
#: which texts are near, the odds that such a pair shares no block, and the fewest bits
#: of a block and of all blocks (what similarity is told from).
WIDE_WIDTH, SIMILAR, MISS, LEAST_BITS, LEAST_WIDE = 5, 0.8, 0.03, 12, 1000
#: Buckets of more fingerprints go to clusters, which are compared so many at once.
MOST, CHUNK = 64, 1024
#: So many links at most are followed in one task, as shuffles of so few cost more.
FEW = 50_000
#: Of the first 64 bits, so many may differ in a pair that is looked at further: of near
#: ones more do with odds of 1 in 5000, of strangers half do.
FIRST_LOOK = 20


def differing(similar: float = SIMILAR) -> float:
    """The share of bits in which fingerprints of texts of this similarity differ."""
    return math.acos(2 * similar / (1 + similar)) / math.pi


def shape_of(texts: int, similar: float = SIMILAR) -> tuple[int, int, int]:
    """(bits of a block, blocks, words of 64 bits) for so many texts: blocks are so long
    that a stranger's seldom is the same, and so many that a near pair shares one but
    with odds of MISS."""
    bits = max(LEAST_BITS, math.ceil(math.log2(max(2, texts))))
    blocks = math.ceil(max(math.log(MISS) / math.log(1 - (1 - differing(similar)) ** bits), LEAST_WIDE / bits))
    return bits, blocks, math.ceil(bits * blocks / BITS)


def wide_print(text: bytes | None, words: int, width: int = WIDE_WIDTH) -> bytes:
    """The fingerprint of a whole text in 64 * words bits, by shingles of `width` words,
    repeats included; all zero without words."""
    split = (text or b"").lower().split()
    if not split:
        return bytes(8 * words)
    flat = b" ".join(split)
    ends = list(accumulate(len(w) + 1 for w in split))
    starts, last = [0, *ends[:-1]], ends[width - 1 :] or ends[-1:]
    digest, ones = xxhash.xxh3_64_intdigest, np.zeros(BITS * words, np.int64)
    odd = np.arange(1, words + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for at in range(0, len(last), 1 << 16):
        found = np.array([digest(flat[a : b - 1]) for a, b in zip(starts[at : at + (1 << 16)], last[at : at + (1 << 16)])], np.uint64)
        for k in range(0, len(found), 255):  # sums of so many fit in a byte
            x = found[k : k + 255, None] + odd
            x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
            x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
            ones += np.unpackbits((x ^ x >> np.uint64(31)).view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint8)
    return np.packbits(2 * ones > len(last), bitorder="little").tobytes()


def _words(column: pa.Array, words: int) -> np.ndarray:
    """Binary fingerprints as an array (rows, words)."""
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(-1, words)


def wide_prints(docs: DataFrame, words: int, id_col: str = "doc_id", text_col: str = "text", width: int = WIDE_WIDTH) -> DataFrame:
    """(id, text_key, fp binary) for every row; text_key tells texts of one id apart."""

    def run(batches):
        for b in batches:
            found = [wide_print(t.as_py(), words, width) for t in b.column(2).cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(found, pa.binary())], ["id", "text_key", "fp"])

    text = col(docs, text_col)
    return docs.select(col(docs, id_col).cast("long").alias("id"), F.xxhash64(text).alias("text_key"), text.alias("text")).mapInArrow(run, "id long, text_key long, fp binary")


def wide_links(nodes: DataFrame, shape: tuple[int, int, int], most: int = MOST, chunk: int = CHUNK, similar: float = SIMILAR) -> DataFrame:
    """Edges (u, v) of numbers that join all nodes (n, fp: different fingerprints) which
    share a block and differ in as few bits as texts of this similarity do, by one
    standard deviation more at most, into their components.

    Nodes are keyed by each block; the keys are made anew for each use, which is cheaper
    than to store them. Buckets of more than `most` nodes show where texts are dense:
    their nodes are verified against the first one, each pair once however many blocks it
    shares, and those at twice the distance allowed or less belong to one cluster. All
    pairs of a cluster are compared in tasks, in chunks of bounded size; the few nodes
    farther off than that are compared with all of their bucket in the same way. As many
    links leave a task as join its nodes. Other buckets need only the pairs that no
    cluster holds: each that agrees in the 64 bits which nodes carry along is verified,
    once. So nothing is left out, and no dense group gives all its pairs as rows."""
    bits, blocks, words = shape
    p = differing(similar)
    limit = math.floor(p * bits * blocks + math.sqrt(p * (1 - p) * bits * blocks))
    whole = np.frombuffer(np.packbits(np.arange(BITS * words) < bits * blocks, bitorder="little").tobytes(), np.uint64)
    weigh = 1 << np.arange(bits, dtype=np.int64)

    def keys(batches):
        for b in batches:
            fps = np.unpackbits(_words(b.column(1), words).view(np.uint8), axis=1, bitorder="little") if b.num_rows else np.zeros((0, BITS * words), np.uint8)
            values = fps[:, : bits * blocks].reshape(-1, blocks, bits).astype(np.int64) @ weigh
            some = _words(b.column(1), words)[:, 0].view(np.int64) if b.num_rows else np.zeros(0, np.int64)
            columns = np.repeat(b.column(0).to_numpy(), blocks), (values + (np.arange(1, blocks + 1, dtype=np.int64) << 40)).ravel(), np.repeat(some, blocks), np.repeat(b.column(2).to_numpy(), blocks)
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["n", "key", "look", "cluster"])

    def apart(a, b):
        return np.bitwise_count((a ^ b) & whole).sum(axis=-1, dtype=np.int32)

    def verify(batches):
        for b in batches:
            if b.num_rows:
                yield b.select(["u", "v"]).append_column("apart", pa.array(apart(_words(b.column(2), words), _words(b.column(3), words))))

    def forest(table: pa.Table) -> pa.Table:
        """One chunk's own nodes against one chunk of all: edges that join what is near."""
        own, every = table.filter(table["own"]), table.filter(pc.invert(table["own"]))
        a, b, out = _words(own["fp"].combine_chunks(), words), _words(every["fp"].combine_chunks(), words), []
        ids, at = np.unique(np.concatenate([own["n"].to_numpy(), every["n"].to_numpy()]), return_inverse=True)
        left, right, of = at[: len(a)], at[len(a) :], np.arange(len(ids))
        for i in range(len(a)):
            near = right[apart(a[i], b) <= limit]
            for x, k in zip(*np.unique(of[near], return_index=True)):
                if x != of[left[i]]:
                    out.append((int(ids[left[i]]), int(ids[near[k]])))
                    of[of == x] = of[left[i]]
        return pa.table({"u": pa.array([x for x, _ in out], pa.int64()), "v": pa.array([y for _, y in out], pa.int64())})

    by = nodes.select("n", "fp")
    keyed = lambda df: df.mapInArrow(keys, "n long, key long, look long, cluster long")
    told = lambda df: cut(df.distinct().join(by.withColumnsRenamed({"n": "u", "fp": "x"}), "u").join(by.withColumnsRenamed({"n": "v", "fp": "y"}), "v").select("u", "v", "x", "y").mapInArrow(verify, "u long, v long, apart int"))
    plain = keyed(by.withColumn("cluster", F.col("n")))
    few, links = plain, []
    sizes = cut(plain.groupBy("key").agg(F.count("*").alias("size"), F.min("n").alias("head")).filter(F.col("size") > most))
    if count := sizes.count():
        large = F.broadcast(sizes) if count <= MAX_BROADCAST else sizes
        met = cut(plain.join(large, "key").filter(F.col("n") != F.col("head")).select("key", F.col("head").alias("u"), F.col("n").alias("v")))
        hung = told(met.select("u", "v"))
        clusters = cut(components(hung.filter(F.col("apart") <= 2 * limit), few=FEW).select(F.col("node").alias("n"), "component"))
        placed = by.join(clusters, "n", "left").select("n", "fp", F.coalesce("component", "n").alias("cluster"))
        few = keyed(placed).join(large, "key", "left_anti")
        far = met.join(hung.filter(F.col("apart") > 2 * limit), ["u", "v"]).select(F.col("v").alias("n"), "key")
        # Clusters have negative keys: all their nodes are own ones, and a pair of chunks
        # is compared once.
        inside = clusters.select("n", (-1 - F.col("component")).alias("key"))
        own = cut(inside.unionByName(far))
        some = met.join(own.filter("key > 0").select("key").distinct(), "key")
        every = cut(inside.unionByName(some.select(F.explode(F.array("u", "v")).alias("n"), "key").distinct()))
        chunks = every.groupBy("key").agg(F.ceil(F.count("*") / chunk).cast("int").alias("chunks"))
        of = lambda df: df.join(chunks, "key").withColumn("at", F.pmod(F.xxhash64("n"), "chunks").cast("int")).withColumn("last", F.col("chunks") - 1)
        own = of(own).select("n", "key", F.col("at").alias("low"), F.explode(F.sequence(F.when(F.col("key") < 0, F.col("at")).otherwise(0), "last")).alias("high"), F.lit(True).alias("own"))
        every = of(every).select("n", "key", F.explode(F.sequence(F.lit(0), F.when(F.col("key") < 0, F.col("at")).otherwise(F.col("last")))).alias("low"), F.col("at").alias("high"), F.lit(False).alias("own"))
        both = own.unionByName(every).join(by, "n").select("key", "low", "high", "own", "n", "fp")
        links = [hung.filter(F.col("apart") <= limit).select("u", "v"), both.groupBy("key", "low", "high").applyInArrow(forest, "u long, v long")]
    # No list is longer than `most`.
    few = few.groupBy("key").agg(F.collect_list(F.struct("n", "look", "cluster")).alias("nodes")).filter(F.size("nodes") > 1)
    agree = lambda x, y: F.bit_count(x.look.bitwiseXOR(y.look)) <= FIRST_LOOK
    asked = lambda x: (x.n > F.col("a.n")) & (x.cluster != F.col("a.cluster")) & agree(F.col("a"), x)
    pairs = few.select(F.explode("nodes").alias("a"), "nodes").select(F.col("a.n").alias("u"), F.explode(F.filter("nodes", asked)).alias("b")).select("u", F.col("b.n").alias("v"))
    found = told(pairs).filter(F.col("apart") <= limit).select("u", "v")
    for some in links:
        found = found.unionByName(some)
    return found


def near_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similar: float = SIMILAR, width: int = WIDE_WIDTH, most: int = MOST) -> DataFrame:
    """(id, text_key, n rows, first struct of id and text_key) for every different id and
    text: `first` is the smallest of its group of near texts, null ids being largest.

    Texts are near if their wide fingerprints say that their shingles (of `width` words,
    or the whole of a shorter text) have a Jaccard similarity of `similar`; groups are
    what links reach. Copies are one node. Null, empty and wordless texts are near one
    another. Other columns are not read; an empty table gives no rows."""
    shape = shape_of(docs.count(), similar)
    prints = cut(wide_prints(docs, shape[2], id_col, text_col, width).groupBy("id", "text_key").agg(F.first("fp").alias("fp"), F.count("*").alias("rows")))
    rank = F.struct(F.coalesce("id", F.lit(_LAST)).alias("id"), "text_key")
    nodes = cut(prints.groupBy("fp").agg(F.min(rank).alias("first")).withColumn("n", F.monotonically_increasing_id()))
    of = components(cut(wide_links(nodes, shape, most, similar=similar)), few=FEW).select(F.col("node").alias("n"), "component")
    firsts = cut(nodes.join(of, "n", "left").select("n", "fp", "first", F.coalesce("component", "n").alias("component")))
    heads = firsts.groupBy("component").agg(F.min("first").alias("head"))
    named = cut(firsts.join(heads, "component").select("fp", "head"))
    return prints.join(named, "fp").select("id", "text_key", "rows", F.col("head").alias("first"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similar: float = SIMILAR, width: int = WIDE_WIDTH) -> DataFrame:
    """docs with one row of each group of near_texts(): that of the smallest id (null is
    the largest) and, of that id's texts, the one of the smallest key. Of rows that
    repeat both any one stays. Documents are shuffled once, by id and text."""
    here, key = fresh(docs, "kept_id", "kept_text")
    groups = near_texts(docs, id_col, text_col, similar, width)
    first = groups.filter((F.coalesce("id", F.lit(_LAST)) == F.col("first.id")) & (F.col("text_key") == F.col("first.text_key")))
    first = cut(first.select(F.col("id").alias(here), F.col("text_key").alias(key), "rows"))
    same = col(docs, id_col).cast("long").eqNullSafe(F.col(here)) & (F.xxhash64(col(docs, text_col)) == F.col(key))
    once = docs.join(first.filter("rows = 1").drop("rows"), same, "left_semi")
    often = first.filter("rows > 1").drop("rows")
    if not often.limit(1).count():
        return once
    return once.union(docs.join(often, same).dropDuplicates([here, key]).select(*(col(docs, c) for c in docs.columns)))
