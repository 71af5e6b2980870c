"""Mixing sources to target weights by Sainte-Lague apportionment.

A source's documents stand in seeded order in shards of bounded size; a shard's
words are cut into blocks of equal length. Blocks go to sources, and a source's
to its shards, by highest quotients; the shards then select their quota of
blocks from a seeded start. All of it is DataFrame operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import col, cut, fresh, ranked, word_count

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2
BLOCK = 32
SHARD = 50_000
SEED = 17
#: The most sources that are broadcast; more are joined by shuffle.
MAX_BROADCAST = 100_000


def highest_quotients(kids: DataFrame, parent: list[str], order: list[str]) -> DataFrame:
    """kids (parent, order, weight double, cap long, seats long of the parent, the
    same for all its kids) with `quota` long: the seats by Sainte-Lague, highest
    weight / (2k - 1) first, ties by order; a kid stops at its cap.

    At a level L, kids have min(cap, round(weight * L)) seats. At the level where
    min(cap, weight * L) sums up to half a seat per kid less than all seats, none
    of these can be one too many; at half a seat more, none beyond can be won. So
    only those between are ranked: about two for each kid."""
    group = Window.partitionBy(*parent)
    seats = F.least("seats", F.sum("cap").over(group))
    x = kids.select(*parent, *order, "weight", "cap", seats.alias("seats"), F.count("*").over(group).alias("n"))
    x = x.withColumn("full_at", F.when(F.col("weight") > 0, F.col("cap") / F.col("weight")))
    rising = group.orderBy(F.col("full_at").asc_nulls_last(), *order)
    x = x.withColumn("capped", F.coalesce(F.sum("cap").over(rising.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    x = x.withColumn("open_weight", F.sum("weight").over(rising.rowsBetween(0, Window.unboundedFollowing)))

    def level(total):
        here = F.when(F.col("full_at").isNotNull(), F.greatest((total - F.col("capped")) / F.col("open_weight"), F.lit(0.0)))
        return F.max(F.when(here <= F.col("full_at"), here)).over(group)

    x = x.withColumns({"low": level(F.col("seats") - F.col("n") / 2.0), "high": level(F.col("seats") + F.col("n") / 2.0)})
    # No level means that all kids are full. A spare seat on either side keeps the
    # rounding of doubles out of it.
    won = lambda at, spare: F.when(F.col("weight") > 0, F.when(F.col(at).isNull(), F.col("cap")).otherwise(F.floor(F.col("weight") * F.col(at) + 0.5) + spare)).otherwise(0)
    x = x.withColumn("sure", F.least("cap", F.greatest(won("low", -1), F.lit(0))).cast("long"))
    x = x.withColumn("most", F.least("cap", F.greatest(won("high", 1), F.col("sure"))).cast("long"))
    x = x.withColumn("open", F.col("seats") - F.sum("sure").over(group))
    each = x.select("*", F.explode(F.sequence("sure", "most")).alias("k"))
    quotient = F.when(F.col("k") > F.col("sure"), F.col("weight") / (2 * F.col("k") - 1))
    place = F.row_number().over(Window.partitionBy(*parent).orderBy(quotient.desc_nulls_last(), *order))
    each = each.withColumn("in", ((F.col("k") > F.col("sure")) & (F.col("weight") > 0) & (place <= F.col("open"))).cast("long"))
    return each.groupBy(*parent, *order).agg((F.first("sure") + F.sum("in")).alias("quota"))


def apportion(kids: DataFrame, seats: DataFrame, group: list[str], fan: int) -> DataFrame:
    """(group, index, quota) for kids (group, index 0.., weight, cap) from seats
    (group, seats). No more than `fan` kids are ranked in one window: more are
    gathered in ranges of at most fan, these in ranges again, and seats handed
    down level by level."""
    top = kids.agg(F.max("index")).first()[0] or 0
    step = 1
    while top // step >= fan:
        step *= fan
    above = seats.select(*group, F.lit(0).cast("long").alias("parent"), F.col("seats").cast("long").alias("seats"))
    while True:
        node = F.floor(F.col("index") / step).cast("long")
        level = kids.groupBy(*group, node.alias("node")).agg(F.sum("weight").alias("weight"), F.sum("cap").cast("long").alias("cap"))
        level = level.withColumn("parent", F.floor(F.col("node") / fan).cast("long")).join(above, [*group, "parent"])
        quota = cut(highest_quotients(level, [*group, "parent"], ["node"]).drop("parent"))
        if step == 1:
            return quota.withColumnRenamed("node", "index")
        above = quota.select(*group, F.col("node").alias("parent"), F.col("quota").alias("seats"))
        step //= fan


def targets(sources: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """sources (missing, name, total) with index, weight and target. Weights repeat
    over the sources by code point, null last. All targets together are `share` of
    all words; one stops at `most` times its source's words, and what it exceeds
    them by goes to the others by weight. The rise of the level is a short loop
    over two sums."""
    repeated = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.col("index") % len(weights) + 1).cast("int"))
    x = cut(ranked(sources, "index", F.col("missing"), F.col("name")).withColumn("weight", repeated))
    words = x.agg(F.sum("total")).first()[0] or 0
    full, level = F.lit(most) * F.col("total"), 0.0
    while True:
        over = full <= F.lit(level) * F.col("weight")
        capped, open_weight = x.agg(F.sum(F.when(over, full)), F.sum(F.when(~over, F.col("weight")))).first()
        new = (share * words - (capped or 0)) / open_weight if open_weight else level
        if new <= level:
            break
        level = new
    return x.withColumn("target", F.least(full.cast("double"), F.lit(level) * F.col("weight")))


def mix(docs: DataFrame, id_col="doc_id", text_col="text", source_col="source", weights=WEIGHTS, share=SHARE, most=MOST, block=BLOCK, shard=SHARD, seed=SEED, keep_all=False) -> DataFrame:
    """One row per document: id, size, source_size, target, taken; with keep_all
    docs' columns instead, and a last column of a new name (struct of size, passes,
    first, and what selected() needs).

    size is the number of words. taken counts the words the mix takes, repeats
    included: a shard with a quota of q of its n blocks takes all blocks q div n
    times, and q mod n, evenly spaced from a seeded start, once more. So no
    document is taken more than `most` times in full. A target is met to within
    about a block.

    A null text has no words, a null source is a source of its own. Ties of the
    seeded order fall to equal rows or to the id; repeated rows each count. An
    empty table gives none. Other columns are neither read nor changed."""
    names = fresh(docs, "missing", "name", "size", "hash", "shard", "start", "whole", "blocks", "quota", "goal", "source_total", "shards", "mix")
    missing, name, size, hashed, shard_, start, whole, blocks, quota, goal, total, n_shards, taken_at = names
    base = docs if keep_all else docs.select(id_col, text_col, source_col)
    base = base.withColumns({
        missing: col(docs, source_col).isNull(), name: F.coalesce(col(docs, source_col).cast("string"), F.lit("")),
        size: word_count(col(docs, text_col)), hashed: F.xxhash64(F.lit(seed), col(docs, id_col), col(docs, text_col)),
    })
    slim = cut(base.select(F.col(id_col).alias("id"), F.col(missing).alias("missing"), F.col(name).alias("name"), F.col(size).alias("size"), F.col(hashed).alias("hash")))
    group = ["missing", "name"]
    sources = targets(slim.groupBy(*group).agg(F.sum("size").alias("total")), weights, share, most)
    shards_of = F.greatest(F.ceil(F.col("total") / shard), F.lit(1)).cast("long")
    sources = cut(sources.withColumn("shards", shards_of))
    index = lambda h, n: F.pmod(F.shiftrightunsigned(h, 20), n)
    # The sources are broadcast if they are few: a join on them would send a large
    # source's documents to one task, as the steps that follow keep its dealing.
    few = sources.count() <= MAX_BROADCAST
    to_all = lambda x: F.broadcast(x) if few else x
    dealt = slim.join(to_all(sources.select(*group, "shards")), group)
    sizes = dealt.groupBy(*group, index(F.col("hash"), F.col("shards")).alias("index")).agg(F.sum("size").alias("whole"))
    sizes = cut(sizes.withColumn("blocks", F.ceil(F.col("whole") / block).cast("long")))

    in_blocks = sizes.groupBy(*group).agg(F.sum("blocks").alias("blocks"))
    kids = sources.join(in_blocks, group).select(
        F.lit(0).alias("root"), "index", (F.when(F.col("total") > 0, F.col("target") * F.col("blocks") / F.col("total")).otherwise(0.0)).alias("weight"), (most * F.col("blocks")).alias("cap"), *group)
    kids = cut(kids)
    seats = kids.groupBy("root").agg(F.round(F.sum("weight")).cast("long").alias("seats"))
    by_source = apportion(kids, seats, ["root"], 4096).select("index", F.col("quota").alias("seats"))
    by_source = cut(kids.select("index", *group).join(by_source, "index").drop("index"))
    leaves = sizes.select(*group, "index", F.col("blocks").cast("double").alias("weight"), (most * F.col("blocks")).alias("cap"))
    quotas = sizes.join(apportion(leaves, by_source, group, 128), [*group, "index"])
    quotas = cut(quotas.select(F.col("missing").alias(missing), F.col("name").alias(name), F.col("index").alias(shard_), F.col("whole").alias(whole), F.col("blocks").alias(blocks), F.col("quota").alias(quota)))

    facts = sources.select(F.col("missing").alias(missing), F.col("name").alias(name), F.col("shards").alias(n_shards), F.col("total").alias(total), F.col("target").alias(goal))
    rows = base if keep_all else slim.select(F.col("id").alias(id_col), F.col("missing").alias(missing), F.col("name").alias(name), F.col("size").alias(size), F.col("hash").alias(hashed))
    rows = rows.join(to_all(facts), [missing, name]).withColumn(shard_, index(F.col(hashed), F.col(n_shards))).drop(n_shards)
    rows = rows.join(quotas, [missing, name, shard_])
    before = Window.partitionBy(missing, name, shard_).orderBy(hashed, id_col, size).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn(start, F.coalesce(F.sum(size).over(before), F.lit(0)))
    turn = F.pmod(F.xxhash64(F.lit(seed), F.col(missing), F.col(name), F.col(shard_)), F.greatest(F.col(blocks), F.lit(1)))
    extra = F.when(F.col(blocks) > 0, F.col(quota) % F.col(blocks)).otherwise(0)
    passes = F.when(F.col(blocks) > 0, F.floor(F.col(quota) / F.col(blocks))).otherwise(0).cast("long")
    at = F.struct(F.col(size).alias("size"), passes.alias("passes"), F.col(start).alias("first"), F.col(blocks).alias("blocks"), extra.alias("extra"), turn.alias("turn"))
    if keep_all:
        return rows.withColumn(taken_at, at).select(*(col(docs, c) for c in docs.columns), taken_at)
    rows = rows.withColumn("at", at)
    inside = chosen_before(F.col("at.first") + F.col("at.size"), "at", block) - chosen_before(F.col("at.first"), "at", block)
    taken = F.when(F.col(blocks) > 0, F.col("at.passes") * F.col("at.size") + inside).otherwise(0)
    return rows.select(id_col, F.col(size).alias("size"), F.col(total).alias("source_size"), F.col(goal).alias("target"), taken.cast("long").alias("taken"))


def selected(k: Column, at: str) -> Column:
    """1 if the shard's block k is among those taken once more, else 0: of n blocks
    the r where k * r + turn steps over a multiple of n."""
    n, r, turn = F.col(f"{at}.blocks"), F.col(f"{at}.extra"), F.col(f"{at}.turn")
    return (F.floor(((k + 1) * r + turn) / n) - F.floor((k * r + turn) / n))


def chosen_before(p: Column, at: str, block: int) -> Column:
    """Of the shard's first p words, how many lie in blocks taken once more."""
    n, r, turn = F.col(f"{at}.blocks"), F.col(f"{at}.extra"), F.col(f"{at}.turn")
    k = F.floor(p / block)
    return block * (F.floor((k * r + turn) / n) - F.floor(turn / n)) + selected(k, at) * (p - k * block)


def mixed_texts(docs: DataFrame, id_col="doc_id", text_col="text", source_col="source", block=BLOCK, **how) -> DataFrame:
    """The mix itself: docs' columns, a row for each pass over a document. A pass
    over all its words keeps the text as it is; the last takes the words of the
    selected blocks, each with the white space before it. A document without words
    stays once if its source has none at all, else it has nothing to give and
    goes. Nulls, ties and repeated rows as in mix()."""
    rows = mix(docs, id_col, text_col, source_col, block=block, keep_all=True, **how)
    text, at = col(docs, text_col), rows.columns[-1]
    pieces = F.regexp_extract_all(text, F.lit(r"([\x20\x09-\x0D]*[^\x20\x09-\x0D]+)"))
    block_of = lambda i: F.floor((F.col(f"{at}.first") + i) / block)
    some = F.array_join(F.filter(pieces, lambda _, i: selected(block_of(i), at) == 1), "")
    part = F.when((F.col(f"{at}.extra") > 0) & (F.col(f"{at}.size") > 0), F.ltrim(some))
    last, new = fresh(rows, "last_pass", "mixed_text")
    rows = rows.withColumn(last, part)
    none = F.array().cast("array<string>")
    copies = F.concat(F.array_repeat(text, F.col(f"{at}.passes").cast("int")), F.when(F.length(F.col(last)) > 0, F.array(F.col(last))).otherwise(none))
    kept = F.when(F.col(f"{at}.size") > 0, copies).otherwise(F.when(F.col(f"{at}.blocks") == 0, F.array(text)).otherwise(none))
    rows = rows.withColumn(new, F.explode(kept))
    return rows.select(*(F.col(new).alias(c) if c == text_col else col(docs, c) for c in docs.columns))
