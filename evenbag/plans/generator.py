"""Rewrites stacked to trees from one seed.

A tree grows from the root: what is asked of a node (a filter, exact columns, rows that
are written down, a tag or key channel) narrows the choice to rewrites that can give
it; one is drawn by weight, and if it declines, the next. A rewrite asks its inputs in
turn, so the arms of a union or join are rewritten each for itself."""

from __future__ import annotations

import math
import random
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from evenbag.functions.predicates import predicate
from evenbag.operators import codecs, dml, expansions, joins, layouts, partitionings, projections, windows
from evenbag.operators.base import KEY, keyed, parity_key
from evenbag.plans.barriers import checkpointed, fresh_name, named, written


@dataclass(frozen=True)
class Wanted:
    """What is asked of a node's rows. where: only rows for which it is TRUE; two are
    both to hold. columns: just these, in this order; two lists cannot be merged.
    stored: rows that are written down. channel: with an added column, tag or key."""

    where: Column | None = None
    columns: tuple[str, ...] | None = None
    stored: bool = False
    channel: str | None = None

    def merged(self, other: Wanted) -> Wanted:
        if self.columns and other.columns and self.columns != other.columns or self.channel and other.channel and self.channel != other.channel:
            raise ValueError("two lists of columns, or two channels, are asked for")
        both = [w for w in (self.where, other.where) if w is not None]
        where = both[0] & both[1] if len(both) == 2 else both[0] if both else None
        return Wanted(where, self.columns or other.columns, self.stored or other.stored, self.channel or other.channel)

    def asked(self) -> frozenset[str]:
        has = {"where": self.where is not None, "columns": self.columns is not None, "stored": self.stored, self.channel: self.channel is not None}
        return frozenset(k for k, yes in has.items() if yes)


#: A source of predicates: of (schema, seed) the text of one, or None; the same seed
#: always gives the same.
PredicateSource = Callable[[StructType, int], str | None]


@dataclass
class Tree:
    """A tree that grows: its base, the draws, what is left to spend, the steps taken."""

    base: DataFrame
    rng: random.Random
    weights: dict[str, float]
    nodes: int
    predicates: PredicateSource = predicate
    steps: list[str] = field(default_factory=list)
    lazy: int = 0

    def predicate(self) -> Column:
        """A predicate of the base's columns; IS NULL of the first if the source has none."""
        text = self.predicates(self.base.schema, self.rng.randrange(1 << 30))
        return F.expr(text) if text else F.col(self.base.columns[0]).isNull()

    def order(self, names: Iterable[str]) -> list[str]:
        """A permutation by weight: keys -ln(u) / w, lowest first; weight 0 is out."""
        weighed = [(n, self.weights.get(n, REWRITES[n].weight)) for n in names]
        return [n for _, n in sorted((-math.log(self.rng.random() or 1e-300) / w, n) for n, w in weighed if w > 0)]

    def grow(self, depth: int, wanted: Wanted = Wanted()) -> DataFrame:
        asked = wanted.asked()
        if depth > 0 and self.nodes > 0:
            for name in self.order(n for n, r in REWRITES.items() if asked <= r.gives and r.must <= asked):
                spent = len(self.steps), self.nodes
                self.nodes -= 1
                self.steps.append(name)
                try:
                    made = REWRITES[name].make(self, depth - 1, wanted)
                except ValueError:  # columns that cannot be grouped
                    made = None
                if made is not None:
                    return self.settled(made, wanted)
                del self.steps[spent[0] :]
                self.nodes = spent[1]
        return self.leaf(wanted)

    def leaf(self, wanted: Wanted) -> DataFrame:
        """The base, with what is asked for put on it plainly."""
        df = self.base if wanted.where is None else self.base.filter(wanted.where)
        if wanted.channel == "key":
            df = keyed(df)
        elif wanted.channel == "tag":
            df = df.withColumn(expansions.TAG, F.lit(expansions.KEEP))
        return self.shaped(written(df) if wanted.stored else df, wanted)

    def shaped(self, df: DataFrame, wanted: Wanted) -> DataFrame:
        """df in the names, types and order asked for: the base's, or some of them."""
        schema = self.base.schema
        own = [f for f in schema if wanted.columns is None or f.name in wanted.columns]
        if wanted.columns:
            own.sort(key=lambda f: wanted.columns.index(f.name))
        extra = {"tag": [expansions.TAG], "key": [KEY]}.get(wanted.channel, [])
        return df.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in own), *extra)

    def settled(self, df: DataFrame, wanted: Wanted) -> DataFrame:
        """df as asked; every few lazy nodes a barrier, so that plans stay short."""
        self.lazy += 1
        if self.lazy >= BARRIER_EVERY:
            self.lazy, df = 0, checkpointed(df)
        return self.shaped(df, wanted)


#: Lazy nodes between two barriers.
BARRIER_EVERY = 4
_ALL = frozenset({"where", "columns", "stored"})


@dataclass(frozen=True)
class Rewrite:
    """weight; make(tree, depth, wanted), which declines with None; what it can give if
    asked, and what it gives only (its use is to give that)."""

    weight: float
    make: Callable[[Tree, int, Wanted], DataFrame | None]
    gives: frozenset[str] = frozenset({"where", "columns"})
    must: frozenset[str] = frozenset()


def over(rewrite: Callable[[DataFrame, Tree], DataFrame | None]):
    """A rewrite of whatever its one input gives: what is asked of it, it asks below."""
    return lambda tree, depth, wanted: rewrite(tree.grow(depth, wanted), tree)


def _arms(split: Callable[[Tree], list[Column] | None]):
    """The union of one input per filter, each grown for itself."""

    def make(tree: Tree, depth: int, wanted: Wanted) -> DataFrame | None:
        filters = split(tree)
        if filters is None:
            return None
        arms = [tree.grow(depth, wanted.merged(Wanted(where=p))) for p in filters]
        out = arms[0]
        for arm in arms[1:]:
            out = out.unionByName(arm)
        return out

    return make


def _parity(tree: Tree) -> list[Column] | None:
    key = parity_key(tree.base.schema)
    return key and [F.col(key) % 2 == 0, (F.col(key) % 2 != 0) | F.col(key).isNull()]


def _truths(tree: Tree) -> list[Column]:
    p = tree.predicate()
    return [p, ~p, p.isNull()]


def _filtered(tree: Tree, depth: int, wanted: Wanted) -> DataFrame | None:
    """The filter asked for, here instead of below."""
    below = tree.grow(depth, replace(wanted, where=None, columns=None))
    return projections.determined_filter(below, tree.predicate(), wanted.where)


def _projected(tree: Tree, depth: int, wanted: Wanted) -> DataFrame | None:
    """The columns asked for, here instead of below."""
    return projections.projection(tree.grow(depth, replace(wanted, columns=None)), *(F.col(c) for c in wanted.columns))


def _halves(tree: Tree, depth: int, wanted: Wanted) -> DataFrame | None:
    """Some of the columns and the others, joined on a key that is written first; each
    half is a tree of its own over the written rows."""
    names = list(wanted.columns or tree.base.columns)
    if len(names) < 2:
        return None
    key = fresh_name("half")
    rows, half, arms = keyed(tree.grow(depth, wanted), key), len(names) // 2, []
    for some in (names[:half], names[half:]):
        part = Tree(rows.select(key, *some), tree.rng, tree.weights, min(2, tree.nodes), tree.predicates)
        arms.append(part.grow(min(depth, 1)))
        tree.steps += part.steps
    return arms[0].join(arms[1], key).select(*names)


def _expanded(reduce: list, channel: str):
    """A reduction over an input that has the channel."""
    return lambda tree, depth, wanted: tree.rng.choice(reduce)(tree.grow(depth, replace(wanted, channel=channel)))


def _deleted(tree: Tree, depth: int, wanted: Wanted) -> DataFrame:
    """DELETE and INSERT need a table of their own below."""
    return dml.delete_reinsert(tree.grow(depth, wanted.merged(Wanted(stored=True))), tree.predicate() if not wanted.columns else None)


def _tagged(rewrite):
    def make(tree: Tree, depth: int, wanted: Wanted) -> DataFrame:
        return rewrite(tree.grow(depth, replace(wanted, channel=None)))

    return make


_KEYED = [expansions.key_distinct, expansions.key_group, expansions.key_window, expansions.key_first]
_TAGGED = [expansions.tag_prune_filter, expansions.tag_prune_delete]
_STORES = [layouts.table, layouts.sorted_buckets, layouts.zstd_files, layouts.orc_files, layouts.materialized_view, layouts.range_sorted, layouts.four_shards]
REWRITES = {
    "explicit_projection": Rewrite(1, over(lambda d, t: projections.explicit_projection(d)), _ALL),
    "cte": Rewrite(1, over(lambda d, t: projections.cte(d))),
    "materialized_cte": Rewrite(1, over(lambda d, t: projections.materialized_cte(d))),
    "lateral_reproject": Rewrite(1, over(lambda d, t: projections.lateral_reproject(d))),
    "add_drop_column": Rewrite(1, over(lambda d, t: projections.add_drop_column(d))),
    "distinct_as_group_by": Rewrite(1, over(lambda d, t: projections.distinct_as_group_by(d))),
    "case_columns": Rewrite(2, lambda t, n, w: None if w.columns else projections.case_columns(t.grow(n, w), t.predicate())),
    "determined_filter": Rewrite(2, lambda t, n, w: None if w.columns else projections.determined_filter(t.grow(n, w), t.predicate())),
    "filter_here": Rewrite(3, _filtered, frozenset({"where", "columns"}), frozenset({"where"})),
    "columns_here": Rewrite(3, _projected, frozenset({"where", "columns"}), frozenset({"columns"})),
    "left_join_empty": Rewrite(1, over(lambda d, t: joins.left_join_empty(d))),
    "semi_join_keys": Rewrite(1, over(lambda d, t: joins.semi_join_keys(d))),
    "flag_join": Rewrite(2, over(lambda d, t: joins.flag_join(d, t.rng.choice(["inner", "left", "right", "full"]), t.rng.choice([None, "merge", "shuffle_hash"])))),
    "split_join": Rewrite(1, over(lambda d, t: joins.split_join(d))),
    "positional_join": Rewrite(1, over(lambda d, t: joins.positional_join(d))),
    "halves": Rewrite(1, _halves),
    "cross_join_filter": Rewrite(1, over(lambda d, t: joins.cross_join_filter(d))),
    "parity_arms": Rewrite(2, _arms(_parity)),
    "truth_arms": Rewrite(2, _arms(_truths)),
    "rank_mod_union": Rewrite(1, over(lambda d, t: partitionings.rank_mod_union(d, t.rng.choice([2, 3, 4])))),
    "union_empty": Rewrite(1, over(lambda d, t: partitionings.union_empty(d))),
    "except_empty": Rewrite(1, over(lambda d, t: partitionings.except_empty(d))),
    "intersect_self": Rewrite(1, over(lambda d, t: partitionings.intersect_self(d))),
    "distinct_union_duplicate": Rewrite(1, over(lambda d, t: partitionings.distinct_union_duplicate(d))),
    "tag_reduce": Rewrite(1, _expanded(_TAGGED, "tag")),
    "key_reduce": Rewrite(2, _expanded(_KEYED, "key")),
    "tag_explode": Rewrite(2, _tagged(expansions.tag_explode), frozenset({"where", "columns", "tag"}), frozenset({"tag"})),
    "tag_insert_extras": Rewrite(1, over(lambda d, t: expansions.tag_insert_extras(d)), frozenset({"where", "columns", "tag"}), frozenset({"tag"})),
    "key_explode": Rewrite(2, _tagged(expansions.key_explode), frozenset({"where", "columns", "key"}), frozenset({"key"})),
    "key_insert_extras": Rewrite(1, over(lambda d, t: expansions.key_insert_extras(d)), frozenset({"where", "columns", "key"}), frozenset({"key"})),
    "window_rewrite": Rewrite(1, over(lambda d, t: windows.window_rewrite(d, t.rng.choice(windows.FUNCTIONS), t.rng.choice(windows.FRAMES)))),
    "codec": Rewrite(1, over(lambda d, t: t.rng.choice([codecs.hex_codec, codecs.base64_codec, codecs.json_codec, codecs.mixed_codec])(d))),
    "pack": Rewrite(1, over(lambda d, t: t.rng.choice([codecs.array_pack, codecs.array_transform, codecs.map_pack, codecs.struct_pack])(d))),
    "delete_reinsert": Rewrite(1, _deleted),
    "noop_update": Rewrite(1, lambda t, n, w: None if w.columns else dml.noop_update(t.grow(n, w.merged(Wanted(stored=True))), t.predicate())),
    "store": Rewrite(2, lambda t, n, w: t.rng.choice(_STORES)(t.grow(n, replace(w, stored=False))), _ALL),
    "store_only": Rewrite(3, lambda t, n, w: t.rng.choice(_STORES)(t.grow(n, replace(w, stored=False))), _ALL, frozenset({"stored"})),
}


@dataclass
class Derived:
    df: DataFrame
    steps: list[str]


def derive(df: DataFrame, seed: int, depth: int = 5, weights: dict[str, float] | None = None, nodes: int = 12, wanted: Wanted = Wanted(), name: str | None = None, predicates: PredicateSource = predicate) -> Derived:
    """df's rows (those, and those columns, that are wanted) by a tree of at most
    `nodes` rewrites, `depth` deep. The same seed draws the same rewrites and
    predicates. With a name it is also a temporary view."""
    base = checkpointed(df)
    tree = Tree(base, random.Random(seed), weights or {}, nodes, predicates)
    out = tree.grow(depth, wanted)
    if name:
        out.createOrReplaceTempView(named("VIEW", name))
    return Derived(out, tree.steps)


def forks(df: DataFrame, seed: int, names: list[str], depth: int = 3) -> dict[str, Derived]:
    """Independent trees over one base under several names."""
    return {name: derive(df, seed + k, depth) for k, name in enumerate(names)}
