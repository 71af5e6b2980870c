"""Comparison of DataFrames as bags."""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

RELATIVE, ABSOLUTE = 1e-4, 5e-4
#: So many differing rows are paired one by one on the driver; more are first paired
#: by Spark, in cells of a grid. So many of what is left are listed.
MAX_RESIDUAL, MAX_LISTED = 10_000, 10_000


@dataclass
class Difference:
    types: list[str] = field(default_factory=list)
    only_in_base: list[tuple] = field(default_factory=list)
    only_in_other: list[tuple] = field(default_factory=list)
    reconciled: int = 0
    unlisted: int = 0

    @property
    def equal(self) -> bool:
        return not (self.types or self.only_in_base or self.only_in_other or self.unlisted)


def same_types(base: DataFrame, other: DataFrame) -> list[str]:
    """What differs in names and types, in order; nullability does not count."""
    a, b = ([(f.name, f.dataType.simpleString()) for f in df.schema] for df in (base, other))
    return [f"{x} is not {y}" for x, y in zip(a, b) if x != y] + ([f"{len(a)} columns are not {len(b)}"] if len(a) != len(b) else [])


def _frozen(c: Column, t: T.DataType) -> Column:
    """A value that can be grouped by, equal just where the value is: maps as entries in
    order, variants as text, also inside arrays and structs."""
    if isinstance(t, T.MapType):
        entry = T.StructType([T.StructField("key", t.keyType), T.StructField("value", t.valueType)])
        return F.sort_array(F.transform(F.map_entries(c), lambda e: _frozen(e, entry)))
    if isinstance(t, T.VariantType):
        return F.to_json(c)
    if isinstance(t, T.ArrayType):
        return F.transform(c, lambda e: _frozen(e, t.elementType))
    if isinstance(t, T.StructType):
        return F.when(c.isNotNull(), F.struct(*(_frozen(c[f.name], f.dataType).alias(f.name) for f in t)))
    return c


def _plain(t: T.DataType) -> bool:
    return not isinstance(t, (T.MapType, T.VariantType, T.ArrayType, T.StructType))


def frozen(df: DataFrame) -> DataFrame:
    """df with columns that can be grouped by."""
    return df.select(*((F.col(f"`{f.name}`") if _plain(f.dataType) else _frozen(F.col(f"`{f.name}`"), f.dataType)).alias(f.name) for f in df.schema))


def residual(base: DataFrame, other: DataFrame) -> DataFrame:
    """Rows that the bags do not share, with surplus > 0 if base has more of them.
    One aggregation: rows are counted before the shuffle, nulls group as equals, NaN
    equals NaN and -0.0 equals 0.0."""
    signed = frozen(base).withColumn("surplus", F.lit(1)).union(frozen(other).withColumn("surplus", F.lit(-1)))
    return signed.groupBy(*(f"`{c}`" for c in base.columns)).agg(F.sum("surplus").alias("surplus")).filter("surplus <> 0")


def _number(x) -> float | None:
    """The number that a cell is, or says as text; booleans are none."""
    if isinstance(x, str):
        try:
            return float(x) if x.strip() == x and "_" not in x else None
        except ValueError:
            return None
    return float(x) if isinstance(x, (int, float, Decimal)) and not isinstance(x, bool) else None


def _close(x, y) -> bool:
    a, b = _number(x), _number(y)
    if a is not None and b is not None:
        return x == y or a == b or math.isnan(a) and math.isnan(b) or math.isfinite(a) and math.isfinite(b) and math.isclose(a, b, rel_tol=RELATIVE, abs_tol=ABSOLUTE)
    if isinstance(x, (list, tuple)) and isinstance(y, (list, tuple)):
        return len(x) == len(y) and all(map(_close, x, y))
    return x is None and y is None or type(x) is type(y) and x == y


def _cell(c: Column, t: T.DataType, shift: float) -> Column:
    """Where a value lies: numbers (and texts that say one) of a cell are close, other
    values have a cell of their own."""
    if isinstance(t, (T.NumericType, T.StringType)):
        x = c.try_cast("double")
        at = F.signum(x) * F.log1p(F.abs(x) * RELATIVE / ABSOLUTE) / RELATIVE * 2
        finite = x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
        return F.when(finite, F.concat(F.lit("#"), F.floor(at + shift).cast("string"))).otherwise(F.concat(F.lit("="), c.cast("string")))
    return c


def paired(left: DataFrame) -> DataFrame:
    """A residual after rows were paired with one of the other side in the same cells;
    twice, the second time with cells shifted by half. All rows of a cell are close, so
    it keeps what one side has more of, under the values of one of its rows. A close
    pair that both grids part stays. Aggregations only."""
    fields = [f for f in left.schema if f.name != "surplus"]
    for shift in (0.0, 0.5):
        cells = [x for f in fields for x in (_cell(F.col(f"`{f.name}`"), f.dataType, shift), F.col(f"`{f.name}`").isNull())]
        row = F.struct(*(F.col(f"`{f.name}`").alias(f"c{k}") for k, f in enumerate(fields)))
        x = left.groupBy(F.xxhash64(*cells).alias("a"), F.xxhash64(F.lit(1), *cells).alias("b"))
        x = x.agg(F.sum("surplus").alias("net"), F.max_by(row, "surplus").alias("more"), F.min_by(row, "surplus").alias("less")).filter("net <> 0")
        kept = F.when(F.col("net") > 0, F.col("more")).otherwise(F.col("less"))
        left = x.withColumn("kept", kept).select(*(F.col(f"kept.c{k}").alias(f.name) for k, f in enumerate(fields)), F.col("net").alias("surplus"))
    return left


def compare(base: DataFrame, other: DataFrame) -> Difference:
    """Types first, then rows. What is left unmatched is paired where numbers are
    close, and counted. Beyond MAX_RESIDUAL different rows Spark pairs them first; if
    more than so many still differ, the rest is only counted."""
    out = Difference(types=same_types(base, other))
    if out.types:
        return out
    left = residual(base, other)
    rows = left.limit(MAX_RESIDUAL + 1).collect()
    if len(rows) > MAX_RESIDUAL:
        before = left.agg(F.sum(F.abs("surplus"))).first()[0]
        left = paired(left)
        after = left.agg(F.sum(F.abs("surplus"))).first()[0] or 0
        out.reconciled = (before - after) // 2
        rows = left.limit(MAX_LISTED + 1).collect()
        if len(rows) > MAX_LISTED:
            out.unlisted = left.count() - MAX_LISTED
    mine, theirs = [], []
    for r in rows[:MAX_LISTED]:
        (mine if r["surplus"] > 0 else theirs).extend([tuple(r)[:-1]] * abs(r["surplus"]))
    for row in mine:
        match = next((k for k, x in enumerate(theirs) if all(map(_close, row, x))), None)
        if match is None:
            out.only_in_base.append(row)
        else:
            theirs.pop(match)
            out.reconciled += 1
    out.only_in_other = theirs
    return out
