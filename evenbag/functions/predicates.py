"""Random typed predicates over a table's columns.

The text runs unchanged on Spark and, after for_duckdb(), on DuckDB, and is the same
for the same seed. It has no cast that can fail, no division and no subquery, so no
plan can raise. What a column may stand in depends on the family of its type."""

from __future__ import annotations

import random
import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import types as T

#: Literals of each family, as SQL.
LITERALS = {
    "number": ["0", "3", "-2", "17", "-49", "1000"],
    "decimal": ["0.00", "1.25", "-500.25", "1499.75"],
    "double": ["CAST(0 AS DOUBLE)", "CAST(0.125 AS DOUBLE)", "CAST(-25 AS DOUBLE)", "CAST(99.5 AS DOUBLE)"],
    "text": ["''", "'a'", "'b'", "'Zed'", "'o''brien'", "'trailing '"],
    "date": ["DATE '1992-02-29'", "DATE '1995-01-01'", "DATE '1998-08-02'"],
    "time": ["TIMESTAMP_NTZ '1993-03-03 03:03:03'", "TIMESTAMP_NTZ '1996-12-31 00:00:00'"],
    "truth": ["TRUE", "FALSE"],
}
PATTERNS = ["'%'", "'%a%'", "'Z%'", "'%g '", "'__c'", "'%''%'"]
COMPARISONS = ["=", "<>", "<", "<=", ">", ">="]
ORDERED = frozenset(LITERALS) - {"truth"}

#: The scalar functions, by family of their first argument, with {a} and
#: {b} for columns of that family, and the family of the result. ceil and floor of
#: doubles are guarded, as infinities have no whole number.
FUNCTIONS = {
    "number": [("abs({a})", "number"), ("greatest({a}, {b})", "number"), ("least({a}, {b})", "number"), ("coalesce({a}, {b})", "number"), ("nullif({a}, {b})", "number"), ("ifnull({a}, {b})", "number"), ("CAST(sign({a}) AS INT)", "number"), ("CAST({a} AS STRING)", "text")],
    "decimal": [("abs({a})", "decimal"), ("greatest({a}, {b})", "decimal"), ("least({a}, {b})", "decimal"), ("CAST(ceil({a}) AS DECIMAL(20,2))", "decimal"), ("CAST(floor({a}) AS DECIMAL(20,2))", "decimal"), ("CAST(sign({a}) AS INT)", "number"), ("coalesce({a}, {b})", "decimal"), ("nullif({a}, {b})", "decimal")],
    "double": [("abs({a})", "double"), ("greatest({a}, {b})", "double"), ("least({a}, {b})", "double"), ("CAST(sign({a}) AS INT)", "number"), ("CASE WHEN abs({a}) < 1000000 THEN CAST(ceil({a}) AS DOUBLE) END", "double"), ("CASE WHEN abs({a}) < 1000000 THEN CAST(floor({a}) AS DOUBLE) END", "double")],
    "text": [
        ("length({a})", "number"), ("char_length({a})", "number"), ("upper({a})", "text"), ("lower({a})", "text"), ("initcap({a})", "text"), ("trim({a})", "text"), ("ltrim({a})", "text"), ("rtrim({a})", "text"), ("reverse({a})", "text"), ("replace({a}, 'a', 'bb')", "text"), ("substr({a}, 2)", "text"), ("substr({a}, 1, 2)", "text"),
        ("instr({a}, 'e')", "number"), ("position('r' IN {a})", "number"), ("ascii({a})", "number"), ("hex({a})", "text"), ("greatest({a}, {b})", "text"), ("least({a}, {b})", "text"), ("coalesce({a}, {b})", "text"), ("nullif({a}, {b})", "text"), ("ifnull({a}, {b})", "text"), ("startswith({a}, 'a')", "truth"), ("endswith({a}, 'n')", "truth"),
    ],
    "truth": [("greatest({a}, {b})", "truth"), ("least({a}, {b})", "truth"), ("coalesce({a}, {b})", "truth"), ("nullif({a}, {b})", "truth"), ("CAST({a} AS STRING)", "text")],
}


def family(t: T.DataType) -> str | None:
    """The family of a type; None for those that cannot be ordered or compared."""
    if isinstance(t, T.IntegralType) or isinstance(t, T.DecimalType) and t.scale == 0:
        return "number"
    kinds = {T.DecimalType: "decimal", T.DoubleType: "double", T.StringType: "text", T.DateType: "date", T.TimestampNTZType: "time", T.BooleanType: "truth"}
    return kinds.get(type(t))


@dataclass
class Place:
    """A column to write an atom about."""

    rng: random.Random
    column: str
    kind: str | None
    peers: list[str]

    def peer(self) -> str:
        return self.rng.choice(self.peers)

    def literal(self, kind: str | None = None) -> str:
        return self.rng.choice(LITERALS[kind or self.kind])

    def comparison(self) -> str:
        return self.rng.choice(COMPARISONS)

    def negated(self) -> str:
        return self.rng.choice(["", "NOT "])

    def call(self) -> str:
        text, kind = self.rng.choice(FUNCTIONS[self.kind])
        call = text.format(a=self.column, b=self.peer())
        return call if kind == "truth" else f"{call} {self.comparison()} {self.literal(kind)}"


@dataclass(frozen=True)
class Shape:
    """A kind of atom: how often it is drawn, what families it suits, its text."""

    weight: float
    suits: Callable[[str | None], bool]
    text: Callable[[Place], str]


SHAPES = (
    Shape(3, lambda kind: True, lambda p: f"{p.column} IS {p.negated()}NULL"),
    Shape(4, lambda kind: kind in ORDERED, lambda p: f"{p.column} {p.comparison()} {p.literal()}"),
    Shape(2, lambda kind: kind in ORDERED, lambda p: f"{p.column} {p.comparison()} {p.peer()}"),
    Shape(2, lambda kind: kind in ORDERED, lambda p: f"{p.column} {p.negated()}BETWEEN {p.literal()} AND {p.literal()}"),
    Shape(2, lambda kind: kind is not None, lambda p: f"{p.column} {p.negated()}IN ({', '.join(p.literal() for _ in range(p.rng.choice([2, 2, 4])))})"),
    Shape(2, lambda kind: kind is not None, lambda p: f"{p.column} IS {p.negated()}DISTINCT FROM {p.rng.choice([p.peer, p.literal])()}"),
    Shape(2, lambda kind: kind == "text", lambda p: f"{p.column} {p.negated()}LIKE {p.rng.choice(PATTERNS)}"),
    Shape(2, lambda kind: kind == "number", lambda p: f"MOD({p.column}, 2) {p.rng.choice(['=', '<>'])} {p.rng.choice('01')}"),
    Shape(4, lambda kind: kind in FUNCTIONS, Place.call),
    Shape(3, lambda kind: kind == "truth", lambda p: f"{p.negated()}{p.column}"),
)


def atom(schema: T.StructType, rng: random.Random) -> str:
    """One test of a column, of the shapes that its type allows: any type may be asked
    for NULL, those that can be ordered may be compared."""
    f = rng.choice(list(schema))
    kind = family(f.dataType)
    place = Place(rng, f.name, kind, [g.name for g in schema if family(g.dataType) == kind])
    fit = [s for s in SHAPES if s.suits(kind)]
    return rng.choices(fit, [s.weight for s in fit])[0].text(place)


def predicate(schema: T.StructType, seed: int, atoms: int = 4) -> str:
    """Up to `atoms` atoms, joined two by two with AND or OR and negated now and then;
    every operand stands in brackets."""
    rng = random.Random(seed)
    parts = [f"({atom(schema, rng)})" for _ in range(rng.randint(1, atoms))]
    while len(parts) > 1:
        k = rng.randrange(len(parts) - 1)
        parts[k : k + 2] = [f"({parts[k]} {rng.choice(['AND', 'OR'])} {parts[k + 1]})"]
        if rng.random() < 0.3:
            parts[k] = f"(NOT {parts[k]})"
    return parts[0]


def for_duckdb(text: str) -> str:
    """The same in DuckDB's words; initcap it does not have."""
    for ours, theirs in (("TIMESTAMP_NTZ '", "TIMESTAMP '"), ("startswith(", "starts_with("), ("endswith(", "ends_with(")):
        text = text.replace(ours, theirs)
    word = "upper(substr(w, 1, 1)) || substr(w, 2)"
    return re.sub(r"initcap\((\w+)\)", rf"array_to_string(list_transform(string_split(lower(\1), ' '), lambda w: {word}), ' ')", text)
