"""Random queries over tables, as SQL text that Spark and DuckDB both run.

A form of query is a table of clauses and the odds of each; one function draws the
clauses and writes them down. Sums and averages are of exact numbers only, nothing is
limited, and every column has an alias."""

from __future__ import annotations

import random
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import types as T

from evenbag.functions.predicates import family, predicate


@dataclass(frozen=True)
class Form:
    """weight: how often it is drawn. items: what it selects, of (schema, rng), and the
    columns it groups by. odds: of each clause it may have."""

    weight: float
    items: Callable[[T.StructType, random.Random], tuple[list[str], list[str]]]
    odds: dict[str, float] = field(default_factory=dict)
    tables: int = 1


def _some(schema: T.StructType, rng: random.Random) -> list[str]:
    """Some columns, one at least, in their order."""
    drawn = set(rng.sample(schema.names, rng.randint(1, len(schema.names))))
    return [c for c in schema.names if c in drawn]


#: name -> (types that it may be of, its text). AVG is of integers only: of those
#: both engines divide the same two numbers.
AGGREGATES = {
    "count": (lambda t: True, "CAST(COUNT({c}) AS BIGINT)"),
    "min": (lambda t: not isinstance(t, T.BooleanType), "MIN({c})"),
    "max": (lambda t: not isinstance(t, T.BooleanType), "MAX({c})"),
    "sum": (lambda t: family(t) in ("number", "decimal"), "CAST(SUM({c}) AS DECIMAL(38,{scale}))"),
    "avg": (lambda t: isinstance(t, T.IntegralType), "CAST(AVG({c}) AS DOUBLE)"),
}


def _aggregates(schema: T.StructType, rng: random.Random) -> list[str]:
    out = ["CAST(COUNT(*) AS BIGINT) AS n_rows"]
    fit = [(name, f) for f in schema if family(f.dataType) for name, (suits, _) in AGGREGATES.items() if suits(f.dataType)]
    for name, f in sorted(rng.sample(fit, min(len(fit), rng.randint(1, 5))), key=str):
        scale = f.dataType.scale if isinstance(f.dataType, T.DecimalType) else 0
        out.append(f"{AGGREGATES[name][1].format(c=f.name, scale=scale)} AS {name}_{f.name}")
    return out


def _groups(schema: T.StructType, rng: random.Random) -> tuple[list[str], list[str]]:
    may = [f.name for f in schema if family(f.dataType) not in (None, "double")]
    keys = rng.sample(may, min(len(may), rng.choice([1, 2, 2])))
    return [*keys, *_aggregates(schema, rng)], keys


FORMS = {
    "rows": Form(5, lambda s, rng: (_some(s, rng), []), {"distinct": 0.3, "where": 0.7, "order": 0.5}),
    "groups": Form(3, _groups, {"where": 0.5, "having": 0.4, "order": 0.3}),
    "totals": Form(2, lambda s, rng: (_aggregates(s, rng), []), {"where": 0.8}),
    "nested": Form(2, lambda s, rng: (_some(s, rng), []), {"inner": 0.9, "where": 0.4, "distinct": 0.1}),
    "joined": Form(6, lambda s, rng: ([f"{rng.choice('ab')}.{c} AS {c}" for c in _some(s, rng)], []), {"left": 0.5, "inner": 0.5}, tables=2),
}


def written(form: Form, names: list[str], schema: T.StructType, rng: random.Random) -> str:
    """A query of this form over the first of the names, or the first two. The two of a
    join meet on the first column of the schema, the key."""
    items, keys = form.items(schema, rng)
    has = {clause for clause, odds in form.odds.items() if rng.random() < odds}
    where = lambda: f" WHERE {predicate(schema, rng.randrange(1 << 30))}"
    source = f"(SELECT * FROM {names[0]}{where()}) AS a" if "inner" in has else f"{names[0]} a" if form.tables == 2 else names[0]
    if form.tables == 2:
        source += f" {'LEFT JOIN' if 'left' in has else 'JOIN'} {names[1]} b ON a.{schema[0].name} = b.{schema[0].name}"
    text = f"SELECT {'DISTINCT ' if 'distinct' in has else ''}{', '.join(items)} FROM {source}"
    text += where() if "where" in has else ""
    text += f" GROUP BY {', '.join(keys)}" if keys else ""
    text += f" HAVING COUNT(*) > {rng.choice('012')}" if "having" in has else ""
    order = rng.sample(keys or items, min(2, len(keys or items)))
    return text + (f" ORDER BY {', '.join(f'{c}{rng.choice(["", " DESC"])}' for c in order)}" if "order" in has else "")


def query(names: list[str], schema: T.StructType, seed: int, form: str | None = None) -> str:
    """A query over one of the names or, if there are more, perhaps a join of two."""
    rng = random.Random(seed)
    forms = {k: f for k, f in FORMS.items() if f.tables <= len(names)}
    drawn = form or rng.choices(list(forms), [f.weight for f in forms.values()])[0]
    return written(FORMS[drawn], rng.sample(names, FORMS[drawn].tables), schema, rng)


def tlp_pair(name: str, schema: T.StructType, seed: int) -> tuple[str, str]:
    """A query, and the union of its rows where p is TRUE, FALSE and NULL."""
    p = predicate(schema, seed)
    arms = (f"SELECT * FROM {name} WHERE {x}" for x in (p, f"NOT {p}", f"{p} IS NULL"))
    return f"SELECT * FROM {name}", " UNION ALL ".join(arms)


def norec_pair(name: str, schema: T.StructType, seed: int) -> tuple[str, str]:
    """The number of rows where p is TRUE, by filter and by sum."""
    p = predicate(schema, seed)
    by_sum = f"SELECT CAST(COALESCE(SUM(CASE WHEN {p} THEN 1 ELSE 0 END), 0) AS BIGINT) AS n FROM {name}"
    return f"SELECT CAST(COUNT(*) AS BIGINT) AS n FROM {name} WHERE {p}", by_sum
