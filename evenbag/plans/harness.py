"""Rounds: a base and what is derived from it must answer every query alike."""

from __future__ import annotations

import math
import random
import re
import time
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession

from .barriers import checkpointed, scope
from .compare import Difference, compare
from .generator import derive, forks
from .shape import PlanLog, fingerprint, operators
from .workload import query

PASS, MISMATCH, ERROR, KNOWN, UNCOMPARABLE = "pass", "mismatch", "error", "known issue", "uncomparable"
#: Names of the tables in a round's queries: one, or one for each fork.
TABLE = "t"


@dataclass
class Verdict:
    """pass, mismatch, error (only the derived side fails), known issue (it fails as a
    pattern says it may) or uncomparable (the base fails, which says nothing)."""

    query: str
    verdict: str
    difference: Difference | None = None
    error: str = ""
    plans: tuple[str, str] = ("", "")


@dataclass
class Round:
    seed: int
    depth: int
    names: list[str]
    steps: dict[str, list[str]]
    rows_equal: dict[str, bool] = field(default_factory=dict)
    verdicts: list[Verdict] = field(default_factory=list)
    error: str = ""

    @property
    def equal(self) -> bool:
        """Whether rows and types of all that is derived are those of the base."""
        return not self.error and all(self.rows_equal.values())

    @property
    def findings(self) -> list[Verdict]:
        return [v for v in self.verdicts if v.verdict in (MISMATCH, ERROR)]

    def header(self) -> str:
        return f"-- seed {self.seed}: " + "; ".join(f"{n}: {' > '.join(s) or 'plain'}" for n, s in self.steps.items())

    def journal(self) -> Iterator[str]:
        yield self.header()
        for v in self.verdicts:
            yield from entry(v)


def entry(v: Verdict) -> tuple[str, str]:
    return f"{v.query};", f"-- => {v.verdict}"


class Journal:
    """A file of rounds as they go: every line is on disk before the next query runs, so
    a crash loses none that is known."""

    def __init__(self, path: str | Path):
        self.path = Path(path)

    def add(self, *lines: str) -> None:
        with self.path.open("a") as f:
            for line in lines:
                f.write(line + "\n")
                f.flush()


def read_journal(text: str) -> list[tuple[str, str]]:
    """(query, verdict) of a journal; a last entry that was cut off is left out."""
    out, lines = [], []
    for line in text.splitlines():
        if line.startswith("-- => "):
            out.append(("\n".join(lines).rstrip(";"), line[6:]))
            lines = []
        elif not line.startswith("--"):
            lines.append(line)
    return out


def corpus(text: str, seed: int | None = None) -> list[str]:
    """The queries of a text, which ; divides but in quotes; with a seed, in its order."""
    found = (m[0].strip() for m in re.finditer(r"(?:'[^']*'|\"[^\"]*\"|--[^\n]*|[^;'\"])+", text))
    out = [q for q in found if re.sub(r"--[^\n]*", "", q).strip()]
    if seed is not None:
        random.Random(seed).shuffle(out)
    return out


def accepted(spark: SparkSession, text: str, **tables: DataFrame) -> bool:
    """Whether Spark can analyse a query, without running it."""
    try:
        spark.sql(text, **tables).schema
    except PySparkException:
        return False
    return True


def _side(text: str, tables: dict[str, DataFrame]) -> tuple[DataFrame | None, str, str]:
    """(rows, plan, error) of a query over these tables. The rows are written, so that
    what fails while it runs fails here."""
    spark = next(iter(tables.values())).sparkSession
    try:
        df = spark.sql(text, **tables)
        rows = checkpointed(df)
    except PySparkException as e:
        return None, "", str(e)[:2000]
    return rows, fingerprint(df), ""


def judge(base: DataFrame | dict[str, DataFrame], other: DataFrame | dict[str, DataFrame], text: str, known: Sequence[str] = (), plans: PlanLog | None = None) -> Verdict:
    """One query, its {names} filled in with either side, each run by itself. An error of
    the derived side alone that a pattern of `known` finds is a known issue."""
    sides = [_side(text, x if isinstance(x, dict) else {TABLE: x, "table": x} if "{table}" in text else {TABLE: x}) for x in (base, other)]
    (mine, plan_a, fails), (theirs, plan_b, failed) = sides
    if mine is None:
        return Verdict(text, UNCOMPARABLE, error=fails)
    if theirs is None:
        return Verdict(text, KNOWN if any(re.search(k, failed) for k in known) else ERROR, error=failed, plans=(plan_a, plan_b))
    if plans is not None:
        plans.see(plan_b, len(operators(theirs)), text)
    found = compare(mine, theirs)
    return Verdict(text, PASS if found.equal else MISMATCH, found, plans=(plan_a, plan_b))


def compare_forks(base: DataFrame, made: dict[str, DataFrame]) -> dict[str, bool]:
    """For each name whether its rows and types are the base's."""
    return {name: compare(base, df).equal for name, df in made.items()}


QuerySource = Callable[[list[str], int], Iterator[str]]


def workload_source(df: DataFrame) -> QuerySource:
    """The random queries of plans.workload over the names of a round."""

    def queries(names: list[str], seed: int) -> Iterator[str]:
        k = 0
        while True:
            yield query([f"{{{n}}}" for n in names], df.schema, seed * 1000 + k)
            k += 1

    return queries


def run_round(df: DataFrame, seed: int, depth: int = 4, queries: int | Iterable[str] = 5, copies: int = 1, source: QuerySource | None = None, journal: Journal | None = None, known: Sequence[str] = (), seconds: float = math.inf, plans: PlanLog | None = None, derived: Callable | None = None) -> Round:
    """Derive one table, or `copies` forks of it; compare all rows and types; then judge
    queries, in which {t}, or {t0}, {t1} ..., stand for the base on one side and for what
    is derived on the other. Ends after `seconds`. What the round made is dropped."""
    names = [TABLE] if copies == 1 else [f"{TABLE}{k}" for k in range(copies)]
    out = Round(seed, depth, names, {})
    with scope(df.sparkSession):
        base, until = checkpointed(df), time.monotonic() + seconds
        try:
            made = {TABLE: (derived or derive)(base, seed, depth)} if copies == 1 else forks(base, seed, names, depth)
            out.steps = {n: d.steps for n, d in made.items()}
            other = {n: checkpointed(d.df) if derived else d.df for n, d in made.items()}
            out.rows_equal = compare_forks(base, other)
        except PySparkException as e:
            out.error = str(e)[:2000]
        if journal:
            journal.add(out.header())
        if not out.equal:
            return out
        texts = iter(queries) if not isinstance(queries, int) else (q for _, q in zip(range(queries), (source or workload_source(df))(names, seed)))
        for text in texts:
            if time.monotonic() > until:
                break
            if journal:
                journal.add(f"{text};")
            v = judge(dict.fromkeys(names, base) | {"table": base}, other | {"table": next(iter(other.values()))}, text, known, plans)
            out.verdicts.append(v)
            if journal:
                journal.add(entry(v)[1])
    return out


def sweep(df: DataFrame, rewrite, seeds: Iterable[int]) -> dict[int, bool]:
    """Whether one rewrite of (df, seed) keeps the rows, by seed."""
    return {s: compare(df, rewrite(df, s)).equal for s in seeds}


@dataclass
class Report:
    """Totals over rounds."""

    rounds: int = 0
    not_derived: int = 0
    not_equal: int = 0
    queries: int = 0
    verdicts: dict[str, int] = field(default_factory=dict)
    tolerated_queries: int = 0
    tolerated_rows: int = 0
    plans: set[str] = field(default_factory=set)

    def add(self, r: Round) -> None:
        self.rounds += 1
        self.not_derived += bool(r.error)
        self.not_equal += not r.error and not r.equal
        for v in r.verdicts:
            self.queries += 1
            self.verdicts[v.verdict] = self.verdicts.get(v.verdict, 0) + 1
            noisy = v.difference.reconciled if v.difference else 0
            self.tolerated_queries += noisy > 0
            self.tolerated_rows += noisy
            self.plans |= {p for p in v.plans if p}

    def lines(self) -> list[str]:
        told = ", ".join(f"{n} {v}" for v, n in sorted(self.verdicts.items())) or "none"
        return [f"{self.rounds} rounds, {self.not_derived} not derived, {self.not_equal} with other rows", f"{self.queries} queries: {told}", f"{self.tolerated_rows} rows in {self.tolerated_queries} queries equal but for noise", f"{len(self.plans)} different plans"]


#: The most differing rows that a finding shows, and rows of a base written into it.
SHOWN, EMBEDDED = 32, 200


def repro(base: DataFrame, r: Round, v: Verdict, recipe: str | None = None) -> str:
    """A script that builds the base, derives from it again and runs the query on both
    sides. recipe: an expression that gives the base from `spark`; without one the
    rows are written into the script, if they are EMBEDDED at most."""
    if recipe is None:
        rows = base.limit(EMBEDDED + 1).collect()
        if len(rows) > EMBEDDED:
            raise ValueError(f"a base of more than {EMBEDDED} rows needs a recipe")
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema)
        recipe = f"spark.createDataFrame({[tuple(x) for x in rows]!r}, {schema!r})"
    tables = "derive(base, {0}, {1}).df".format(r.seed, r.depth)
    made = f"{{'{TABLE}': {tables}}}" if r.names == [TABLE] else f"{{n: d.df for n, d in forks(base, {r.seed}, {r.names!r}, {r.depth}).items()}}"
    shown = [f"# {side}: {row!r}" for side, rows in (("only base", v.difference.only_in_base), ("only derived", v.difference.only_in_other)) for row in rows[:SHOWN]] if v.difference else []
    error = [f"# {line}" for line in v.error.splitlines()[:20]]
    return "\n".join([
        f'"""{v.verdict}: seed {r.seed}, {r.steps}"""', *error, *shown,
        "import datetime", "from datetime import date", "from decimal import Decimal", "from pyspark.sql import Row, SparkSession",
        "from evenbag.plans.barriers import checkpointed", "from evenbag.plans.generator import derive, forks", "from evenbag.plans.harness import judge", "from evenbag.sources import tables",
        "inf, nan = float('inf'), float('nan')",
        "spark = SparkSession.builder.getOrCreate()", f"base = checkpointed({recipe})", f"made = {made}",
        f"found = judge(dict.fromkeys(made, base), made, {v.query!r})", "print(found.verdict, found.error, found.difference)", "",
    ])


def write_findings(folder: str | Path, base: DataFrame, r: Round, recipe: str | None = None) -> list[Path]:
    """A script for each finding of a round, and a line for each in index.txt."""
    folder = Path(folder)
    folder.mkdir(parents=True, exist_ok=True)
    out = []
    for v in r.findings:
        path = folder / f"finding_{len(list(folder.glob('finding_*.py'))):04d}.py"
        path.write_text(repro(base, r, v, recipe))
        with (folder / "index.txt").open("a") as f:
            f.write(f"{path.name}\t{v.verdict}\tseed {r.seed}\t{' '.join(v.query.split())}\n")
        out.append(path)
    return out
