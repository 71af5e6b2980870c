"""The plans that ran: their operators, their fingerprints, a file of those seen."""

from __future__ import annotations

import csv
import hashlib
import re
from pathlib import Path

from pyspark.sql import DataFrame


def operators(df: DataFrame) -> list[str]:
    """The operators of the plan that Spark chose, top down, without their details. Of a
    DataFrame that has run it is the plan that ran: after adaptive execution changed
    it. Else it is the plan that it would begin with."""
    plan = df._jdf.queryExecution().executedPlan()
    while plan.getClass().getSimpleName() in ("AdaptiveSparkPlanExec", "ResultQueryStageExec"):
        plan = plan.executedPlan() if plan.getClass().getSimpleName() == "AdaptiveSparkPlanExec" else plan.plan()
    return [m[1] for line in plan.toString().splitlines() if (m := re.match(r"[\s:+\-|*()\d]*([A-Z]\w+)", line))]


def ran(df: DataFrame) -> list[str]:
    """operators() of df's final plan: it is computed here, its rows thrown away."""
    df._jdf.queryExecution().toRdd().count()
    return operators(df)


def fingerprint(df: DataFrame) -> str:
    return hashlib.sha1("\n".join(operators(df)).encode()).hexdigest()


class PlanLog:
    """The different plans met so far, one line of a CSV file each: fingerprint, number
    of operators, the first query. What the file already has is known."""

    def __init__(self, path: str | Path):
        self.path = Path(path)
        self.known: set[str] = set()
        if self.path.exists():
            with self.path.open(newline="") as f:
                self.known = {row["fingerprint"] for row in csv.DictReader(f)}
        else:
            self.path.write_text("fingerprint,operators,query\n")

    def see(self, mark: str, size: int, query: str) -> bool:
        """Whether this plan is new."""
        if mark in self.known:
            return False
        self.known.add(mark)
        with self.path.open("a", newline="") as f:
            csv.writer(f).writerow([mark, size, query])
        return True
