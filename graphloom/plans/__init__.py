"""Facts of a physical plan, for tests and for looking at what Catalyst made of a query."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame


@dataclass(frozen=True)
class PlanFacts:
    text: str
    exchanges: int
    products: int
    python: int
    read: frozenset[str]
    pushed: tuple[str, ...]


def facts(df: DataFrame) -> PlanFacts:
    """Exchanges, nested-loop and Cartesian joins, Python stages, columns read and filters pushed to the scans, of the
    plan before it runs."""
    text = df._jdf.queryExecution().executedPlan().toString()
    read = {c.split(":")[0] for schema in re.findall(r"ReadSchema: struct<(.*?)>(?:,|\n|$)", text) for c in schema.split(",") if c}
    pushed = tuple(p for group in re.findall(r"PushedFilters: \[(.*?)\], ", text) if (p := group))
    return PlanFacts(text, len(re.findall(r"Exchange (?:hash|range|Single|Round)", text)), len(re.findall(r"CartesianProduct|BroadcastNestedLoopJoin", text)), len(re.findall(r"MapInArrow|MapInPandas|InArrow|InPandas|EvalPython", text)), frozenset(read), pushed)
