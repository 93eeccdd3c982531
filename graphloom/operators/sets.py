"""Set operations on result tables, by column name."""

from __future__ import annotations

from pyspark.sql import DataFrame


def intersection(a: DataFrame, b: DataFrame, every: bool = False) -> DataFrame:
    """Rows that stand in both, without repeats; every: as often as they stand in both. Nulls are equal to nulls;
    columns are matched by name, and other names in b are an error. An empty side gives no rows."""
    if sorted(a.columns) != sorted(b.columns):
        raise ValueError(f"the tables have different columns: {a.columns} and {b.columns}")
    b = b.select(*[f"`{c}`" for c in a.columns])
    return a.intersectAll(b) if every else a.intersect(b)
