"""References to records that do not exist: null-mask anti-joins with declared match semantics."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..runtime import salted_join

MATCHES = ("simple", "partial", "full")


def null_masks(keys: Sequence[str]) -> list[tuple[bool, ...]]:
    """All null patterns of a composite key, True = the column is null; 2^k of them."""
    return list(product((False, True), repeat=len(keys)))


def _both(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions)


def orphans(child: DataFrame, parent: DataFrame, keys: Sequence[tuple[str, str]], row_id: str, match: str = "simple", state: dict[str, Column] | None = None) -> DataFrame:
    """Child rows whose reference finds no parent row, with __reason 'missing' or 'mixed_null'.

    keys: (child column, parent column) pairs of one composite reference. Child rows are grouped by which of the
    reference's columns are null; each group is anti-joined on its non-null columns only:
    - simple: a reference with any null refers to nothing and is no orphan;
    - partial: the non-null columns must agree with some parent row; all null refers to nothing;
    - full: all null refers to nothing, a mix of nulls and values is itself an error ('mixed_null').
    Parent keys are reduced to distinct values before the join (partial aggregation first), and hot reference
    values are salted over row_id, so one value may hold most child rows. Rows that repeat in child repeat in the
    result. Child columns are kept, whatever they are called; parent columns other than the keys are not read.

    state: aggregates over the parent rows of one key, by name. With it the rows that do find a parent are returned
    too, with a null __reason and their parent's state: the anti-join becomes a left join that keeps what it met, so
    the child is read and shuffled once for every question about its references.
    """
    if match not in MATCHES:
        raise ValueError(f"match is one of {MATCHES}")
    columns = [c for c, _ in keys]
    found = []
    for mask in null_masks(columns):
        here = [k for k, null in zip(keys, mask) if not null]
        rows = child.where(_both([F.col(c).isNull() if null else F.col(c).isNotNull() for c, null in zip(columns, mask)]))
        if not here or (match == "simple" and any(mask)):
            continue
        if match == "full" and any(mask):
            extra = [F.lit(None).cast(t).alias(n) for n, t in _state_types(parent, state).items()]
            found.append(rows.select(*child.columns, F.lit("mixed_null").alias("__reason"), *extra))
            continue
        known = parent.where(_both([F.col(p).isNotNull() for _, p in here]))
        # a composite reference is a struct of its columns; a single one stays plain
        parts = [F.col(p).cast(child.schema[c].dataType).alias(f"__ref{i}") for i, (c, p) in enumerate(here)]
        own = [F.col(c).alias(f"__ref{i}") for i, (c, _) in enumerate(here)]
        ref, value = (parts[0], own[0]) if len(here) == 1 else (F.struct(*parts), F.struct(*own))
        rows = rows.withColumn("__ref", value)
        if state is None:
            lost = salted_join(rows, known.select(ref.alias("__ref")).distinct(), "__ref", "left_anti", F.col(row_id))
            found.append(lost.select(*child.columns, F.lit("missing").alias("__reason")))
        else:
            met = known.groupBy(ref.alias("__ref")).agg(*[a.alias(n) for n, a in state.items()]).withColumn("__met", F.lit(True))
            both = salted_join(rows, met, "__ref", "left", F.col(row_id))
            found.append(both.select(*child.columns, F.when(F.col("__met").isNull(), "missing").alias("__reason"), *state))
    if not found:
        extra = [F.lit(None).cast(t).alias(n) for n, t in _state_types(parent, state).items()]
        return child.limit(0).select("*", F.lit("missing").alias("__reason"), *extra)
    return reduce(DataFrame.unionByName, found)


def _state_types(parent: DataFrame, state: dict[str, Column] | None) -> dict[str, T.DataType]:
    return {f.name: f.dataType for f in parent.agg(*[a.alias(n) for n, a in state.items()]).schema} if state else {}


def checked(child: DataFrame, parent: DataFrame, key: tuple[str, str], row_id: str, loaded: str = "loaded_at", parent_loaded: str | None = "loaded_at", deleted: Column | None = None) -> DataFrame:
    """Bad references of a single-column key with their __reason: 'missing' (orphans()), 'deleted' (the parent row
    meets `deleted`), 'late' (the parent arrived after the child row; equal times are not late).

    Null references, and null times, are no case. The parent key is assumed unique; if it repeats, the parent
    counts as deleted if any row is, and as loaded at its earliest time. Hot references are salted.
    """
    state = {"__deleted": F.max(deleted if deleted is not None else F.lit(False)), "__since": F.min(parent_loaded) if parent_loaded else F.max(F.lit(None).cast("timestamp"))}
    rows = orphans(child, parent, [key], row_id, "simple", state)
    reason = F.coalesce("__reason", F.when(F.col("__deleted"), "deleted").when(F.col("__since") > F.col(loaded), "late"))
    return rows.withColumn("__reason", reason).where(F.col("__reason").isNotNull()).select(*child.columns, "__reason")
