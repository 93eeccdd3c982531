"""Percentiles per group over very large columns, by cumulative frequencies.

Values are reduced to counts per (group, bin) with map-side combine. A bin is a value's place on a logarithmic scale:
its representative differs from every value in it by at most `error` of that value, so a percentile has that relative
error, whatever the shape and the tail. A group has at most as many bins as the scale has steps between its smallest
and largest value (about 14,000 for 12 decades at 0.1 %), never as many as it has rows. With an error of 0 a bin is a
value: results are exact, and a group has as many bins as it has different values.

Frequency tables of separate partitions, days or runs are combined by adding counts (combine()); percentiles come
from the sum: range-sort by group and bin, running sums within each range partition, plus the counts that the group
has in earlier partitions, then the first bin that reaches the target rank.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..runtime import materialize


def bin_of(value: Column, error: float) -> Column:
    """Bin number: 0 for zero, i + offset for positive values between gamma^(i-1) and gamma^i, mirrored below zero;
    infinities have the outermost bins. Null and NaN have none. An error of 0 gives the value itself."""
    if not error:
        return F.when(~F.isnan(value), value + F.lit(0.0))  # -0.0 is 0.0
    log_gamma = math.log((1 + error) / (1 - error))
    top = F.lit(2**40)
    magnitude = F.ceil(F.log(F.abs(value)) / F.lit(log_gamma)) + F.lit(2**30)
    inf = F.abs(value) == F.lit(float("inf"))
    place = F.when(value == 0, F.lit(0)).when(inf, top).otherwise(magnitude)
    return F.when(value.isNotNull() & ~F.isnan(value), F.when(value < 0, -place).otherwise(place).cast("bigint"))


def value_of(bin_: Column, error: float) -> Column:
    """The representative of a bin."""
    if not error:
        return bin_
    gamma = (1 + error) / (1 - error)
    i = F.abs(bin_) - F.lit(2**30)
    size = F.when(bin_ == 0, 0.0).when(F.abs(bin_) == F.lit(2**40), float("inf")).otherwise(F.exp(i * F.lit(math.log(gamma))) * F.lit(2.0 / (gamma + 1.0)))
    return F.when(bin_ < 0, -size).otherwise(size)


def frequencies(df: DataFrame, groups: Sequence[str], value: str, error: float = 0.001) -> DataFrame:
    """(groups, bin, n): the combinable form. Null group values are groups of their own; null and NaN values are
    left out; an empty table gives an empty one."""
    binned = df.select(*groups, bin_of(F.col(value).cast("double"), error).alias("bin")).where(F.col("bin").isNotNull())
    return binned.groupBy(*groups, "bin").agg(F.count("*").alias("n"))


def combine(tables: Sequence[DataFrame], groups: Sequence[str]) -> DataFrame:
    """Sum of frequency tables with the same error; columns other than groups are added over (a day, a partition)."""
    rows = reduce(DataFrame.unionByName, [t.select(*groups, "bin", "n") for t in tables])
    return rows.groupBy(*groups, "bin").agg(F.sum("n").alias("n"))


def cumulative(freq: DataFrame, groups: Sequence[str], error: float = 0.001, partitions: int | None = None) -> DataFrame:
    """(groups, bin, n, upto, total, value): every bin with the number of values in it, up to and with it, and in its
    group, and its representative value. Counts of several such tables can be added bin by bin; any percentile can be
    read off. A group may span any number of range partitions: a window sees what a partition holds of it."""
    partitions = partitions or int(freq.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [*groups, "bin"]
    ranged = freq.repartitionByRange(partitions, *order).withColumn("__part", F.spark_partition_id())
    ranged = materialize(ranged, "ranges")  # both readers below must see the same partition numbers
    within = Window.partitionBy("__part", *groups).orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    running = ranged.withColumn("__upto", F.sum("n").over(within))
    per_part = ranged.groupBy(*groups, "__part").agg(F.sum("n").alias("__held"))
    before = Window.partitionBy(*groups).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy(*groups)
    offsets = per_part.withColumn("__offset", F.coalesce(F.sum("__held").over(before), F.lit(0))).withColumn("total", F.sum("__held").over(every))
    offsets = offsets.select(*[F.col(g).alias(f"__g{i}") for i, g in enumerate(groups)], F.col("__part").alias("__p"), "__offset", "total")
    same = [F.col(g).eqNullSafe(F.col(f"__g{i}")) for i, g in enumerate(groups)]
    placed = running.join(offsets, reduce(lambda a, b: a & b, same, F.col("__part") == F.col("__p")))
    return placed.select(*groups, "bin", "n", (F.col("__upto") + F.col("__offset")).alias("upto"), "total", value_of(F.col("bin"), error).alias("value"))


def percentiles(freq: DataFrame, groups: Sequence[str], targets: Sequence[float], error: float = 0.001, partitions: int | None = None) -> DataFrame:
    """(groups, p, n, value): the value of rank ceil(p n), at least 1, of each group's n values, with a relative
    error of at most `error`. Ties share a bin and so a value."""
    placed = cumulative(freq, groups, error, partitions)
    ranks = F.array(*[F.struct(F.lit(float(p)).alias("p"), F.greatest(F.lit(1), F.ceil(F.lit(float(p)) * F.col("total"))).alias("rank")) for p in targets])
    hit = placed.withColumn("__t", F.explode(F.filter(ranks, lambda t: (t["rank"] > F.col("upto") - F.col("n")) & (t["rank"] <= F.col("upto")))))
    return hit.select(*groups, F.col("__t.p").alias("p"), F.col("total").alias("n"), "value")
