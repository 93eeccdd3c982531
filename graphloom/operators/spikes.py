"""Implausible readings per source: isolation forests, stuck runs and physical limits.

Every reading gets features relative to its own source - level, difference to the reading before, difference to
the usual value at the same step of a run (season), length of the run of equal values - and a score of an isolation
forest trained on that source alone. A reading is flagged by
- a physical limit of its field;
- a stuck run: `stuck` or more readings in a row with the same value;
- isolation: its score reaches the source's own threshold. The threshold is fitted to the forest: it is the least
  score of the source's own readings if they lay `far` usual spreads outside a normal level (one or two), on the same
  side, and were as they are otherwise. A reading that its step of the run explains is none, however far from the level it is; a level that
  is met after a spike is none, however large the difference. An exact check follows, which only spares what lies within
  `near` spreads of a normal level or of the usual value at its step.

The forest is grown twice, the second time without the share of the sample that scores highest in the first, so that
it knows what is normal. Its trees have acceptable ranges: a node whose split feature has a point beyond the reach of the node's own
readings does not count towards the point's path, so scores go on rising outside of what was seen in training.

A source may hold any share of all rows. Readings are range-partitioned by (source, id) into partitions of about `block`
rows, so a source's readings are together and in order, in as many partitions as they need; what a partition has to know
of the ones before and behind it - the reading before, the step, the length of a run - comes from one or two summary
rows a partition, so results do not depend on `block`. Forests are trained on at most about `sample` non-null readings
per source and metric, drawn by a hash of the id (an isolation tree uses `psi` of them in any case); quantiles, seasonal
medians, counts and scores are of all readings. Models go to every task while all of them together are small
(`broadcast` bytes), else to the partitions of their source.
"""

from __future__ import annotations

import pickle
import zlib
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from ..runtime import materialize

#: Steps of a run that have a usual value of their own; later steps share the last.
SEASON = 32
#: Readings that a step needs for a usual value; with fewer, season says nothing that level does not.
SEASON_LEAST = 8
GRID = tuple(round(i / 100, 2) for i in range(1, 100))
#: Spreads up to which distances count in full.
STRAIGHT = 8.0
#: Share of a sample's readings that score highest in a first forest and are not trained on.
TRIM = 0.05
#: How often a split looks at level, difference, season and run length.
WEIGHTS = np.array([0.45, 0.1, 0.35, 0.1])
#: Width of a node's acceptable range on either side of its threshold, in widths of its readings.
REACH = 1.5


@dataclass(frozen=True)
class Rules:
    limits: Mapping[str, tuple[float, float]]
    stuck: int = 5
    far: float = 6.5
    near: float = 3.0
    sample: int = 8192
    trees: int = 24
    psi: int = 128
    block: int = 1 << 17
    broadcast: int = 32 << 20


def levels(grid: np.ndarray) -> tuple[np.ndarray, float]:
    """The one or two normal levels of a source and its usual spread about them, from its 1 %..99 % quantiles."""
    center = np.median(grid)
    spread = 1.4826 * np.median(np.abs(grid - center))
    one = (np.array([center]), max(float(spread), 1e-9 * max(1.0, abs(float(center)))))
    cut = (grid[0] + grid[-1]) / 2
    for _ in range(20):
        low, high = grid[grid <= cut], grid[grid > cut]
        if not len(low) or not len(high):
            return one
        cut, before = (low.mean() + high.mean()) / 2, cut
        if cut == before:
            break
    a, b = np.median(low), np.median(high)
    within = 1.4826 * np.median(np.concatenate([np.abs(low - a), np.abs(high - b)]))
    if min(len(low), len(high)) < 10 or b - a < 3.3 * within:
        return one
    return np.array([a, b]), max(float(within), 1e-9 * max(1.0, abs(float(b))))


def distance(x: np.ndarray, level: np.ndarray, spread: float) -> np.ndarray:
    """Signed distance to the nearest level in spreads."""
    d = (x[:, None] - level[None, :]) / spread
    return d[np.arange(len(x)), np.abs(d).argmin(axis=1)]


def features(x, before, step, run, model) -> np.ndarray:
    """level, difference, season, run length, a column each; the first three squeezed, so that a far value does not hide
    nearer ones from the forest's splits. Season is what the step of the run does not explain of the level: no
    more than the level itself, less where such readings are usual at this step."""
    level = distance(x, model["levels"], model["spread"])
    diff = np.where(np.isnan(before), 0.0, (x - before) / model["spread"])
    off = (x - model["season"][np.minimum(step, SEASON - 1)]) / model["spread"]
    off = np.where(np.abs(off) < np.abs(level), off, level)
    return np.stack([squeeze(level), squeeze(diff), squeeze(off), np.log1p(run)]).astype(np.float32).T


def squeeze(v: np.ndarray) -> np.ndarray:
    """Spreads as they are up to STRAIGHT, logarithmic beyond."""
    return np.sign(v) * (np.minimum(np.abs(v), STRAIGHT) + np.log1p(np.clip(np.abs(v) - STRAIGHT, 0, 1e9)))


def average_path(n: np.ndarray | float) -> np.ndarray:
    """Mean depth of an unsuccessful search in a binary tree of n points."""
    n = np.asarray(n, float)
    return np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + 0.5772156649) - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))


def grow(points: np.ndarray, trees: int, psi: int, seed: int) -> dict:
    """An isolation forest over points (points x features). A tree is complete: node i has the children 2i + 1 and
    2i + 2. A node splits a feature at a threshold; [low, high] is its acceptable range, the threshold give or take
    REACH times the width of its own readings. Beneath a leaf all goes left and nothing counts, to the last level, where `rest` has what
    the leaf's readings would still add to the path."""
    rng = np.random.default_rng(seed)
    points = points.T
    size = min(psi, points.shape[1])
    depth = int(np.ceil(np.log2(max(size, 2))))
    inner, last = 2**depth - 1, 2**depth
    feature, rest = np.zeros((trees, inner), np.int8), np.zeros((trees, last), np.float32)
    split = np.empty((trees, inner, 3), np.float32)
    split[:] = (np.inf, np.inf, -np.inf)  # threshold, low, high
    for t in range(trees):
        todo = [(0, points[:, rng.choice(points.shape[1], size, replace=False)], 0)]
        while todo:
            at, part, level = todo.pop()
            low, high = part.min(axis=1), part.max(axis=1)
            wide = np.flatnonzero(high > low)
            if level >= depth or part.shape[1] <= 1 or not len(wide):
                rest[t, (at + 1) * 2 ** (depth - level) - 1 - inner] = average_path(part.shape[1])
                continue
            share = WEIGHTS[wide].cumsum()
            pick, place = rng.random(2)
            f = int(wide[min(np.searchsorted(share, pick * share[-1], "right"), len(wide) - 1)])
            threshold = float(low[f] + place * (high[f] - low[f]))
            reach = REACH * float(high[f] - low[f])
            feature[t, at], split[t, at] = f, (threshold, threshold - reach, threshold + reach)
            right = part[f] >= np.float32(threshold)
            todo += [(2 * at + 1, part[:, ~right], level + 1), (2 * at + 2, part[:, right], level + 1)]
    return {"feature": feature, "split": split, "rest": rest, "depth": depth, "c": float(average_path(size)) or 1.0}


def anomaly_score(forest: dict, points: np.ndarray) -> np.ndarray:
    """2^(-mean path / c) of points (points x features): near 1 for isolated points, about 0.5 and less for usual ones."""
    n = len(points)
    flat, rows = np.ascontiguousarray(points.T, np.float32).ravel(), np.arange(n)
    total = np.zeros(n, np.float32)
    inner = 2 ** forest["depth"] - 1
    for feature, split, rest in zip(forest["feature"], forest["split"], forest["rest"]):
        offset = feature.astype(np.int64) * n
        threshold, low, high = (np.ascontiguousarray(split[:, i]) for i in range(3))
        v = flat[offset[0] : offset[0] + n]  # all points are at the root
        total += (v >= low[0]) & (v <= high[0])
        at = 1 + (v >= threshold[0])
        for _ in range(forest["depth"] - 1):
            v = flat.take(offset.take(at) + rows)
            total += (v >= low.take(at)) & (v <= high.take(at))
            at = 2 * at + 1 + (v >= threshold.take(at))
        total += rest.take(at - inner)
    return np.exp2(-(total.astype(np.float64) / len(forest["rest"])) / forest["c"])


def fitted(x: np.ndarray, before: np.ndarray, step: np.ndarray, run: np.ndarray, grid: np.ndarray, season: np.ndarray, rules: Rules, seed: int) -> dict:
    """A source's model of one metric: levels, seasonal medians, forest, and the threshold of the forest's score beyond
    each level on either side."""
    level, spread = levels(grid)
    model = {"levels": level, "spread": spread, "season": season}
    points = features(x, before, step, run, model)
    # spikes among few readings would be in every tree: the forest is grown again without what a first one sets apart
    first = anomaly_score(grow(points, max(4, rules.trees // 3), rules.psi, seed), points)
    points = points[first <= np.quantile(first, 1 - TRIM)]
    model["forest"] = grow(points, rules.trees, rules.psi, seed)
    threshold = np.full((len(level), 2), np.inf)
    squeezed = float(squeeze(np.array(rules.far)))
    for i, v in enumerate(level):
        for side, sign in enumerate((-1, 1)):
            # between two levels there may be no place so far from both
            if np.abs(v + sign * rules.far * spread - level).min() >= rules.far * spread * (1 - 1e-9):
                probes = points[: rules.psi].copy()  # usual but for level and season
                probes[:, 0] = probes[:, 2] = sign * squeezed
                threshold[i, side] = anomaly_score(model["forest"], probes).min()
    model["threshold"] = threshold
    return model


def judged(model: dict | None, x: np.ndarray, before: np.ndarray, step: np.ndarray, run: np.ndarray, rules: Rules) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(score, signed distance to the nearest level, whether it is isolated) of one source's readings of one metric."""
    n = len(x)
    if model is None:
        return np.zeros(n), np.zeros(n), np.zeros(n, bool)
    points = features(x, before, step, run, model)
    score = anomaly_score(model["forest"], points)
    off = (x[:, None] - model["levels"][None, :]) / model["spread"]
    nearest = np.abs(off).argmin(axis=1)
    d = off[np.arange(n), nearest]
    # season is no farther than the level, so this spares what is near either
    return score, d, (score >= model["threshold"][nearest, (d > 0).astype(int)]) & (np.abs(points[:, 2]) >= rules.near)


# --- readings in order


def _numbers(column: pa.ChunkedArray) -> np.ndarray:
    return column.cast(pa.float64()).fill_null(np.nan).to_numpy()


def _changes(column: pa.ChunkedArray) -> np.ndarray:
    """Whether a value differs from the one before; nulls are equal. The first does."""
    codes = column.combine_chunks().dictionary_encode(null_encoding="encode")
    codes = (codes.chunk(0) if isinstance(codes, pa.ChunkedArray) else codes).indices.to_numpy(zero_copy_only=False)
    return np.concatenate([[True], codes[1:] != codes[:-1]])


def _prepared(t: pa.Table, part: int, k: int) -> pa.Table:
    """A partition's readings, sorted by source and id: the step of each within its run, and for each metric the reading
    before and the length of its run of equal values, as far as this partition shows. open: the step counts from a run
    that may have begun earlier; edge bits: 1 for the partition's first run of values, 2 for its last, which may go on.
    border: what neighbouring partitions must know, on the first row of the partition's first and last source."""
    x = [_numbers(t.column(f"x{i}")) for i in range(k)]
    same = ~_changes(t.column("source")) & ~_changes(t.column("id")) & ~_changes(t.column("__run"))
    for v in x:
        same[1:] &= (v[1:] == v[:-1]) | (np.isnan(v[1:]) & np.isnan(v[:-1]))
    if same.any():  # repeated deliveries stand side by side
        t = t.filter(pa.array(~same))
        x = [v[~same] for v in x]
    ids, n = t.column("id").to_numpy(), t.num_rows
    new = _changes(t.column("source"))
    group = np.cumsum(new) - 1
    starts = np.flatnonzero(new)
    fresh = new | _changes(t.column("__run"))
    fresh[1:] |= ids[1:] != ids[:-1] + 1
    begin = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
    open_ = begin == 0
    out = {"id": t.column("id"), "source": t.column("source"), "part": pa.array(np.full(n, part, np.int32)), "step": pa.array((ids - ids[begin]).astype(np.int64)), "open": pa.array(open_)}
    ends = sorted({0, len(starts) - 1})
    upto = np.append(starts[1:], n)
    runs = t.column("__run")
    border = {"first_id": [], "last_id": [], "first_run": [], "last_run": [], "fresh": [], "first_v": [], "first_n": [], "last_v": [], "last_n": [], "whole": []}
    for g in ends:
        lo, hi = starts[g], upto[g]
        later = begin[hi - 1]
        border["first_id"].append(int(ids[lo])), border["last_id"].append(int(ids[hi - 1]))
        border["first_run"].append(runs[int(lo)].as_py()), border["last_run"].append(runs[int(hi - 1)].as_py())
        border["fresh"].append(int(ids[later]) if later > lo else None)
        for name in ("first_v", "first_n", "last_v", "last_n", "whole"):
            border[name].append([None] * k)
    for i, v in enumerate(x):
        ok = np.flatnonzero(~np.isnan(v))
        value, of = v[ok], group[ok]
        turn = np.ones(len(ok), bool)
        turn[1:] = (of[1:] != of[:-1]) | (value[1:] != value[:-1])
        number = np.cumsum(turn) - 1
        length = np.bincount(number) if len(ok) else np.zeros(0, np.int64)
        before, run, edge = np.full(n, np.nan), np.zeros(n, np.int64), np.zeros(n, np.int8)
        if len(ok):
            before[ok[1:]] = np.where(of[1:] == of[:-1], value[:-1], np.nan)
            run[ok] = length[number]
        for e, g in enumerate(ends):
            mine = np.flatnonzero(of == g)
            if not len(mine):
                continue
            first, last = number[mine[0]], number[mine[-1]]
            border["first_v"][e][i], border["first_n"][e][i] = float(value[mine[0]]), int(length[first])
            border["last_v"][e][i], border["last_n"][e][i] = float(value[mine[-1]]), int(length[last])
            border["whole"][e][i] = bool(first == last)
            if g == 0:
                edge[ok[number == first]] |= 1
            if g == len(starts) - 1:
                edge[ok[number == last]] |= 2
        out |= {f"x{i}": pa.array(v, mask=np.isnan(v)), f"b{i}": pa.array(before, mask=np.isnan(before)), f"n{i}": pa.array(run), f"e{i}": pa.array(edge)}
    kinds = {"first_id": pa.int64(), "last_id": pa.int64(), "first_run": runs.type, "last_run": runs.type, "fresh": pa.int64(), "first_v": pa.list_(pa.float64()), "first_n": pa.list_(pa.int64()), "last_v": pa.list_(pa.float64()), "last_n": pa.list_(pa.int64()), "whole": pa.list_(pa.bool_())}
    rows = pa.StructArray.from_arrays([pa.array(border[c], kind) for c, kind in kinds.items()], list(kinds))
    place = np.full(n, -1, np.int64)
    place[starts[ends]] = np.arange(len(ends))
    out["border"] = rows.take(pa.array(place, mask=place < 0))
    return pa.table(out)


def _readings(df: DataFrame, source: str, run: str, metrics: Sequence[str], rules: Rules) -> DataFrame:
    """The readings in order with what their own partition says of them (_prepared()), written out."""
    x = df.where(F.col(source).isNotNull() & F.col("id").isNotNull())
    x = x.select(F.col("id").cast("bigint"), F.col(source).alias("source"), F.col(run).alias("__run"), *[F.col(m).cast("double").alias(f"x{i}") for i, m in enumerate(metrics)])
    k = len(metrics)
    parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-x.count() // rules.block))
    order = ["source", "id", "__run", *[f"x{i}" for i in range(k)]]
    ranged = x.repartitionByRange(parts, "source", "id").sortWithinPartitions(*order)

    def prepare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        held = [b for b in batches if b.num_rows]
        if held:
            yield from _prepared(pa.Table.from_batches(held), TaskContext.get().partitionId(), k).to_batches(max_chunksize=1 << 16)

    kind = lambda c: x.schema[c].dataType.simpleString()
    per = ", ".join(f"x{i} double, b{i} double, n{i} bigint, e{i} tinyint" for i in range(k))
    border = f"struct<first_id:bigint,last_id:bigint,first_run:{kind('__run')},last_run:{kind('__run')},fresh:bigint,first_v:array<double>,first_n:array<bigint>,last_v:array<double>,last_n:array<bigint>,whole:array<boolean>>"
    return materialize(ranged.mapInArrow(prepare, f"id bigint, source {kind('source')}, part int, step bigint, open boolean, {per}, border {border}"), "readings")


def _carried(x: DataFrame, k: int) -> DataFrame:
    """(source, part, start, before_i, first_i, last_i): what a partition's readings get from the partitions before and
    behind: the id where an open run began, the last readings, and the whole lengths of runs of values that cross its
    borders. One or two rows a partition."""
    b = x.where(F.col("border").isNotNull()).select("source", "part", "border.*")
    w = Window.partitionBy("source").orderBy("part")
    past = w.rowsBetween(Window.unboundedPreceding, -1)
    goes_on = F.coalesce(F.lag("last_run").over(w).eqNullSafe(F.col("first_run")) & (F.lag("last_id").over(w) + 1 == F.col("first_id")), F.lit(False))
    b = b.withColumn("goes_on", goes_on).withColumn("end", F.coalesce("fresh", F.when(~F.col("goes_on"), F.col("first_id"))))
    start = F.when(F.col("goes_on"), F.last("end", ignorenulls=True).over(past))
    before = [F.last(F.col("last_v")[i], ignorenulls=True).over(past).alias(f"before{i}") for i in range(k)]
    own = b.select("source", "part", start.alias("start"), *before)
    runs = F.array(*[F.struct(F.lit(i).alias("metric"), F.lit(p).alias("last"), F.col("last_v" if p else "first_v")[i].alias("v"), F.col("last_n" if p else "first_n")[i].alias("n"), F.col("whole")[i].alias("whole")) for i in range(k) for p in (0, 1)])
    ends = b.select("source", "part", F.explode(runs).alias("r")).select("source", "part", "r.*").where("v is not null and not (whole and last = 1)")
    w = Window.partitionBy("source", "metric").orderBy("part", "last")
    turn = F.coalesce((F.lag("v").over(w) != F.col("v")) | (F.lag("part").over(w) == F.col("part")), F.lit(True))
    chain = ends.withColumn("chain", F.sum(turn.cast("int")).over(w))
    chain = chain.withColumn("total", F.sum("n").over(Window.partitionBy("source", "metric", "chain")))
    totals = [F.max(F.when((F.col("metric") == i) & ((F.col("last") == p) | F.col("whole")), F.col("total"))).alias(f"{'last' if p else 'first'}{i}") for i in range(k) for p in (0, 1)]
    return own.join(chain.groupBy("source", "part").agg(*totals), ["source", "part"], "left")


def _joined_up(x: DataFrame, carried: DataFrame, k: int) -> DataFrame:
    """The readings with what their neighbours' partitions add."""
    y = x.drop("border").join(carried, ["source", "part"], "left")
    columns = {"step": F.when(F.col("open") & F.col("start").isNotNull(), F.col("id") - F.col("start")).otherwise(F.col("step"))}
    for i in range(k):
        bit = lambda m, i=i: F.col(f"e{i}").bitwiseAND(F.lit(m).cast("tinyint")) != 0
        columns[f"b{i}"] = F.coalesce(f"b{i}", f"before{i}")
        columns[f"n{i}"] = F.coalesce(F.when(bit(1), F.col(f"first{i}")), F.when(bit(2), F.col(f"last{i}")), F.col(f"n{i}"))
    return y.withColumns(columns).select("id", "source", "part", "step", *[f"{c}{i}" for i in range(k) for c in "xbn"])


def score_readings(df: DataFrame, source: str, run: str, metrics: Sequence[str], rules: Rules) -> DataFrame:
    """(id, source, metric, value, score, distance, run_length, impossible, stuck, isolated) of every non-null reading.

    df: `id` (unique, in the order of measuring), the source column, the run column (where a new value or a gap in
    id begins a run) and the metrics. Exact repeats count once; rows with a null id or source are left out; NaN is no
    reading; an empty table gives no rows; other columns are ignored. A source with too few non-null readings
    of a metric for a forest (under 8) has score 0 there and these readings are judged by the other rules alone.
    """
    k = len(metrics)
    spark = df.sparkSession
    raw = _readings(df, source, run, metrics, rules)
    x = _joined_up(raw, materialize(_carried(raw, k), "carried"), k)
    grids = [F.percentile_approx(f"x{i}", list(GRID), 2000).alias(f"q{i}") for i in range(k)]
    # written out, so that its size is known where it meets the readings: they are not shuffled by source
    stats = raw.groupBy("source").agg(*[F.count(f"x{i}").alias(f"c{i}") for i in range(k)], *grids)
    medians = [c for i in range(k) for c in (F.count(f"x{i}").alias(f"k{i}"), F.percentile_approx(f"x{i}", 0.5, 10000).alias(f"m{i}"))]
    usual = x.groupBy("source", F.least("step", F.lit(SEASON - 1)).alias("s")).agg(*medians)
    usual = usual.groupBy("source").agg(F.collect_list(F.struct("s", *[f"{c}{i}" for i in range(k) for c in "km"])).alias("season"))
    stats = materialize(stats.join(usual, "source"), "stats")

    def fit(pdf: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        models = []
        for i in range(k):
            part = pdf[pdf[f"x{i}"].notna()].sort_values("id")
            grid = own[f"q{i}"].iloc[0]
            if grid is None or len(part) < 8:
                models.append(None)
                continue
            season = np.full(SEASON, np.nan)
            for u in own["season"].iloc[0]:
                if u[f"k{i}"] >= SEASON_LEAST:
                    season[u["s"]] = u[f"m{i}"]
            columns = [part[f"{c}{i}"].to_numpy(float) for c in "xb"]
            models.append(fitted(*columns, part["step"].to_numpy(np.int64), part[f"n{i}"].to_numpy(float), np.asarray(grid, float), season, rules, i + 1))
        return pd.DataFrame({"source": [own["source"].iloc[0]], "model": [zlib.compress(pickle.dumps(models), 1)]})

    source_type = raw.schema["source"].dataType.simpleString()
    hashed = F.pmod(F.xxhash64("id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    sample = x.join(stats.select("source", *[f"c{i}" for i in range(k)]), "source")
    for i in range(k):  # each metric draws from its own readings, so one that is rarely filled in keeps them all
        sample = sample.withColumn(f"x{i}", F.when(hashed < F.lit(float(rules.sample)) / F.col(f"c{i}"), F.col(f"x{i}")))
    sample = sample.where(F.coalesce(*[f"x{i}" for i in range(k)]).isNotNull())
    sample = sample.select("source", "id", "step", *[f"{c}{i}" for i in range(k) for c in "xbn"])
    models = sample.groupBy("source").cogroup(stats.toDF(*stats.columns).groupBy("source")).applyInPandas(fit, f"source {source_type}, model binary")
    models = materialize(models, "models")

    names = ["id", "source", "metric", "value", "score", "distance", "run_length", "isolated"]
    read = ["id", "step", *[f"{c}{i}" for i in range(k) for c in "xbn"]]

    def judge(t: pa.Table | pa.RecordBatch, source_column: pa.Array, packed: bytes | None) -> Iterator[pa.RecordBatch]:
        models_ = pickle.loads(zlib.decompress(packed)) if packed is not None else [None] * k
        for i in range(k):
            ok = pc.is_valid(t.column(f"x{i}"))
            part = t.select(["id", "step", f"x{i}", f"b{i}", f"n{i}"]).filter(ok)
            columns = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in part.columns]
            ids, step, value, before, length = columns
            x_ = value.to_numpy(zero_copy_only=False)
            score, far, isolated = judged(models_[i], x_, before.fill_null(np.nan).to_numpy(zero_copy_only=False), step.to_numpy(zero_copy_only=False), length.to_numpy(zero_copy_only=False).astype(float), rules)
            n = len(x_)
            yield pa.RecordBatch.from_arrays([ids, source_column.take(pa.array(np.zeros(n, np.int8))), pa.array(np.full(n, i, np.int32)), value, pa.array(score), pa.array(far), length, pa.array(isolated)], names)

    out = f"id long, source {source_type}, metric int, value double, score double, distance double, run_length long, isolated boolean"
    size = models.agg(F.coalesce(F.sum(F.length("model")), F.lit(0))).first()[0]
    if size <= rules.broadcast:
        known = spark.sparkContext.broadcast({r["source"]: bytes(r["model"]) for r in models.collect()})

        def judge_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                column = b.column("source")
                codes = column.dictionary_encode()
                for c, value in enumerate(codes.dictionary.to_pylist()):
                    mine = b if len(codes.dictionary) == 1 else b.filter(pc.equal(codes.indices, c))
                    yield from judge(mine.select(read), codes.dictionary.slice(c, 1), known.value.get(value))

        scored = x.select("source", *read).mapInArrow(judge_batch, out)
    else:
        placed = x.select("source", "part").distinct().join(models, "source").select("source", "part", "model").toDF("source", "part", "model")

        def judge_group(readings: pa.Table, model: pa.Table) -> pa.Table:
            packed = model.column("model")[0].as_py() if model.num_rows else None
            return pa.Table.from_batches(list(judge(readings.select(read), readings.column("source").combine_chunks().slice(0, 1), packed)))

        scored = x.groupBy("source", "part").cogroup(placed.groupBy("source", "part")).applyInArrow(judge_group, out)
    length = F.col("run_length")
    name = F.element_at(F.array(*[F.lit(m) for m in metrics]), F.col("metric") + 1)
    beyond = [(name == m) & ((F.col("value") < lo) | (F.col("value") > hi)) for m, (lo, hi) in rules.limits.items()]
    impossible = reduce(lambda a, c: a | c, beyond, F.lit(False))
    return scored.select("id", "source", name.alias("metric"), "value", "score", "distance", length, impossible.alias("impossible"), (length >= rules.stuck).alias("stuck"), "isolated")
