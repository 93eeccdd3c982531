"""Session helpers: table access, the shared folder for intermediate tables, exact-repeat removal."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

_written: list[tuple[SparkSession, str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table `name` of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """Folder that all executors share, from spark.checkpoint.dir. Where that is unset, a session on one machine gets a
    temporary folder; on a cluster it is an error, since a machine's own folder is not the others'."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = spark.sparkContext.getCheckpointDir()
    if not folder:
        master = spark.sparkContext.master
        if not re.match(r"local(-cluster)?(\[|$)", master):
            raise ValueError(f"spark.checkpoint.dir is unset; {master} needs a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="graphloom-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def materialize(df: DataFrame, label: str = "step") -> DataFrame:
    """Writes df as a Parquet table in the shared folder and reads it back: lineage ends there, so a lost
    executor costs a re-read and not a recomputation. The table is removed when the session ends, or at the end of
    the scratch() block that it was written in."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/graphloom/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def written_lines(df: DataFrame, label: str, path: str = "") -> str:
    """Writes the single text column of df as lines to the shared folder, by default to a path that is removed like
    materialize()'s."""
    path = path or fresh_path(df.sparkSession, label)
    df.write.text(path)
    return path


def fresh_path(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that is removed like materialize()'s tables."""
    path = f"{shared_dir(spark)}/graphloom/{label}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def _remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def cleanup() -> None:
    """Removes the tables that materialize() wrote, as far as their sessions are alive."""
    while _written:
        spark, path = _written.pop()
        try:
            _remove(spark, path)
        except Exception:  # the session has ended; its folder is the cluster's to clear
            pass


@contextmanager
def scratch() -> Iterator[None]:
    """Tables that materialize() writes inside the block are removed at its end: use up or store the block's results
    within it. Long sessions keep the shared folder small by it."""
    before = len(_written)
    try:
        yield
    finally:
        while len(_written) > before:
            _remove(*_written.pop())


def dropped(df: DataFrame) -> None:
    """Removes a table of materialize() that nothing reads any more."""
    names = {f.rpartition("/")[0].rpartition("/")[2] for f in df.inputFiles()}
    for entry in [e for e in _written if e[1].rpartition("/")[2] in names]:
        _written.remove(entry)
        _remove(*entry)


atexit.register(cleanup)


def distinct_rows(df: DataFrame, *columns: str) -> DataFrame:
    """Rows without exact repeats (all columns equal, nulls equal to nulls). One hash aggregate with map-side
    combine; the shuffle key is the whole row, so no key can be hot. With `columns` only these are kept, and the row's
    64-bit hash stands for the others on the way."""
    if not columns:
        return df.dropDuplicates()
    return df.select(*columns, row_hash(df).alias("__hash")).dropDuplicates().drop("__hash")


def row_hash(df: DataFrame) -> Column:
    """64-bit hash of all columns. xxhash64 skips nulls, so each column's null flag is hashed as well."""
    return F.xxhash64(*[c for n in df.columns for c in (F.col(f"`{n}`"), F.col(f"`{n}`").isNull())])


def hot_keys(df: DataFrame, key: str, share: float = 0.01) -> DataFrame:
    """Values of `key` in at least `share` of the non-null rows: at most 1/share rows, whatever the input."""
    counts = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("__n"))
    total = counts.agg(F.sum("__n")).scalar()
    return counts.where(F.col("__n") >= F.lit(share) * total).select(key)


def salted_join(left: DataFrame, right: DataFrame, key: str, how: str, salt_on: Column, share: float = 0.01, salts: int = 16) -> DataFrame:
    """Equi-join on one key, where a few key values hold much of `left`: rows of hot keys get one of `salts`
    salts, and the right rows of hot keys are repeated once per salt. Only the list of hot keys (at most 1/share
    rows, 100 by default) is broadcast. Other keys join unsalted. how: inner, left, left_semi or left_anti."""
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"salted_join cannot do {how}")
    hot = F.broadcast(hot_keys(left, key, share).withColumn("__hot", F.lit(True)))
    lsalt = F.when(F.col("__hot"), F.pmod(F.xxhash64(salt_on), F.lit(salts)).cast("int")).otherwise(F.lit(0))
    rsalt = F.when(F.col("__hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    lefts = left.join(hot, key, "left").withColumn("__salt", lsalt).drop("__hot")
    rights = right.join(hot, key, "left").withColumn("__salt", F.explode(rsalt)).drop("__hot")
    return lefts.join(rights, [key, "__salt"], how).drop("__salt")


def followed(df: DataFrame, group: str, order: list[str], value: str, name: str) -> DataFrame:
    """df with `name`: the value of the next row of the same group in `order` (unique within a group), null at its end.
    Rows are range-partitioned by group and order, so a group that holds most rows is worked in as many partitions as
    it needs; a partition's last row of a group gets its value from the next partition's first, one row a partition."""
    n = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    ranged = materialize(df.repartitionByRange(n, group, *order).withColumn("__part", F.spark_partition_id()), "ranged")
    w = Window.partitionBy("__part", group).orderBy(*order)
    inside = ranged.withColumn(name, F.lead(value).over(w)).withColumn("__last", F.lead(F.lit(True)).over(w).isNull())
    firsts = ranged.groupBy("__part", group).agg(F.min_by(F.struct(value), F.struct(*order)).alias("__first"))
    after = firsts.select("__part", F.col(group).alias("__group"), F.lead(f"__first.{value}").over(Window.partitionBy(group).orderBy("__part")).alias("__next"))
    joined = inside.join(after.withColumnRenamed("__part", "__of"), (F.col("__part") == F.col("__of")) & F.col(group).eqNullSafe(F.col("__group")), "left")
    return joined.withColumn(name, F.when(F.col("__last"), F.col("__next")).otherwise(F.col(name))).select(*df.columns, name)
