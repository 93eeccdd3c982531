"""Attribute-value rows into wide typed tables: combineByKey with per-entity slot registers.

Names and values are read on the JVM side (functions.readable); what remains of a row is (entity, slot, time, order,
value). An entity's combiner is a set of slot registers, each holding the latest readable value; setting a register
and merging two sets are associative and commutative, so duplicates fall away on the map side and an entity's row
count never reaches one task. A typed encoder turns the registers into one full row per entity.
"""

from __future__ import annotations

import datetime
import decimal
from collections.abc import Callable, Iterator, Mapping, Sequence

import pyarrow as pa
from pyspark import RDD
from pyspark.sql import DataFrame, Row, functions as F, types as T

from ..functions.readable import name_key, with_text

SQL_TYPES = {"long": T.LongType(), "decimal": T.DecimalType(20, 2), "boolean": T.BooleanType(), "date": T.DateType(), "string": T.StringType()}
ENCODERS: dict[str, Callable[[str], object]] = {
    "long": int,
    "decimal": decimal.Decimal,
    "boolean": lambda s: s == "true",
    "date": datetime.date.fromisoformat,
    "string": str,
}


def _first(cell: tuple) -> dict:
    return {cell[0]: cell[1:]}


def _set(registers: dict, cell: tuple) -> dict:
    held = registers.get(cell[0])
    if held is None or held < cell[1:]:
        registers[cell[0]] = cell[1:]
    return registers


def _merge(a: dict, b: dict) -> dict:
    if len(a) < len(b):
        a, b = b, a
    for slot, value in b.items():
        held = a.get(slot)
        if held is None or held < value:
            a[slot] = value
    return a


def typed_cells(rows: DataFrame, attributes: DataFrame, entity: Sequence[str], attr: str, val: str, time: str, order: str, kind: str) -> DataFrame:
    """Readable cells: entity columns, canonical attribute name, its type, time, order, and the value's one written
    form. `attributes` (kind, attr, val_type) is the fixed dictionary of the wide table; unknown names, unreadable
    values and null entities give no cell. It joins on (kind, name key); Spark broadcasts it if its size allows."""
    known = attributes.select(F.col(kind).alias("__kind"), name_key(F.col(attr)).alias("__name"), F.col(attr).alias("__attr"), F.col("val_type").alias("__type"))
    x = rows.select(*[F.col(c) for c in entity], F.col(kind).alias("__kind0"), name_key(F.col(attr)).alias("__name0"), F.col(val).alias("__val"), F.col(time).alias("__time"), F.col(order).alias("__order"))
    x = x.join(known, (F.col("__kind0") == F.col("__kind")) & (F.col("__name0") == F.col("__name")))
    ok = F.col("__text").isNotNull()
    for c in entity:
        ok = ok & F.col(c).isNotNull()
    return with_text(x, "__val", F.col("__type"), "__text").where(ok).select(*entity, "__attr", "__type", "__time", "__order", "__text")


def registers(cells: DataFrame, entity: Sequence[str], slots: dict[str, int], partitions: int | None = None) -> RDD:
    """(entity, {slot: (time, order, text)}) of cells whose attribute has a slot: the one combineByKey over them."""
    spark, size = cells.sparkSession, len(entity)
    partitions = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    micros = F.coalesce(F.unix_micros(F.col("__time").cast("timestamp")), F.lit(-(2**63)))  # plain ints compare and pickle cheaply
    place = F.create_map(*[F.lit(x) for name, slot in slots.items() for x in (name, slot)])[F.col("__attr")]
    order = F.coalesce(F.col("__order").cast("bigint"), F.lit(-(2**63)))
    slim = cells.select(*[F.col(c).cast("string") for c in entity], place.alias("__s"), micros.alias("__t"), order.alias("__o"), "__text").where(F.col("__s").isNotNull())

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, b.schema) as out:
                    out.write_batch(b)
                yield pa.RecordBatch.from_arrays([pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["packed"])

    def keyed(row: Row) -> Iterator[tuple]:
        b = pa.ipc.open_stream(row[0]).read_next_batch()
        columns = [c.to_pylist() for c in b.columns]
        return zip(zip(*columns[:size]), zip(*columns[size:]))

    # rows reach Python as Arrow batches and not one by one
    return slim.mapInArrow(pack, "packed binary").rdd.flatMap(keyed).combineByKey(_first, _set, _merge, partitions)


def widen_kinds(cells: DataFrame, entity: Sequence[str], kind: str, columns: Mapping[str, Sequence[tuple[str, str]]], partitions: int | None = None) -> dict[str, DataFrame]:
    """The wide table of each kind of entity (its columns by kind, one of the entity's columns says the kind), from one
    pass and one shuffle of the cells."""
    slots = {name: i for i, name in enumerate(dict.fromkeys(n for cs in columns.values() for n, _ in cs))}
    held = registers(cells, entity, slots, partitions)
    at = list(entity).index(kind)
    return {k: _encoded(cells, held.filter(lambda pair, k=k: pair[0][at] == k), entity, cs, slots) for k, cs in columns.items()}


def widen(cells: DataFrame, entity: Sequence[str], columns: Sequence[tuple[str, str]], partitions: int | None = None) -> DataFrame:
    """One row per entity with a typed column for each (name, type) of `columns`, from typed_cells().

    The latest __time wins, then the highest __order, then the greater text; a null time is earlier than any other.
    Repeated rows change nothing. An entity without any readable cell has no row; an empty table gives an empty
    typed table. Column names that clash with the entity's get the prefix `a_`.
    """
    slots = {name: i for i, (name, _) in enumerate(columns)}
    return _encoded(cells, registers(cells, entity, slots, partitions), entity, columns, slots)


def _encoded(cells: DataFrame, held: RDD, entity: Sequence[str], columns: Sequence[tuple[str, str]], slots: dict[str, int]) -> DataFrame:
    encoders = [(slots[n], ENCODERS[t]) for n, t in columns]
    names = [f"a_{n}" if n in entity else n for n, _ in columns]
    schema = T.StructType([T.StructField(c, T.StringType()) for c in entity] + [T.StructField(n, SQL_TYPES[t]) for n, (_, t) in zip(names, columns)])

    def encode(pair: tuple) -> tuple:
        key, registers_ = pair
        return (*key, *[f(registers_[i][2]) if i in registers_ else None for i, f in encoders])

    wide = cells.sparkSession.createDataFrame(held.map(encode), schema, verifySchema=False)
    return wide.select(*[F.col(c).cast(cells.schema[c].dataType) for c in entity], *names)


def cells_of(wide: DataFrame, entity: Sequence[str], columns: Sequence[tuple[str, str]]) -> DataFrame:
    """The wide table's cells with a value, back as rows: entity columns, attr, val_text."""
    items = F.array(*[F.struct(F.lit(n).alias("attr"), F.col(f"a_{n}" if n in entity else n).cast("string").alias("val_text")) for n, _ in columns])
    out = wide.select(*entity, F.explode(items).alias("__c")).select(*entity, "__c.attr", "__c.val_text")
    return out.where(F.col("val_text").isNotNull())
