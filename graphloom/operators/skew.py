"""Per-key results where a few keys hold most rows: dense accumulator arrays.

Input splits are read in pieces of a fixed number of rows. A piece dictionary-encodes its own keys and adds its measures
into one dense array per measure (numpy.bincount / scatter-add), so whatever it holds of a hot key leaves it as one row.
The pieces' array rows are then hashed and sorted by key, and a task adds them up batch by batch in the same way,
handing the last key of a batch on to the next: what a task holds at once is a batch, whatever the number of keys and
of pieces. The work of a key's task is bounded by the number of pieces, never by the key's row count.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

#: Rows of one piece of an input split.
PIECE = 1 << 19
_WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def _encoded(keys: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Dense codes of the keys (nulls get a code of their own) and the dictionary by code."""
    d = keys.dictionary_encode(null_encoding="encode")
    return d.indices.to_numpy(zero_copy_only=False), d.dictionary


def _scatter(kind: str, codes: np.ndarray, values: np.ndarray, size: int) -> np.ndarray:
    """Sums, least or greatest of the values of each code, in the values' own type."""
    whole = values.dtype.kind == "i"
    if kind == "sum":
        out = np.zeros(size, values.dtype)
        np.add.at(out, codes, values)
    elif kind == "min":
        out = np.full(size, np.iinfo(np.int64).max if whole else np.inf, values.dtype)
        np.minimum.at(out, codes, values)
    else:
        out = np.full(size, np.iinfo(np.int64).min if whole else -np.inf, values.dtype)
        np.maximum.at(out, codes, values)
    return out


def accumulate(df: DataFrame, key: str, sums: Sequence[str] = (), mins: Sequence[str] = (), maxs: Sequence[str] = (), piece: int = PIECE) -> DataFrame:
    """One row per key: n (rows), and sum_c, min_c, max_c of the given numeric columns: bigint for columns of whole
    numbers, exact as long as the sum is a bigint, double for all others.

    A null key is a key of its own; nulls of a measure count in n alone, and a measure with no value is null.
    NaN counts as no value. An empty table gives no rows. Extra columns of df are ignored. Sums of many doubles
    depend on the order of adding in their last digits.
    """
    key_type = df.schema[key].dataType.simpleString()
    measures = list(dict.fromkeys([*sums, *mins, *maxs]))
    whole = {c: isinstance(df.schema[c].dataType, _WHOLE) for c in measures}
    parts = [(kind, c) for kind, names in (("sum", sums), ("min", mins), ("max", maxs)) for c in names]
    outs = {"n": True} | {f"cnt_{c}": True for c in measures} | {f"{kind}_{c}": whole[c] for kind, c in parts}
    schema = f"__key {key_type}" + "".join(f", `{o}` {'bigint' if w else 'double'}" for o, w in outs.items())

    def emit(dictionary: pa.Array, dense: dict[str, np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([dictionary, *[pa.array(dense[o], pa.int64() if w else pa.float64()) for o, w in outs.items()]], ["__key", *outs])

    def of_rows(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(batches).combine_chunks()
        keys = t.column(0)
        codes, dictionary = _encoded(keys.chunk(0) if keys.num_chunks == 1 else pa.concat_arrays(keys.chunks))
        size = len(dictionary)
        dense = {"n": np.bincount(codes, minlength=size)}
        for i, c in enumerate(measures):
            column = t.column(i + 1)
            ok = column.is_valid().to_numpy()
            x = column.fill_null(0).to_numpy().astype(np.int64 if whole[c] else np.float64)
            if not whole[c]:
                ok = ok & ~np.isnan(x)
            dense[f"cnt_{c}"] = np.bincount(codes[ok], minlength=size)
            for kind, name in parts:
                if name == c:
                    dense[f"{kind}_{c}"] = _scatter(kind, codes[ok], x[ok], size)
        return emit(dictionary, dense)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for b in batches:
            if b.num_rows:
                held.append(b)
                rows += b.num_rows
            if rows >= piece:
                yield of_rows(held)
                held, rows = [], 0
        if held:
            yield of_rows(held)

    def added(b: pa.RecordBatch) -> pa.RecordBatch:
        codes, dictionary = _encoded(b.column(0))
        return emit(dictionary, {o: _scatter(o[:3] if o[:4] in ("min_", "max_") else "sum", codes, b.column(o).to_numpy(), len(dictionary)) for o in outs})

    def reduce_sorted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carry = None  # the last key's row: the next batch may go on with that key
        for b in batches:
            if not b.num_rows:
                continue
            if carry is not None:
                b = pa.Table.from_batches([carry, b.select(carry.schema.names).cast(carry.schema)]).combine_chunks().to_batches()[0]
            done = added(b)
            carry = done.slice(done.num_rows - 1)
            if done.num_rows > 1:
                yield done.slice(0, done.num_rows - 1)
        if carry is not None:
            yield carry

    kept = df.select(F.col(key).alias("__key"), *[F.col(c).cast("bigint" if whole[c] else "double").alias(c) for c in measures])
    total = kept.mapInArrow(split, schema).repartition("__key").sortWithinPartitions("__key").mapInArrow(reduce_sorted, schema)
    shown = [F.when(F.col(f"cnt_{c}") > 0, F.col(f"{kind}_{c}")).alias(f"{kind}_{c}") for kind, c in parts]
    return total.select(F.col("__key").alias(key), "n", *shown)


def heavy_keys(totals: DataFrame, key: str, share: float) -> DataFrame:
    """Non-null keys that hold at least `share` of all rows with a non-null key; `totals` is accumulate()'s result."""
    known = totals.where(F.col(key).isNotNull())
    return known.where(F.col("n") >= F.lit(share) * known.agg(F.sum("n")).scalar())
