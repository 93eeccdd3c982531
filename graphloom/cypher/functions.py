"""Scalar functions of the query language as JVM-side column expressions."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, functions as F


def _substring(s: Column, start: Column, length: Column | None = None) -> Column:
    return F.substring(s, start + 1, length if length is not None else F.length(s))


def _size(x: Column, dtype: str) -> Column:
    return F.length(x) if dtype == "string" else F.size(x)


def _range(a: Column, b: Column, step: Column | None = None) -> Column:
    by = step if step is not None else F.lit(1)
    empty = F.array().cast("array<bigint>")
    there = ((by > 0) & (a <= b)) | ((by < 0) & (a >= b))
    return F.when(there, F.sequence(a.cast("bigint"), b.cast("bigint"), F.when(there, by.cast("bigint")).otherwise(F.when(a <= b, 1).otherwise(-1)))).otherwise(empty)


def _tail(x: Column) -> Column:
    return F.when(F.size(x) > 0, F.slice(x, F.lit(2), F.greatest(F.size(x) - 1, F.lit(0)))).otherwise(x)


def _round(x: Column, digits: Column | None = None) -> Column:
    scale = F.pow(F.lit(10.0), digits) if digits is not None else F.lit(1.0)
    return F.floor(x * scale + 0.5) / scale


def _to_integer(x: Column) -> Column:
    return F.coalesce(x.try_cast("bigint"), x.try_cast("double").try_cast("bigint"))


#: name -> function of columns
SCALARS: dict[str, Callable[..., Column]] = {
    "coalesce": F.coalesce,
    "abs": F.abs,
    "ceil": lambda x: F.ceil(x.cast("double")).cast("double"),
    "floor": lambda x: F.floor(x.cast("double")).cast("double"),
    "round": _round,
    "sign": lambda x: F.signum(x).cast("bigint"),
    "sqrt": lambda x: F.when(x >= 0, F.sqrt(F.greatest(x, F.lit(0)))).otherwise(F.lit(float("nan"))),
    "exp": F.exp,
    "log": F.ln,
    "log10": F.log10,
    "sin": F.sin,
    "cos": F.cos,
    "tan": F.tan,
    "cot": F.cot,
    "asin": F.asin,
    "acos": F.acos,
    "atan": F.atan,
    "atan2": F.atan2,
    "degrees": F.degrees,
    "radians": F.radians,
    "pi": lambda: F.lit(math.pi),
    "e": lambda: F.lit(math.e),
    "rand": F.rand,
    "toupper": F.upper,
    "upper": F.upper,
    "tolower": F.lower,
    "lower": F.lower,
    "trim": F.trim,
    "ltrim": F.ltrim,
    "rtrim": F.rtrim,
    "replace": lambda s, a, b: F.replace(s, a, b),
    "split": lambda s, by: F.split(s, F.concat(F.lit("\\Q"), by, F.lit("\\E"))),
    "substring": _substring,
    "left": lambda s, n: F.substring(s, F.lit(1), n),
    "right": lambda s, n: F.when(n <= 0, "").otherwise(F.substring(s, F.greatest(F.length(s) - n, F.lit(0)) + 1, n)),
    "reverse": F.reverse,
    "tostring": lambda x: x.cast("string"),
    "tointeger": _to_integer,
    "tofloat": lambda x: x.try_cast("double"),
    "toboolean": lambda x: F.when(F.lower(x.cast("string")) == "true", True).when(F.lower(x.cast("string")) == "false", False),
    "head": lambda x: F.get(x, F.lit(0)),
    "last": lambda x: F.try_element_at(x, F.lit(-1)),
    "tail": _tail,
    "range": _range,
    "date": lambda s: s.try_cast("date"),
    "datetime": lambda s: s.try_cast("timestamp"),
    "timestamp": lambda: F.unix_millis(F.current_timestamp()),
    "isempty": lambda x: F.when(x.isNotNull(), F.size(x) == 0),
}
SIZED = {"size": _size, "length": _size}
