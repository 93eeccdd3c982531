"""Column expressions that read a value of a declared type out of free text, or give null.

All are built-in JVM expressions. A value is readable when its meaning in the type is beyond doubt; blanks, null and
placeholders never are. Text may be wrapped in one pair of matching quotes and in white space of any kind.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

#: White space and invisible characters that count as nothing at the ends of a value.
EDGE = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \u0085\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u200b\u200c\u200d\u2028\u2029\u202f\u205f\u2060\u3000\ufeff"

# The words that mean true and false.
TRUE_WORDS = ("true", "t", "yes", "y", "on", "1")
FALSE_WORDS = ("false", "f", "no", "n", "off", "0")

# English month names in order; a prefix of three letters or the full name counts.
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")

#: A number: sign, digits plain or in groups of three, fraction, exponent.
NUMBER = r"^([+-]?)(?=\.?\d)(\d*|\d{1,3}(?:,\d{3})+)(?:\.(\d+))?(?:[eE]([+-]?\d{1,3}))?$"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value evaluated once however often body uses it. Lambdas are interpreted: where many rows are
    read, with_text() takes the same steps as columns of their own."""
    return F.element_at(F.transform(F.array(value), body), 1)


def trimmed(c: Column) -> Column:
    """Without outer white space; null if nothing is left."""
    return F.nullif(F.btrim(c, F.lit(EDGE)), F.lit(""))


def _bare(t: Column) -> Column:
    quoted = (F.length(t) > 1) & (F.left(t, F.lit(1)) == F.right(t, F.lit(1))) & F.left(t, F.lit(1)).isin('"', "'")
    return F.when(quoted, trimmed(F.substring(t, F.lit(2), F.length(t) - 2))).otherwise(t)


def unquoted(c: Column) -> Column:
    """trimmed(), then without one pair of matching quotes around the whole value."""
    return let(trimmed(c), _bare)


#: Parts of a number's text, by their group in NUMBER.
_PARTS = {"sign": 1, "whole": 2, "part": 3, "shift": 4}


def _taken(t: Column, name: str) -> Column:
    """One part of a number's text; null if it is no number."""
    x = F.regexp_extract(t, NUMBER, _PARTS[name])
    if name == "whole":
        x = F.replace(x, F.lit(","), F.lit(""))
    return F.coalesce(x.try_cast("int"), F.lit(0)) if name == "shift" else x


def _whole(p: dict[str, Column]) -> Column:
    """The digits before the point once the exponent is worked in. Digits are moved, never rounded."""
    point = F.length(p["whole"]) + p["shift"]
    moved = F.when(point <= 0, "0").otherwise(F.rpad(F.left(F.concat(p["whole"], p["part"]), point), point, F.lit("0")))
    return F.when(p["shift"] == 0, F.when(p["whole"] == "", "0").otherwise(p["whole"])).otherwise(moved)


def _fraction(p: dict[str, Column]) -> Column:
    """The digits behind the point once the exponent is worked in."""
    digits, point = F.concat(p["whole"], p["part"]), F.length(p["whole"]) + p["shift"]
    moved = F.when(point <= 0, F.concat(F.repeat(F.lit("0"), -point), digits)).otherwise(F.substring(digits, point + 1, F.greatest(F.lit(0), F.length(digits) - point)))
    return F.when(p["shift"] == 0, p["part"]).otherwise(moved)


def _long(p: dict[str, Column]) -> Column:
    return F.when(F.length(F.rtrim(_fraction(p), F.lit("0"))) == 0, F.concat(p["sign"], _whole(p)).try_cast("bigint"))


def _decimal(p: dict[str, Column]) -> Column:
    """Only the third digit of a fraction decides how it is rounded to cents."""
    text = F.concat(p["sign"], _whole(p), F.lit("."), F.left(F.concat(_fraction(p), F.lit("0")), F.lit(3)))
    return F.round(text.try_cast("decimal(38,3)"), 2).try_cast("decimal(20,2)")


def _number(c: Column, body: Callable[[dict[str, Column]], Column]) -> Column:
    def read(t: Column) -> Column:
        taken = F.struct(*[_taken(t, n).alias(n) for n in _PARTS])
        return F.when(t.rlike(NUMBER), let(taken, lambda p: body({n: p[n] for n in _PARTS})))

    return let(unquoted(c), read)


def as_long(c: Column) -> Column:
    """bigint: a number without a fraction (1614.0 and 1,063 are whole); null beyond bigint."""
    return _number(c, _long)


def as_decimal(c: Column) -> Column:
    """decimal(20,2): a number, rounded half up to cents; null beyond that type."""
    return _number(c, _decimal)


def _boolean(t: Column) -> Column:
    word = F.lower(t)
    return F.when(word.isin(*TRUE_WORDS), True).when(word.isin(*FALSE_WORDS), False)


def as_boolean(c: Column) -> Column:
    """boolean: one of the words of TRUE_WORDS or FALSE_WORDS, in any case."""
    return let(unquoted(c), _boolean)


def _date(t: Column) -> Column:
    names = "|".join(f"{m}|{m[:3]}" for m in MONTHS)
    time = r"(?:[T ]\d{1,2}:\d{2}(?::\d{2}(?:\.\d+)?)?\s?(?:Z|[+-]\d{2}:?\d{2})?)?"
    digits = rf"^(\d{{4}})(?:([-/.])(\d{{1,2}})\2(\d{{1,2}}){time}|(\d{{2}})(\d{{2}}))$"
    words = rf"(?i)^(?:(\d{{1,2}})\.?\s+({names})\.?,?|({names})\.?\s+(\d{{1,2}}),?)\s+(\d{{4}})$"
    numbers = F.create_map(*[F.lit(x) for i, m in enumerate(MONTHS, 1) for k in dict.fromkeys((m, m[:3])) for x in (k, str(i))])
    ordered = F.regexp_replace(t, digits, "$1-$3$5-$4$6")
    w = lambda i: F.regexp_extract(t, words, i)
    named = F.when(w(5) != "0000", F.concat_ws("-", w(5), numbers[F.lower(F.concat(w(2), w(3)))], F.concat(w(1), w(4))))
    numeric = F.when((ordered != t) | t.rlike(digits), F.when(~t.startswith("0000"), ordered))
    return F.when(F.left(t, F.lit(4)).rlike(r"^\d{4}$"), numeric).when(t.rlike(words), named).try_cast("date")


def as_date(c: Column) -> Column:
    """date: year-month-day with -, /, . or no separator, a time of day after it dropped; `4 May 1998`;
    `May 4, 1998`. Orders of day and month that leave doubt are not read, nor dates that do not exist, nor the
    year 0."""
    return let(unquoted(c), _date)


def as_text(c: Column) -> Column:
    """string: without outer white space, null if blank."""
    return trimmed(c)


READERS = {"long": as_long, "decimal": as_decimal, "boolean": as_boolean, "date": as_date, "string": as_text}


def canonical_text(c: Column, val_type: str) -> Column:
    """The value read as val_type, in its one written form: plain digits; two decimals; true/false; yyyy-MM-dd."""
    return READERS[val_type](c).cast("string")


def with_text(rows: DataFrame, value: str, kind: Column, name: str) -> DataFrame:
    """rows with canonical_text() of a column whose type differs by row (`kind`), step by step: each step is a column
    that the next ones use, so it is computed once and stays in generated code. A kind that is none gives null."""
    made = [f"__{name}_{x}" for x in ("trim", "bare", "number", *_PARTS)]
    trim, bare = F.col(made[0]), F.col(made[1])
    x = rows.withColumn(made[0], trimmed(F.col(value))).withColumn(made[1], _bare(trim))
    x = x.withColumn(made[2], F.when(kind.isin("long", "decimal"), F.when(bare.rlike(NUMBER), bare)))
    parts = {n: F.col(c) for c, n in zip(made[3:], _PARTS)}
    x = x.withColumns({c: F.when(F.col(made[2]).isNotNull(), _taken(F.col(made[2]), n)) for c, n in zip(made[3:], _PARTS)})
    read = {"long": _long(parts), "decimal": _decimal(parts), "boolean": _boolean(bare), "date": _date(bare), "string": trim}
    text = F.lit(None).cast("string")
    for t, c in read.items():
        text = F.when(kind == t, c.cast("string")).otherwise(text)
    # a filter on the text does not pass an explode, so the text is computed once and not for the filter as well
    return x.withColumn(name, F.explode(F.array(text))).drop(*made)


def name_key(c: Column) -> Column:
    """A name without case, spaces and separators: letters and digits alone, lower case."""
    return F.lower(F.regexp_replace(c, r"[^\p{L}\p{N}]", ""))
