"""Queries of the text and percentile problems (p2, p7, p8, p9) and their SQL."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..runtime import distinct_rows, table
from . import leakage, lookalike, quantiles, tokenizing

GROUPS = ("graph_name", "worker_count")
TARGETS = (0.01, 0.05, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99)


def _shown(c: str) -> Column:
    """Seven digits of a value whose error is a thousandth: the last bits of exp() differ between engines."""
    return F.col(c).cast("float").cast("double")


def _performance(spark: SparkSession, d: str, *more: str) -> DataFrame:
    return distinct_rows(table(spark, d, "graph_performance_data"), *GROUPS, "execution_time", *more)


def p2_distribution(spark: SparkSession, d: str) -> DataFrame:
    """Cumulative frequencies of execution_time per graph and worker count: the combinable form of all percentiles."""
    freq = quantiles.frequencies(_performance(spark, d), GROUPS, "execution_time")
    return quantiles.cumulative(freq, GROUPS).withColumn("value", _shown("value"))


def p2_percentiles(spark: SparkSession, d: str) -> DataFrame:
    """Percentiles of execution_time per graph and worker count, within 0.1 %."""
    freq = quantiles.frequencies(_performance(spark, d), GROUPS, "execution_time")
    out = quantiles.percentiles(freq, GROUPS, TARGETS)
    return out.select(*GROUPS, "p", "n", _shown("value").alias("value"))


def p2_exact(spark: SparkSession, d: str) -> DataFrame:
    """The same percentiles from counts of the values themselves."""
    freq = quantiles.frequencies(_performance(spark, d), GROUPS, "execution_time", 0)
    return quantiles.percentiles(freq, GROUPS, TARGETS, 0)


def p2_within(spark: SparkSession, d: str) -> DataFrame:
    """Whether each percentile of the bounded tables lies within the error of the exact one."""
    x = _performance(spark, d)
    near = quantiles.percentiles(quantiles.frequencies(x, GROUPS, "execution_time"), GROUPS, TARGETS)
    true = quantiles.percentiles(quantiles.frequencies(x, GROUPS, "execution_time", 0), GROUPS, TARGETS, 0)
    true = true.select(*[F.col(g).alias(f"__{g}") for g in GROUPS], F.col("p").alias("__p"), F.col("value").alias("exact"))
    same = [F.col(g).eqNullSafe(F.col(f"__{g}")) for g in GROUPS]
    both = near.join(true, same[0] & same[1] & (F.col("p") == F.col("__p")))
    return both.select(*GROUPS, "p", "n", (F.abs(F.col("value") - F.col("exact")) <= 0.001 * F.abs("exact") * (1 + 1e-9)).alias("within"))


def p2_daily_frequencies(spark: SparkSession, d: str) -> DataFrame:
    """The combinable form per day of loading."""
    daily = _performance(spark, d, "loaded_at").withColumn("day", F.to_date("loaded_at"))
    return quantiles.frequencies(daily, ["day", *GROUPS], "execution_time")


def p2_median_of_days(spark: SparkSession, d: str) -> DataFrame:
    """Medians per graph from the sum of the days' frequency tables."""
    total = quantiles.combine([p2_daily_frequencies(spark, d)], ["graph_name"])
    out = quantiles.percentiles(total, ["graph_name"], [0.5])
    return out.select("graph_name", "n", _shown("value").alias("value"))


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokenizing.encode(table(spark, d, "documents"), "doc_id", "text")


def p7_decoded(spark: SparkSession, d: str) -> DataFrame:
    """Texts back from their ids."""
    return tokenizing.decode(p7_ids(spark, d), "doc_id", "ids")


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.find(table(spark, d, "documents"), "doc_id", "text", table(spark, d, "eval_item"), "item_id", "text")


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return lookalike.look_alike_pairs(table(spark, d, "documents"), "doc_id", "text")


def p9_normalized(spark: SparkSession, d: str) -> DataFrame:
    """Every document in its canonical spelling."""
    return lookalike.normalized(table(spark, d, "documents"), "doc_id", "text")


QUERIES = {f.__name__: f for f in (p2_distribution, p2_percentiles, p2_exact, p2_within, p2_daily_frequencies, p2_median_of_days, p7_ids, p7_decoded, p8_found, p9_found, p9_normalized)}

_GAMMA = "ln(1.001 / 0.999)"
_BINS = f"""
WITH r AS (SELECT DISTINCT * FROM graph_performance_data),
b AS (SELECT graph_name, worker_count, CAST(loaded_at AS DATE) AS day, CAST(CASE WHEN execution_time = 0 THEN 0
  ELSE sign(execution_time) * (ceil(ln(abs(execution_time)) / {_GAMMA}) + 1073741824) END AS BIGINT) AS bin FROM r WHERE execution_time IS NOT NULL AND NOT isnan(execution_time))
"""
_VALUE = f"CAST(CAST(CASE WHEN bin = 0 THEN 0 ELSE sign(bin) * exp((abs(bin) - 1073741824) * {_GAMMA}) * (2 / (1.001 / 0.999 + 1)) END AS FLOAT) AS DOUBLE)"


def _percentile_sql(groups: str, targets: str) -> str:
    return f"""{_BINS}, f AS (SELECT {groups}, bin, count(*) AS c FROM b GROUP BY ALL),
u AS (SELECT {groups}, bin, c, sum(c) OVER (PARTITION BY {groups} ORDER BY bin) AS upto, sum(c) OVER (PARTITION BY {groups}) AS n FROM f),
t AS (SELECT unnest([{targets}]) AS p)
SELECT {groups}, CAST(p AS DOUBLE) AS p, CAST(n AS BIGINT) AS n, {_VALUE} AS value FROM u, t
WHERE greatest(1, ceil(CAST(p AS DOUBLE) * n)) > upto - c AND greatest(1, ceil(CAST(p AS DOUBLE) * n)) <= upto"""


def _look_sql() -> str:
    """Pairs of different texts with one look: the tables applied to whole texts, without a vocabulary. The engine
    composes accents only, so letters that come composed with them are added to the tables."""
    swap = {a: b for _, other, latin in lookalike.LOOKALIKES for a, b in zip(other, latin)} | dict(lookalike.SIGNS)
    swap |= {chr(o): plain for o, plain in lookalike.WIDTHS.items() if len(plain) == 1}
    for c in map(chr, [*range(0x370, 0x530), *range(0x1F00, 0x2000)]):
        base, *marks = unicodedata.normalize("NFD", c)
        if base in swap and marks and len(composed := unicodedata.normalize("NFC", swap[base] + "".join(marks))) == 1:
            swap.setdefault(c, composed)
    text = lambda x: "'" + x.replace("'", "''") + "'"
    of = lambda chars: "[" + "".join(f"\\x{{{ord(c):x}}}" for c in chars) + "]"
    look = f"regexp_replace(text, '{of(lookalike.IGNORABLE)}', '', 'g')"
    for a, b in (("ﬀ", "ff"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬃ", "ffi"), ("ﬄ", "ffl")):
        look = f"replace({look}, '{a}', '{b}')"
    look = f"nfc_normalize(translate(nfc_normalize({look}), {text(''.join(swap))}, {text(''.join(swap.values()))}))"
    look = f"trim(regexp_replace(regexp_replace({look}, '{of(lookalike.SPACES)}+', ' ', 'g'), ' ?\\n ?', chr(10), 'g'), ' ' || chr(10))"
    return f"WITH l AS (SELECT doc_id, text, {look} AS look FROM documents WHERE text <> '') SELECT a.doc_id AS doc_id_a, b.doc_id AS doc_id_b FROM l a JOIN l b ON a.look = b.look AND a.doc_id < b.doc_id AND a.text <> b.text"


def _exact_sql(value: str) -> str:
    return f"""WITH r AS (SELECT DISTINCT * FROM graph_performance_data), g AS (SELECT graph_name, worker_count, count(*) AS n, unnest([{", ".join(f"{{'p': CAST({p} AS DOUBLE), 'v': quantile_disc(execution_time, {p})}}" for p in TARGETS)}]) AS x
FROM r WHERE execution_time IS NOT NULL AND NOT isnan(execution_time) GROUP BY graph_name, worker_count) SELECT graph_name, worker_count, x.p AS p, n, {value} FROM g"""


SQL = {
    "p2_exact": _exact_sql("x.v AS value"),
    "p2_within": _exact_sql("true AS within"),
    "p9_found": _look_sql(),
    "p2_distribution": _BINS + f""", f AS (SELECT graph_name, worker_count, bin, count(*) AS c FROM b GROUP BY ALL)
SELECT graph_name, worker_count, bin, CAST(c AS BIGINT) AS n, CAST(sum(c) OVER (PARTITION BY graph_name, worker_count ORDER BY bin) AS BIGINT) AS upto,
  CAST(sum(c) OVER (PARTITION BY graph_name, worker_count) AS BIGINT) AS total, {_VALUE} AS value FROM f""",
    "p2_percentiles": _percentile_sql("graph_name, worker_count", ", ".join(map(str, TARGETS))),
    "p2_daily_frequencies": _BINS + "SELECT day, graph_name, worker_count, bin, CAST(count(*) AS BIGINT) AS n FROM b GROUP BY ALL",
    "p2_median_of_days": f"SELECT graph_name, n, value FROM ({_percentile_sql('graph_name', '0.5')})",
    "p7_decoded": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
}
