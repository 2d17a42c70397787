"""Panel quality operators: quantile bounds (A4), range filter (X18), sequential
outlier trimming (A5), z-score (A6), coverage (A7), event rate (A8), date span (A9).

Per-series statistics are window aggregates over ``partitionBy(keys)``: the
panel is already clustered by series, so trimming all variables adds no
exchange and no join. Exact ``percentile`` holds a value->count map per group;
a series group is bounded by its number of days.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vigil.functions.util import as_list

# Trimming quantiles.
Q_LOW = 0.01
Q_HIGH = 0.99


def _virtual_index(n, q: float):
    """numpy 'linear' method: virtual index n*q + (1-q) - 1, its floor and fraction."""
    vi = n * F.lit(float(q)) + F.lit(1.0 - float(q)) - F.lit(1.0)
    lo = F.floor(vi)
    return lo, vi - lo


def _lerp(a, b, g):
    """a + (b-a)*g, or b - (b-a)*(1-g) when g >= 0.5 (equal neighbours give exactly a)."""
    return F.when(g >= 0.5, b - (b - a) * (F.lit(1.0) - g)).otherwise(a + (b - a) * g)


def with_quantiles(df: DataFrame, keys, column: str, qs, names) -> DataFrame:
    """Add exact per-series quantiles of ``column`` as columns (window, no join).

    One sort by (series, value): a first Window node numbers the non-null
    values and counts them, a second one (same specification, so no new sort)
    picks the order statistics around each virtual index. A group is one
    series of daily rows, bounded by its number of days.
    """
    keys = as_list(keys)
    by_value = Window.partitionBy(*keys).orderBy(F.col(column).asc_nulls_last())
    whole = by_value.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rest = [F.col(c) for c in df.columns]
    staged = df.select(*rest, (F.row_number().over(by_value) - 1).alias("_rn"),
                       F.count(column).over(whole).alias("_n"))
    n, last = F.col("_n"), F.col("_n") - 1
    idx = []
    for i, q in enumerate(qs):
        lo, g = _virtual_index(n, q)
        idx += [F.least(F.greatest(lo, F.lit(0)), last).alias(f"_lo{i}"),
                F.least(F.greatest(lo + 1, F.lit(0)), last).alias(f"_hi{i}"), g.alias(f"_g{i}")]
    staged = staged.select("*", *idx)

    def stat(i):
        return F.max(F.when(F.col("_rn") == F.col(i), F.col(column))).over(whole)

    picked = staged.select("*", *[stat(f"_{e}{i}").alias(f"_{e}v{i}") for i in range(len(qs)) for e in ("lo", "hi")])
    out = [F.when(n > 0, _lerp(F.col(f"_lov{i}"), F.col(f"_hiv{i}"), F.col(f"_g{i}"))).alias(name)
           for i, name in enumerate(names)]
    return picked.select(*rest, *out)


def quantile_bounds(df: DataFrame, keys, column: str, lo: float = Q_LOW, hi: float = Q_HIGH) -> DataFrame:
    """A4: exact linear-interpolation quantiles per series (one row per series)."""
    keys = as_list(keys)
    staged = with_quantiles(df.select(*keys, column), keys, column, (lo, hi), ("q_low", "q_high"))
    return staged.groupBy(*keys).agg(F.first("q_low").alias("q_low"), F.first("q_high").alias("q_high"))


def trim_one(df: DataFrame, keys, column: str, lo: float = Q_LOW, hi: float = Q_HIGH) -> DataFrame:
    """A4 + X18: keep rows with q_lo <= x <= q_hi of their series (NULL x is dropped)."""
    staged = with_quantiles(df, keys, column, (lo, hi), ("_qlo", "_qhi"))
    return staged.where(F.col(column).between(F.col("_qlo"), F.col("_qhi"))).drop("_qlo", "_qhi")


def _bound(value, use):
    """``use(value)`` with ``value`` computed once, whatever number of times ``use`` names it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _kept(rows, column: str, lo: float, hi: float):
    """The structs of an array whose ``column`` lies between the array's own quantiles of it.

    ``rows`` is itself the step before, so it is bound too: named twice, seven steps would be
    computed 2^7 times."""
    def quantile(sorted_values, q):
        n = F.size(sorted_values)
        at, g = _virtual_index(n, q)
        pick = lambda i: F.element_at(sorted_values, (F.least(F.greatest(i, F.lit(0)), n - 1) + 1).cast("int"))
        return F.when(n > 0, _lerp(pick(at), pick(at + 1), g))

    def step(given):
        values = F.sort_array(F.filter(given[column], lambda v: v.isNotNull()))
        ends = _bound(values, lambda v: F.struct(quantile(v, lo).alias("lo"), quantile(v, hi).alias("hi")))
        return _bound(ends, lambda e: F.filter(given, lambda r: r[column].between(e["lo"], e["hi"])))

    return _bound(rows, step)


def trim_sequential(df: DataFrame, keys, columns, lo: float = Q_LOW, hi: float = Q_HIGH) -> DataFrame:
    """A5: trim each column in the given order; each step's quantiles are taken on
    the rows left by the previous step (order matters).

    A series is one array of daily rows, bounded by its number of days, and every step filters
    that array: one aggregate in all, instead of two sorts and two windows per column."""
    keys = as_list(keys)
    rest = [c for c in df.columns if c not in keys]
    series = df.groupBy(*keys).agg(F.collect_list(F.struct(*rest)).alias("_rows"))
    for c in columns:
        series = series.withColumn("_rows", _kept(F.col("_rows"), c, lo, hi))
    return series.select(*keys, F.inline("_rows")).select(*df.columns)


def zscore_fit(df: DataFrame, keys, columns) -> DataFrame:
    """A6 fit: per series mean and population std (zero std -> 1), long form
    (keys, feature, mean, std)."""
    keys = as_list(keys)
    aggs = []
    for c in columns:
        sd = F.stddev_pop(c)
        aggs.append(F.struct(F.lit(c).alias("feature"), F.avg(c).alias("mean"),
                             F.when(sd == 0, F.lit(1.0)).otherwise(sd).alias("std")))
    return (df.groupBy(*keys).agg(F.array(*aggs).alias("_s"))
            .select(*keys, F.inline("_s")))


def zscore_apply(df: DataFrame, keys, columns) -> DataFrame:
    """A6 apply: (x - mean) / std with the series' own statistics (window, no join)."""
    w = Window.partitionBy(*as_list(keys))
    out = []
    for c in df.columns:
        if c in columns:
            sd = F.stddev_pop(c).over(w)
            out.append(((F.col(c) - F.avg(c).over(w)) / F.when(sd == 0, F.lit(1.0)).otherwise(sd)).alias(c))
        else:
            out.append(F.col(c))
    return df.select(*out)


def coverage(df: DataFrame, keys, date_col: str = "date") -> DataFrame:
    """Observed days / days in [first, last]."""
    keys = as_list(keys)
    d = F.col(date_col)
    return df.groupBy(*keys).agg(
        F.count(d).alias("n_days"),
        (F.datediff(F.max(d), F.min(d)) + 1).alias("span_days"),
    ).withColumn("coverage_ratio", F.col("n_days") / F.col("span_days"))


def event_rate(df: DataFrame, keys, flag_col: str, name: str = "event_rate") -> DataFrame:
    """Mean of a 0/1 flag per group (global when ``keys`` is empty)."""
    return df.groupBy(*as_list(keys)).agg(F.avg(flag_col).alias(name), F.count(flag_col).alias("n"))


def date_span(df: DataFrame, keys, date_col: str = "date") -> DataFrame:
    """First and last day per group."""
    return df.groupBy(*as_list(keys)).agg(F.min(date_col).alias("date_start"),
                                         F.max(date_col).alias("date_end"))
