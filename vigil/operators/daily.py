"""Daily panel operators: daily mean (A1), calendar completion (J3),
inner alignment of variables (J1) and time interpolation (W9).

Shuffles: ``daily_mean`` is one hash aggregate on (keys, date) with map-side
partial aggregation, so a hot series is combined before the exchange. Every
later step is a window partitioned by the series keys; after the daily
aggregate a series holds at most one row per calendar day, so a window group
is bounded by the date span, not by the raw row count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigil.functions.util import as_list, col_of

OBS_PREFIX = "_obs_"


def obs_col(var: str) -> str:
    return f"{OBS_PREFIX}{var}"


def series_window(keys, date_col: str = "date"):
    return Window.partitionBy(*as_list(keys)).orderBy(date_col)


def daily_mean(df: DataFrame, keys, date_col, values: dict[str, Column],
               present: dict[str, Column] | None = None, keep_counts: bool = True) -> DataFrame:
    """A1: mean of the non-null observations per (keys, day) for each variable.

    ``values`` maps a variable name to its value expression; ``present`` maps it
    to a boolean saying that an input row is an observation of that variable
    (long input: ``variable = 'PM25'``). Rows without a date are dropped. The
    ``_obs_<var>`` counts keep "a row existed" apart from "the value is null",
    which calendar bounds (J1) need.
    """
    keys = as_list(keys)
    day = col_of(date_col).cast("date")
    base = df.select(*[F.col(k) for k in keys], day.alias("date"),
                     *[v.alias(f"_v_{n}") for n, v in values.items()],
                     *[(present[n] if present else F.lit(True)).alias(f"_p_{n}") for n in values])
    base = base.where(F.col("date").isNotNull())
    aggs = []
    for n in values:
        p = F.col(f"_p_{n}")
        aggs.append(F.avg(F.when(p, F.col(f"_v_{n}"))).alias(n))
        if keep_counts:
            aggs.append(F.count(F.when(p, F.lit(1))).alias(obs_col(n)))
    out = base.groupBy(*keys, "date").agg(*aggs)
    if present is not None:
        # a day only exists for the variables observed on it
        out = out.where(F.greatest(*[F.col(obs_col(n)) for n in values]) > 0) if keep_counts else out
    return out


def long_values(variable_col, value_col, variables) -> tuple[dict, dict]:
    """(values, present) for a long (variable, value) input with a fixed variable list."""
    var = col_of(variable_col)
    val = col_of(value_col)
    return ({v: val for v in variables}, {v: var == F.lit(v) for v in variables})


def complete_calendar(daily: DataFrame, keys, variables, date_col: str = "date") -> DataFrame:
    """Every day between a series' first and last day exists; new days are NULL.

    No join: each day is exploded into itself plus the missing days up to the
    next present day (``lead``), inside the series window.
    """
    keys = as_list(keys)
    w = series_window(keys, date_col)
    nxt = F.lead(date_col).over(w)
    d = F.col(date_col)
    other = [c for c in daily.columns if c not in keys and c != date_col]
    staged = (daily.select(*keys, d.alias("_orig"), *other, nxt.alias("_next"))
              .select(*keys, "_orig", *other, F.explode(F.sequence(
                  F.col("_orig"), F.coalesce(F.date_sub("_next", 1), F.col("_orig")))).alias("_day")))
    is_orig = F.col("_day") == F.col("_orig")
    cols = []
    for c in other:
        if c.startswith(OBS_PREFIX):
            cols.append(F.when(is_orig, F.col(c)).otherwise(F.lit(0)).cast("long").alias(c))
        else:
            cols.append(F.when(is_orig, F.col(c)).alias(c))
    return staged.select(*keys, F.col("_day").alias(date_col), *cols)


def align_variables(panel: DataFrame, keys, variables, date_col: str = "date",
                    drop_counts: bool = True) -> DataFrame:
    """Keep the days present for every variable, i.e. the days inside every
    variable's own [first observed day, last observed day] (the row exists,
    whether or not its value is null). A series lacking a variable keeps nothing."""
    keys = as_list(keys)
    w = Window.partitionBy(*keys)
    lo, hi = [], []
    for v in variables:
        seen = F.when(F.col(obs_col(v)) > 0, F.col(date_col))
        lo.append(F.min(seen).over(w))
        hi.append(F.max(seen).over(w))
    all_seen = F.lit(True)
    for b in lo:
        all_seen = all_seen & b.isNotNull()
    keep = all_seen & F.col(date_col).between(F.greatest(*lo) if len(lo) > 1 else lo[0],
                                              F.least(*hi) if len(hi) > 1 else hi[0])
    out = panel.withColumn("_keep", keep).where("_keep").drop("_keep")
    if drop_counts:
        out = out.drop(*[obs_col(v) for v in variables])
    return out


def interpolate_time(df: DataFrame, keys, columns, date_col: str = "date") -> DataFrame:
    """Linear-in-time fill between the nearest known neighbours of each gap;
    leading and trailing gaps take the nearest known value; known values stay."""
    keys = as_list(keys)
    # Both neighbours use running frames (unbounded preceding .. current row):
    # a "current row .. unbounded following" frame is re-aggregated per row
    # (quadratic per series), so the next known value is looked up as the
    # running last value in descending day order instead.
    w = Window.partitionBy(*keys)
    before = w.orderBy(F.col(date_col).asc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    after = w.orderBy(F.col(date_col).desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    d = F.col(date_col)
    # Values and days as columns of their own: a window buffer of plain numbers is updated in place, one of structs is not.
    near = df.select("*", *[F.last(x, ignorenulls=True).over(w).alias(f"_{side}{kind}_{c}") for side, w in (("b", before), ("a", after))
                            for c in columns for kind, x in (("v", F.col(c)), ("d", F.when(F.col(c).isNotNull(), d)))])
    out = []
    for c in columns:
        v, prev, nxt, start, end = F.col(c), *[F.col(f"_{n}_{c}") for n in ("bv", "av", "bd", "ad")]
        slope = (nxt - prev) / F.datediff(end, start)
        filled = (F.when(v.isNotNull(), v)
                  .when(prev.isNull(), nxt)
                  .when(nxt.isNull(), prev)
                  .otherwise(slope * F.datediff(d, start) + prev))
        out.append(filled.alias(c))
    rest = [F.col(c) for c in df.columns if c not in columns]
    return near.select(*rest, *out).select(*df.columns)


def filled_calendar(daily: DataFrame, keys, variables, date_col: str = "date") -> DataFrame:
    """J3 + J1 + W9 in one pass: what ``interpolate_time(align_variables(complete_calendar(...)))`` gives.

    All windows run over the observed days only. The days in between are generated last: from an
    observed day up to the next one, a variable's known neighbours are the same, so each observed
    day carries them and the generated days are plain arithmetic. Without counts every row observes every variable.
    """
    keys = as_list(keys)
    whole = Window.partitionBy(*keys)
    d = F.col(date_col)
    counted = [v for v in variables if obs_col(v) in daily.columns]
    seen = [F.when(F.col(obs_col(v)) > 0, d) for v in counted] + [d] * (len(counted) < len(variables))
    lows, highs = [F.min(x).over(whole) for x in seen], [F.max(x).over(whole) for x in seen]
    bounds = daily.select("*", F.array(*lows).alias("_lows"), F.array(*highs).alias("_highs"))
    inside = (F.forall("_lows", lambda x: x.isNotNull())
              & d.between(F.array_max("_lows"), F.array_min("_highs")))
    rows = bounds.where(inside)
    before = whole.orderBy(d.asc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    after = whole.orderBy(d.desc()).rowsBetween(Window.unboundedPreceding, -1)
    near = rows.select(
        *keys, d.alias("_day"), F.lead(d).over(whole.orderBy(d.asc())).alias("_next"),
        *[F.last(x, ignorenulls=True).over(w).alias(f"_{side}{kind}_{v}") for side, w in (("b", before), ("a", after)) for v in variables
          for kind, x in (("v", F.col(v)), ("d", F.when(F.col(v).isNotNull(), d)))])
    # The line of a variable from this day on: the value it starts from, its slope (NULL: constant) and the days since its start.
    lines = []
    for v in variables:
        prev, nxt, start, end = (F.col(f"_{c}_{v}") for c in ("bv", "av", "bd", "ad"))
        lines += [F.coalesce(prev, nxt).alias(f"_from_{v}"), ((nxt - prev) / F.datediff(end, start)).alias(f"_slope_{v}"),
                  F.datediff("_day", start).alias(f"_since_{v}")]
    gap = F.sequence(F.lit(0), F.coalesce(F.datediff("_next", "_day") - 1, F.lit(0)))
    # The lines are columns of the observed days, below the generator: named in one select with it they would be computed per generated day.
    held = near.select(*keys, "_day", *lines, gap.alias("_gap"))
    days = held.select(*[c for c in held.columns if c != "_gap"], F.explode("_gap").alias("_k"))
    out = []
    for v in variables:
        base, slope, k = F.col(f"_from_{v}"), F.col(f"_slope_{v}"), F.col(f"_since_{v}") + F.col("_k")
        out.append(F.when(slope.isNull() | (k == 0), base).otherwise(slope * k + base).alias(v))
    return days.select(*keys, F.date_add("_day", F.col("_k")).alias(date_col), *out)


def drop_incomplete(df: DataFrame, columns) -> DataFrame:
    """Drop rows with a NULL in any of ``columns``."""
    return df.dropna(subset=list(columns))
