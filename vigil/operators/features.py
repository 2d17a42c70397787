"""Feature table (X13-X15, W1-W7, X19): calendar, lags, shifted rolling
statistics, differences and previous categories.

All lag and difference expressions share one window specification
(``partitionBy(keys).orderBy(date)``), so Spark plans them as one Exchange and
one Sort; rolling statistics are plain arithmetic on the lagged values.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vigil.functions.calendar import calendar_columns
from vigil.functions.util import as_list

# Base variables, lag steps and rolling widths of the model.
BASE_NUMERIC = ("PM25", "PM10", "temp", "hum", "pres", "wind", "winddir")
LAGS = (1, 2, 3, 5, 7, 14)
ROLL_WINDOWS = (2, 3, 5, 7, 14)
DIFFS = (1, 2)
CAT_LAGS = (1, 2, 3)
ROLL_STATS = ("mean", "max", "min", "std")

EXCLUDED = ("date", "CAT", "critical_now")
FUTURE_CATEGORY_COLS = ("CAT_24h", "CAT_48h", "CAT_72h")


def lag_columns(keys, base=BASE_NUMERIC, lags=LAGS, date_col: str = "date"):
    w = Window.partitionBy(*as_list(keys)).orderBy(date_col)
    return [F.lag(c, k).over(w).alias(f"{c}_lag{k}") for k in lags for c in base]


def shift_name(c: str, k: int) -> str:
    return f"_{c}_before{k}"


def _total(c: str, w: int) -> str:
    return f"_{c}_total{w}"


def with_shifts(df: DataFrame, keys, base=BASE_NUMERIC, windows=ROLL_WINDOWS, date_col: str = "date") -> DataFrame:
    """Adds the values of the last max(windows) rows and, per width, their sum (NULL unless all
    are present): one offset function per value instead of one sliding frame per statistic."""
    w0 = Window.partitionBy(*as_list(keys)).orderBy(date_col)
    shifted = df.select("*", *[F.lag(c, k).over(w0).alias(shift_name(c, k)) for c in base
                               for k in range(1, max(windows) + 1)])
    return with_totals(shifted, base, windows)


def with_totals(shifted: DataFrame, base=BASE_NUMERIC, windows=ROLL_WINDOWS) -> DataFrame:
    """Adds per column and width the sum of the shifted values (NULL unless all are present)."""
    return shifted.select("*", *[sum((F.col(shift_name(c, k)) for k in range(2, w + 1)), F.col(shift_name(c, 1))).alias(_total(c, w))
                                 for c in base for w in windows])


def rolling_columns(base=BASE_NUMERIC, windows=ROLL_WINDOWS, stats=ROLL_STATS):
    """Statistic over rows [i-w, i-1], NULL unless all w values are present; on a frame with
    ``with_shifts`` columns."""
    def value(stat, c, w):
        past, mean = [F.col(shift_name(c, k)) for k in range(1, w + 1)], F.col(_total(c, w)) / F.lit(float(w))
        if stat == "mean":
            return mean
        if stat == "std":
            squares = sum(((x - mean) * (x - mean) for x in past[1:]), (past[0] - mean) * (past[0] - mean))
            return F.sqrt(squares / F.lit(float(w - 1)))
        extreme = (F.greatest if stat == "max" else F.least)(*past)
        return F.when(F.col(_total(c, w)).isNotNull(), extreme)

    return [value(stat, c, w).alias(f"{c}_{stat}{w}") for w in windows for stat in stats for c in base]


def diff_columns(keys, base=BASE_NUMERIC, diffs=DIFFS, date_col: str = "date"):
    w = Window.partitionBy(*as_list(keys)).orderBy(date_col)
    return [(F.col(c) - F.lag(c, k).over(w)).alias(f"{c}_diff{k}") for k in diffs for c in base]


def previous_category_columns(keys, cat_col="CAT", flag_col="critical_now", lags=CAT_LAGS,
                              date_col: str = "date"):
    w = Window.partitionBy(*as_list(keys)).orderBy(date_col)
    out = []
    for k in lags:
        out.append(F.lag(cat_col, k).over(w).alias(f"CAT_lag{k}"))
        out.append(F.lag(flag_col, k).over(w).alias(f"critical_lag{k}"))
    return out


def add_features(df: DataFrame, keys, base=BASE_NUMERIC, lags=LAGS, windows=ROLL_WINDOWS,
                 date_col: str = "date", with_calendar: bool = True,
                 with_categories: bool = True) -> DataFrame:
    """All model features in the fixed order: input columns, calendar, lags,
    rolling (per width: mean, max, min, std), diffs, previous categories."""
    keys = as_list(keys)
    cols = [F.col(c) for c in df.columns]
    if with_calendar:
        cols += calendar_columns(date_col)
    windowed = lag_columns(keys, base, lags, date_col) + diff_columns(keys, base, DIFFS, date_col)
    lagged = [f"{c}_lag{k}" for k in lags for c in base]
    diffs = [f"{c}_diff{k}" for k in DIFFS for c in base]
    previous = []
    if with_categories:
        windowed += previous_category_columns(keys, date_col=date_col)
        previous = [f"{n}_lag{k}" for k in CAT_LAGS for n in ("CAT", "critical")]
    staged = with_shifts(df.select("*", *windowed), keys, base, windows, date_col)
    return staged.select(*cols, *lagged, *rolling_columns(base, windows), *diffs, *previous)


def feature_columns(df: DataFrame, target: str, keys=(), include_future_categories: bool = False):
    """Every column but the date, current category, current flag, target and
    series keys. Future categories are left out unless asked for (they leak the
    target)."""
    skip = set(EXCLUDED) | {target} | set(as_list(keys))
    if not include_future_categories:
        skip |= set(FUTURE_CATEGORY_COLS)
    return [c for c in df.columns if c not in skip]
