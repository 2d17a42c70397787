"""Looking ahead: category k calendar days later (J2) and the row-shifted target.

Both are window functions over the series partitioning already in place; the
calendar lookup uses a RANGE frame on the day instead of a self-join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vigil.functions.category import category, critical_flag
from vigil.functions.util import as_list

# Look-ahead days and their column names; the forecast horizon.
FUTURE_DAYS = ((1, "CAT_24h"), (2, "CAT_48h"), (3, "CAT_72h"))
HORIZON_DAYS = 2


def value_days_ahead(df: DataFrame, column: str, keys, days: int, date_col: str = "date"):
    """Value of ``column`` of ``df`` on the calendar day ``date + days`` of the same series (NULL if absent)."""
    # Ordered by the day itself, as the target and the lags are: one sort serves them all. SQL text, as a frame of the
    # DataFrame interface counts in longs, which an order by dates does not take.
    day = f"`{date_col}`" if isinstance(df.schema[date_col].dataType, T.DateType) else f"CAST(`{date_col}` AS DATE)"
    by = ", ".join(f"`{k}`" for k in as_list(keys))
    return F.expr(f"first(`{column}`) OVER (PARTITION BY {by} ORDER BY {day} "
                  f"RANGE BETWEEN {int(days)} FOLLOWING AND {int(days)} FOLLOWING)")


def add_category(df: DataFrame, value_col: str = "PM25", out: str = "CAT", cuts=None) -> DataFrame:
    """X11 on a panel column."""
    return df.withColumn(out, category(value_col) if cuts is None else category(value_col, cuts))


def add_future_categories(df: DataFrame, keys, cat_col: str = "CAT", days=FUTURE_DAYS,
                          date_col: str = "date", drop_missing: bool = True) -> DataFrame:
    """Category at date+1, +2, +3 calendar days; rows lacking any are dropped."""
    names = []
    for k, name in days:
        df = df.withColumn(name, value_days_ahead(df, cat_col, keys, k, date_col))
        names.append(name)
    return df.dropna(subset=names) if drop_missing else df


def add_target(df: DataFrame, keys, cat_col: str = "CAT", horizon: int = HORIZON_DAYS,
               mode: str = "rows", date_col: str = "date") -> DataFrame:
    """X12 + W8: ``critical_now`` and ``critical_t_plus_<h>``.

    ``mode='rows'`` takes the flag ``h`` rows later (the source behaviour);
    ``mode='days'`` takes it ``h`` calendar days later.
    """
    target = f"critical_t_plus_{horizon}"
    df = df.withColumn("critical_now", critical_flag(cat_col))
    if mode == "rows":
        w = Window.partitionBy(*as_list(keys)).orderBy(date_col)
        return df.withColumn(target, F.lead("critical_now", horizon).over(w))
    if mode == "days":
        return df.withColumn(target, value_days_ahead(df, "critical_now", keys, horizon, date_col))
    raise ValueError(f"mode must be 'rows' or 'days', not {mode!r}")
