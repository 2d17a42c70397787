"""Clean daily panel (the build-from-source-files path): daily means of every
variable, calendar completion, inner alignment, time interpolation, complete
rows only, sequential outlier trimming, category and its value 1-3 days ahead,
plus the z-scored copy and scaler table.

Physical shape: one partial+final hash aggregate keyed by (series, day), then
one exchange on the series keys; every later step (alignment bounds, neighbours
for the interpolation, calendar explode, 7 trimming quantiles, look-ahead) is a window,
generator or array step on that same partitioning. No joins, no broadcast.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.functions.util import as_list
from vigil.operators.daily import daily_mean, drop_incomplete, filled_calendar, long_values
from vigil.operators.features import BASE_NUMERIC
from vigil.operators.horizon import add_category, add_future_categories
from vigil.operators.quality import trim_sequential, zscore_apply, zscore_fit
from vigil.session import compiled_methods, cut_lineage


# Estimated bytes of observed days that one task of the window stages gets: about 200,000 calendar days of seven variables.
SERIES_BYTES = 1 << 19
UNKNOWN_BYTES = 1 << 60     # no estimate at all (rows made in Python) is above this


def series_partitions(df: DataFrame) -> int:
    """spark.sql.shuffle.partitions, or more where the daily table's estimated size asks for it."""
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(least, -(-size // SERIES_BYTES)) if size < UNKNOWN_BYTES else least


def by_series(df: DataFrame, keys, partitions: int | None = None) -> DataFrame:
    """Hash-partition the daily table by series once. Every later window is
    keyed by series, so this exchange replaces the one the first window would
    add; its partition count is set (``series_partitions``) so that the CPU-heavy
    window stages are not merged into a few large tasks, and a task's share
    stays the same when the table grows."""
    compiled_methods(df.sparkSession)   # the windows and hundreds of features on it make such methods
    n = partitions or series_partitions(df)
    return df.repartition(n, *[F.col(k) for k in as_list(keys)])


def daily_panel(obs: DataFrame, keys, date_col: str, variables=BASE_NUMERIC,
                variable_col: str | None = None, value_col: str | None = None) -> DataFrame:
    """A1 + J3 + J1 + W9 + X16.

    Wide input: one column per variable. Long input: ``variable_col`` names the
    variable and ``value_col`` holds the value.
    """
    keys = as_list(keys)
    if variable_col:
        values, present = long_values(variable_col, value_col, variables)
    else:
        values, present = {v: F.col(v) for v in variables}, None
    # a row of wide input observes every variable: its counts would all be positive, and are not shuffled
    daily = by_series(daily_mean(obs, keys, date_col, values, present, keep_counts=present is not None), keys)
    return drop_incomplete(filled_calendar(daily, keys, variables), variables)


def clean_panel(obs: DataFrame, keys, date_col: str, variables=BASE_NUMERIC,
                trim_columns=None, value_for_category: str = "PM25", cuts=None,
                variable_col: str | None = None, value_col: str | None = None) -> DataFrame:
    """The raw clean dataset: keys, date, variables, CAT, CAT_24h, CAT_48h, CAT_72h."""
    keys = as_list(keys)
    panel = daily_panel(obs, keys, date_col, variables, variable_col, value_col)
    panel = trim_sequential(panel, keys, list(trim_columns or variables))
    panel = add_category(panel, value_for_category, "CAT", cuts)
    return add_future_categories(panel, keys)


def write_panel(panel: DataFrame, keys, table: str, path: str, buckets: int | None = None, date_col: str = "date",
                dealt: bool = False) -> DataFrame:
    """The panel as a table bucketed by series and sorted by day within it, read back.

    One bucket is one file, so features, scaling, trimming and scoring of the table plan without an exchange. Its
    bucket count should suit the data (at most about 128 MB a bucket); it is kept by every later step. ``dealt``: the panel is
    in ``by_series`` partitions already, which then are the buckets, and is not exchanged again."""
    keys = as_list(keys)
    spark = panel.sparkSession
    n = partitions_of(panel) if dealt else buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = panel if dealt else by_series(panel, keys, n)
    (rows.write.mode("overwrite").option("path", path).option("compression", "zstd")
     .bucketBy(n, *keys).sortBy(*keys, date_col).saveAsTable(table))
    return spark.table(table)


def partitions_of(df: DataFrame) -> int:
    """How many partitions the (last) exchange of ``df`` deals its rows to."""
    return int(df._jdf.queryExecution().sparkPlan().outputPartitioning().numPartitions())


def scaled_panel(clean: DataFrame, keys, variables=BASE_NUMERIC) -> tuple[DataFrame, DataFrame]:
    """The z-scored dataset (population std per series) and its scaler table."""
    return zscore_apply(clean, keys, list(variables)), zscore_fit(clean, keys, list(variables))


def build_raw(spark: SparkSession, files: dict[str, str], out_dir: str, keys, variables=BASE_NUMERIC) -> DataFrame:
    """The job from one text file per variable to the written datasets (S1-S4, A1 ... J2, S11, S12): ``raw`` (the clean
    panel), ``scaled`` and ``scaler`` under ``out_dir``. Returns the raw dataset as read back."""
    from vigil.plans.artefacts import write_table
    from vigil.sources.delimited import load_variables
    keys = as_list(keys)
    obs = load_variables(spark, files, keys)
    panel = cut_lineage(clean_panel(obs, keys, "date", variables, variable_col="variable", value_col="value"))
    scaled, scaler = scaled_panel(panel, keys, variables)
    scaler = cut_lineage(scaler)    # a few rows per series: sorting samples its input, which would be fitted twice
    for name, table, order in (("raw", panel, [*keys, "date"]), ("scaled", scaled, [*keys, "date"]), ("scaler", scaler, [*keys, "feature"])):
        write_table(table, f"{out_dir}/{name}", order)
    return spark.read.parquet(f"{out_dir}/raw")
