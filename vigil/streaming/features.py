"""Streaming features (W1-W6 for L12s): panel rows arriving as files -> lags, rolling statistics, differences.

Row-based windows cannot run on a stream, so the stream carries the last rows of each series as state: a row leaves
the stateful operator together with the values before it, nearest first, and everything else is the same
built-in arithmetic as in the batch feature table. State per series is bounded by the longest window. The stream's checkpoint
holds state and progress, so a restarted query goes on where the last one ended.

Rows of a series must arrive in date order across files (within one file any order will do): a row that is not later
than the last one seen of its series is left out, as is a second row of the same day.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vigil.functions.calendar import calendar_columns
from vigil.functions.util import as_list
from vigil.operators.features import (BASE_NUMERIC, DIFFS, LAGS, ROLL_WINDOWS, rolling_columns, shift_name, with_totals)


def with_history(rows: DataFrame, keys, base=BASE_NUMERIC, depth: int = max(ROLL_WINDOWS), date_col: str = "date") -> DataFrame:
    """Adds ``_<c>_history`` (array, nearest row first, at most ``depth``) to a stream of (keys, date, base) rows."""
    keys, base = as_list(keys), list(base)
    key_fields = [rows.schema[k] for k in keys]
    history = [T.StructField(f"_{c}_history", T.ArrayType(T.DoubleType())) for c in base]
    lines = [T.StructField(f"_{c}_line", T.ArrayType(T.DoubleType())) for c in base]
    out = T.StructType([*key_fields, T.StructField("_days", T.ArrayType(T.DateType())), *lines])
    state_type = T.StructType([T.StructField("last", T.DateType()), *history])

    def carry(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        last, past = (None, [[] for _ in base])
        if state.exists:
            last, *past = state.get
        days, columns = [], [[] for _ in base]
        for f in frames:
            days += f[date_col].tolist()
            for values, c in zip(columns, base):
                values += f[c].tolist()
        first = {}
        for i, d in enumerate(days):
            first.setdefault(d, i)
        new = sorted(d for d in first if d is not None and (last is None or d > last))
        if last is None and None in first:
            new.append(None)
        if not new:
            return
        # past: nearest first; a line: oldest first, the rows before and then the new ones
        held = [[*before[::-1], *(None if v is None or v != v else v for v in (values[first[d]] for d in new))]
                for before, values in zip(past, columns)]
        state.update((new[-1], *(line[-depth:][::-1] for line in held)))
        yield pd.DataFrame(dict(zip(out.fieldNames(), ([v] for v in (*key, new, *held)))))

    typed = rows.select(*keys, F.col(date_col).cast("date").alias(date_col), *[F.col(c).cast("double").alias(c) for c in base])
    carried = typed.groupBy(*keys).applyInPandasWithState(carry, out, state_type, "append", "NoTimeout")
    # One row per series and batch leaves Python; its rows and their histories are cut out of the lines by expressions.
    new, before = F.size("_days"), F.size(f"_{base[0]}_line") - F.size("_days")

    def row(i):
        at = before + i
        past = [F.reverse(F.slice(f"_{c}_line", F.greatest(at - depth, F.lit(0)) + 1, F.least(at, F.lit(depth)))) for c in base]
        return F.struct(F.get("_days", i).alias(date_col), *[F.get(f"_{c}_line", at).alias(c) for c in base],
                        *[h.alias(f"_{c}_history") for c, h in zip(base, past)])

    return carried.select(*keys, F.inline(F.transform(F.sequence(F.lit(0), new - 1), row)))


def features_of_history(rows: DataFrame, keys, base=BASE_NUMERIC, lags=LAGS, windows=ROLL_WINDOWS, diffs=DIFFS,
                        date_col: str = "date", with_calendar: bool = True) -> DataFrame:
    """The columns of ``add_features`` (without categories), in its order, from rows with their history."""
    keys = as_list(keys)
    depth = max(*windows, *lags, *diffs)
    shifted = rows.select(*keys, date_col, *base, *[F.get(f"_{c}_history", k - 1).alias(shift_name(c, k))
                                                     for c in base for k in range(1, depth + 1)])
    shifted = with_totals(shifted, base, windows)
    return shifted.select(
        *keys, date_col, *base, *(calendar_columns(date_col) if with_calendar else []),
        *[F.col(shift_name(c, k)).alias(f"{c}_lag{k}") for k in lags for c in base], *rolling_columns(base, windows),
        *[(F.col(c) - F.col(shift_name(c, k))).alias(f"{c}_diff{k}") for k in diffs for c in base])


def feature_stream(spark: SparkSession, source_dir: str, schema, keys, sink_dir: str, checkpoint_dir: str, base=BASE_NUMERIC,
                   date_col: str = "date", fmt: str = "parquet", max_files_per_trigger: int = 1, available_now: bool = True):
    """Start the stream: files of panel rows, oldest first -> feature rows appended to a parquet sink."""
    rows = (spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files_per_trigger)
            .option("recursiveFileLookup", "true").format(fmt).load(source_dir))
    out = features_of_history(with_history(rows, keys, base, date_col=date_col), keys, base, date_col=date_col)
    writer = (out.writeStream.format("parquet").option("path", sink_dir)
              .option("checkpointLocation", checkpoint_dir).outputMode("append"))
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="10 seconds")
    return writer.start()
