"""Scoring input check."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil.functions.parse import to_number_plain

# The snapshot columns a scoring model needs, in order.
REQUIRED_COLUMNS = ("PM25", "temp", "hum", "wind")


def check_columns(df: DataFrame, required=REQUIRED_COLUMNS) -> None:
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"a snapshot needs {', '.join(required)}; not there: {', '.join(missing)}")


def validate_snapshots(df: DataFrame, required=REQUIRED_COLUMNS, keep=()) -> DataFrame:
    """S10 for any number of rows: required columns coerced to numbers,
    ``valid`` = 1 when none is missing; output = kept id columns + required
    columns in fixed order + valid. Extra columns are dropped."""
    check_columns(df, required)
    cols = [to_number_plain(F.col(c)).alias(c) for c in required]
    out = df.select(*keep, *cols)
    ok = F.lit(True)
    for c in required:
        ok = ok & F.col(c).isNotNull()
    return out.withColumn("valid", ok.cast("int"))


def strict_snapshot(df: DataFrame, required=REQUIRED_COLUMNS) -> DataFrame:
    """The single-snapshot contract: exactly one row, all required values numeric."""
    checked = validate_snapshots(df, required)
    row = checked.agg(F.count(F.lit(1)).alias("n"), F.sum(1 - F.col("valid")).alias("bad")).first()
    if row["n"] != 1:
        raise ValueError(f"one snapshot row expected, {row['n']} found")
    if row["bad"]:
        raise ValueError(f"the snapshot lacks a number in at least one of {', '.join(required)}")
    return checked.drop("valid")
