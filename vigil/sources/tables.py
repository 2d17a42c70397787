"""Readers for the parquet tables and the panels derived from them.

Each reader selects only the columns it uses, so the parquet scan prunes the
rest (``ReadSchema`` in the plan) and filters push down to the scan.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def table_path(sf_dir: str, name: str) -> str:
    return os.path.join(sf_dir, f"{name}.parquet")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(table_path(sf_dir, name))


# The seven station variables as derived from lineitem, one supplier = one
# series. Values are rescaled so the standard category cut points apply, and
# some values are made missing by key rules to exercise gap handling.
LINEITEM_VARIABLES = {
    "PM25": "l_quantity * 3.5",
    "PM10": "CASE WHEN l_orderkey % 7 = 3 THEN NULL ELSE l_extendedprice / 1000.0 END",
    "temp": "CASE WHEN l_orderkey % 11 = 5 THEN NULL ELSE l_discount * 100.0 END",
    "hum": "l_tax * 100.0",
    "pres": "CAST(1000 - l_linenumber AS DOUBLE)",
    "wind": "CASE WHEN l_partkey % 13 = 0 THEN NULL ELSE l_extendedprice / l_quantity / 100.0 END",
    "winddir": "CAST((l_partkey * 7) % 360 AS DOUBLE)",
}
LINEITEM_SERIES = "l_suppkey"
LINEITEM_DATE = "l_shipdate"


def lineitem_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(series_id, ts, PM25 .. winddir): one observation row per line item."""
    li = read_table(spark, sf_dir, "lineitem")
    return li.select(F.col(LINEITEM_SERIES).alias("series_id"), F.col(LINEITEM_DATE).alias("ts"),
                     *[F.expr(e).alias(n) for n, e in LINEITEM_VARIABLES.items()])


# events as a long table: one variable per event type, one series per user.
EVENT_VARIABLES = ("click", "error", "purchase", "signup", "view")


def event_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(series_id, ts, variable, value) from events."""
    ev = read_table(spark, sf_dir, "events")
    return ev.select(F.col("user_id").alias("series_id"), F.col("ts"),
                     F.col("event_type").alias("variable"), F.col("value"))
