import datetime as dt

from pyspark.sql import functions as F

from vigil.functions.category import alert, category, critical_flag
from vigil.operators.horizon import add_future_categories, add_target


def test_cut_points_are_strict(spark):
    vals = [None, 0.0, 50.0, 50.01, 79.0, 79.5, 109.0, 109.1, 169.0, 169.01]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vals)], "i int, v double")
    got = [r[0] for r in df.orderBy("i").select(category("v")).collect()]
    assert got == [None, "buena", "buena", "regular", "regular", "alerta", "alerta", "preemergencia",
                   "preemergencia", "emergencia"]
    flags = [r[0] for r in df.orderBy("i").select(critical_flag(category("v"))).collect()]
    assert flags == [0, 0, 0, 0, 0, 0, 0, 1, 1, 1]


def test_alert_inclusive(spark):
    df = spark.createDataFrame([(0.5,), (0.49,)], "p double")
    assert [r[0] for r in df.select(alert("p", 0.5)).collect()] == [1, 0]


def test_calendar_lookup_vs_row_shift(spark):
    d0 = dt.date(2024, 1, 1)
    days = [0, 1, 2, 4, 5]  # day 3 missing
    cats = ["buena", "emergencia", "buena", "preemergencia", "buena"]
    df = spark.createDataFrame([(1, d0 + dt.timedelta(d), c) for d, c in zip(days, cats)],
                               "series_id int, date date, CAT string")
    fut = add_future_categories(df, ["series_id"], drop_missing=False).orderBy("date").collect()
    assert [r.CAT_48h for r in fut] == ["buena", None, "preemergencia", None, None]
    assert [r.CAT_24h for r in fut] == ["emergencia", "buena", None, "buena", None]
    rows = add_target(df, ["series_id"]).orderBy("date").collect()
    assert [r.critical_t_plus_2 for r in rows] == [0, 1, 0, None, None]
    days_mode = add_target(df, ["series_id"], mode="days").orderBy("date").collect()
    assert [r.critical_t_plus_2 for r in days_mode] == [0, None, 1, None, None]
