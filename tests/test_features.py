import datetime as dt

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from vigil.operators.features import add_features, feature_columns
from vigil.operators.horizon import add_target
from vigil.functions.calendar import calendar_columns

BASE = ["PM25", "PM10", "temp", "hum", "pres", "wind", "winddir"]


def panel(spark, n=30, seed=0, null_at=(5,)):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        vals = [float(x) for x in np.round(rng.normal(60, 30, 7), 2)]
        if i in null_at:
            vals[0] = None
        cat = ["buena", "regular", "alerta", "preemergencia", "emergencia"][i % 5]
        rows.append((1, dt.date(2024, 1, 1) + dt.timedelta(days=i), *vals, cat))
    schema = "series_id int, date date, " + ", ".join(f"{c} double" for c in BASE) + ", CAT string"
    return spark.createDataFrame(rows, schema), rows


def test_rolling_lag_diff_match_pandas(spark):
    df, rows = panel(spark)
    out = add_features(add_target(df, ["series_id"]), ["series_id"]).orderBy("date").toPandas()
    pdf = pd.DataFrame([r[2:9] for r in rows], columns=BASE, dtype=float)
    for w in (2, 3, 5, 7, 14):
        for st, fn in (("mean", "mean"), ("max", "max"), ("min", "min"), ("std", "std")):
            want = getattr(pdf.rolling(w), fn)().shift(1)
            for c in BASE:
                assert np.allclose(out[f"{c}_{st}{w}"].astype(float), want[c], equal_nan=True, atol=1e-9), (c, st, w)
    for k in (1, 2, 3, 5, 7, 14):
        assert np.allclose(out[f"PM25_lag{k}"].astype(float), pdf["PM25"].shift(k), equal_nan=True)
    assert np.allclose(out["temp_diff2"].astype(float), pdf["temp"].diff(2), equal_nan=True)
    assert out["CAT_lag2"].tolist()[2:5] == ["buena", "regular", "alerta"]


def test_feature_count_and_exclusions(spark):
    df, _ = panel(spark)
    df = df.withColumn("CAT_48h", F.lit("buena"))
    feats = add_features(add_target(df, ["series_id"]), ["series_id"])
    cols = feature_columns(feats, "critical_t_plus_2", ["series_id"])
    assert len(cols) == 220 and "CAT_48h" not in cols and "critical_now" not in cols
    assert len(feature_columns(feats, "critical_t_plus_2", ["series_id"], include_future_categories=True)) == 221


def test_no_leakage_from_later_rows(spark):
    df, rows = panel(spark, seed=4)
    later = [r if i < 20 else (*r[:2], *(999.0,) * 7, "emergencia") for i, r in enumerate(rows)]
    df2 = spark.createDataFrame(later, df.schema)
    f1 = add_features(df.withColumn("critical_now", F.lit(0)), ["series_id"]).where("date < '2024-01-21'")
    f2 = add_features(df2.withColumn("critical_now", F.lit(0)), ["series_id"]).where("date < '2024-01-21'")
    assert f1.exceptAll(f2).count() == 0


def test_calendar_monday_zero(spark):
    df = spark.createDataFrame([(dt.date(2024, 1, 1),), (dt.date(2024, 1, 7),), (dt.date(2024, 7, 1),)], "date date")
    r = df.select(*calendar_columns("date")).collect()
    assert [x.dayofweek for x in r] == [0, 6, 0] and [x.is_weekend for x in r] == [0, 1, 0]
    assert [x.summer for x in r] == [1, 1, 0] and r[2].winter == 1
    assert np.isclose(r[0].doy_sin, np.sin(2 * np.pi / 365.25))
