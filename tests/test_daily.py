import datetime as dt

import numpy as np
from pyspark.sql import functions as F

from vigil.operators.daily import (align_variables, complete_calendar, daily_mean, filled_calendar, interpolate_time,
                                   long_values)

D0 = dt.date(2024, 3, 1)


def d(k):
    return D0 + dt.timedelta(days=k)


def test_daily_mean_skips_nulls_and_bad_dates(spark):
    rows = [(1, dt.datetime(2024, 3, 1, 1), 1.0), (1, dt.datetime(2024, 3, 1, 23), None),
            (1, dt.datetime(2024, 3, 1, 12), 3.0), (1, None, 100.0), (1, dt.datetime(2024, 3, 2), None)]
    df = spark.createDataFrame(rows, "s int, ts timestamp, v double")
    out = {r.date: r.v for r in daily_mean(df, ["s"], "ts", {"v": F.col("v")}).collect()}
    assert out == {d(0): 2.0, d(1): None}


def test_calendar_is_dense_and_keeps_values(spark):
    df = spark.createDataFrame([(1, d(0), 1.0, 1), (1, d(3), 4.0, 1), (2, d(1), 5.0, 1)],
                               "s int, date date, v double, _obs_v long")
    out = complete_calendar(df, ["s"], ["v"]).orderBy("s", "date").collect()
    assert [(r.s, r.date, r.v, r._obs_v) for r in out] == [
        (1, d(0), 1.0, 1), (1, d(1), None, 0), (1, d(2), None, 0), (1, d(3), 4.0, 1), (2, d(1), 5.0, 1)]


def test_time_interpolation_matches_np_interp(spark):
    known = {2: 1.0, 3: 4.0, 7: 0.0, 8: 2.5}
    rows = [(1, d(k), known.get(k)) for k in range(0, 12)]
    df = spark.createDataFrame(rows, "s int, date date, v double")
    got = [r.v for r in interpolate_time(df, ["s"], ["v"]).orderBy("date").collect()]
    xs = sorted(known)
    want = np.interp(range(12), xs, [known[x] for x in xs])
    assert np.allclose(got, want, rtol=0, atol=1e-12)


def test_alignment_uses_row_presence_not_values(spark):
    rows = [(1, d(0), "a", 1.0), (1, d(5), "a", None), (1, d(2), "b", 2.0), (1, d(9), "b", 3.0),
            (2, d(0), "a", 1.0)]  # series 2 has no "b": nothing kept
    df = spark.createDataFrame(rows, "s int, date date, variable string, value double")
    values, present = long_values("variable", "value", ["a", "b"])
    daily = daily_mean(df, ["s"], "date", values, present)
    out = align_variables(complete_calendar(daily, ["s"], ["a", "b"]), ["s"], ["a", "b"]).collect()
    assert sorted(r.date for r in out) == [d(k) for k in range(2, 6)]
    assert {r.s for r in out} == {1}


def test_one_pass_fill_equals_the_three_steps(spark):
    rng = np.random.default_rng(5)
    rows = []
    for s in range(12):
        for k in sorted(rng.choice(60, 25, replace=False).tolist()):
            a, b = (None if rng.random() < 0.3 else float(rng.normal()) for _ in range(2))
            rows.append((s, d(k), a, int(rng.random() < 0.8) if s != 3 else 0, b, 1))
    df = spark.createDataFrame(rows, "s int, date date, a double, _obs_a long, b double, _obs_b long")
    steps = interpolate_time(align_variables(complete_calendar(df, ["s"], ["a", "b"]), ["s"], ["a", "b"]),
                             ["s"], ["a", "b"])
    want = sorted((r.s, r.date, r.a, r.b) for r in steps.fillna(-99.0).collect())
    got = sorted((r.s, r.date, r.a, r.b) for r in filled_calendar(df, ["s"], ["a", "b"]).fillna(-99.0).collect())
    assert len(want) > 100 and got == want


def test_panel_stages_stay_small_enough_for_the_jit(spark):
    import re

    from vigil.plans.panel import daily_panel
    names = [f"v{i}" for i in range(7)]
    df = spark.createDataFrame([(1, d(0), *[1.0] * 7)], "s int, date date, " + ", ".join(f"{n} double" for n in names))
    panel = daily_panel(df, ["s"], "date", names)
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = spark._jvm.PythonSQLUtils.explainString(panel.select("*", (panel.v0 + 1).alias("w"))._jdf.queryExecution(), "codegen")
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", plan)]
    assert sizes and max(sizes) < 8000       # longer methods are interpreted, never compiled


def test_a_line_starts_again_at_each_known_day(spark):
    rows = [(1, d(0), None, 1.0), (1, d(2), 4.0, -0.0), (1, d(5), None, None), (1, d(6), 0.0, float("inf")), (1, d(9), None, 2.0)]
    df = spark.createDataFrame(rows, "s int, date date, a double, b double").selectExpr("*", "1L AS _obs_a", "1L AS _obs_b")
    got = {(r.date - d(0)).days: (r.a, r.b) for r in filled_calendar(df, ["s"], ["a", "b"]).collect()}
    assert [got[k][0] for k in range(10)] == [4.0, 4.0, 4.0, 3.0, 2.0, 1.0, 0.0, 0.0, 0.0, 0.0]
    assert got[0][1] == 1.0 and got[6][1] == float("inf") and got[9][1] == 2.0


def test_partitions_by_series_grow_with_the_table(spark, tmp_path, monkeypatch):
    from vigil.plans import panel as P
    path = str(tmp_path / "t")
    spark.range(20000).selectExpr("id % 50 AS s", "rand(1) AS a").write.parquet(path)
    df = spark.read.parquet(path)
    assert P.series_partitions(df) == int(spark.conf.get("spark.sql.shuffle.partitions"))
    monkeypatch.setattr(P, "SERIES_BYTES", 4096)
    assert P.by_series(df, ["s"]).rdd.getNumPartitions() == P.series_partitions(df) > 20
    assert P.series_partitions(spark.createDataFrame([(1,)], "s int")) >= 1


def test_a_task_of_the_window_stages_gets_a_megabyte(spark, tmp_path):
    from vigil.plans import panel as P
    path = str(tmp_path / "t")
    spark.range(1_400_000).selectExpr("id % 50 AS s", "rand(1) AS a").write.parquet(path)
    size = sum(f.stat().st_size for f in (tmp_path / "t").glob("*.parquet"))
    assert 9 << 20 < size < 16 << 20
    assert P.series_partitions(spark.read.parquet(path)) >= size >> 20
