import datetime as dt
import math

from pyspark.sql import functions as F

from vigil.operators.daily import daily_mean, filled_calendar, obs_col
from vigil.operators.features import add_features
from vigil.operators.horizon import add_future_categories, add_target
from vigil.plans.panel import daily_panel
from vigil.plans.registry import ROUND_GUARD, round6


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_rounding_is_sparks_without_decimals(spark):
    values = [(k + 0.5) / 1e6 - ROUND_GUARD for k in range(-300, 300)] + [k / 8 for k in range(-40, 40)] + [
        0.0, -0.0, -1e-9, 1e-9, 1e300, -1e300, 123456789.1234565, math.inf, -math.inf, math.nan, None]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    y = (F.col("x") + F.lit(ROUND_GUARD)) * F.lit(1e6)
    assert df.where(F.abs(y - F.rint(y)) == 0.5).count() > 100        # halves are among them
    both = df.select((F.round(y) / F.lit(1e6)).cast("string").alias("want"), round6(F.col("x")).cast("string").alias("got"))
    assert both.where("NOT (want <=> got)").count() == 0
    assert "round(" not in plan_of(df.select(round6(F.col("x"))))


def test_look_ahead_target_and_lags_share_one_sort(spark):
    rows = [(s, dt.date(2024, 1, 1) + dt.timedelta(days=i), float(i), "ab"[i % 2]) for s in (1, 2) for i in range(40) if i % 7]
    df = spark.createDataFrame(rows, "series_id int, date date, a double, CAT string").repartition(2, "series_id")
    out = add_features(add_target(add_future_categories(df, ["series_id"]), ["series_id"]), ["series_id"], ["a"], with_calendar=False)
    assert plan_of(out).split("Initial Plan")[-1].count("Sort [") == 1
    held = {(s, d): c for s, d, _, c in rows}
    got = {(r.series_id, r.date): (r.CAT_24h, r.CAT_48h, r.CAT_72h) for r in out.collect()}
    ahead = {k: tuple(held.get((k[0], k[1] + dt.timedelta(days=n))) for n in (1, 2, 3)) for k in held}
    assert got == {k: v for k, v in ahead.items() if None not in v}


def test_wide_panels_shuffle_no_counts(spark):
    rows = [(s, dt.date(2024, 1, 1) + dt.timedelta(days=i), None if i % 5 == s else float(i * i), float(i) if i % 3 else None)
            for s in (1, 2) for i in range(0, 60, 1 + s)]
    obs = spark.createDataFrame([*rows, (3, None, 1.0, 1.0), (4, dt.date(2024, 1, 1), None, None)],
                                "series_id int, date date, a double, b double")
    values = {v: F.col(v) for v in ("a", "b")}
    counted = filled_calendar(daily_mean(obs, ["series_id"], "date", values), ["series_id"], ["a", "b"]).dropna()
    panel = daily_panel(obs, ["series_id"], "date", ["a", "b"])
    assert panel.exceptAll(counted).count() == counted.exceptAll(panel).count() == 0 and panel.count() > 50
    assert obs_col("a") not in plan_of(panel)


def test_large_methods_are_left_to_compiled_ones(spark):
    from vigil.plans.panel import by_series
    name, df = "spark.sql.codegen.hugeMethodLimit", spark.range(3).selectExpr("id AS series_id")
    before = spark.conf.get(name, None)
    try:
        spark.conf.unset(name)
        by_series(df, ["series_id"])
        assert spark.conf.get(name) == "8000"
        spark.conf.set(name, "9000")
        by_series(df, ["series_id"])
        assert spark.conf.get(name) == "9000"
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def test_a_dealt_panel_is_bucketed_without_another_exchange(spark, monkeypatch):
    import tempfile

    from vigil.plans import panel as P
    rows = [(s, dt.date(2024, 1, 1) + dt.timedelta(days=i), float(i)) for s in range(9) for i in range(30)]
    df = P.by_series(spark.createDataFrame(rows, "series_id int, date date, a double"), ["series_id"], 5).where("a <> 3")
    monkeypatch.setattr(P, "by_series", lambda *a: 1 / 0)
    table = P.write_panel(df, ["series_id"], "dealt_panel_test", tempfile.mkdtemp(prefix="vigil-panel-"), dealt=True)
    assert len(table.inputFiles()) <= 5 and sorted(table.collect()) == sorted(tuple(r) for r in rows if r[2] != 3)
    features = plan_of(add_features(table, ["series_id"], ["a"], with_categories=False))
    assert "SelectedBucketsCount: 5 out of 5" in features and "Exchange" not in features
    spark.sql("DROP TABLE dealt_panel_test")


def test_a_run_is_counted_without_storing_rows(spark, monkeypatch):
    from vigil.operators.features import BASE_NUMERIC
    from vigil.operators.horizon import add_category
    from vigil.plans import modeling
    schema = "series_id int, date date, " + ", ".join(f"{c} double" for c in BASE_NUMERIC)
    rows = [(s, dt.date(2024, 1, 1) + dt.timedelta(days=i + s), *[float((i * 37 + s) % 200)] * 7)
            for s in (1, 2, 3) for i in range(30) if i % (5 + s)] + [(None, dt.date(2024, 1, 9), *[170.0] * 7)]
    panel = add_category(spark.createDataFrame(rows, schema), "PM25")
    panel = add_future_categories(panel, ["series_id"], drop_missing=False)
    df, features, target = modeling.model_ready(panel, ["series_id"])
    want = modeling.panel_sums(panel, ["series_id"]), modeling.observed_rows(df, target)[1], features
    monkeypatch.setattr(modeling, "cut_lineage", lambda *a: 1 / 0)
    assert modeling.counted_run(panel, ["series_id"]) == want and want[0]["n"] == len(rows) and want[0]["span"] > 80
    none = modeling.counted_run(panel.where("date IS NULL"), ["series_id"])
    assert none[0] == dict.fromkeys(("n", "span", "critical", "known")) and none[1]["n_rows_model"] == 0
