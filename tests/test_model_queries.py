from vigil.operators.cv import CV_SPLITS
from vigil.plans import modeling, registry


def test_evaluation_queries_take_the_whole_feature_set(monkeypatch):
    ready = ("rows", [f"f{i}" for i in range(220)], "critical_t_plus_2")
    seen = []
    monkeypatch.setattr(registry, "_model_ready", lambda spark, sf_dir: ready)
    monkeypatch.setattr(modeling, "evaluate_models", lambda df, feats, target, keys, **o: seen.append((df, feats, target)) or [None] * 4)
    monkeypatch.setattr("vigil.operators.cv.assign_date_folds", lambda df: df)
    monkeypatch.setattr("vigil.operators.cv.fold_split", lambda df, fold: (df, f"test {fold}"))
    monkeypatch.setattr(modeling, "fit_model", lambda name, train, feats, target, keys, params: seen.append((train, feats, target)))
    monkeypatch.setattr(modeling, "scored_rows", lambda model, rows, keys, target: rows)
    registry.q_oof_predictions(None, "")
    registry.q_cv_fold_metrics(None, "")
    assert registry.q_gbt_calibrated_scores(None, "") == f"test {CV_SPLITS}"
    assert seen == [ready] * 3


def test_boosted_queries_train_every_round(monkeypatch):
    from vigil.operators.models import GBT_PARAMS
    seen = []
    monkeypatch.setattr(registry, "_model_ready", lambda spark, sf_dir: ("rows", ["f"], "y"))
    monkeypatch.setattr(modeling, "evaluate_models", lambda *a, gbt_params=None, **o: seen.append(gbt_params) or [None] * 4)
    monkeypatch.setattr("vigil.operators.cv.assign_date_folds", lambda df: df)
    monkeypatch.setattr("vigil.operators.cv.fold_split", lambda df, fold: (df, df))
    monkeypatch.setattr(modeling, "fit_model", lambda name, train, feats, target, keys, params=None: seen.append(params))
    monkeypatch.setattr(modeling, "scored_rows", lambda model, rows, keys, target: rows)
    for query in ("oof_predictions", "cv_fold_metrics", "gbt_calibrated_scores"):
        registry.QUERIES[query](None, "")
    assert [dict(GBT_PARAMS, **(params or {})) for params in seen] == [GBT_PARAMS] * 3 and GBT_PARAMS["maxIter"] == 350


def test_model_rows_are_made_of_a_bucketed_panel(spark, monkeypatch):
    import datetime as dt

    from vigil.operators.horizon import add_category, add_future_categories
    from vigil.plans.panel import by_series
    rows = [(s, dt.date(2024, 1, 1) + dt.timedelta(days=i), *[float((i * 37 + s) % 200)] * 7) for s in (1, 2, 3) for i in range(30)]
    schema = "series_id int, date date, " + ", ".join(f"{c} double" for c in registry.VARS)
    panel = add_future_categories(add_category(by_series(spark.createDataFrame(rows, schema), registry.KEYS, 4), "PM25"), registry.KEYS)
    monkeypatch.setattr(registry, "clean_lineitem_panel", lambda *a: panel)
    df, features, target = registry._model_ready(spark, "")
    want, _, _ = modeling.model_ready(panel, registry.KEYS)
    assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString() and len(features) == 220
    columns = ["series_id", "date", target, "PM25_std14", "CAT_lag3", "wind_diff2"]
    assert sorted(map(str, df.select(columns).collect())) == sorted(map(str, want.select(columns).collect()))


def test_final_scores_are_made_once(spark, monkeypatch):
    stored = []
    cut = modeling.cut_lineage
    monkeypatch.setattr(modeling, "cut_lineage", lambda d, *a: stored.append(d.columns) or cut(d, *a))
    df = spark.range(60).selectExpr("0 AS s", "date_add(date'2024-01-01', int(id)) AS date", "double(id % 7) AS a", "int(id % 7 > 3) AS y")
    _, _, predictions, _ = modeling.fit_final(df, ["a"], "y", ["s"], "logit_balanced")
    assert predictions.count() == 60 and stored == [["s", "date", "y_true", "y_prob", "_g"]]
    assert "Range" not in predictions._jdf.queryExecution().executedPlan().toString()
