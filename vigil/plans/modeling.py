"""Model selection and the final model.

Driver-side loops are over models and folds only (2 x 5 fits); every fit,
score and metric is a Spark job, and only metadata-sized results (metric rows,
thresholds, coefficients) come back to the driver.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from vigil.functions.category import alert, critical_flag
from vigil.functions.util import as_list
from vigil.operators import evaluate as ev
from vigil.operators.cv import CV_SPLITS, assign_date_folds, assign_folds
from vigil.operators.features import add_features, feature_columns
from vigil.operators.horizon import HORIZON_DAYS, add_target
from vigil.operators.fold_fits import fit_logits
from vigil.operators.models import fit_gbt_calibrated, fit_logit
from vigil.plans.artefacts import save_model, write_json, write_table
from vigil.plans.panel import scaled_panel
from vigil.session import cut_lineage

# The model names.
MODELS = ("logit_balanced", "hgb_calibrated")


def model_ready(panel: DataFrame, keys, horizon: int = HORIZON_DAYS, mode: str = "rows",
                include_future_categories: bool = False) -> tuple[DataFrame, list[str], str]:
    """Features + target on a clean panel; rows without a target dropped."""
    keys = as_list(keys)
    target = f"critical_t_plus_{horizon}"
    df = add_features(add_target(panel, keys, horizon=horizon, mode=mode), keys)
    df = df.where(F.col(target).isNotNull()).withColumn(target, F.col(target).cast("int"))
    return df, feature_columns(df, target, keys, include_future_categories), target


def fit_model(name: str, train: DataFrame, features, target: str, keys, gbt_params: dict | None = None):
    if name == "logit_balanced":
        return fit_logit(train, features, target)
    if name == "hgb_calibrated":
        return fit_gbt_calibrated(train, features, target, ["date", *as_list(keys)], gbt_params)
    raise ValueError(f"unknown model {name!r}")


def scored_rows(model, rows: DataFrame, keys, target: str) -> DataFrame:
    return model.score(rows).select(*as_list(keys), "date", F.col(target).alias("y_true"), "y_prob")


def evaluate_models(df: DataFrame, features, target: str, keys, models=MODELS, n_splits: int = CV_SPLITS,
                    recall_target: float = ev.RECALL_TARGET, gbt_params: dict | None = None,
                    pooled_dates: bool = True, tune_on: str = "test"):
    """Forward-chained CV of each model. Returns (summary, fold metrics,
    thresholds, out-of-fold predictions). ``pooled_dates``: folds over the dates of all series, as
    one model serves them all; otherwise over the rows of each series. ``tune_on``: each fold's threshold is
    picked on its test rows, as the source does, or on its training rows ("train"), so that the metrics
    are of a choice that has not seen the test rows."""
    if tune_on not in ("test", "train"):
        raise ValueError(f"tune_on must be 'test' or 'train', not {tune_on!r}")
    keys = as_list(keys)
    # not stored: ``df`` has hundreds of columns, which a pass makes from the panel sooner than it writes or reads them
    folded = ((assign_date_folds(df, n_splits=n_splits) if pooled_dates else assign_folds(df, keys, n_splits=n_splits))
              .where(F.col("n") > n_splits).withColumn("cell", F.coalesce("test_fold", F.lit(0))))
    spark = df.sparkSession
    held = {r["cell"]: r["count"] for r in folded.groupBy("cell").count().collect()}       # a row per fold
    folds = [f for f in range(1, n_splits + 1) if held.get(f)]
    if not folds:
        raise ValueError(f"{n_splits} folds need more than {n_splits} days")
    mk = ["model", "fold"]
    parts, sizes, picks = [], [], []
    for name in models:
        # fold f trains on every earlier cell, so one pass prepares or fits all folds of the logistic model
        if name == "logit_balanced":
            fitted = dict(zip(folds, fit_logits(folded, features, target, [range(f) for f in folds])))
        for f in folds:
            train, test = folded.where(F.col("cell") < f), folded.where(F.col("cell") == f)
            model = fitted[f] if name == "logit_balanced" else fit_model(name, train, features, target, keys, gbt_params)
            part = scored_rows(model, test, keys, target).select(
                F.lit(name).alias("model"), F.lit(f).alias("fold"), "*")
            parts.append(cut_lineage(part))
            if tune_on == "train":
                own = scored_rows(model, train, keys, target).select(F.lit(name).alias("model"), F.lit(f).alias("fold"), "*")
                curve = ev.threshold_curve(own, mk, "y_true", "y_prob")
                picks.append(cut_lineage(ev.pick_threshold(curve, mk, recall_target).select(*mk, "threshold")))
            sizes.append((name, f, sum(held.get(k, 0) for k in range(f))))
    oof = parts[0]
    for p in parts[1:]:
        oof = oof.unionByName(p)
    n_train = spark.createDataFrame(sizes, "model string, fold int, n_train long")
    picked = reduce(DataFrame.unionByName, picks) if picks else None
    folds = cut_lineage(ev.fold_metrics(oof, mk, "y_true", "y_prob", recall_target, n_train, picked))
    thresholds = folds.select(*mk, "threshold", "precision", "recall", "f1", "balanced_acc")
    oof = oof.join(F.broadcast(folds.select(*mk, "threshold")), mk).withColumn("y_pred", alert("y_prob", "threshold")).drop(
        "threshold")
    summary = ev.cv_summary(folds)
    return summary, folds, thresholds, oof


def fit_final(df: DataFrame, features, target: str, keys, name: str, recall_target: float = ev.RECALL_TARGET,
              gbt_params: dict | None = None):
    """Fit on every row, threshold chosen on the same rows (as the source
    does), in-sample predictions; coefficient table for the logistic model."""
    keys = as_list(keys)
    model = fit_model(name, df, features, target, keys, gbt_params)
    # stored: a few columns, which the threshold and the predictions both read; the features are made once for them
    scored = cut_lineage(scored_rows(model, df, keys, target).withColumn("_g", F.lit(0)))
    best = ev.pick_threshold(ev.threshold_curve(scored, ["_g"], "y_true", "y_prob"), ["_g"], recall_target)
    thr = best.drop("_g").first().asDict()
    preds = scored.drop("_g").withColumn("y_pred", alert("y_prob", float(thr["threshold"])))
    importance = model.importance(df.sparkSession) if hasattr(model, "importance") else None
    return model, thr, preds, importance


def _observed(df: DataFrame, target: str, seen: Observation) -> DataFrame:
    return df.observe(seen, F.count(F.lit(1)).alias("n_rows_model"), F.avg(target).alias("event_rate_target"),
                      F.min("date").alias("date_start"), F.max("date").alias("date_end"))


def observed_rows(df: DataFrame, target: str) -> tuple[DataFrame, dict]:
    """The rows, stored, and what the run's records count of them, observed while they are written."""
    seen = Observation(f"model rows {uuid.uuid4().hex}")
    df = cut_lineage(_observed(df, target, seen))
    return df, dict(seen.get)


def counted_run(panel: DataFrame, keys) -> tuple[dict, dict, list[str]]:
    """What ``panel_sums`` and ``observed_rows`` count, from one pass that stores nothing: the model rows with all their
    features are written to a sink that keeps none, as only their counts are wanted, and the panel's rows are observed on
    the way there. Returns (sums of the panel, counts of the model rows, features)."""
    keys = as_list(keys)
    whole = Window.partitionBy(*keys)
    day, critical = F.col("date"), critical_flag("CAT")
    # a series' span stands in its first row
    span = F.when(F.row_number().over(whole.orderBy(day)) == 1, F.datediff(F.max(day).over(whole), F.min(day).over(whole)) + 1)
    passed, seen = (Observation(f"{name} {uuid.uuid4().hex}") for name in ("panel", "model rows"))
    rows = panel.withColumn("_span", span).observe(
        passed, F.count(day).alias("n"), F.sum("_span").alias("span"), F.sum(critical).alias("critical"),
        F.count(critical).alias("known"), F.count(F.lit(1)).alias("rows"))
    df, features, target = model_ready(rows.drop("_span"), keys)
    _observed(df, target, seen).write.format("noop").mode("overwrite").save()
    sums = dict(passed.get)
    return {k: v if sums["rows"] else None for k, v in sums.items() if k != "rows"}, dict(seen.get), features


def panel_sums(panel: DataFrame, keys) -> dict:
    """Days, days of the series' spans, critical days and days with a category. One aggregate over the panel."""
    day, critical = F.col("date"), critical_flag("CAT")
    each = panel.groupBy(*as_list(keys)).agg(F.count(day).alias("n"), (F.datediff(F.max(day), F.min(day)) + 1).alias("span"),
                                             F.sum(critical).alias("critical"), F.count(critical).alias("known"))
    return each.agg(*[F.sum(c).alias(c) for c in ("n", "span", "critical", "known")]).first().asDict()


def run_metadata(whole: dict, counts: dict, features, chosen: str) -> dict:
    """What is recorded of a run: its rows, days, events (``panel_sums``) and features."""
    return dict(selected_model=chosen, horizon_days=HORIZON_DAYS, recall_target=ev.RECALL_TARGET, n_features=len(features),
                feature_columns=list(features), n_rows_observed=whole["n"],
                coverage_ratio_observed_vs_full_range=whole["n"] / whole["span"] if whole["span"] else None,
                event_rate_now=whole["critical"] / whole["known"] if whole["known"] else None, **{k: (str(v) if k.startswith("date") else v) for k, v in counts.items()})


def run_modeling(spark: SparkSession, panel: DataFrame, keys, out_dir: str | None = None,
                 models=MODELS, gbt_params: dict | None = None) -> dict:
    """The whole modelling step on a clean panel; writes the result tables and
    artefacts under ``out_dir`` when given."""
    keys = as_list(keys)
    panel = cut_lineage(panel)
    df, features, target = model_ready(panel, keys)
    df, counts = observed_rows(df, target)
    summary, folds, thresholds, oof = evaluate_models(df, features, target, keys, models,
                                                      gbt_params=gbt_params)
    chosen = ev.best_model(summary).first()["model"]
    model, thr, preds, importance = fit_final(df, features, target, keys, chosen, gbt_params=gbt_params)
    result = dict(summary=summary, fold_metrics=folds, thresholds=thresholds, oof=oof, predictions=preds,
                  model_ready=df, importance=importance, model=model, threshold=thr, chosen=chosen, panel=panel, keys=keys,
                  metadata=run_metadata(panel_sums(panel, keys), counts, features, chosen))
    if out_dir:
        write_outputs(spark, result, out_dir)
    return result


def summary_lines(metadata: dict, threshold: dict) -> list[tuple[str, str]]:
    """The summary's lines on data, chosen model and threshold."""
    lines = [(k, str(v)) for k, v in metadata.items() if k != "feature_columns"]
    return lines + [(f"threshold_{k}" if k != "threshold" else k, repr(v)) for k, v in threshold.items()]


def run_summary(spark: SparkSession, result: dict) -> DataFrame:
    """(item, value) lines of one run: data, chosen model, threshold, CV means of the chosen model."""
    lines = summary_lines(result["metadata"], result["threshold"])
    chosen = result["summary"].where(F.col("model") == result["chosen"]).first().asDict()    # one row
    lines += [(k, repr(v)) for k, v in chosen.items() if k != "model"]
    return spark.createDataFrame([(i, k, v) for i, (k, v) in enumerate(lines)], "line int, item string, value string")


# Where each result table goes and what it is sorted by.
OUTPUTS = {"summary": ("model",), "fold_metrics": ("model", "fold"), "thresholds": ("model", "fold"),
           "oof": ("model", "fold", "date"), "predictions": ("date",), "importance": (), "model_ready": ("date",)}


def write_outputs(spark: SparkSession, result: dict, out_dir: str) -> None:
    """Raw, scaled and result tables, scaler, model with threshold, metadata, summary."""
    keys = result["keys"]
    scaled, scaler = scaled_panel(result["panel"], keys)
    write_table(result["panel"], f"{out_dir}/raw", [*keys, "date"])
    write_table(scaled, f"{out_dir}/scaled", [*keys, "date"])
    write_table(cut_lineage(scaler), f"{out_dir}/scaler", [*keys, "feature"])
    for name, order in OUTPUTS.items():
        if result.get(name) is not None:
            write_table(result[name], f"{out_dir}/{name}", order or [F.col("abs_coef").desc()])
    save_model(spark, result["model"], f"{out_dir}/final_model", dict(
        result["threshold"], recall_target=ev.RECALL_TARGET, horizon_days=HORIZON_DAYS))
    write_json(spark, f"{out_dir}/final_model_metadata", result["metadata"])
    write_table(run_summary(spark, result), f"{out_dir}/run_summary", ["line"])
