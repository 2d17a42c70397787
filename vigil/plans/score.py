"""Scoring snapshots (L11, L12, X20): validated rows -> probability,
threshold, 0/1 alert. A projection only: no shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil.functions.category import alert
from vigil.functions.util import as_list
from vigil.session import cut_lineage
from vigil.sources.scoring import REQUIRED_COLUMNS, validate_snapshots

OPERATIONAL_FEATURES = list(REQUIRED_COLUMNS)


def alert_table(model, threshold: float, snapshots: DataFrame, keep=()) -> DataFrame:
    """Valid snapshots scored; invalid ones are left out (see
    ``validate_snapshots`` for the rejected rows)."""
    checked = validate_snapshots(snapshots, keep=keep)
    # by a generator: a filter would move below the numbers, whose texts would be made and parsed once for it and once more
    whole = F.when(F.col("valid") == 1, F.array(F.struct(*[c for c in checked.columns if c != "valid"])))
    valid = checked.select(F.inline(whole))
    scored = model.score(valid, "predicted_probability_48h")
    return scored.select(*keep, *REQUIRED_COLUMNS, "predicted_probability_48h",
                         F.lit(float(threshold)).alias("decision_threshold"),
                         alert("predicted_probability_48h", float(threshold)).alias("critical_alert_48h"))


def fit_operational(panel: DataFrame, keys, features=OPERATIONAL_FEATURES):
    """The 4-variable model the scorer uses: logistic pipeline on the snapshot
    columns, target 2 rows ahead, threshold chosen in-sample."""
    from vigil.plans.modeling import fit_final
    from vigil.operators.horizon import add_target
    df = add_target(panel, keys).where(F.col("critical_t_plus_2").isNotNull())
    df = cut_lineage(df.select(*as_list(keys), "date", *features, F.col("critical_t_plus_2").cast("int").alias("critical_t_plus_2")))
    model, thr, _preds, _imp = fit_final(df, list(features), "critical_t_plus_2", keys, "logit_balanced")
    return model, float(thr["threshold"])
