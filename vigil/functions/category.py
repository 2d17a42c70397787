"""Threshold categories, critical flag and the alert decision rule."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vigil.functions.util import col_of

# Category names and their strict lower cut points for PM2.5
# (a value above 169 is "emergencia", above 109 "preemergencia", above 79
# "alerta", above 50 "regular", otherwise "buena").
CATEGORY_CUTS = (
    (169.0, "emergencia"),
    (109.0, "preemergencia"),
    (79.0, "alerta"),
    (50.0, "regular"),
)
BASE_CATEGORY = "buena"
CRITICAL_CATEGORIES = ("preemergencia", "emergencia")


def category(c, cuts=CATEGORY_CUTS, base: str = BASE_CATEGORY) -> Column:
    """X11: first cut point (highest first) strictly exceeded; NULL input -> NULL."""
    x = col_of(c)
    expr = None
    for cut, name in sorted(cuts, key=lambda t: -t[0]):
        expr = F.when(x > F.lit(cut), F.lit(name)) if expr is None else expr.when(x > F.lit(cut), F.lit(name))
    expr = F.when(x.isNull(), F.lit(None).cast("string")) if expr is None else expr
    return F.when(x.isNotNull(), expr.otherwise(F.lit(base)))


def critical_flag(c, critical=CRITICAL_CATEGORIES) -> Column:
    """1 when the category is critical, else 0 (a missing category is 0)."""
    return F.coalesce(col_of(c).isin(*critical), F.lit(False)).cast("int")


def alert(prob, threshold) -> Column:
    """alert = probability >= threshold (inclusive)."""
    t = F.lit(threshold) if isinstance(threshold, (int, float)) else col_of(threshold)
    return (col_of(prob) >= t).cast("int")
