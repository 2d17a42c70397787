"""Keep one row per key (O2, O3).

Implemented as ``min_by`` aggregates: a hash aggregate with map-side partial
aggregation, so a key with a huge number of duplicates is reduced before the
shuffle and never sorted as one window group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil.functions.util import as_list


def first_per_key(df: DataFrame, keys, order_cols=None) -> DataFrame:
    """O2/O3: per key the row with the smallest ``order_cols`` (a total order
    is the caller's duty; without one an arbitrary row is kept)."""
    keys = as_list(keys)
    order_cols = as_list(order_cols)
    rest = [c for c in df.columns if c not in keys]
    if not rest:
        return df.select(*keys).distinct()
    payload = F.struct(*[F.col(c) for c in rest])
    if order_cols:
        order = F.struct(*[F.col(c) for c in order_cols])
        picked = F.min_by(payload, order)
    else:
        picked = F.first(payload)
    return df.groupBy(*keys).agg(picked.alias("_row")).select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest])
