"""Two-class Fisher scores: (mean0 - mean1)^2 / (var0 + var1), population variances."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsprism.functions.reshape import rows_from


def fisher_numeric(df: DataFrame, features: Sequence[str], label_col: str = "label") -> DataFrame:
    """One scan with conditional means and population variances, then one row per feature.

    A zero denominator (constant in both classes) scores 0. Output: (feature, fisher_score).
    """
    aggs = []
    for i, f in enumerate(features):
        for v in (0, 1):
            own = F.when(F.col(label_col) == v, F.col(f).cast("double"))
            aggs += [F.avg(own).alias(f"m{i}_{v}"), F.var_pop(own).alias(f"v{i}_{v}")]
    wide = df.agg(*aggs)
    rows = []
    for i, f in enumerate(features):
        apart = F.col(f"m{i}_0") - F.col(f"m{i}_1")
        spread = F.col(f"v{i}_0") + F.col(f"v{i}_1")
        score = F.when(spread == 0, F.lit(0.0)).otherwise(apart * apart / spread)
        rows.append({"feature": F.lit(f), "fisher_score": F.round(score, 6)})
    return rows_from(wide, rows)
