"""Array expressions for logits and token states (higher-order functions, no UDF)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def softmax(logits) -> Column:
    """Numerically stable softmax over an array<double>."""
    x = _c(logits)
    shifted = F.transform(x, lambda v: F.exp(v - F.array_max(x)))
    total = F.aggregate(shifted, F.lit(0.0), lambda a, v: a + v)
    return F.transform(shifted, lambda v: v / total)


def argmax(logits) -> Column:
    """0-based index of the first maximum."""
    x = _c(logits)
    return (F.array_position(x, F.array_max(x)) - 1).cast("int")


def log_softmax(logits) -> Column:
    x = _c(logits)
    m = F.array_max(x)
    lse = m + F.log(F.aggregate(F.transform(x, lambda v: F.exp(v - m)), F.lit(0.0), lambda a, v: a + v))
    return F.transform(x, lambda v: v - lse)


def smoothed_cross_entropy(logits, label, epsilon: float = 0.05) -> Column:
    """Label-smoothed cross entropy of one row: -sum_k q_k log p_k,
    q_true = 1 - eps + eps/K, q_other = eps/K."""
    logp = log_softmax(logits)
    k = F.size(_c(logits))
    other = F.lit(epsilon) / k
    weighted = F.transform(
        logp,
        lambda lp, i: F.when(i == _c(label), F.lit(1.0 - epsilon) + other).otherwise(other) * lp,
    )
    return -F.aggregate(weighted, F.lit(0.0), lambda a, v: a + v)


def mean_pool(hidden, mask) -> Column:
    """sum_t(hidden[t] * mask[t]) / max(sum_t mask[t], 1e-9), per dimension; no tokens give an empty vector."""
    h = _c(hidden)
    m = _c(mask)
    denom = F.greatest(F.aggregate(m, F.lit(0.0), lambda a, v: a + v.cast("double")), F.lit(1e-9))
    width = F.coalesce(F.size(F.get(h, F.lit(0))), F.lit(0))
    dims = F.when(width > 0, F.sequence(F.lit(0), width - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(
        dims,
        lambda d: F.aggregate(
            F.zip_with(h, m, lambda row, w: row[d].cast("double") * w.cast("double")),
            F.lit(0.0), lambda a, v: a + v) / denom,
    )
