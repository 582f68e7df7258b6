"""Reshaping of aggregate rows (JVM-side, no extra scans)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def rows_from(wide: DataFrame, rows: Sequence[Mapping[str, Column]], keep: Sequence[str] = ()) -> DataFrame:
    """Emit ``len(rows)`` output rows for every row of ``wide`` in one Generate.

    Each mapping names the output columns of one emitted row, as expressions
    over ``wide``'s columns. Unioning one projection per output row instead
    would plan the whole aggregate subtree (scan, shuffles) once per branch;
    here the aggregate runs once and the rows come from ``inline``.
    """
    structs = [F.struct(*[c.alias(k) for k, c in r.items()]) for r in rows]
    return wide.select(*keep, F.inline(F.array(*structs)))
