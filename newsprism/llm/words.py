"""Per-worker tables of word rows and bounded training samples, shared by the learned operators."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsprism.llm.common import hash_fraction

#: Distinct words one Python worker remembers; beyond it the table starts anew (results stay the same).
REMEMBERED = 400_000


class WordRows:
    """Row of numbers for each word, worked out once per worker and word."""

    def __init__(self, compute: Callable[[list[str]], np.ndarray], limit: int = REMEMBERED):
        self.compute, self.limit = compute, limit
        self._reset()

    def _reset(self) -> None:
        table = self
        self.new: list[str] = []

        class Places(dict):
            def __missing__(self, word: str) -> int:
                self[word] = at = len(self)
                table.new.append(word)
                return at
        self.places, self.rows, self.filled = Places(), None, 0

    def lookup(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(rows, places) of the words; places compare equal just for equal words of this call."""
        if len(self.places) > self.limit:
            self._reset()
        at = np.fromiter(map(self.places.__getitem__, words), dtype=np.int64, count=len(words))
        if self.new:
            fresh = self.compute(self.new)
            if self.rows is None or self.filled + len(fresh) > len(self.rows):
                grown = np.zeros((2 * (self.filled + len(fresh)), fresh.shape[1]), dtype=fresh.dtype)
                if self.filled:
                    grown[:self.filled] = self.rows[:self.filled]
                self.rows = grown
            self.rows[self.filled:self.filled + len(fresh)] = fresh
            self.filled += len(fresh)
            self.new.clear()
        if self.rows is None:
            self.rows = self.compute([])
        return self.rows[at], at


def balanced_sample(rows: DataFrame, label: str, key: list[Column], per_label: int, salt: int) -> DataFrame:
    """About ``per_label`` rows of each label, chosen by a hash of ``key``; never over twice as many in all.

    One count per label reaches the driver; the choice itself needs no shuffle.
    """
    counts = {r[0]: r[1] for r in rows.groupBy(label).count().collect()}
    if not counts:
        return rows.limit(0)
    share = F.lit(0.0)
    for value, count in counts.items():
        share = F.when(F.col(label) == F.lit(value), F.lit(min(1.0, per_label / count))).otherwise(share)
    return rows.where(hash_fraction(key, salt) < share).limit(2 * per_label * len(counts))


def stretches(words: list[str], size: int, most: int) -> list[list[str]]:
    """Stretches of ``size`` words; of a long text ``most`` of them, evenly spread (training only)."""
    every = [words[i:i + size] for i in range(0, len(words), size)]
    if len(every) <= most:
        return every
    return [every[i * len(every) // most] for i in range(most)]
