"""Quality classifier: supervised subword embeddings.

A text is a bag of features: each white-space separated token, its character
trigrams and four-grams (edges marked), and each pair of neighbouring tokens (a token
that repeats the one before is one feature of its own). Features are hashed into
BUCKETS vectors; a text is the average of its vectors, a softmax layer over it gives
the class probabilities, and both are trained by stochastic gradient descent.

The output layer is linear in the average, so a word's share is worked out once per
worker and a text is the sum over its words, whatever its length.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsprism.llm.common import crc_remainder, pick, worker_state
from newsprism.llm.words import WordRows, balanced_sample, stretches

BUCKETS = 1 << 17
DIMENSIONS = 8
#: Rows shown to the training in all, and at least EPOCHS times each.
SHOWN, EPOCHS = 12_000, 5
BATCH = 16
RATE = 20.0
#: Bounds of the training sample: rows per class, and tokens per row (evenly spread stretches).
ROWS_PER_CLASS = 1000
STRETCH, STRETCHES_PER_ROW = 64, 8
THRESHOLD = 0.7
#: Buckets of their own: a token that repeats the one before it.
AGAIN = 0


@dataclass
class Model:
    logits: np.ndarray = field(repr=False)  # per bucket, its vector's share in logit(1) - logit(0)
    bias: float
    key: str = field(default_factory=lambda: uuid.uuid4().hex)


def _bucket(hashed: np.ndarray) -> np.ndarray:
    return (hashed % np.uint64(BUCKETS - 1)).astype(np.int64) + 1


def _token_features(token: str) -> list[int]:
    """Hashes of the token and its character n-grams."""
    edged = f"<{token}>"
    grams = [edged[i:i + n] for n in (3, 4) for i in range(len(edged) - n + 1)]
    return [xxhash.xxh64_intdigest("w" + token), *map(xxhash.xxh64_intdigest, grams)]


def _pairs(hashes: np.ndarray) -> np.ndarray:
    """Buckets of the neighbouring pairs of token hashes."""
    left, right = hashes[:-1], hashes[1:]
    mixed = (left * np.uint64(0x9E3779B97F4A7C15)) ^ (right >> np.uint64(7)) ^ (right << np.uint64(31))
    return np.where(left == right, AGAIN, _bucket(mixed))


def _bag(tokens: list[str], known: dict[str, np.ndarray]) -> np.ndarray:
    """Bucket of every feature of a training text."""
    for t in tokens:
        if t not in known:
            known[t] = np.array(_token_features(t), dtype=np.uint64)
    found = [known[t] for t in tokens]
    own = np.array([hashes[0] for hashes in found], dtype=np.uint64)
    return np.concatenate([_bucket(np.concatenate(found)), _pairs(own)])


def train(samples: list[tuple[int, list[list[str]]]], odds: float = 1.0) -> Model | None:
    """Fit on (class, stretches of tokens) rows; None without rows. Repeatable.

    Classes weigh alike in training; ``odds`` (class 1 to class 0 among all labelled
    rows) then moves the bias to their true shares.
    """
    samples = sorted((label, rows) for label, rows in samples if rows)
    if not samples:
        return None
    known: dict[str, np.ndarray] = {}
    bags, labels = [], []
    for label, rows in samples:
        feature, count = np.unique(np.concatenate([_bag(r, known) for r in rows]), return_counts=True)
        bags.append((feature.astype(np.int32), (count / count.sum()).astype(np.float32)))
        labels.append(label)
    known.clear()
    labels = np.array(labels)
    share = np.bincount(labels, minlength=2) / len(labels)
    weight = np.where(share > 0, 0.5 / np.maximum(share, 1e-9), 0.0)[labels]
    random = np.random.default_rng(11)
    vectors = random.uniform(-1.0, 1.0, (BUCKETS, DIMENSIONS)) / DIMENSIONS
    output, bias = random.uniform(-0.5, 0.5, (2, DIMENSIONS)), np.zeros(2)
    epochs = max(EPOCHS, -(-SHOWN // len(bags)))
    steps, step = epochs * -(-len(bags) // BATCH), 0
    for _ in range(epochs):
        order = random.permutation(len(bags))
        for lo in range(0, len(order), BATCH):
            rate = RATE * (1 - step / steps)
            step += 1
            at = order[lo:lo + BATCH]
            sizes = np.array([len(bags[i][0]) for i in at])
            feature = np.concatenate([bags[i][0] for i in at])
            share_of = np.concatenate([bags[i][1] for i in at])
            first = np.cumsum(sizes) - sizes
            hidden = np.add.reduceat(vectors[feature] * share_of[:, None], first, axis=0)
            score = hidden @ output.T + bias
            p = np.exp(score - score.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(at)), labels[at]] -= 1.0
            p *= weight[at][:, None] / len(at)
            back = p @ output
            output -= 0.1 * rate * (p.T @ hidden)
            bias -= 0.1 * rate * p.sum(axis=0)
            change = np.repeat(back, sizes, axis=0) * share_of[:, None] * rate
            touched, place = np.unique(feature, return_inverse=True)
            for d in range(DIMENSIONS):
                vectors[touched, d] -= np.bincount(place, change[:, d])
    return Model((vectors @ (output[1] - output[0])), float(bias[1] - bias[0] + np.log(odds)))


class Scorer:
    """The model inside one worker, with the shares of the tokens met so far."""

    def __init__(self, model: Model):
        self.model = model
        self.words = WordRows(self._rows)

    def _rows(self, tokens: list[str]) -> np.ndarray:
        """Per token: sum of its logits, number of features, its hash (as float bits)."""
        rows = np.zeros((len(tokens), 3))
        if tokens:
            found = list(map(_token_features, tokens))
            sizes = np.array([len(f) for f in found])
            logits = self.model.logits[_bucket(np.array([h for f in found for h in f], dtype=np.uint64))]
            rows[:, 0] = np.add.reduceat(logits, np.cumsum(sizes) - sizes)
            rows[:, 1] = sizes
            rows[:, 2] = np.array([f[0] for f in found], dtype=np.uint64).view(np.float64)
        return rows

    def score(self, text: str | None) -> float:
        tokens = (text or "").split()
        total, features, before = 0.0, 0.0, None
        for lo in range(0, len(tokens), 1 << 18):
            rows, _ = self.words.lookup(tokens[lo:lo + (1 << 18)])
            hashes = np.ascontiguousarray(rows[:, 2]).view(np.uint64)
            if before is not None:
                hashes = np.concatenate([before, hashes])
            before = hashes[-1:]
            total += rows[:, 0].sum() + self.model.logits[_pairs(hashes)].sum()
            features += rows[:, 1].sum() + len(hashes) - 1
        logit = self.model.bias + (total / features if features else 0.0)
        return float(1.0 / (1.0 + np.exp(-np.clip(logit, -500, 500))))


def fit(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_id_col: str = "doc_id",
        label_col: str = "quality", rows_per_class: int = ROWS_PER_CLASS) -> Model | None:
    """Learn from rows whose crc32(id as text) mod 4 is not 2.

    The sample holds about ``rows_per_class`` labelled ids of each class, chosen by a
    hash (ids with both labels take no part); it is small and joined by broadcast,
    and its rows, cut to evenly spread stretches, are what reaches the driver.
    """
    known = pick(labels, doc_id=label_id_col, label=label_col)
    known = (known.where((crc_remainder(F.col("doc_id"), 4) != 2) & F.col("label").isin(0, 1))
             .groupBy("doc_id").agg(F.min("label").cast("int").alias("label"), F.max("label").cast("int").alias("top"))
             .where("label = top").drop("top"))
    chosen = balanced_sample(known, "label", [F.col("doc_id")], rows_per_class, salt=5)
    rows = pick(df, doc_id=id_col, text=text_col).where(F.col("text").isNotNull())

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"label": batch["label"],
                                "rows": [stretches(t.split(), STRETCH, STRETCHES_PER_ROW) for t in batch["text"]]})
    sample = (rows.join(F.broadcast(chosen), "doc_id").limit(4 * rows_per_class)
              .select("label", F.col("text").cast("string").alias("text")))
    found = sample.mapInPandas(cut, "label int, rows array<array<string>>").collect()
    shares = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    return train([(r["label"], [list(x) for x in r["rows"]]) for r in found],
                 (shares.get(1, 0) + 1) / (shares.get(0, 0) + 1))


def score_column(model: Model | None, df: DataFrame, text: Column) -> Column:
    """Probability of class 1; 0.5 where there was nothing to learn from."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        learned = shared.value
        for batch in batches:
            if learned is None:
                yield pd.Series(np.full(len(batch), 0.5))
                continue
            scorer = worker_state(learned.key, lambda: Scorer(learned))
            yield pd.Series([scorer.score(t) for t in batch], dtype="float64")
    return score(text)


def classify(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             threshold: float = THRESHOLD, rows_per_class: int = ROWS_PER_CLASS) -> DataFrame:
    """One row per input row: doc_id, held_out, score, predicted.

    Null and empty texts score by the bias alone. A null id is not held out and not
    learned from. Repeated rows each return a row; an empty table gives an empty
    result, and without usable labels every score is 0.5.
    """
    model = fit(df, labels, id_col, text_col, rows_per_class=rows_per_class)
    rows = pick(df, doc_id=id_col, text=text_col).select(
        "doc_id", score_column(model, df, F.col("text").cast("string")).alias("score"))
    return rows.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.coalesce(crc_remainder(F.col("doc_id"), 4) == 2, F.lit(False)).alias("held_out"),
                       "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
