"""Word vectors learned from the corpus: co-occurrence counts, positive PMI, randomised SVD.

Counts of word pairs within a window are made per task before the shuffle and summed by
Spark. The weighted pairs stay a table; the factorisation reads it in a few passes, each
a product of the sparse symmetric matrix with a narrow block of columns, whose partial
sums are added up as a tree. The driver holds blocks of the size vocabulary x rank only.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsprism.operators import terms as tm
from newsprism.session import cut_lineage, drop_cut, reach_workers, scratch

#: Distinct pairs a task holds before it passes its counts on, and partial blocks that the driver adds up itself.
HELD_PAIRS, PARTIALS = 2_000_000, 16


@dataclass(frozen=True)
class WordVectors:
    """Vectors of the vocabulary's words, strongest dimension first."""
    words: tuple[str, ...]
    vectors: np.ndarray

    def encoder(self) -> Callable[[], Callable[[np.ndarray], np.ndarray]]:
        """Factory of an encoder of space-joined tokens: the mean of the known tokens' vectors, 0 without any."""
        words, vectors = list(self.words), self.vectors.astype(np.float32)

        def make() -> Callable[[np.ndarray], np.ndarray]:
            known = pa.array(words, pa.string())

            def encode(texts: np.ndarray) -> np.ndarray:
                tokens = pc.split_pattern(pa.array([str(t) for t in texts], pa.string()), " ")
                at = pc.index_in(tokens.flatten(), value_set=known)
                there = at.is_valid().to_numpy(zero_copy_only=False)
                ends = np.concatenate([[0], np.cumsum(there)])[tokens.offsets.to_numpy()]
                index = at.fill_null(0).to_numpy(zero_copy_only=False)[there]
                out = np.zeros((len(texts), vectors.shape[1]), dtype=np.float64)
                filled = np.flatnonzero(np.diff(ends))
                if len(filled):
                    out[filled] = np.add.reduceat(vectors[index].astype(np.float64), ends[:-1][filled], axis=0)
                return (out / np.maximum(np.diff(ends), 1)[:, None]).astype(np.float32)
            return encode
        return make

    def nearest(self, word: str, k: int = 5) -> list[str]:
        """The ``k`` words of highest cosine to ``word``."""
        unit = self.vectors / np.maximum(np.linalg.norm(self.vectors, axis=1, keepdims=True), 1e-12)
        order = np.argsort(-(unit @ unit[self.words.index(word)]), kind="stable")
        return [self.words[i] for i in order if self.words[i] != word][:k]


def pair_counts(df: DataFrame, text_col: str, words: Sequence[str], window: int = 5) -> DataFrame:
    """(i, j, n), i <= j: how often words i and j of the vocabulary stand within ``window`` tokens of each other.

    Distances count all tokens, also those outside the vocabulary. Null texts have none.
    """
    width = len(words)
    shared = df.sparkSession.sparkContext.broadcast(list(words))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pa.array(shared.value, pa.string())
        keys, counts = np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)

        def row(keys: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(keys // width), pa.array(keys % width), pa.array(counts)], ["i", "j", "n"])
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                column = batch.column("t").slice(at, 256)
                word = pc.index_in(column.flatten(), value_set=known).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
                doc = np.repeat(np.arange(len(column)), np.diff(column.offsets.to_numpy()))
                new = []
                for gap in range(1, window + 1):
                    a, b = word[:-gap], word[gap:]
                    near = (a >= 0) & (b >= 0) & (doc[:-gap] == doc[gap:])
                    new.append(np.minimum(a, b)[near] * width + np.maximum(a, b)[near])
                fresh, times = np.unique(np.concatenate(new), return_counts=True)
                every, place = np.unique(np.concatenate([keys, fresh]), return_inverse=True)
                counts = np.bincount(place, np.concatenate([counts, times]), len(every)).astype(np.int64)
                keys = every
                if len(keys) > HELD_PAIRS:
                    yield row(keys, counts)
                    keys, counts = keys[:0], counts[:0]
        yield row(keys, counts)

    reach_workers(df.sparkSession)
    tokens = df.select(tm.tokenize(F.coalesce(F.col(text_col), F.lit(""))).alias("t"))
    return tokens.mapInArrow(count, "i long, j long, n long").groupBy("i", "j").agg(F.sum("n").alias("n"))


def positive_pmi(pairs: DataFrame) -> DataFrame:
    """(i, j, v), i <= j, v > 0: ln(n_ij * N / (n_i * n_j)) where above 0, over the symmetric counts."""
    sides = pairs.select("i", "n").unionByName(pairs.select(F.col("j").alias("i"), "n"))
    totals = sides.groupBy("i").agg(F.sum("n").cast("double").alias("total"))  # one row per word of the vocabulary
    grand = totals.agg(F.sum("total").alias("grand"))
    left = totals.select("i", F.col("total").alias("a"))
    right = totals.select(F.col("i").alias("j"), F.col("total").alias("b"))
    # a pair of equal words stands once in the pair table and counts twice on the diagonal
    n = F.col("n") * F.when(F.col("i") == F.col("j"), 2.0).otherwise(1.0)
    value = F.log(n * F.col("grand") / (F.col("a") * F.col("b")))
    return (pairs.join(left, "i").join(right, "j").join(F.broadcast(grand))  # a single row
            .select("i", "j", value.alias("v")).where("v > 0"))


def block_product(matrix: DataFrame, block: np.ndarray) -> np.ndarray:
    """The symmetric matrix of (i, j, v), i <= j, times a block of columns: one pass over its entries."""
    shared = matrix.sparkSession.sparkContext.broadcast(block)
    shape = block.shape

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, other = np.zeros(shape), shared.value
        for batch in batches:
            i, j, v = (batch.column(c).to_numpy() for c in ("i", "j", "v"))
            for at in range(0, len(i), 50_000):
                a, b, x = i[at:at + 50_000], j[at:at + 50_000], v[at:at + 50_000, None]
                np.add.at(total, a, x * other[b])
                off = a != b
                np.add.at(total, b[off], x[off] * other[a[off]])
        yield packed(total)

    def packed(total: np.ndarray) -> pa.RecordBatch:
        rows = np.flatnonzero(total.any(axis=1))
        return pa.RecordBatch.from_arrays([pa.array([rows.astype("<i8").tobytes()], pa.binary()),
                                           pa.array([total[rows].tobytes()], pa.binary())], ["rows", "sums"])

    def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape)
        for batch in batches:
            for row in batch.to_pylist():
                add(total, row)
        yield packed(total)

    def add(total: np.ndarray, row) -> None:
        total[np.frombuffer(row["rows"], dtype="<i8")] += np.frombuffer(row["sums"]).reshape(-1, shape[1])

    ddl = "rows binary, sums binary"
    partial = matrix.mapInArrow(multiply, ddl).repartition(PARTIALS).mapInArrow(gathered, ddl)
    total = np.zeros(shape)
    for row in partial.collect():
        add(total, row)
    shared.destroy()
    return total


def factorise(matrix: DataFrame, size: int, rank: int, oversample: int = 8, rounds: int = 2, seed: int = 42
              ) -> tuple[np.ndarray, np.ndarray]:
    """(values, vectors) of the ``rank`` eigenvalues of largest magnitude, by a randomised range finder.

    ``rounds`` power iterations with re-orthogonalisation; rounds + 2 passes over the
    matrix. Each vector's entry of largest magnitude is positive.
    """
    width = min(size, rank + oversample)
    basis = np.linalg.qr(np.random.default_rng(seed).standard_normal((size, width)))[0]
    for _ in range(rounds + 1):
        basis = np.linalg.qr(block_product(matrix, basis))[0]
    small = basis.T @ block_product(matrix, basis)
    values, turned = np.linalg.eigh((small + small.T) / 2)
    order = np.argsort(-np.abs(values), kind="stable")[:rank]
    vectors = basis @ turned[:, order]
    signs = np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(vectors.shape[1])])
    return values[order], vectors * np.where(signs == 0, 1, signs)


def learn_word_vectors(df: DataFrame, text_col: str = "content", *, dim: int = 64, window: int = 5, min_df: int = 2,
                       max_features: int = 20000) -> WordVectors:
    """Vectors of the ``max_features`` most counted words (of ``min_df`` documents or more): eigenvectors of the
    positive PMI matrix with the largest positive eigenvalues, scaled by their square roots, so that products of
    vectors come near the PMI of their words.

    Stop words take part. Fewer words than ``dim`` leave the further dimensions 0; without
    any word, or any pair, all vectors are 0.
    """
    with scratch(df.sparkSession):
        tokens = df.select(tm.tokenize(F.coalesce(F.col(text_col), F.lit(""))).alias("t"))
        vocab = tm.vocabulary_of(tm.stats_of(tokens, "t"), min_df, max_features)
        words = [r["term"] for r in vocab.select("term").orderBy("term").collect()]  # <= max_features rows
        vectors = np.zeros((len(words), dim))
        if words:
            pairs = cut_lineage(pair_counts(df, text_col, words, window))
            matrix = cut_lineage(positive_pmi(pairs)).cache()
            drop_cut(pairs)
            values, found = factorise(matrix, len(words), min(2 * dim, len(words)))  # about half of them are negative
            matrix.unpersist()
            up = np.flatnonzero(values > 0)[:dim]
            vectors[:, :len(up)] = found[:, up] * np.sqrt(values[up])
    return WordVectors(tuple(words), vectors)
