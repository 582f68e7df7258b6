"""Exact top-k search by Fagin's threshold algorithm over sorted per-dimension lists.

Vectors are turned into integers, floor(scale * component). Rows are dealt into blocks
and queries into blocks; each pair of blocks is one group of bounded size. Within a
group every dimension has its list of rows in order of value. A query walks all lists
from the end that its sign favours, in steps of growing depth; rows met for the first
time are scored exactly. The value at the reached depth of every list bounds the score
of any row not met yet, and the walk stops once that bound is below the kth score (an
equal bound goes on, as a tie may have a smaller id). The best of each block are then
ranked over all blocks.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsprism.llm.common import pick

K = 5
SCALE = 256
#: Least and greatest number of rows (queries) of a block: it grows with the table, up to what a task holds.
BLOCK_ROWS, MOST_ROWS = 4096, 32768
BLOCK_QUERIES, MOST_QUERIES = 2048, 32768
#: Depth of the first step, and how many times deeper each next one reaches.
FIRST_DEPTH, GROWTH = 16, 4


def integers(vector: Column, scale: int = SCALE) -> Column:
    """floor(scale * x) of each component; null if the vector is null or empty, or holds null or non-finite components."""
    value = F.transform(vector, lambda x: x.cast("double"))
    finite = F.forall(value, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.when((F.size(value) > 0) & finite, F.transform(value, lambda x: F.floor(x * scale).cast("long")))


class Lists:
    """Sorted lists of one block of rows: for each direction and dimension the rows, best first.

    A row stands for ``copies`` rows of the table with this id and vector.
    """

    def __init__(self, ids: np.ndarray, rows: np.ndarray, copies: np.ndarray):
        self.ids, self.copies, self.vectors = ids, copies, {np.int64: rows}
        self.largest = float(np.abs(rows).max(initial=0))
        order = np.argsort(rows, axis=0, kind="stable").T
        self.order = np.stack([order, order[:, ::-1]]).astype(np.int32)  # for negative, positive weights
        value = np.take_along_axis(rows.T, order, axis=1)
        self.value = np.stack([value, value[:, ::-1]])

    def rows(self, kind: type) -> np.ndarray:
        if kind not in self.vectors:
            self.vectors[kind] = self.vectors[np.int64].astype(kind)
        return self.vectors[kind]

    def best(self, query_id: int, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, scores) of the k best rows other than the query's own row: high scores first, then small ids."""
        bound = len(query) * float(np.abs(query).max(initial=0)) * self.largest
        if bound >= 2 ** 63:
            raise OverflowError("scores must fit 64 bits")
        kind = np.float32 if bound < 2 ** 24 else np.float64 if bound < 2 ** 53 else np.int64  # sums stay exact
        weights, rows = query.astype(kind), self.rows(kind)
        used = np.flatnonzero(query)
        up = (query[used] > 0).astype(np.int64)
        n = len(self.ids)
        own = np.flatnonzero(self.ids == query_id)
        own = own[(self.vectors[np.int64][own] == query).all(axis=1)]  # one row at most: the query's own and its copies
        met = np.zeros(n, dtype=bool)
        met[own] = self.copies[own] == 1
        which, scores = np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)  # best distinct rows so far
        reached, depth = 0, min(FIRST_DEPTH, n)
        while True:
            if len(used):
                at = np.zeros(n, dtype=bool)
                at[self.order[up, used, reached:depth].ravel()] = True
                fresh = np.flatnonzero(at & ~met)
            else:  # every score is 0: there is no list to walk
                fresh, depth = np.flatnonzero(~met), n
            if len(fresh):
                met[fresh] = True
                gained = (rows[fresh] @ weights).astype(np.int64)
                if len(scores) >= k:
                    good = gained >= scores[-1]
                elif len(gained) > k:
                    good = gained >= np.partition(gained, len(gained) - k)[len(gained) - k]
                else:
                    good = np.ones(len(gained), dtype=bool)
                which = np.concatenate([which, fresh[good]])
                scores = np.concatenate([scores, gained[good]])
                first = np.lexsort((self.ids[which], -scores))[:k]
                which, scores = which[first], scores[first]
            if depth >= n or (len(scores) == k and int((query[used] * self.value[up, used, depth - 1]).sum()) < scores[-1]):
                times = self.copies[which] - np.isin(which, own)
                return np.repeat(self.ids[which], times)[:k], np.repeat(scores, times)[:k]
            reached, depth = depth, min(n, depth * GROWTH)


def _search(k: int):
    def of_group(table: pa.Table) -> pa.Table:
        ids, copies = table.column("id").to_numpy(), table.column("copies").to_numpy()
        is_query = table.column("is_query").to_numpy()
        vectors = np.concatenate([c.flatten().to_numpy() for c in table.column("v").chunks]).reshape(len(ids), -1)
        found = {"query_id": [], "vec_id": [], "score": []}
        digests, times = [], []
        if is_query.any() and not is_query.all():
            lists = Lists(ids[~is_query], vectors[~is_query], copies[~is_query])
            digest = table.column("digest").filter(pa.array(is_query)).to_pylist()
            for query_id, query, own, asked in zip(ids[is_query], vectors[is_query], digest, copies[is_query]):
                best, scores = lists.best(int(query_id), query, k)
                found["query_id"].append(np.full(len(best), query_id))
                found["vec_id"].append(best)
                found["score"].append(scores)
                digests += [own] * len(best)
                times.append(np.full(len(best), asked))
        columns = {name: np.concatenate([np.empty(0, dtype=np.int64), *parts]) for name, parts in found.items()}
        return pa.table({**columns, "digest": pa.array(digests, pa.string()),
                         "asked": np.concatenate([np.empty(0, dtype=np.int64), *times])})
    return of_group


def block_size(rows: int, least: int, most: int, blocks: int = 64) -> int:
    """Rows of a block: about ``blocks`` blocks, none smaller than ``least`` or larger than ``most``."""
    return max(least, min(most, math.ceil(rows / blocks)))


def top_k(df: DataFrame, is_query: Column, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K,
          scale: int = SCALE, block_rows: int | None = None, block_queries: int | None = None) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k highest integer inner products of every query row.

    ``is_query`` is a condition on the column ``id``. Candidates are all rows but the
    query's own, of as many components: also others of its id, and copies of it. Every
    query row has its list, so rows that share an id, or are copies, give one list each.
    Ties go to the smaller id; fewer than k candidates give all. Vectors null, empty or
    with null or non-finite components, and null ids, take no part. Scores that may not
    fit 64 bits raise OverflowError. Empty tables, or no query, give an empty result.

    Each block of queries meets each block of rows, so about rows * queries * (1 /
    block_rows + 1 / block_queries) vectors are shuffled; blocks grow with the table up
    to MOST_ROWS and MOST_QUERIES. Only the two row counts reach the driver.
    """
    rows = (pick(df, id=id_col, vector=vector_col)
            .select(F.col("id").cast("long").alias("id"), integers(F.col("vector"), scale).alias("v"))
            .where("id is not null and v is not null")
            .groupBy("id", "v").agg(F.count(F.lit(1)).alias("copies")))
    rows = rows.withColumn("is_query", F.coalesce(is_query, F.lit(False)))
    n, asked = rows.agg(F.count("*"), F.count_if("is_query")).first()
    block_rows = block_rows or block_size(n, BLOCK_ROWS, MOST_ROWS)
    block_queries = block_queries or block_size(asked, BLOCK_QUERIES, MOST_QUERIES, 8)
    row_blocks, query_blocks = max(1, math.ceil(n / block_rows)), max(1, math.ceil(asked / block_queries))
    block = lambda count: F.pmod(F.xxhash64("id", "v"), F.lit(count)).cast("int")
    every = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    dealt = rows.select("id", "v", "copies", F.lit(False).alias("is_query"), F.lit(None).cast("string").alias("digest"),
                        block(row_blocks).alias("rb"), every(query_blocks).alias("qb"))
    digest = F.md5(F.array_join("v", ",").cast("binary"))  # tells queries of one id apart
    asking = rows.where("is_query").select("id", "v", "copies", "is_query", digest.alias("digest"),
                                           every(row_blocks).alias("rb"), block(query_blocks).alias("qb"))
    found = (dealt.unionByName(asking).withColumn("width", F.size("v")).groupBy("width", "rb", "qb")
             .applyInArrow(_search(k), "query_id long, vec_id long, score long, digest string, asked long"))
    order = Window.partitionBy("query_id", "digest").orderBy(F.desc("score"), "vec_id")
    best = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return (best.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("asked"))))
            .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"))
