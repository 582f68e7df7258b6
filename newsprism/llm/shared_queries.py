"""Ranked lexical search of many queries at once by evaluating their common subexpressions once.

A query is a multiset of terms and a document's score the sum of its terms' parts.
Term sets that several queries share are mined from the queries: first the terms that
occur in just the same queries become one node, then the pair of nodes that most
queries share becomes a node of its own, again and again, until no two queries share a
pair. The nodes form a directed graph in which every node is the sum of two others (or
of terms) and every query the sum of a few nodes. For a block of documents each node's
accumulator is worked out once, level by level, and the queries are combined from them.

Two passes over the corpus: the first counts terms (N, L and the document frequency of
each term asked for) and writes each document's occurrences of these terms to the shared
folder; the second scores the documents from there. Each task keeps the best of each query;
these lists are ranked by slices of documents before they meet.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter, defaultdict
from collections.abc import Iterator, Sequence
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from newsprism.llm.common import pick
from newsprism.session import cut_lineage

K = 20
#: Queries evaluated by one graph; more are dealt into blocks, each with a graph of its own.
BLOCK_QUERIES = 2048
#: Documents whose accumulators are worked out together.
BLOCK_DOCS = 128
#: Slices of the tasks' lists that are ranked before a query's lists meet.
SLICES = 64
#: Numbers of accumulators and of kept candidates that a task holds at a time.
CELLS, WAITING = 1 << 20, 200_000
#: Nodes of one query that pairs are mined among, the most shared ones (bounds the mining; results do not depend on it).
MINED_NODES = 256


def _byte_table() -> bytes:
    """Maps A-Z to a-z, keeps a-z, 0-9 and all bytes of characters beyond ASCII, and makes the rest spaces."""
    keep = set(b"abcdefghijklmnopqrstuvwxyz0123456789") | set(range(128, 256))
    return bytes(b + 32 if 65 <= b <= 90 else b if b in keep else 32 for b in range(256))


TABLE = _byte_table()


def terms(text: str | None) -> list[bytes]:
    """Terms of a text in UTF-8: runs of ASCII letters, digits and characters beyond ASCII; A-Z lower-cased."""
    return text.encode().translate(TABLE).split() if text else []


class SharingGraph:
    """Common subexpressions of the queries.

    ``leaves``: (term, times) of each leaf; ``atoms``: leaves of each first node; ``joins``:
    levels of (node, left, right); ``queries``: nodes of each query. Nodes are numbered
    atoms first.
    """

    def __init__(self, queries: Sequence[Counter]):
        by_use: dict[tuple[int, ...], list[tuple[int, int]]] = {}
        users: dict[tuple[int, int], list[int]] = defaultdict(list)
        for q, counts in enumerate(queries):
            for leaf in counts.items():
                users[leaf].append(q)
        for leaf in sorted(users):
            by_use.setdefault(tuple(users[leaf]), []).append(leaf)
        groups = list(by_use.items())  # terms used by just the same queries
        self.leaves = [leaf for _, leaves in groups for leaf in leaves]
        self.atom_sizes = [len(leaves) for _, leaves in groups]
        nodes: list[set[int]] = [set() for _ in queries]
        for node, (using, _) in enumerate(groups):
            for q in using:
                nodes[q].add(node)
        level = [0] * len(groups)
        joins: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
        shared: dict[tuple[int, int], set[int]] = defaultdict(set)
        for q, own in enumerate(nodes):
            common = sorted((n for n in own if len(groups[n][0]) > 1), key=lambda n: (-len(groups[n][0]), n))
            common = sorted(common[:MINED_NODES])
            for i, a in enumerate(common):
                for b in common[i + 1:]:
                    shared[a, b].add(q)
        heap = [(-len(using), pair) for pair, using in shared.items() if len(using) > 1]
        heapq.heapify(heap)
        while heap:
            count, pair = heapq.heappop(heap)
            using = shared.get(pair, set())
            if len(using) < 2:
                continue
            if -count != len(using):  # fewer queries share it by now
                heapq.heappush(heap, (-len(using), pair))
                continue
            new = len(level)
            level.append(1 + max(level[n] for n in pair))
            joins[level[new]].append((new, *pair))
            using = set(using)
            gained: dict[int, set[int]] = defaultdict(set)
            for q in using:
                nodes[q] -= set(pair)
                for other in nodes[q]:
                    for n in pair:
                        shared.get((min(n, other), max(n, other)), set()).discard(q)
                    gained[other].add(q)
                nodes[q].add(new)
            shared.pop(pair)
            for other, qs in gained.items():
                if len(qs) > 1:
                    shared[other, new] = qs
                    heapq.heappush(heap, (-len(qs), (other, new)))
        self.levels = [np.array(joins[i], dtype=np.int64) for i in sorted(joins)]
        self.queries = [sorted(own) for own in nodes]
        self.size = len(level)

    def additions(self) -> int:
        """Sums per document, against ``sum(len(q))`` of the queries one by one."""
        return len(self.leaves) + sum(len(x) for x in self.levels) + sum(map(len, self.queries))


class Evaluator:
    """Scores of all queries of a graph for a block of documents."""

    def __init__(self, graph: SharingGraph, place: np.ndarray):
        self.graph = graph
        self.term = place[[t for t, _ in graph.leaves]]
        self.times = np.array([c for _, c in graph.leaves], dtype=np.int64)[:, None]
        self.atom_starts = np.cumsum([0, *graph.atom_sizes[:-1]]) if graph.atom_sizes else np.empty(0, np.int64)
        self.refs = np.array([n for own in graph.queries for n in own], dtype=np.int64)
        self.filled = np.array([q for q, own in enumerate(graph.queries) if own], dtype=np.int64)
        self.starts = np.cumsum([0, *[len(graph.queries[q]) for q in self.filled]])[:-1].astype(np.int64)

    def scores(self, parts: np.ndarray) -> np.ndarray:
        """``parts`` holds a row per term and a column per document; the result a row per query in ``filled``."""
        sums = np.empty((self.graph.size, parts.shape[1]), dtype=np.int64)
        np.add.reduceat(parts[self.term] * self.times, self.atom_starts, axis=0, out=sums[:len(self.atom_starts)])
        for level in self.graph.levels:
            sums[level[:, 0]] = sums[level[:, 1]] + sums[level[:, 2]]
        return np.add.reduceat(sums[self.refs], self.starts, axis=0)


def weight(n_docs: int, doc_freq: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * doc_freq + 1)))


class Best:
    """The k best (score, document) of each query met so far: high scores first, then small ids, null ids last."""

    def __init__(self, n_queries: int, k: int):
        self.k, self.least = k, np.zeros(n_queries, dtype=np.int64)
        self.kept = tuple(np.empty(0, dtype=np.int64) for _ in range(4))
        self.new: list[tuple] = []
        self.waiting = 0

    def add(self, queries: np.ndarray, scores: np.ndarray, ids: np.ndarray, unnamed: np.ndarray) -> None:
        row, column = np.nonzero((scores > 0) & (scores >= self.least[queries][:, None]))
        self.new.append((queries[row], scores[row, column], ids[column], unnamed[column]))
        self.waiting += len(row)
        if self.waiting > WAITING:
            self.settle()

    def settle(self) -> tuple:
        q, s, d, u = (np.concatenate(c) for c in zip(self.kept, *self.new))
        order = np.lexsort((d, u, -s, q))
        q, s, d, u = q[order], s[order], d[order], u[order]
        first = np.searchsorted(q, np.arange(len(self.least)))
        place = np.arange(len(q)) - first[q]
        kth = place == self.k - 1
        self.least[q[kth]] = s[kth]
        keep = place < self.k
        self.kept, self.new, self.waiting = (q[keep], s[keep], d[keep], u[keep]), [], 0
        return self.kept


def _postings(docs: DataFrame, wanted: dict[bytes, int]) -> DataFrame:
    """Per document: id, number of terms, and the numbers and frequencies of its wanted terms, packed."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                n, ids, freqs = [], [], []
                for text in part.column("text").to_pylist():
                    words = terms(text)
                    found = np.fromiter(map(wanted.get, words, repeat(-1)), dtype=np.int32, count=len(words))
                    known, times = np.unique(found[found >= 0], return_counts=True)
                    n.append(len(words))
                    ids.append(known.astype("<i4").tobytes())
                    freqs.append(times.astype("<i4").tobytes())
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids, pa.binary()), pa.array(freqs, pa.binary())],
                    ["doc_id", "n", "terms", "freqs"])
    return docs.mapInArrow(count, "doc_id long, n long, terms binary, freqs binary")


def _doc_frequencies(postings: DataFrame, n_terms: int) -> dict[int, int]:
    """Documents that hold each term: counted per task, then summed per term."""
    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n_terms, dtype=np.int64)
        for b in batches:
            total += np.bincount(np.frombuffer(b"".join(b.column("terms").to_pylist()), dtype="<i4"), minlength=n_terms)
        met = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(met, pa.int64()), pa.array(total[met], pa.int64())], ["term", "df"])
    rows = postings.select("terms").mapInArrow(tally, "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))
    return {r["term"]: r["df"] for r in rows.collect()}  # no more rows than the queries have terms


def _scored(postings: DataFrame, graph: SharingGraph, weights: list[int], n_docs: int, n_terms: int, k: int) -> DataFrame:
    """(query, doc_id, score): each task's k best documents of every query."""
    used = np.array(sorted({t for t, _ in graph.leaves}), dtype=np.int64)
    place = np.full(len(weights), -1, dtype=np.int64)
    place[used] = np.arange(len(used))
    evaluator = Evaluator(graph, place)
    width = max(1, min(BLOCK_DOCS, CELLS // (graph.size + len(used))))
    w = np.array(weights, dtype=np.int64)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(len(graph.queries), k)
        for batch in batches:
            for at in range(0, batch.num_rows, width):
                part = batch.slice(at, width)
                doc = part.column("doc_id")
                unnamed = np.array(doc.is_null())
                ids = doc.fill_null(0).to_numpy()
                packed = part.column("terms").to_pylist()
                term = np.frombuffer(b"".join(packed), dtype="<i4")
                freq = np.frombuffer(b"".join(part.column("freqs").to_pylist()), dtype="<i4").astype(np.int64)
                which = np.repeat(np.arange(len(ids)), [len(p) // 4 for p in packed])
                m = np.array([75 + 25 * n * n_docs // n_terms for n in part.column("n").to_pylist()], dtype=np.int64)
                here = place[term] >= 0
                term, freq, which = term[here], freq[here], which[here]
                parts = np.zeros((len(used), len(ids)), dtype=np.int64)
                parts[place[term], which] = w[term] * (1_000_000_000 * freq // (1000 * freq + 12 * m[which]))
                best.add(evaluator.filled, evaluator.scores(parts), ids, unnamed)
        q, s, d, u = best.settle()
        if len(q):
            yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(d, mask=u.astype(bool)), pa.array(s)],
                                             ["query", "doc_id", "score"])

    return postings.mapInArrow(score, "query long, doc_id long, score long")


def search(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", doc_text: str = "text", item_id: str = "item_id",
           item_text: str = "text", k: int = K, block_queries: int = BLOCK_QUERIES) -> DataFrame:
    """item_id, rank (from 1), doc_id, score: the k documents of highest score above 0 for every item.

    Weights and length norms are the integer ones of the contract (README); equal scores
    go by ascending doc_id, null ids last. Whole texts count; null texts have no terms
    and no rank. Rows that share an id are documents (items) of their own. Items without
    terms, and an empty table on either side, give no rows. The items are a stated query
    set: their texts reach the driver and the graph goes to the tasks; of the documents
    only the number of terms per term asked for does.
    """
    asked = [(r["id"], Counter(terms(r["text"]))) for r in
             pick(items, id=item_id, text=item_text).selectExpr("cast(id as long) id", "cast(text as string) text")
             .orderBy("id", "text").collect()]
    spark = docs.sparkSession
    wanted = {t: i for i, t in enumerate(sorted({t for _, own in asked for t in own}))}
    rows = pick(docs, doc_id=doc_id, text=doc_text).selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text")
    postings = cut_lineage(_postings(rows, wanted))
    n_docs, n_terms = postings.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
    frequency = _doc_frequencies(postings, max(1, len(wanted))) if n_docs else {}
    weights = [weight(n_docs, frequency.get(i, 0)) for i in range(len(wanted))]
    found = spark.createDataFrame([], "query long, doc_id long, score long")
    for first in range(0, len(asked) if n_docs and wanted else 0, block_queries):
        own = [Counter({wanted[t]: c for t, c in counts.items()}) for _, counts in asked[first:first + block_queries]]
        if any(own):
            block = _scored(postings, SharingGraph(own), weights, n_docs, n_terms, k)
            found = found.unionByName(block.withColumn("query", F.col("query") + first))
    found = found.withColumn("_slice", F.pmod(F.xxhash64("doc_id"), F.lit(SLICES)))
    for keys in (("query", "_slice"), ("query",)):
        order = Window.partitionBy(*keys).orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
        found = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    names = spark.createDataFrame([(i, item) for i, (item, _) in enumerate(asked)], "query long, item_id long")
    return found.join(names, "query").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
