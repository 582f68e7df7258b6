"""Top-k search and SimHash near-duplicates against brute force."""

import collections
import math

import numpy as np
import pytest
import xxhash
from llm_rows import DOCS
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsprism.llm import components, queries, simhash_dedup, topk_threshold

SF = "/root/testdata/sf0.001"


def brute_top_k(rows, k):
    """rows: (id, list of integers); every row whose id is divisible by 50 asks all other rows."""
    out = collections.Counter()
    for at, (q, vector) in enumerate(rows):
        if q % 50 == 0:
            scores = sorted((-sum(a * b for a, b in zip(vector, v)), i) for n, (i, v) in enumerate(rows)
                            if n != at and len(v) == len(vector))[:k]
            out.update((q, rank, i, -s) for rank, (s, i) in enumerate(scores, 1))
    return out


def got_top_k(df):
    return collections.Counter(tuple(r) for r in df.select("query_id", "rank", "vec_id", "score").collect())


def whole(vector):
    return [math.floor(256 * x) for x in vector]


def test_top_k_of_the_table(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    vectors = [(r["vec_id"], whole(r["embedding"])) for r in rows]
    assert got_top_k(queries.op1_topk_threshold(spark, SF)) == brute_top_k(vectors, 5)


SCHEMA = T.StructType([T.StructField("score", T.StringType()), T.StructField("vec_id", T.LongType()),
                       T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("rank", T.IntegerType())])


@pytest.mark.parametrize("block_rows,block_queries", [(4096, 2048), (7, 3)])
def test_top_k_with_ties_and_bad_rows(spark, block_rows, block_queries):
    random = np.random.default_rng(1)
    good = {i: [float(np.float32(x)) for x in random.integers(-3, 4, 4) / 4] for i in range(60)}
    good[50], good[100] = [0.0] * 4, good[3]
    good[101], good[150] = [1.0, 2.0], [2.0, -1.0]
    rows = [("s", i, v, 1) for i, v in good.items()]
    rows += [("s", 3, good[3], 1), ("s", 0, good[0], 2), ("s", 0, good[0], 3)]  # copies
    rows += [("s", 50, good[7], 1), ("s", 2, [1.0] * 4, 1), ("s", 2, [1.0] * 4, 2), ("s", 2, [1.0, 2.0], 1),  # one id, other vectors
             ("s", 200, [0.75] * 4, 1), ("s", 200, [0.75, 0.5, 0.75, 0.75], 1)]
    taking_part = [(r[1], whole(r[2])) for r in rows]
    rows += [("s", 200, None, 1), ("s", 250, [1.0, None, 0.0, 0.0], 1), ("s", 300, [float("nan"), 0.0, 0.0, 0.0], 1),
             ("s", 350, [float("inf"), 0.0, 0.0, 0.0], 1), ("s", 400, [], 1), ("s", None, [1.0, 1.0, 1.0, 1.0], 1)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = got_top_k(topk_threshold.top_k(df, F.col("id") % 50 == 0, block_rows=block_rows, block_queries=block_queries))
    assert got == brute_top_k(taking_part, 5)


def test_the_walk_stops_early_and_right():
    random = np.random.default_rng(2)
    rows = np.zeros((4000, 8), dtype=np.int64)
    rows[:, 0] = random.permutation(4000)
    lists = topk_threshold.Lists(np.arange(4000), rows, np.ones(4000, dtype=np.int64))
    read = []
    lists.order = type("Counted", (), {"__getitem__": lambda self, at, o=lists.order: read.append(o[at].size) or o[at]})()
    ids, scores = lists.best(-1, np.array([3, 0, 0, 0, 0, 0, 0, 0]), 5)
    assert scores.tolist() == [3 * x for x in (3999, 3998, 3997, 3996, 3995)] and sum(read) < 100


def test_large_components_stay_exact():
    rows = np.array([[2 ** 30, 1], [2 ** 30, 0], [0, 5]], dtype=np.int64)
    ids, scores = topk_threshold.Lists(np.array([7, 8, 9]), rows, np.ones(3, dtype=np.int64)).best(1, np.array([2 ** 30, 1]), 2)
    assert ids.tolist() == [7, 8] and scores.tolist() == [2 ** 60 + 1, 2 ** 60]
    with pytest.raises(OverflowError):
        topk_threshold.Lists(np.array([7]), rows[:1] * 4, np.ones(1, dtype=np.int64)).best(1, np.array([2 ** 31, 1]), 2)


def test_top_k_of_nothing(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert topk_threshold.top_k(df, F.col("id") % 50 == 0).count() == 0
    one = spark.createDataFrame([("s", 1, [1.0], 1)], SCHEMA)
    assert topk_threshold.top_k(one, F.col("id") % 50 == 0).count() == 0


def brute_fingerprint(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(rows):
    """rows: (id or None, fingerprint) -> component id of each row."""
    n, parent = len(rows), list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for i in range(n):
        for j in range(i):
            if bin(rows[i][1] ^ rows[j][1]).count("1") <= 3:
                parent[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[find(i)] = min(least.get(find(i), doc), doc)
    return [least.get(find(i)) for i in range(n)]


def expected(docs):
    prints = [(i, brute_fingerprint(t)) for i, t in docs]
    return collections.Counter((i, f"{p:016x}", c) for (i, p), c in zip(prints, brute_components(prints)))


def test_simhash_of_the_table(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert collections.Counter(map(tuple, queries.op10_simhash_dedup(spark, SF).collect())) == expected(docs)


def test_simhash_of_awkward_rows(awkward, empty):
    rows = simhash_dedup.near_duplicates(awkward).select(
        "doc_id", simhash_dedup.hex_fingerprint(F.col("fp")), "component_id").collect()
    assert collections.Counter(map(tuple, rows)) == expected([(i, t) for i, t, *_ in DOCS])
    assert simhash_dedup.near_duplicates(empty).count() == 0


@pytest.mark.parametrize("block", [1024, 5])
def test_links_connect_all_within_range(spark, block):
    random = np.random.default_rng(3)
    values = {int(x) for x in random.integers(-2 ** 63, 2 ** 63 - 1, 150)}
    for x in list(values)[:40]:  # chains and balls of near fingerprints
        for _ in range(6):
            for b in random.choice(64, random.integers(1, 5), replace=False):
                x ^= -(1 << 63) if b == 63 else 1 << int(b)
            values.add(x)
    values = sorted(values)
    tree = components.stars(simhash_dedup.links(spark.createDataFrame([(v,) for v in values], "fp long"), block=block))
    root = {r["member"]: r["root"] for r in tree.collect()}
    mask = (1 << 64) - 1
    want = brute_components([(v, v & mask) for v in values])
    assert [root.get(v, v) for v in values] == want


def test_the_bound_never_exceeds_the_distance():
    random = np.random.default_rng(4)
    a, b = random.integers(0, 2 ** 63, (2, 5000), dtype=np.uint64)
    bound = np.bitwise_count(simhash_dedup._embedding(a) ^ simhash_dedup._embedding(b))
    assert (bound <= np.bitwise_count(a ^ b)).all()
    counts = lambda x: [bin(x >> s & 3).count("1") for s in range(0, 64, 2)]
    assert bound[:50].tolist() == [sum(abs(p - q) for p, q in zip(counts(int(x)), counts(int(y)))) for x, y in zip(a[:50], b[:50])]


def test_column_and_array_embeddings_agree(spark):
    values = [0, -1, 1, 2 ** 63 - 1, -2 ** 63, 0x123456789ABCDEF]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in values], "fp long").select(
        simhash_dedup.embedding(F.col("fp"))).collect()]
    assert got == simhash_dedup._embedding(np.array(values, dtype=np.int64).view(np.uint64)).view(np.int64).tolist()


def test_stars_of_chains_and_loops(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100), (101, 102), (102, 101), (200, 150)]
    found = {r["member"]: r["root"] for r in components.stars(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {i: 0 for i in range(1, 41)} | {102: 101, 200: 150}
    assert components.stars(spark.createDataFrame([], "a long, b long")).count() == 0


def test_one_representative_stays(awkward):
    kept = simhash_dedup.keep_representatives(awkward)
    assert kept.columns == awkward.columns and kept.dtypes == awkward.dtypes
    got = sorted((r[1] is None, r[1] or 0) for r in kept.collect())
    prints = [(i, brute_fingerprint(t)) for i, t, *_ in DOCS]
    component = brute_components(prints)
    want = sorted({(c is None, c or 0) for c in component})
    assert got == want
