"""Ranked search over shared accumulators against brute force."""

import collections
import math
import random
import re

import numpy as np
import pytest
from llm_rows import DOCS

from newsprism.llm import queries, shared_queries

SF = "/root/testdata/sf0.001"


def brute_terms(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall("[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lowered)


def brute_search(docs, items, k=20):
    """docs, items: (id, text); rows (item, rank, doc, score)."""
    own = [(i, collections.Counter(brute_terms(t))) for i, t in docs]
    n_docs, n_terms = sum(bool(c) for _, c in own), sum(c.total() for _, c in own)
    df = collections.Counter(t for _, c in own for t in c)
    out = []
    for item, text in items:
        scores = []
        for doc, counts in own:
            score = 0
            for t, times in collections.Counter(brute_terms(text)).items():
                if counts[t]:
                    w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                    m = 100 - 25 + 25 * counts.total() * n_docs // n_terms
                    score += times * w * (1_000_000_000 * counts[t] // (1000 * counts[t] + 12 * m))
            if score > 0:
                scores.append((-score, doc is None, doc or 0))
        out += [(item, rank, None if none else doc, -s) for rank, (s, none, doc) in enumerate(sorted(scores)[:k], 1)]
    return collections.Counter(out)


def got(df):
    return collections.Counter((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in df.collect())


def items_of(spark, rows):
    return spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "item_id long, text string, rank int, Text string")


def test_terms_are_the_runs_of_the_class():
    text = "".join(map(chr, range(0x250))) + "Ünï A_b-c9\u2028d\u00a0e\x85f 🎉 X"
    assert [t.decode() for t in shared_queries.terms(text)] == brute_terms(text)
    assert shared_queries.terms(None) == [] and shared_queries.terms("") == []


def test_whole_table(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert got(queries.op12_shared_queries(spark, SF)) == brute_search(docs, items)


@pytest.mark.parametrize("block", [2, 2048])
def test_awkward_rows_and_ties(spark, awkward, empty, block, monkeypatch):
    items = [(1, "the river and the people"), (2, "River PEOPLE the the the"), (3, None), (4, " ?! "), (5, "lost id"),
             (None, "bread"), (1, "un deux"), (6, "w1x1 " * 300 + " w2x2 nowhere"), (6, "w1x1 " * 300 + " w2x2 nowhere"), (7, "中文 🎉 für")]
    docs = [(i, t) for i, t, *_ in DOCS]
    monkeypatch.setattr(shared_queries, "WAITING", 3)
    for k in (1, 3, 20):
        assert got(shared_queries.search(awkward, items_of(spark, items), k=k, block_queries=block)) == brute_search(docs, items, k)
    assert shared_queries.search(empty, items_of(spark, items)).count() == 0
    assert shared_queries.search(awkward, items_of(spark, [])).count() == 0
    assert shared_queries.search(awkward, items_of(spark, [(1, None)])).count() == 0
    nothing = spark.createDataFrame([(1, None), (2, "?")], "doc_id long, text string")
    assert shared_queries.search(nothing, items_of(spark, items)).count() == 0


def test_many_ties_over_many_tasks(spark):
    rows = [(i, "same words here" if i % 3 else "other words") for i in range(3000)] + [(None, "same words here")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(17)
    items = [(1, "same"), (2, "other words"), (3, "here words same")]
    assert got(shared_queries.search(docs, items_of(spark, items))) == brute_search(rows, items)


def test_the_graph_shares_and_sums_right(monkeypatch):
    draw = random.Random(3)
    common = [draw.sample(range(60), 8) for _ in range(6)]
    own = [collections.Counter(draw.choices(range(60), k=12) + draw.choice(common) + draw.choice(common)) for _ in range(50)]
    own += [collections.Counter(), collections.Counter({3: 1}), own[0]]
    parts = np.array([[draw.randrange(10 ** 9) for _ in range(7)] for _ in range(60)])
    plain = sum(map(len, own))
    for mined in (256, 3):
        monkeypatch.setattr(shared_queries, "MINED_NODES", mined)
        graph = shared_queries.SharingGraph(own)
        evaluator = shared_queries.Evaluator(graph, np.arange(60))
        want = np.array([sum((c * parts[t] for t, c in own[q].items())) for q in evaluator.filled])
        assert (evaluator.scores(parts) == want).all()
        assert len(evaluator.filled) == len(own) - 1
        assert graph.additions() < plain
    assert len(graph.levels) > 0
