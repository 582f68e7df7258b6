"""The language models against counts of every word and bigram, kept as text."""

import collections
import math

import numpy as np
from llm_rows import table

from newsprism.llm import lm_difference


def exact_losses(docs, target):
    texts = [(i, (t or "").lower().split()) for i, t in docs]
    distinct = len({w for _, t in texts for w in t})
    out = {i: [len(t)] for i, t in texts}
    for chosen in ([t for i, t in texts if i in target], [t for _, t in texts]):
        single = collections.Counter(w for t in chosen for w in t)
        pair = collections.Counter(p for t in chosen for p in zip(t, t[1:]))
        p1 = lambda w: (single[w] + 1) / (single.total() + distinct + 1)  # noqa: E731,B023
        for i, t in texts:
            loss = [-math.log(p1(w)) for w in t[:1]] + [
                -math.log((pair[c, w] + lm_difference.MIX * p1(w)) / (single[c] + lm_difference.MIX)) for c, w in zip(t, t[1:])]
            out[i].append(sum(loss) / len(loss) if loss else 0.0)
    return out


def test_every_word_and_bigram_counts(spark, awkward, monkeypatch):
    draw = np.random.default_rng(5)
    texts = [" ".join(f"r{n}" for n in draw.integers(0, 40_000, 25_000)) for _ in range(4)]  # more words than 32768
    texts += ["the of " * 300 + "a " * 200 + " ".join(f"the w{i % 9} of" for i in range(400)) for _ in range(3)]
    texts += [f"{'x' * 64}{end} the {'x' * 64}{end} of r7" for end in "ababc"] + [None, "", "alone", "lower LOWER"]
    docs = [(i, t) for i, t in enumerate(texts)]
    target = {0, 4, 7, 8, 14}
    want = exact_losses(docs, target)
    rows = table(spark, [(i, t, "en", "a", 1) for i, t in docs]).repartition(3)
    ids = spark.createDataFrame([(i,) for i in target], "id long")
    for hot, paired, bucket, held in ((lm_difference.HOT, lm_difference.PAIRED, 1 << 21, 1 << 20), (12, 3, 9000, 20_000), (12, 3, 2000, 10)):
        monkeypatch.setattr(lm_difference, "BUCKET_TOKENS", bucket)
        monkeypatch.setattr(lm_difference, "HELD_TOKENS", held)
        monkeypatch.setattr(lm_difference, "HOT", hot)
        monkeypatch.setattr(lm_difference, "PAIRED", paired)
        got = {r["doc_id"]: r for r in lm_difference.score(rows, ids).collect()}
        assert got.keys() == want.keys()
        for i, (n, *losses) in want.items():
            assert got[i]["n_tokens"] == n and np.allclose([got[i]["target_loss"], got[i]["background_loss"]], losses, rtol=1e-9)


def test_a_hot_bigram_fills_no_bucket(spark, monkeypatch):
    """Two words outside the paired ones follow each other in a third of the text; their bigram is counted apart."""
    monkeypatch.setattr(lm_difference, "BUCKET_TOKENS", 800)
    monkeypatch.setattr(lm_difference, "PAIRED", 2)
    texts = [" ".join(f"r{(7 * d + i) % 50} licence text" for i in range(40)) for d in range(30)] + ["text licence", "licence", "", None]
    docs = list(enumerate(texts))
    want = exact_losses(docs, {1, 2, 30})
    rows = table(spark, [(i, t, "en", "a", 1) for i, t in docs]).repartition(5)
    ids = spark.createDataFrame([(i,) for i in (1, 2, 30)], "id long")
    for held in (1 << 20, 50, 1):
        monkeypatch.setattr(lm_difference, "HELD_TOKENS", held)
        got = {r["doc_id"]: r for r in lm_difference.score(rows, ids).collect()}
        for i, (n, *losses) in want.items():
            assert got[i]["n_tokens"] == n and np.allclose([got[i]["target_loss"], got[i]["background_loss"]], losses, rtol=1e-9)
    numbering, tokens = lm_difference.learn_numbering(lm_difference._texts(rows, "text"))
    coded = lm_difference.numbered(rows, numbering, ids, "doc_id", "text")
    model = lm_difference.fit(coded, numbering, tokens)
    pair = np.array([[numbering.hot[w]] for w in ("licence", "text")], dtype=np.uint64)
    assert model.pairs[1][model.places(*pair)[0]] == 30 * 40
    text = np.array([numbering.hot[w] for w in texts[0].split()], dtype=np.uint64)
    block = lm_difference._blocks([(0, False, text)], 0, np.array([0], dtype=np.int32), model)
    word, before, _ = lm_difference._unpack(block.column("block")[0].as_py(), 3)
    assert not ((before == pair[0]) & (word == pair[1])).any()
    # the bound holds: no bigram left to the buckets reaches the least count, and the keys are few
    left = collections.Counter(p for t in texts for p in zip((t or "").split(), (t or "").split()[1:]))
    least = max(tokens / lm_difference.FREQUENT, lm_difference.BUCKET_TOKENS / 8)
    for (a, b), n in left.items():
        at = model.places(*np.array([[numbering.hot[a]], [numbering.hot[b]]], dtype=np.uint64))[0]
        assert at >= 0 or n < least
    assert len(model.frequent) <= 2 * tokens / least


def test_a_clash_of_numbers_is_found(spark, awkward):
    assert lm_difference._clash(spark.createDataFrame([("a",), ("b",), ("a",)], "word string"), 0)
    assert not lm_difference._clash(spark.createDataFrame([("a",), ("b",), ("ab",)], "word string"), 0)


def test_rows_without_an_id_are_spread_and_scored(spark):
    docs = [(None, f"no name {i % 3}") for i in range(60)] + [(0, "named text"), (1, "no name 1"), (1, "other text")]
    rows = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    got = lm_difference.score(rows, spark.createDataFrame([(1,), (None,)], "id long")).collect()
    assert len(got) == len(docs) and sum(r["doc_id"] is None for r in got) == 60
    named = {i: t for i, t in enumerate(t for _, t in docs)}
    want = exact_losses(list(named.items()), {61, 62})
    by_doc = {(docs[i][0], round(x, 9), round(y, 9)) for i, (_, x, y) in want.items()}
    assert {(r["doc_id"], round(r["target_loss"], 9), round(r["background_loss"], 9)) for r in got} == by_doc
