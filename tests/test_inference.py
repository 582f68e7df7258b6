"""Pooling and pluggable inference."""

import math
import random
import zlib

import numpy as np

from newsprism.functions import text as tx
from newsprism.functions import vectors as vx
from newsprism.operators import embed
from newsprism.operators import inference as inf


def test_mean_pool_with_zero_mask(spark):
    df = spark.createDataFrame([([[1.0, 2.0], [3.0, 4.0]], [1, 0]), ([[1.0, 1.0]], [0])],
                               "hidden array<array<double>>, mask array<int>")
    got = [r[0] for r in df.select(vx.mean_pool("hidden", "mask")).collect()]
    assert got[0] == [1.0, 2.0]
    assert got[1] == [0.0, 0.0]


def test_softmax_and_smoothed_ce(spark):
    import math
    df = spark.createDataFrame([([1.0, 3.0], 1)], "logits array<double>, label int")
    r = df.select(vx.softmax("logits").alias("p"), vx.argmax("logits").alias("k"),
                  vx.smoothed_cross_entropy("logits", "label", 0.05).alias("ce")).first()
    p1 = math.exp(3) / (math.exp(1) + math.exp(3))
    assert abs(r["p"][1] - p1) < 1e-12 and r["k"] == 1
    assert abs(r["ce"] - -(0.975 * math.log(p1) + 0.025 * math.log(1 - p1))) < 1e-12


def hashing_encoder_factory(dim):
    """A stand-in encoder: L2-normalised hashed token counts."""
    def make():
        def encode(texts):
            out = np.zeros((len(texts), dim), dtype=np.float32)
            for i, t in enumerate(texts):
                for token in str(t).lower().split():
                    out[i, zlib.crc32(token.encode()) % dim] += 1.0
            return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)
        return encode
    return make


def test_batch_encode(spark):
    df = spark.createDataFrame([(1, "a b c"), (2, "")], "row_id long, content string")
    out = inf.batch_encode(df, hashing_encoder_factory(8), batch_size=1).orderBy("row_id").collect()
    assert len(out[0]["embedding"]) == 8 and abs(sum(x * x for x in out[0]["embedding"]) - 1) < 1e-5


def planted(n=300):
    draw = random.Random(1)
    filler = [f"w{i}" for i in range(40)]
    rows = []
    for i in range(n):
        words = draw.choices(filler, k=30)
        for pair in (("king", "queen"), ("bread", "butter")):
            if draw.random() < 0.5:
                at = draw.randrange(len(words))
                words[at:at] = pair
        rows.append((i, " ".join(words)))
    return rows + [(n, None), (n + 1, ""), (n + 2, "unknownword")]


def test_word_vectors_find_planted_neighbours(spark):
    df = spark.createDataFrame(planted(), "row_id long, content string").repartition(4)
    found = embed.learn_word_vectors(df, dim=16, window=2)
    assert found.vectors.shape == (44, 16)
    assert found.nearest("king", 1) == ["queen"] and found.nearest("butter", 1) == ["bread"]
    out = {r["row_id"]: r["embedding"] for r in inf.batch_encode(df, found.encoder(), max_tokens=5).collect()}
    for i, text in planted():
        tokens = [t for t in (text or "").split()[:5] if t in found.words]
        want = np.mean([found.vectors[found.words.index(t)] for t in tokens], axis=0) if tokens else np.zeros(16)
        assert np.allclose(out[i], want, atol=1e-5)
    assert embed.learn_word_vectors(df.limit(0), dim=4).vectors.shape == (0, 4)


def test_pairs_weights_and_factors_against_numpy(spark, monkeypatch):
    monkeypatch.setattr(embed, "HELD_PAIRS", 50)
    rows = planted(60)
    df = spark.createDataFrame(rows, "row_id long, content string").repartition(3)
    words = sorted({w for _, t in rows for w in (t or "").split()} - {"w3"})
    at = {w: i for i, w in enumerate(words)}
    want = np.zeros((len(words), len(words)))
    for _, text in rows:
        tokens = (text or "").split()
        for i, a in enumerate(tokens):
            for b in tokens[i + 1:i + 4]:
                if a in at and b in at:
                    want[at[a], at[b]] += 1
                    want[at[b], at[a]] += 1
    pairs = embed.pair_counts(df, "content", words, 3).cache()
    for r in pairs.collect():
        assert r["i"] <= r["j"] and r["n"] * (2 if r["i"] == r["j"] else 1) == want[r["i"], r["j"]]
    assert pairs.count() == (np.triu(want) > 0).sum()
    total = want.sum(axis=1)
    with np.errstate(divide="ignore", invalid="ignore"):
        pmi = np.log(want * want.sum() / np.outer(total, total))
    pmi = np.where(pmi > 0, pmi, 0.0)
    matrix = embed.positive_pmi(pairs).cache()
    got = np.zeros_like(pmi)
    for r in matrix.collect():
        got[r["i"], r["j"]] = got[r["j"], r["i"]] = r["v"]
    assert np.allclose(got, pmi)
    block = np.random.default_rng(0).random((len(words), 3))
    assert np.allclose(embed.block_product(matrix, block), pmi @ block)
    values, vectors = embed.factorise(matrix, len(words), 6, oversample=20, rounds=6)
    exact = np.linalg.eigvalsh(pmi)
    exact = exact[np.argsort(-np.abs(exact))][:6]
    assert np.allclose(values, exact, rtol=1e-3)
    assert np.allclose(pmi @ vectors, vectors * values, atol=0.05 * abs(exact[0]))


def test_greedy_generation_keeps_its_budgets(spark):
    assert inf.greedy(lambda out: {"a": 1.0, "b": 1.0, inf.END: 0.0}, 5) == ["a"] * 5
    assert inf.greedy(lambda out: {inf.END: 1.0} if len(out) == 2 else {"x": 0.0}) == ["x", "x"]
    model = {"prior": {"FAKE": -1.0, "REAL": -1.5}, "tokens": {"good": (-9.0, -1.0), "bad": (-1.0, -9.0)}}
    generate = inf.class_generator_factory(model)()

    def ask(article):
        return generate([{"role": "system", "content": tx.SYSTEM_PROMPT}, {"role": "user", "content": tx.USER_PROMPT_PREFIX + article}])
    assert ask("") == "FAKE" and ask("so Good it is") == "REAL" and ask("bad good bad") == "FAKE"
    head, article = inf.prompt_tokens([{"content": tx.SYSTEM_PROMPT}, {"content": tx.USER_PROMPT_PREFIX + "word " * 5000}])
    assert len(head) + len(article) == 2048 and head[:2] == ["you", "are"]
    assert ask("none " * (2048 - len(head)) + "good " * 100) == "FAKE"  # beyond the budget
    assert ask("none " * (2047 - len(head)) + "good " * 100) == "REAL"


def test_class_models_are_smoothed_counts(spark):
    rows = spark.createDataFrame([(0, [("a", 3), ("b", 1)]), (1, [("a", 1), ("z", 5)]), (1, [("a", 2)])],
                                 "label int, terms array<struct<term: string, tf: long>>")
    model = inf.class_language_models(rows, spark.createDataFrame([("a",), ("b",)], "term string"), {0: "FAKE", 1: "REAL"})
    assert model["prior"] == {"FAKE": math.log(2 / 5), "REAL": math.log(3 / 5)}
    assert model["tokens"] == {"a": (math.log(4 / 6), math.log(4 / 5)), "b": (math.log(2 / 6), math.log(1 / 5))}


def test_zero_shot_errors_are_rows(spark):
    def make():
        def generate(messages):
            if "boom" in messages[-1]["content"]:
                raise ValueError("boom")
            return " real "
        return generate
    df = spark.createDataFrame([(1, "ok text", 1), (2, "boom", 0)], "row_id long, content string, label int")
    out = {r["row_id"]: r for r in inf.batch_zero_shot(df, make).collect()}
    assert out[1]["prediction"] == 1 and out[1]["correct"] is True
    assert out[2]["prediction"] is None and out[2]["error"] == "boom" and out[2]["correct"] is False
    assert out[2]["latency_seconds"] is None


def test_mean_pool_of_no_tokens(spark):
    df = spark.createDataFrame([([], [])], "hidden array<array<double>>, mask array<int>")
    assert df.select(vx.mean_pool("hidden", "mask")).first()[0] == []
