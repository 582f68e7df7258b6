"""Language, quality and language-model scores: held-out accuracy, brute force and awkward rows."""

import collections
import itertools
import math
import zlib

import numpy as np
from llm_rows import DOCS
from pyspark.sql import functions as F

from newsprism.llm import language_crf, lm_difference, quality_embed, queries

SF = "/root/testdata/sf0.01"


def test_forward_backward_is_the_sum_over_all_labellings():
    random = np.random.default_rng(5)
    lengths, labels = np.array([4, 3, 1]), 3
    emission = np.ones((4, labels, 3))
    for c, n in enumerate(lengths):
        emission[:n, :, c] = random.uniform(0.1, 2, (n, labels))
    transition = random.uniform(0.1, 2, (labels, labels))
    marginal, pairs = language_crf.forward_backward(emission, lengths, transition, pairs=True)
    total = np.zeros((labels, labels))
    for c, n in enumerate(lengths):
        want, weight, counts = np.zeros((n, labels)), 0.0, np.zeros((labels, labels))
        for path in itertools.product(range(labels), repeat=int(n)):
            w = math.prod(emission[t, y, c] for t, y in enumerate(path))
            w *= math.prod(transition[a, b] for a, b in zip(path, path[1:]))
            weight += w
            for t, y in enumerate(path):
                want[t, y] += w
            for a, b in zip(path, path[1:]):
                counts[a, b] += w
        assert np.allclose(marginal[:n, :, c], want / weight)
        total += counts / weight
    assert np.allclose(pairs, total)


def test_words_of_switched_text_get_their_own_label():
    en, fr = "the river and the town of stone".split(), "les maisons et le jardin des fleurs".split()
    model = language_crf.train([("en", en * 4), ("fr", fr * 4)] * 10)
    means = language_crf.Tagger(model).means(["the town and the river", "les fleurs et le jardin", "the town les fleurs", None, "12"])
    assert means[0].argmax() == 0 and means[1].argmax() == 1 and means[0].max() > 0.9
    assert 0.2 < means[2, 0] < 0.8 and not means[3].any() and not means[4].any()
    assert model.transitions[0, 0] > model.transitions[0, 1] and model.transitions[1, 1] > model.transitions[1, 0]


def test_language_of_held_out_documents(spark):
    langs = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").collect()}
    rows = queries.op3_language_crf(spark, SF).collect()
    assert len(rows) == len(langs) and all(0 <= r["score"] <= 1 for r in rows)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows)
    held = [r for r in rows if r["held_out"]]
    assert sum(r["lang_pred"] == langs[r["doc_id"]] for r in held) >= 0.99 * len(held)


def test_language_of_awkward_rows(awkward, empty):
    rows = language_crf.identify(awkward).collect()
    assert collections.Counter(r["doc_id"] for r in rows) == collections.Counter(i for i, *_ in DOCS)
    by_id = {r["doc_id"]: r for r in rows}
    for doc in (3, 4, 5, 12):
        assert (by_id[doc]["lang_pred"], by_id[doc]["score"]) == ("und", 0.0)
    assert by_id[None]["held_out"] is False and by_id[1]["lang_pred"] == "en"
    assert language_crf.identify(empty).count() == 0 and language_crf.keep_identified(empty).count() == 0
    unlabelled = awkward.withColumn("lang", F.lit(None).cast("string"))
    assert {(r["lang_pred"], r["score"]) for r in language_crf.identify(unlabelled).collect()} == {("und", 0.0)}


def test_only_documents_in_a_language_stay(awkward):
    kept = language_crf.keep_identified(awkward)
    assert kept.columns == awkward.columns and kept.dtypes == awkward.dtypes
    ids = {r[1] for r in kept.collect()}
    assert not ids & {3, 4, 5, 12} and {1, 2, 13} <= ids


def test_quality_of_held_out_documents(spark):
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    rows = queries.op5_quality_embed(spark, SF).collect()
    assert len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in rows)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    held = [r for r in rows if r["held_out"] and r["doc_id"] in labels]
    assert sum(r["predicted"] == labels[r["doc_id"]] for r in held) >= 0.97 * len(held)


def test_score_of_a_text_is_the_average_of_its_vectors():
    model = quality_embed.Model(np.random.default_rng(6).normal(size=quality_embed.BUCKETS), 0.25)
    text = "The the the river | river %% über"
    tokens = text.split()
    known: dict[str, np.ndarray] = {}
    logit = model.logits[quality_embed._bag(tokens, known)].mean() + 0.25
    assert math.isclose(quality_embed.Scorer(model).score(text), 1 / (1 + math.exp(-logit)), rel_tol=1e-9)
    assert quality_embed.Scorer(model).score(None) == quality_embed.Scorer(model).score("") == 1 / (1 + math.exp(-0.25))


def test_quality_of_awkward_rows(spark, awkward, empty):
    labels = spark.createDataFrame([(1, 1, 0), (6, 0, 0), (6, 1, 0), (8, 0, 0), (8, 0, 0), (None, 1, 0), (7, None, 0)],
                                   "doc_id long, quality int, text int")
    rows = quality_embed.classify(awkward, labels).collect()
    assert collections.Counter(r["doc_id"] for r in rows) == collections.Counter(i for i, *_ in DOCS)
    assert all(0 <= r["score"] <= 1 for r in rows)
    assert quality_embed.classify(empty, labels).count() == 0
    assert {r["score"] for r in quality_embed.classify(awkward, labels.limit(0)).collect()} == {0.5}


def brute_losses(docs, target, vocabulary):
    counted = collections.Counter(w for _, t in docs for w in (t or "").lower().split())
    top = sorted((w for w in counted if len(w) <= lm_difference.LONGEST_WORD), key=lambda w: (-counted[w], w))[:vocabulary - 1]
    number = {w: i for i, w in enumerate(top, 1)}
    ids = [(doc, [number.get(w, 0) for w in (t or "").lower().split()]) for doc, t in docs]
    bucket = lambda a, b: int(lm_difference._buckets(np.array([a]), np.array([b]))[0])
    out = []
    models = []
    for chosen in ([i for d, i in ids if d in target], [i for _, i in ids]):
        single = collections.Counter(x for i in chosen for x in i)
        pair = collections.Counter(bucket(a, b) for i in chosen for a, b in zip(i, i[1:]))
        models.append((single, pair, sum(single.values())))
    for doc, i in ids:
        row = [doc, len(i)]
        for single, pair, total in models:
            p1 = lambda w: (single[w] + 1) / (total + len(number) + 1)  # noqa: E731,B023
            loss = [-math.log(p1(w)) if t == 0 else -math.log(
                (pair[bucket(i[t - 1], w)] + lm_difference.MIX * p1(w)) / (single[i[t - 1]] + lm_difference.MIX))
                for t, w in enumerate(i)]
            row.append(sum(loss) / len(loss) if loss else 0.0)
        out.append(tuple(row))
    return out


def same_losses(got, want):
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    got, want = sorted(got, key=key), sorted(want, key=key)
    assert len(got) == len(want)
    for a, b in zip(got, want):
        assert a[:2] == b[:2] and np.allclose(a[2:4], b[2:]) and math.isclose(a[4], b[2] - b[3], abs_tol=1e-9)


def test_loss_difference_as_counted_by_hand(spark, awkward, empty):
    small = "/root/testdata/sf0.001"
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    target = {r["doc_id"] for r in spark.read.parquet(f"{small}/labels.parquet").collect() if r["quality"] == 1}
    same_losses([tuple(r) for r in queries.op9_lm_difference(spark, small).collect()],
                brute_losses(docs, target, lm_difference.VOCABULARY))
    ids = spark.createDataFrame([(1,), (9,), (9,), (None,), (999,)], "id long")
    same_losses([tuple(r) for r in lm_difference.score(awkward, ids, vocabulary=50).collect()],
                brute_losses([(i, t) for i, t, *_ in DOCS], {1, 9}, 50))
    assert lm_difference.score(empty, ids).count() == 0
    assert lm_difference.score(awkward, ids.limit(0)).count() == len(DOCS)
