"""The language stage on documents that the quality rules keep: it rejects what is in no language."""

import numpy as np
from test_text_operators import measured

import corpus_pipeline

SF = "/root/testdata/sf0.01"


def test_planted_documents_without_a_language_go(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    clean = corpus_pipeline.keep_good(spark, docs, SF).select("text", "lang").collect()
    draw = np.random.default_rng(11)
    junk = lambda: "".join(draw.choice(list("bcdfghjkqwvxz"), draw.integers(3, 9)))
    stop = ["the", "of", "and"]
    letters = [" ".join(stop[i % 3] if i % 12 == 0 else junk() for i in range(200)) + "." for _ in range(3)]
    cyrillic = lambda: "".join(map(chr, draw.integers(0x430, 0x450, draw.integers(3, 9))))
    foreign = [" ".join(stop[i % 3] if i % 15 == 0 else cyrillic() for i in range(150)) + "." for _ in range(3)]
    by_lang = {}
    for r in clean:
        by_lang.setdefault(r["lang"], []).extend(r["text"].split())
    mixed = [" ".join(by_lang[lang][500 * n + i] for i in range(60) for lang in sorted(by_lang)) + "." for n in range(3)]
    planted = {1_000_000 + i: t for i, t in enumerate(letters + foreign + mixed)}
    assert len(by_lang) == 4 and not any(measured(t)[-1] for t in planted.values())

    rows = [(i, t, None, "planted", len(t)) for i, t in planted.items()]
    every = docs.unionByName(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"))
    good = corpus_pipeline.keep_good(spark, every, SF)
    before = {r["doc_id"] for r in good.select("doc_id").collect()}
    kept = {r["doc_id"] for r in corpus_pipeline.keep_identified(spark, good, SF).select("doc_id").collect()}
    assert planted.keys() <= before
    assert before - kept == planted.keys()
