"""The corpus pipeline, stage by stage, against brute force over the same rows."""

import collections

import public_tokenizers as P
from llm_rows import DOCS
from test_search_and_dedup import brute_components, brute_fingerprint
from test_text_operators import base_spans, check_packing, measured
from tokenizers import Tokenizer

import corpus_pipeline
from newsprism.llm import language_crf, secret_scan

SF = "/root/testdata/sf0.001"


def redacted(text):
    spans = sorted(tuple(map(int, s.split(":")[1:])) for s in base_spans(text).split(",") if s)
    out, at = "", 0
    for start, end in spans:
        if end > at:
            out += text[at:start] + secret_scan.REPLACEMENT if start >= at else ""
            at = end
    return out + text[at:]


def test_every_stage_does_its_whole_job(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert [name for name in stages] == ["quality_rules", "language_id", "simhash_near_dedup", "secret_scans", "packing"]
    kept, at = {}, docs
    for name in list(stages)[:-1]:
        at = stages[name](spark, at, SF)
        assert at.columns == docs.columns and at.dtypes == docs.dtypes
        kept[name] = {r["doc_id"]: r for r in at.collect()}
        at = spark.createDataFrame(list(kept[name].values()), docs.schema)
    start = {r["doc_id"]: r for r in docs.collect()}
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    good = kept["quality_rules"]
    assert not any(measured(r["text"])[-1] for r in good.values())
    assert all(i in good for i, r in start.items() if labels.get(i) == 1 and not measured(r["text"])[-1])
    assert not any(labels.get(i) == 0 for i in good)

    assert kept["language_id"].keys() == good.keys()  # all of these are in one of the languages
    rows = [(i, brute_fingerprint(r["text"])) for i, r in kept["language_id"].items()]
    assert kept["simhash_near_dedup"].keys() == set(brute_components(rows))
    assert {i: r["text"] for i, r in kept["secret_scans"].items()} == {
        i: redacted(r["text"]) for i, r in kept["simhash_near_dedup"].items()}
    assert all(r["n_chars"] == len(r["text"]) for r in kept["secret_scans"].values() if secret_scan.REPLACEMENT in r["text"])

    tokenizer = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    whole = corpus_pipeline.run(spark, SF).collect()
    assert check_packing(whole, [(i, r["text"]) for i, r in kept["secret_scans"].items()], tokenizer) == 0


def test_stages_take_awkward_and_empty_tables(spark, awkward, empty):
    for table in (awkward, empty):
        at = table
        for name, stage in corpus_pipeline.STAGES:
            at = stage(spark, at, SF)
            if name != "packing":
                assert at.columns == table.columns and at.dtypes == table.dtypes
        got = collections.Counter(r["doc_id"] for r in at.collect())
        assert not got.keys() - {i for i, *_ in DOCS}


def test_the_language_stage_rejects_what_has_no_letters(awkward):
    ids = {r[1] for r in language_crf.keep_identified(awkward).collect()}
    assert all(i in ids or not any(map(str.isalpha, t or "")) for i, t, *_ in DOCS)
